"""Ranked full-text retrieval: prefix queries, BM25, boosts and two-stage top k.

Statistics are sums over all rows, made in one aggregation that yields a single
row; it is joined back as a broadcast of that row.  Ranking is a
``TakeOrderedAndProject``: no row is shuffled but the best of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import budget
from ..functions import text as T
from ..plans.lineage import cut

K1, B = 1.2, 0.75


def _scored(rows: DataFrame, terms: list[str], keys: list[str], every: bool = False) -> DataFrame:
    """(keys, bm25) of the rows with a ``tokens`` array that match any term, or every one.

    Texts are tokenised once: what is kept of a row are its keys, counts and size, a small table that is
    written and read for the statistics and the scores.
    """
    hit = [f"__tf{k}" for k in range(len(terms))]
    rows = rows.select(*keys, *(T.prefix_hits(F.col("tokens"), t).alias(h) for t, h in zip(terms, hit, strict=True)), F.size("tokens").cast("double").alias("__size"))
    rows = cut(rows)
    stats = rows.agg(F.count("*").cast("double").alias("__n"), F.avg("__size").alias("__avg"), *(F.sum((F.col(h) > 0).cast("double")).alias(f"{h}n") for h in hit))
    condition = None
    for h in hit:
        own = F.col(h) > 0
        condition = own if condition is None else condition & own if every else condition | own
    return _with_bm25(rows.where(condition), stats, len(terms)).select(*keys, "bm25")


def _with_bm25(rows: DataFrame, stats: DataFrame, n_terms: int) -> DataFrame:
    """Rows (__tf0 ..., __size) with their bm25; ``stats`` is the one row (__n, __avg, __tf0n ...)."""
    score = F.lit(0.0)
    for k in range(n_terms):
        own, n = F.col(f"__tf{k}"), F.col(f"__tf{k}n")
        idf = F.log((F.col("__n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score + idf * own * (K1 + 1) / (own + K1 * (1 - B + B * F.col("__size") / F.col("__avg")))
    return rows.crossJoin(F.broadcast(stats)).withColumn("bm25", score)


def content_search(chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(path, title, text, start_line, end_line, score) of the best chunks: 4 * limit by bm25, re-ranked with 4 for each query term in the path and 2 for each in the title."""
    budget.text(query, "content query")
    budget.limit(limit)
    terms = [w.lower() for w in T.split_words(query)]
    rows = chunks.withColumn("tokens", _chunk_tokens())
    if not terms:
        return rows.limit(0).select("path", "title", "text", "start_line", "end_line", F.lit(0.0).alias("score"))
    best = _scored(rows, terms, ["path", "ordinal"]).orderBy(F.desc("bm25"), "path", "ordinal").limit(4 * limit)
    return _boosted(chunks.join(F.broadcast(best), ["path", "ordinal"]), terms, limit)  # at most 4 * limit rows


def _boosted(best: DataFrame, terms: list[str], limit: int) -> DataFrame:
    boost = F.lit(0.0)
    for t in terms:
        boost = boost + F.array_contains(T.content_terms(F.col("path")), t).cast("double") * 4 + F.array_contains(T.content_terms(F.col("title")), t).cast("double") * 2
    return best.select("path", "title", "text", "start_line", "end_line", (F.col("bm25") + boost).alias("score")).orderBy(F.desc("score"), "path", "start_line").limit(limit)


def file_affinity(file_terms: Column, terms: list[str]) -> Column:
    """Per query term 7 if the file path has it, 5 if it has a related word."""
    total = F.lit(0.0)
    for t in terms:
        near = F.exists(file_terms, lambda f: T.morphologically_related(f, t))  # noqa: B023  (used at once)
        total = total + F.when(F.array_contains(file_terms, t), F.lit(7.0)).when(near, F.lit(5.0)).otherwise(F.lit(0.0))
    return total


def symbol_search(symbols: DataFrame, query: str, limit: int = 20, kind: str | None = None, candidates: bool = False) -> DataFrame:
    """Symbols with a score, best first; ``candidates`` allows the wider limit that exploring uses."""
    budget.text(query)
    budget.between(limit, budget.MAX_CANDIDATES, "search candidate limit") if candidates else budget.limit(limit)
    terms = budget.terms(T.search_terms(query))
    columns = symbols.columns
    if not terms:
        return symbols.limit(0).withColumn("score", F.lit(0.0))
    # The index has the name, the qualified name, the file and the segments of both names.
    segments = F.array_join(T.identifier_segments(F.concat_ws(" ", "name", "qualified_name")), " ")
    tokens = F.concat(*(T.search_tokens(c) for c in (F.col("name"), F.col("qualified_name"), F.col("file"), segments)))
    rows = _scored(symbols.withColumn("tokens", tokens), terms, ["id", "kind"])
    if kind:
        rows = rows.where(F.col("kind") == kind)  # after the statistics, which are over all symbols
    best = rows.orderBy(F.desc("bm25"), "id").limit(4 * limit).select("id", "bm25")
    best = symbols.join(F.broadcast(best), "id")  # at most 4 * limit rows
    whole = F.lit(query.strip().lower())
    name, qualified = F.lower("name"), F.lower("qualified_name")
    starts = F.lit(False)
    for t in terms:
        starts = starts | name.startswith(t)
    boost = F.when((name == whole) | (qualified == whole), 10.0).when(name.isin(*terms), 6.0).when(starts, 3.0).otherwise(0.0)
    score = F.col("bm25") + file_affinity(T.identifier_segments(F.col("file")), terms) + boost
    return best.select(*columns, score.alias("score")).orderBy(F.desc("score"), "qualified_name", "file", "id").limit(limit)


def memory_search(memories: DataFrame, workspace_id: str, query: str, limit: int = 10) -> DataFrame:
    """Memories of a workspace that have every term as a prefix, by bm25 over all workspaces, then recency."""
    budget.text(query, "memory query", 4096)
    budget.limit(limit)
    terms = T.memory_terms(query)
    columns = memories.columns
    if not terms:
        return memories.limit(0).withColumn("score", F.lit(0.0))
    rows = memories.withColumn("tokens", T.search_tokens(F.concat_ws(" ", "body", F.array_join("tags", " "))))
    found = _scored(rows, terms, ["id", "workspace_id", "updated_at_ms"], every=True).where(F.col("workspace_id") == workspace_id)
    best = found.orderBy(F.desc("bm25"), F.desc("updated_at_ms"), "id").limit(limit).select("id", F.col("bm25").alias("score"))
    best = memories.join(F.broadcast(best), "id")  # at most limit rows
    return best.select(*columns, "score").orderBy(F.desc("score"), F.desc("updated_at_ms"), "id")


def postings(chunks: DataFrame) -> DataFrame:
    """The inverted index (token, path, ordinal, tf): for writing, sorted by token so that Parquet statistics prune prefix ranges."""
    rows = chunks.select("path", "ordinal", F.explode(_chunk_tokens()).alias("token"))
    return rows.groupBy("token", "path", "ordinal").agg(F.count("*").alias("tf"))


def _chunk_tokens() -> Column:
    return F.concat(T.search_tokens(F.col("title")), T.search_tokens(F.col("text")))


def search_index(chunks: DataFrame) -> dict[str, DataFrame]:
    """Tables that ``indexed_search`` reads: ``postings`` (token, path, ordinal, tf, size), a posting having its chunk's size, and ``lengths`` (path, chunks, tokens), a row per file."""
    rows = chunks.select("path", "ordinal", _chunk_tokens().alias("tokens"))
    sized = rows.select("path", "ordinal", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    made = sized.groupBy("token", "path", "ordinal", "size").agg(F.count("*").alias("tf"))
    lengths = rows.groupBy("path").agg(F.count("*").alias("chunks"), F.sum(F.size("tokens")).cast("long").alias("tokens"))
    return {"postings": made.select("token", "path", "ordinal", "tf", "size"), "lengths": lengths}


def by_token(postings_: DataFrame) -> DataFrame:
    """Postings in the order in which they are stored: a prefix is a range of tokens, so of files and row groups."""
    return postings_.repartitionByRange("token").sortWithinPartitions("token", "path", "ordinal")


def indexed_search(index: dict[str, DataFrame], chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """``content_search`` from the tables of ``search_index``: the prefixes' ranges of the postings, a sum per chunk, the best 4 * limit, and only those chunks' texts."""
    budget.text(query, "content query")
    budget.limit(limit)
    terms = [w.lower() for w in T.split_words(query)]
    words = [T.split_words(T.fold_text(t)) for t in terms]
    if not terms or any(len(w) != 1 for w in words):
        return content_search(chunks, query, limit)
    prefixes = [w[0] for w in words]
    wanted = F.lit(False)
    for p in dict.fromkeys(prefixes):
        wanted = wanted | F.col("token").startswith(p)
    hits = index["postings"].where(wanted)
    tf = [F.sum(F.when(F.col("token").startswith(p), F.col("tf")).otherwise(0)).alias(f"__tf{k}") for k, p in enumerate(prefixes)]
    rows = cut(hits.groupBy("path", "ordinal").agg(F.first("size").cast("double").alias("__size"), *tf))
    corpus = index["lengths"].agg(F.sum("chunks").cast("double").alias("__n"), (F.sum("tokens") / F.sum("chunks")).alias("__avg"))
    found = rows.agg(*(F.sum((F.col(f"__tf{k}") > 0).cast("double")).alias(f"__tf{k}n") for k in range(len(terms))))
    best = _with_bm25(rows, corpus.crossJoin(found), len(terms)).select("path", "ordinal", "bm25").orderBy(F.desc("bm25"), "path", "ordinal").limit(4 * limit).collect()
    if not best:
        return _boosted(chunks.limit(0).withColumn("bm25", F.lit(0.0)), terms, limit)
    # At most 4 * limit rows: their paths are a filter of the scan of the texts.
    kept = chunks.sparkSession.createDataFrame([tuple(r) for r in best], "path string, ordinal long, bm25 double")
    texts = chunks.where(F.col("path").isin(*{r["path"] for r in best}))
    return _boosted(texts.join(F.broadcast(kept), ["path", "ordinal"]), terms, limit)
