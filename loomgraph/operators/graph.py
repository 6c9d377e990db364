"""Lookups and traversals of the property graph.

``symbols`` has id, language, kind, name, qualified_name, file and spans;
``relationships`` has source_id, target_id, kind, confidence, explanation,
provenance, evidence_file, evidence_line, evidence_site.

Traversals go level by level: one join of the edges with the frontier a level.
A frontier of at most ``BROADCAST_ROWS`` is broadcast, so the edge table is scanned,
not shuffled; a larger one is joined by a shuffle.  A level is never cut: its edges
are counted whole, and one that breaks the edge limit is an error before anything is
answered from it.  ``bounded=False`` answers whole requests of any size: without the
node and edge limits, and over edges whose ends have no symbol (its columns are null).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import budget
from ..functions.text import glob_regex, ratio
from ..plans.lineage import cut

#: Fixed value: the order in which a trace looks at kinds.
KINDS = ("calls", "references", "imports", "extends", "implements", "contains")
#: Fixed value: the rows (an id and a number each) of a frontier that is broadcast.
BROADCAST_ROWS = 100_000
EVIDENCE = ("provenance", "confidence", "explanation", "evidence_file", "evidence_line", "evidence_site")


def find_symbols(symbols: DataFrame, query: str, name_only: bool = False, bounded: bool = True) -> DataFrame:
    """Symbols by id, name or qualified name, in order of qualified name and file; where bounded, more than the node limit is an error."""
    budget.identifier(query)
    match = F.col("name") == query
    if not name_only:
        match = match | (F.col("id") == query) | (F.col("qualified_name") == query)
    found = symbols.where(match)
    if bounded and found.limit(budget.MAX_NODES + 1).count() > budget.MAX_NODES:
        raise budget.BudgetError(f"symbol lookup exceeded the {budget.MAX_NODES}-item work limit")
    return found.orderBy("qualified_name", "file", "id")


def in_file(file: Column, wanted: str | None) -> Column:
    """Whether a symbol's file is the wanted one: equal, ending so, or of that name."""
    if wanted is None:
        return F.lit(True)
    return file.endswith(budget.identifier(wanted))


def _edge_order() -> list[Column]:
    return [F.desc("confidence"), F.asc("qualified_name"), F.asc("evidence_file"), F.asc("evidence_line"), F.asc("evidence_site"), F.asc("provenance"), F.asc("id")]


def related(symbols: DataFrame, relationships: DataFrame, ids: DataFrame, incoming: bool, kind: str) -> DataFrame:
    """Symbols at the other end of the edges of ``ids`` (origin_id), with evidence."""
    own, other = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    edges = relationships.where(F.col("kind") == kind).select(F.col(own).alias("origin_id"), F.col(other).alias("id"), F.col("kind").alias("relationship"), *EVIDENCE)
    return edges.join(ids, "origin_id").join(symbols, "id")


def named(symbols: DataFrame, relationships: DataFrame, symbol: str, kind: str, incoming: bool, file: str | None = None, limit: int = 20) -> DataFrame:
    """Callers, callees and the like of all symbols of a name: origins in lookup order, each one's edges by confidence, up to the limit."""
    budget.limit(limit)
    origins = find_symbols(symbols, symbol).where(in_file(F.col("file"), file))
    origins = origins.select(F.col("id").alias("origin_id"), F.struct("qualified_name", "file", "id").alias("origin_order"))
    return related(symbols, relationships, origins, incoming, kind).orderBy("origin_order", *_edge_order()).limit(limit).drop("origin_order")


def impact(symbols: DataFrame, relationships: DataFrame, symbol: str, file: str | None = None, max_depth: int = 2, bounded: bool = True) -> DataFrame:
    """Everything that calls the symbol, over up to ``max_depth`` calls: (depth, origin_id, symbol, evidence, disc), roots left out; the first discovery counts."""
    budget.depth(max_depth)
    roots = find_symbols(symbols, symbol, bounded=bounded).where(in_file(F.col("file"), file))
    frontier, size = _numbered(roots.select("qualified_name", "file", "id"), [F.asc("qualified_name"), F.asc("file"), F.asc("id")], 0)
    visited, out, examined, found, start = frontier.select("id"), None, 0, 0, size
    edges = _edges(relationships, ["calls"], incoming=True)
    for depth in range(1, max_depth + 1):
        if not size:
            break
        near, n_edges = _near(symbols, edges, frontier, size, bounded)
        examined += n_edges
        if bounded and examined > budget.MAX_EDGES:
            raise budget.BudgetError(f"impact traversal exceeded the {budget.MAX_EDGES}-edge work limit")
        step, size = _first(near, visited, start)
        found += size
        if bounded and found > budget.MAX_NODES:
            raise budget.BudgetError(f"impact traversal exceeded the {budget.MAX_NODES}-node work limit")
        step = step.withColumn("depth", F.lit(depth))
        out = step if out is None else out.union(step)
        frontier, visited = step.select("id", "disc"), visited.union(step.select("id"))
        start += size
    if out is None:
        out = _first(_near(symbols, edges, frontier, size, bounded)[0], visited, 0)[0].withColumn("depth", F.lit(0))
    return out.orderBy("disc")


def _rank(kinds: list[str]) -> Column:
    rank = F.lit(len(kinds))
    for k in reversed(range(len(kinds))):
        rank = F.when(F.col("relationship") == kinds[k], k).otherwise(rank)
    return rank


def _edges(relationships: DataFrame, kinds: list[str], incoming: bool) -> DataFrame:
    own, other = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    edges = relationships.where(F.col("kind").isin(*kinds)).select(F.col(own).alias("origin_id"), F.col(other).alias("id"), F.col("kind").alias("relationship"), *EVIDENCE)
    return edges.withColumn("kind_rank", _rank(kinds))


def _near(symbols: DataFrame, edges: DataFrame, frontier: DataFrame, size: int, bounded: bool) -> tuple[DataFrame, int]:
    """The edges next to the frontier of ``size`` rows, with the symbols at their other ends, all of them; and how many, or, where bounded, one more than the edge limit."""
    at = frontier.select(F.col("id").alias("origin_id"), F.col("disc").alias("origin_disc"))
    at = edges.join(F.broadcast(at) if size <= BROADCAST_ROWS else at, "origin_id")
    near = at.join(symbols, "id", "inner" if bounded else "left")
    some = cut(near.limit(budget.MAX_EDGES + 1) if bounded else near)
    n = some.count()
    return (near if bounded and n > budget.MAX_EDGES else some), n


def _numbered(rows: DataFrame, order: list[Column], start: int) -> tuple[DataFrame, int]:
    """The rows with ``disc``, their number in order, on from ``start``; and how many.  They are sorted by ranges, not in one task."""
    ordered = cut(rows.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r["part"]: r["count"] for r in ordered.groupBy(part.alias("part")).count().collect()}  # one row per partition
    before = [start]
    for k in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(k, 0))
    disc = F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), part + 1) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ordered.withColumn("disc", disc).drop("__at"), sum(sizes.values())


def _first(near: DataFrame, visited: DataFrame, start: int) -> tuple[DataFrame, int]:
    """New symbols, each by its first discovery, numbered on from ``start``, and how many."""
    order = [F.asc("origin_disc"), F.asc("kind_rank"), *_edge_order()]
    seen = visited.select(F.col("id").alias("seen_id"))
    fresh = near.join(seen, F.col("id").eqNullSafe(F.col("seen_id")), "left_anti")
    first = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("nth = 1").drop("nth")
    return _numbered(first, order, start)


@dataclass
class Trace:
    """How a path search ended: found, no_path, source_not_found, target_not_found, ambiguous_source, ambiguous_target or ambiguous_endpoints."""

    status: str
    path: list = field(default_factory=list)
    examined_nodes: int = 0
    examined_edges: int = 0
    guidance: str | None = None


def trace(symbols: DataFrame, relationships: DataFrame, source: str, target: str, source_file: str | None = None, target_file: str | None = None, max_depth: int = 6) -> Trace:
    """The shortest directed path, kinds tried in their order, every step with its evidence."""
    budget.depth(max_depth)
    ends = [find_symbols(symbols, q).where(in_file(F.col("file"), f)).limit(2).collect() for q, f in ((source, source_file), (target, target_file))]
    a, b = map(len, ends)
    status = "source_not_found" if a == 0 else "target_not_found" if b == 0 else None if a == b == 1 else "ambiguous_target" if a == 1 else "ambiguous_source" if b == 1 else "ambiguous_endpoints"
    if status:
        return Trace(status, guidance=status.replace("_", " ") + "; give a file or an id" * status.startswith("ambiguous"))
    return path(symbols, relationships, ends[0][0]["id"], ends[1][0]["id"], max_depth)


def path(symbols: DataFrame, relationships: DataFrame, origin: str, goal: str, max_depth: int = 6, bounded: bool = True) -> Trace:
    """``trace`` between two ids, which are taken as they are."""
    budget.depth(max_depth)
    if origin == goal:
        return Trace("found", examined_nodes=1)
    spark = symbols.sparkSession
    frontier = spark.createDataFrame([(origin, 1)], "id string, disc long")
    visited, steps, nodes, edges, size = frontier.select("id"), [], 1, 0, 1
    every = _edges(relationships, list(KINDS), incoming=False)
    order = [F.asc("origin_disc"), F.asc("kind_rank"), *_edge_order()]
    for _ in range(max_depth):
        near, n_edges = _near(symbols, every, frontier, size, bounded)
        hit = near.where(F.col("id") == goal).orderBy(*order).first()
        if hit:
            # The search stops at the hit: later edge groups of this level are not examined.
            at = (F.col("origin_disc") < hit["origin_disc"]) | ((F.col("origin_disc") == hit["origin_disc"]) & (F.col("kind_rank") <= hit["kind_rank"]))
            near = near.where(at)
            n_edges = near.count()
        if bounded and edges + n_edges > budget.MAX_EDGES:
            raise budget.BudgetError("path trace exceeded its work limit")
        step, size = _first(near, visited, nodes)
        if hit:
            hit = step.where(F.col("id") == goal).first()
            steps_back, row = [hit], hit
            for level in reversed(steps):
                row = level.where(F.col("id") == row["origin_id"]).first()
                steps_back.append(row)
            return Trace("found", steps_back[::-1], hit["disc"], edges + n_edges)
        steps.append(step)
        nodes, edges = nodes + size, edges + n_edges
        if bounded and nodes > budget.MAX_NODES:
            raise budget.BudgetError("path trace exceeded its work limit")
        if not size:
            break
        frontier, visited = step.select("id", "disc"), visited.union(step.select("id"))
    return Trace("no_path", examined_nodes=nodes, examined_edges=edges, guidance=f"no directed relationship path was found within depth {max_depth}")


def files(symbols: DataFrame, files_: DataFrame, prefix: str | None = None, glob: str | None = None, limit: int = 1000) -> DataFrame:
    """(path, language, symbols): every file with how many symbols it has, by path."""
    budget.between(limit, budget.MAX_FILES, "file limit")
    rows = files_
    if prefix:
        rows = rows.where(F.col("path").startswith(prefix))
    if glob:
        rows = rows.where(F.col("path").rlike(glob_regex(glob)))
    counts = symbols.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
    return rows.join(counts, "path", "left").select("path", "language", F.coalesce("symbols", F.lit(0)).alias("symbols")).orderBy("path").limit(limit)


def symbols_in_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file") == file).orderBy("start_byte", "end_byte", "id")


def first_files(hits: DataFrame, order: list[Column], max_files: int, file_col: str = "file") -> DataFrame:
    """Hits of the first ``max_files`` distinct files, in order, with their file's number; more hits of a file that is in stay in."""
    best = hits.withColumn("__nth", F.row_number().over(Window.partitionBy(file_col).orderBy(*order))).where("__nth = 1")
    best = best.orderBy(*order).limit(max_files)  # a bounded number of rows from here on
    first = best.select(F.col(file_col), F.row_number().over(Window.orderBy(*order)).alias("file_no"))
    return hits.join(F.broadcast(first), file_col).select(*hits.columns, "file_no")


def explore(symbols: DataFrame, relationships: DataFrame, hits: DataFrame, max_files: int) -> tuple[DataFrame, DataFrame]:
    """Search hits within the file budget, and up to 8 relationships a hit for each of callers, callees, references and referenced_by; ``truncated`` tells where there are more."""
    kept = first_files(hits, [F.desc("score"), F.asc("qualified_name"), F.asc("file"), F.asc("id")], max_files)
    ids = kept.select(F.col("id").alias("origin_id"))  # hits are within the candidate limit
    parts = []
    for name, kind, incoming in (("callers", "calls", True), ("callees", "calls", False), ("referenced_by", "references", True), ("references", "references", False)):
        parts.append(related(symbols, relationships, F.broadcast(ids), incoming, kind).withColumn("direction", F.lit(name)))
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    own = Window.partitionBy("origin_id", "direction")
    ranked = every.withColumn("nth", F.row_number().over(own.orderBy(*_edge_order()))).where(F.col("nth") <= budget.MAX_RELATIONSHIPS + 1)
    ranked = ranked.withColumn("truncated", F.max("nth").over(own) > budget.MAX_RELATIONSHIPS)
    return kept, ranked.where(F.col("nth") <= budget.MAX_RELATIONSHIPS)


def quality(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision and recall of distinct (language, caller, callee) edges, per language and, as language null, overall; an empty denominator gives 1."""
    keys = ["language", "caller", "callee"]
    e, p = (df.select(*keys).distinct() for df in (expected, predicted))
    rows = e.withColumn("in_e", F.lit(1)).join(p.withColumn("in_p", F.lit(1)), keys, "full")
    counted = rows.rollup("language").agg(F.count("in_e").alias("expected"), F.count("in_p").alias("predicted"), F.sum(F.when(F.col("in_e").isNotNull() & F.col("in_p").isNotNull(), 1).otherwise(0)).alias("matched"))
    return counted.withColumn("precision", ratio(F.col("matched"), F.col("predicted"))).withColumn("recall", ratio(F.col("matched"), F.col("expected")))
