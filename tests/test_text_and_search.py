import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import budget
from loomgraph.functions import text as T
from loomgraph.operators import chunks, search


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("parseHTTPResponse2Json", ["parsehttpresponse2json", "parse", "http", "response", "2", "json"]),
        ("snake_case name", ["snake", "case", "name"]),
        ("", []),
        ("src/auth/loginPage.ts", ["src", "auth", "loginpage", "login", "page", "ts"]),
        ("aB aB", ["ab", "a", "b"]),
    ],
)
def test_segments(spark, text, want):
    assert T.segments_of(text) == want
    assert one(spark, T.identifier_segments(F.col("s")), s=text) == want


def test_terms():
    assert T.search_terms("how does the loginPage work") == ["loginpage", "login", "page"]
    assert T.search_terms("how to") == ["how", "to"]
    assert T.memory_terms("Foo_bar baz, " * 15)[:2] == ["foo_bar", "baz"] and len(T.memory_terms("a b " * 20)) == 20


def test_morphology(spark):
    for a, b, want in [("authenticate", "authentication", True), ("abcdef", "abcdefgh", True), ("abcde", "abcde", False), ("authorize", "authenticate", False)]:
        assert one(spark, T.morphologically_related(F.col("a"), b), a=a) is want


def test_glob_and_modules(spark):
    assert one(spark, F.col("p").rlike(T.glob_regex("src/**/*.ts")), p="src/a/b/c.ts") and not one(spark, F.col("p").rlike(T.glob_regex("src/*.ts")), p="src/a/c.ts")
    assert one(spark, T.module_key(F.col("p")), p="a/b.tsx") == "a/b" and one(spark, T.module_key(F.col("p")), p="a/b.py") == "a/b.py"


def test_budget():
    for call in (lambda: budget.limit(0), lambda: budget.limit(101), lambda: budget.depth(0), lambda: budget.depth(21), lambda: budget.text("  "), lambda: budget.text("a" * 20000), lambda: budget.terms(["a"] * 65)):
        with pytest.raises(budget.BudgetError):
            call()
    assert budget.limit(100) == 100 and budget.depth(20) == 20


def plain_chunks(text):
    lines = text.replace("\r\n", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out, start = [], 0
    while start < len(lines) and len(out) < 512:
        end, size = start, 0
        while end < len(lines) and end - start < 80 and (end == start or size + len(lines[end].encode()) + 1 <= 4096):
            size += len(lines[end].encode()) + 1
            end += 1
        title = next((x.strip()[1:].strip() for x in lines[start:end] if x.strip().startswith("#") and x.strip()[1:].strip()), "")
        out.append((len(out), title, "\n".join(lines[start:end]), start + 1, end))
        start = end
    return out


def test_chunks(spark):
    rnd = random.Random(2)
    texts = ["", "a", "a\n", "\n", "\n".join("x" for _ in range(81)), "é" * 5000 + "\nb", "# \n## Head # x\nb", "a\r\nb\r\n"]
    texts += ["\n".join("w" * rnd.choice([0, 3, 60, 900]) for _ in range(rnd.randint(1, 200))) for _ in range(20)]
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)] + [("null", None)], "path string, text string")
    got = {}
    for r in chunks.content_chunks(df).collect():
        got.setdefault(r.path, []).append((r.ordinal, r.title, r.text, r.start_line, r.end_line))
    assert "null" not in got
    for i, t in enumerate(texts):
        assert sorted(got.get(f"f{i}", [])) == plain_chunks(t), i


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_plain_chunks_cover_all_lines(sizes):
    found = plain_chunks("\n".join("x" * n for n in sizes))
    at = 1
    for _, _, _, start, end in found:
        assert start == at and end - start < 80
        at = end + 1


def test_content_search_matches_sqlite(spark):
    rnd = random.Random(4)
    vocabulary = ["token", "Tokens", "tokenize", "café", "cafe", "graph", "grape", "x1", "search"]
    rows = [(f"src/{rnd.choice(['token', 'a'])}{i}.md", 0, rnd.choice(["", "Graph search"]), " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))), 1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "path string, ordinal long, title string, text string, start_line long, end_line long")
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table f using fts5(path unindexed, title, text, tokenize=\"unicode61 remove_diacritics 2\")")
    base.executemany("insert into f values (?,?,?)", [(r[0], r[2], r[3]) for r in rows])
    want = dict(base.execute("select path, -bm25(f) from f where f match ?", ('"token"* OR "cafe"* OR "zzz"*',)).fetchall())
    tokens = F.concat(T.search_tokens(F.col("title")), T.search_tokens(F.col("text")))
    got = {r.path: r.bm25 for r in search._scored(df.withColumn("tokens", tokens), ["token", "cafe", "zzz"], ["path"]).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    hits = search.content_search(df, "token café", 5).collect()
    assert len(hits) == 5 and [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert search.content_search(df, "!!", 5).count() == 0


def test_symbol_search_ranks_exact_names_first(spark):
    names = ["loginPage", "login", "logout", "pageLogin", "other"]
    df = spark.createDataFrame([(f"s{i}", "ts", "function", n, f"mod.{n}", f"src/{n}.ts") for i, n in enumerate(names)], "id string, language string, kind string, name string, qualified_name string, file string")
    assert search.symbol_search(df, "loginPage", 2).first().name == "loginPage"
    assert search.symbol_search(df, "mod.login").first().name == "login"
    assert search.symbol_search(df, "login", kind="class").count() == 0
    with pytest.raises(budget.BudgetError):
        search.symbol_search(df, " ".join(f"t{i}x" for i in range(70)))


def test_memory_search_needs_all_terms(spark):
    df = spark.createDataFrame([("a", "w", "alpha beta", ["x"], 1, 1), ("b", "w", "alpha", ["beta"], 1, 2), ("c", "w", "alpha", [], 1, 3), ("d", "v", "alpha beta", [], 1, 4), ("e", "w", "foo_bar one", [], 1, 5), ("f", "w", "foo one bar", [], 1, 5)], "id string, workspace_id string, body string, tags array<string>, created_at_ms long, updated_at_ms long")
    assert {r.id for r in search.memory_search(df, "w", "alp bet").collect()} == {"a", "b"}
    assert {r.id for r in search.memory_search(df, "w", "foo_ba").collect()} == {"e"}


def test_indexed_search_is_the_plain_one(spark):
    import random

    rnd = random.Random(2)
    words = ["heat", "heater", "Lich", "über", "x_y", "tion", "a1", "the"]
    rows = [(f"d{i % 7}/heat{i}.md", 0, rnd.choice(["", "Heat title"]), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), 1, 9) for i in range(120)]
    chunks = spark.createDataFrame(rows, "path string, ordinal long, title string, text string, start_line long, end_line long").cache()
    index = {k: v.cache() for k, v in search.search_index(chunks).items()}
    for query in ("heat", "lich uber", "tion heat a", "nothing", "x_y", "!!"):
        got, want = (r.collect() for r in (search.indexed_search(index, chunks, query, 9), search.content_search(chunks, query, 9)))
        assert [(r.path, r.text, round(r.score, 9)) for r in got] == [(r.path, r.text, round(r.score, 9)) for r in want], query


def test_indexed_search_reads_ranges_of_tokens(spark, tmp_path):
    chunks = spark.createDataFrame([(f"f{i}", 0, "", f"word{i} other", 1, 1) for i in range(50)], "path string, ordinal long, title string, text string, start_line long, end_line long")
    index = search.search_index(chunks)
    search.by_token(index["postings"]).write.parquet(str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where("startswith(token, 'word7')")._jdf.queryExecution().toString()
    assert "StringStartsWith(token,word7)" in plan
