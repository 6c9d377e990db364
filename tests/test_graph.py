import random
from collections import deque

import pytest

from loomgraph.functions import budget
from loomgraph.operators import graph

SYMBOL = "id string, language string, kind string, name string, qualified_name string, file string, start_byte long, end_byte long, start_line long, end_line long"
EDGE = "source_id string, target_id string, kind string, provenance string, confidence double, explanation string, evidence_file string, evidence_line long, evidence_site long"


def symbols(spark, names):
    return spark.createDataFrame([(f"id_{n}", "ts", "function", n, f"m.{n}", f"{n}.ts", 0, 1, 1, 1) for n in names], SYMBOL)


def edges(spark, rows):
    return spark.createDataFrame([(f"id_{a}", f"id_{b}", k, "p", float(c), "e", "f.ts", line, 0) for a, b, k, c, line in rows], EDGE)


def random_graph(seed):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(25)]
    rows = {(rnd.choice(names), rnd.choice(names), rnd.choice(graph.KINDS), rnd.choice([0.5, 0.9, 1.0]), rnd.randint(1, 3)) for _ in range(70)}
    return names, sorted(rows)


def order(rows, key, incoming, kind):
    other = 0 if incoming else 1
    own = [r for r in rows if r[1 - other] == key and r[2] == kind]
    return sorted(own, key=lambda r: (-r[3], f"m.{r[other]}", r[4], f"id_{r[other]}"))


def plain_impact(rows, root, depth):
    seen, queue, out = {root}, deque([(root, 0)]), []
    while queue:
        at, d = queue.popleft()
        if d < depth:
            for r in order(rows, at, True, "calls"):
                if r[0] not in seen:
                    seen.add(r[0])
                    out.append((d + 1, at, r[0]))
                    queue.append((r[0], d + 1))
    return out


def plain_trace(rows, a, b, depth):
    seen, queue, before, examined = {a}, deque([(a, 0)]), {}, 0
    while queue:
        at, d = queue.popleft()
        if d >= depth:
            continue
        for kind in graph.KINDS:
            near = order(rows, at, False, kind)
            examined += len(near)
            for r in near:
                if r[1] in seen:
                    continue
                seen.add(r[1])
                before[r[1]] = at
                if r[1] == b:
                    path, x = [], b
                    while x != a:
                        path.append(x)
                        x = before[x]
                    return "found", path[::-1], len(seen), examined
                queue.append((r[1], d + 1))
    return "no_path", [], len(seen), examined


@pytest.mark.parametrize("seed", [1, 2])
def test_impact_and_trace_in_plain_order(spark, seed):
    names, rows = random_graph(seed)
    s, e = symbols(spark, names).cache(), edges(spark, rows).cache()
    for root in (rows[0][1], rows[5][1]):
        got = [(r.depth, r.origin_id[3:], r.id[3:]) for r in graph.impact(s, e, root, max_depth=3).collect()]
        assert got == plain_impact(rows, root, 3)
    for a, b in ((names[0], names[7]), (names[3], names[20])):
        t = graph.trace(s, e, a, b, max_depth=4)
        assert (t.status, [p["id"][3:] for p in t.path], t.examined_nodes, t.examined_edges) == plain_trace(rows, a, b, 4)


def test_endpoints(spark):
    s = symbols(spark, ["a", "b"]).union(symbols(spark, ["a"]).selectExpr("'id_a2' AS id", "language", "kind", "name", "qualified_name", "'other/a.ts' AS file", "start_byte", "end_byte", "start_line", "end_line"))
    e = edges(spark, [("a", "b", "calls", 1, 1)])
    assert graph.trace(s, e, "zz", "b").status == "source_not_found"
    assert graph.trace(s, e, "b", "zz").status == "target_not_found"
    assert graph.trace(s, e, "a", "b").status == "ambiguous_source"
    assert graph.trace(s, e, "b", "a").status == "ambiguous_target"
    assert graph.trace(s, e, "a", "a").status == "ambiguous_endpoints"
    same = graph.trace(s, e, "b", "b")
    assert (same.status, same.path, same.examined_nodes) == ("found", [], 1)
    assert graph.trace(s, e, "id_a", "b").status == "found"
    assert graph.trace(s, e, "a", "b", source_file="other/a.ts").status == "no_path"


def test_limits(spark, monkeypatch):
    names, rows = random_graph(3)
    s, e = symbols(spark, names), edges(spark, [(n, names[0], "calls", 1, 1) for n in names[1:]])
    with pytest.raises(budget.BudgetError):
        graph.impact(s, e, names[0], max_depth=21)
    monkeypatch.setattr(budget, "MAX_EDGES", 5)
    with pytest.raises(budget.BudgetError):
        graph.impact(s, e, names[0], max_depth=2)


def test_callers_files_quality(spark):
    s, e = symbols(spark, ["a", "b", "c"]), edges(spark, [("a", "c", "calls", 0.5, 1), ("b", "c", "calls", 0.9, 2), ("c", "a", "references", 1, 1)])
    assert [r.id for r in graph.named(s, e, "c", "calls", True).collect()] == ["id_b", "id_a"]
    assert [r.id for r in graph.named(s, e, "c", "calls", True, limit=1).collect()] == ["id_b"]
    files = spark.createDataFrame([("a.ts", "ts"), ("none.ts", "ts")], "path string, language string")
    assert [(r.path, r.symbols) for r in graph.files(s, files).collect()] == [("a.ts", 1), ("none.ts", 0)]
    x = spark.createDataFrame([("ts", "a", "b"), ("py", "c", "d")], "language string, caller string, callee string")
    y = spark.createDataFrame([("ts", "a", "b"), ("ts", "a", "b"), ("ts", "z", "z")], x.schema)
    got = {r.language: (r.precision, r.recall) for r in graph.quality(x, y).collect()}
    assert got == {None: (0.5, 0.5), "ts": (0.5, 1.0), "py": (1.0, 0.0)}
    hits = s.selectExpr("*", "CAST(1 AS DOUBLE) AS score")
    kept, found = graph.explore(s, e, hits, 2)
    assert kept.count() == 2 and {r.direction for r in found.collect()} <= {"callers", "callees", "references", "referenced_by"}


def test_trace_gives_no_path_of_a_cut_level(spark, monkeypatch):
    names = ["a", *(f"h{i}" for i in range(8))]
    s, e = symbols(spark, names), edges(spark, [("a", f"h{i}", "calls", 0.9, 1) for i in range(8)]).coalesce(1)
    assert graph.trace(s, e, "a", "h0").status == "found"
    monkeypatch.setattr(budget, "MAX_EDGES", 5)
    for target in ("h0", "h4", "h7"):
        with pytest.raises(budget.BudgetError):
            graph.trace(s, e, "a", target)


@pytest.mark.parametrize("broadcast", [100_000, 3])
def test_unbounded_impact_is_whole(spark, monkeypatch, broadcast):
    """More nodes, edges and roots than the limits, ends without a symbol or an id, a frontier that is broadcast or shuffled."""
    names, rows = random_graph(1)
    rows = sorted({(a, b, "calls", c, line) for a, b, _, c, line in rows})
    root = rows[0][1]
    s, e = symbols(spark, names).cache(), edges(spark, rows).cache()
    monkeypatch.setattr(budget, "MAX_EDGES", 4)
    monkeypatch.setattr(budget, "MAX_NODES", 4)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", broadcast)
    want = plain_impact(rows, root, 3)
    assert len(want) > 4
    with pytest.raises(budget.BudgetError):
        graph.impact(s, e, root, max_depth=3)
    found = graph.impact(s, e, root, max_depth=3, bounded=False).collect()
    assert [(r.depth, r.origin_id[3:], r.id[3:]) for r in found] == want
    assert [r.disc for r in found] == list(range(2, len(want) + 2))
    nowhere = edges(spark, [("gone", root, "calls", 1, 1), ("further", "gone", "calls", 1, 1)]).union(edges(spark, [("x", root, "calls", 1, 2), ("x", "gone", "calls", 1, 2)]).withColumn("source_id", graph.F.lit(None).cast("string")))
    got = graph.impact(s, nowhere, root, max_depth=3, bounded=False).collect()
    assert sorted((r.depth, r.id or "") for r in got) == [(1, ""), (1, "id_gone"), (2, "id_further")]
    same = s.selectExpr("id", "language", "kind", "'one' AS name", "qualified_name", "file", "start_byte", "end_byte", "start_line", "end_line")
    assert {r.id for r in graph.impact(same, edges(spark, [("new", n, "calls", 1, 1) for n in names]), "one", bounded=False).collect()} == {"id_new"}


def test_impact_query_equals_sql_beyond_the_node_limit(spark, tmp_path, monkeypatch):
    import duckdb

    from loomgraph.plans import catalog

    con = duckdb.connect()
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey",
        "customer": "SELECT range AS c_custkey, 'C' || range AS c_name, 0 AS c_nationkey FROM range(40)",
        "supplier": "SELECT range AS s_suppkey, 'S' || range AS s_name, 0 AS s_nationkey FROM range(20)",
        "part": "SELECT range AS p_partkey, 'red widget' AS p_name, 'Brand#' || (17 + range % 2) AS p_brand, 'T' AS p_type FROM range(30)",
        "orders": "SELECT range AS o_orderkey, range % 37 AS o_custkey FROM range(100)",
        "lineitem": "SELECT range % 110 AS l_orderkey, range % 30 AS l_partkey, 10 + range % 7 AS l_suppkey, 1 AS l_linenumber, 0.1::DOUBLE AS l_discount FROM range(400)",
    }
    for name, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    monkeypatch.setattr(budget, "MAX_NODES", 10)
    got = sorted(tuple(r) for r in catalog.QUERIES["impact"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalog.SQL["impact"]).fetchall()) and len(got) > 40


#: Customer 5 calls order 1, which calls part 2, which references a supplier: number 7, another one, or one beyond a part that has no row.
@pytest.mark.parametrize("supplier, parts, steps", [(7, 3, 3), (8, 3, None), (7, 1, 3)])
def test_trace_query_equals_sql(spark, tmp_path, monkeypatch, supplier, parts, steps):
    import duckdb

    from loomgraph.plans import catalog

    con = duckdb.connect()
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey",
        "customer": "SELECT range AS c_custkey, 'C' || range AS c_name, 0 AS c_nationkey FROM range(9)",
        "supplier": "SELECT range AS s_suppkey, 'S' || range AS s_name, 0 AS s_nationkey FROM range(9)",
        "part": f"SELECT range AS p_partkey, 'red widget' AS p_name, 'Brand#1' AS p_brand, 'T' AS p_type FROM range({parts})",
        "orders": "SELECT range AS o_orderkey, 5 AS o_custkey FROM range(9)",
        "lineitem": f"SELECT 1 AS l_orderkey, 2 AS l_partkey, {supplier} AS l_suppkey, range AS l_linenumber, 0.1::DOUBLE AS l_discount FROM range(4)",
    }
    for name, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    monkeypatch.setattr(budget, "MAX_NODES", 3)
    monkeypatch.setattr(budget, "MAX_EDGES", 3)
    got = [tuple(r) for r in catalog.QUERIES["trace_path"](spark, str(tmp_path)).collect()]
    assert got == con.execute(catalog.SQL["trace_path"]).fetchall() == [("found", steps, "c_5", "s_7")]
