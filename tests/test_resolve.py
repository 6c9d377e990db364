"""Each rule with a case where it holds and one where it must stay silent."""

import pytest

from pyspark.sql import functions as F

from loomgraph.operators import resolve

SYMBOL = "id string, language string, kind string, name string, qualified_name string, file string, start_line long"
REF = "ref_id string, file string, source_id string, target_name string, binding_name string, target_file_hint string, kind string, provenance string, confidence double, explanation string, evidence_file string, evidence_line long"
CALL = "call_id string, file string, caller_id string, fallback_caller_id string, callee_name string, receiver_binding string, receiver_type string, receiver_call_start_byte long, target_file_hint string, provenance string, confidence double, explanation string, resolvable boolean, evidence_file string, evidence_line long, start_byte long"
BINDING = "file string, binding_name string, target_id string, confidence double"
LINK = "source_id string, target_id string, kind string"


def sym(id, name, file, kind="function", qualified=None, language="typescript"):
    return (id, language, kind, name, qualified or name, file, 1)


def ref(n, source, target, kind="imports", hint=None, file="a.ts", binding=None):
    return (f"r{n}", file, source, target, binding or target, hint, kind, "p", 0.95, "ref", file, n)


def call(n, caller, callee, file="a.ts", receiver=None, receiver_type=None, result_of=None, hint=None, fallback=None, start=None):
    return (f"k{n}", file, caller, fallback, callee, receiver, receiver_type, result_of, hint, "syntax/call", 1.0, "call", True, file, n, n if start is None else start)


def frames(spark, symbols, refs=(), calls=(), bindings=(), links=()):
    make = spark.createDataFrame
    return make(symbols, SYMBOL), make(list(refs), REF), make(list(calls), CALL), make(list(bindings), BINDING), make(list(links), LINK)


def pairs(df):
    return sorted((r.source_id, r.target_id, round(r.confidence, 3)) for r in df.collect())


def test_imports(spark):
    symbols = [sym("s", "s", "a.ts", "file"), sym("x", "show", "src/handlers.ts"), sym("y", "show", "src/other.ts"), sym("p", "show", "x.py", language="python")]
    symbols += [sym(f"m{i}", "many", f"m{i}.ts") for i in range(9)]
    s, r, *_ = frames(spark, symbols, [ref(1, "s", "show", hint="src/handlers"), ref(2, "s", "show"), ref(3, "s", "many"), ref(4, "s", "show", hint="./handlers"), ref(5, "s", "none")])
    edges, bindings = resolve.resolve_imports(r, s)
    got = sorted((e.evidence_line, e.target_id, e.confidence) for e in edges.collect())
    assert got == [(1, "x", 0.95), (2, "x", 0.55), (2, "y", 0.55)]
    assert {(b.binding_name, b.target_id) for b in bindings.collect()} == {("show", "x"), ("show", "y")}


def test_heritage_tiers(spark):
    symbols = [sym("c", "C", "a.ts", "class"), sym("l", "Base", "a.ts", "class"), sym("o", "Base", "b.ts", "class"), sym("g", "Only", "z.ts", "class"), sym("t1", "Twice", "x.ts", "class"), sym("t2", "Twice", "y.ts", "class"), sym("i", "Imp", "q.ts", "class"), sym("i2", "Imp", "w.ts", "class")]
    refs = [ref(1, "c", "Base", "extends"), ref(2, "c", "Only", "extends"), ref(3, "c", "Twice", "implements"), ref(4, "c", "Imp", "implements")]
    s, r, _, b, _ = frames(spark, symbols, refs, bindings=[("a.ts", "Imp", "i", 0.95)])
    assert pairs(resolve.resolve_heritage(r, s, b)) == [("c", "g", 0.95), ("c", "i", 0.95), ("c", "l", 0.95)]


def test_function_references(spark):
    symbols = [sym("s", "s", "a.ts"), sym("l", "f", "a.ts"), sym("o", "f", "b.ts"), sym("g1", "g", "b.ts"), sym("g2", "g", "c.ts"), sym("h", "h", "d.ts")]
    s, r, _, b, _ = frames(spark, symbols, [ref(1, "s", "f", "references"), ref(2, "s", "g", "references"), ref(3, "s", "h", "references"), ref(4, "l", "f", "references", file="zz.ts")])
    assert pairs(resolve.resolve_function_references(r, s, b)) == [("l", "o", 0.95), ("s", "h", 0.95), ("s", "l", 0.95)]


def test_call_tiers(spark):
    symbols = [sym("me", "me", "a.ts"), sym("loc", "f", "a.ts"), sym("far", "f", "b.ts"), sym("imp", "g", "b.ts"), sym("imp2", "g", "c.ts"), sym("any", "h", "d.ts"), sym("any1", "two", "d.ts"), sym("any2", "two", "e.ts"), sym("A", "A", "a.ts", "class"), sym("Am", "run", "a.ts", "method", "A.run"), sym("B", "B", "a.ts", "class"), sym("base", "Base", "a.ts", "class"), sym("bm", "go", "a.ts", "method", "Base.go"), sym("other", "run", "z.ts")]
    symbols += [sym(f"m{i}", "many", f"m{i}.ts") for i in range(7)]
    calls = [call(1, "me", "f"), call(2, "me", "g"), call(3, "me", "h"), call(4, "me", "two"), call(5, "me", "many"), call(6, "me", "run", receiver_type="A", receiver="a"), call(7, "me", "go", receiver_type="B", receiver="b"), call(8, "me", "gone", receiver_type="B", receiver="b"), call(9, "nobody", "f")]
    s, _, k, b, links = frames(spark, symbols, calls=calls, bindings=[("a.ts", "g", "imp", 0.95)], links=[("B", "base", "extends")])
    edges, targets = resolve.resolve_calls(k, s, b, links)
    got = sorted((e.evidence_line, e.target_id, e.confidence) for e in edges.collect())
    assert got == [(1, "loc", 0.99), (2, "imp", 0.97), (3, "any", 0.75), (4, "any1", 0.35), (4, "any2", 0.35), (6, "Am", 0.995), (7, "bm", 0.97)]
    words = {e.evidence_line: e.explanation for e in edges.collect()}
    assert "in the same file" in words[1] and "maybe" in words[4]


def test_call_on_a_result(spark):
    symbols = [sym("me", "me", "a.ts"), sym("make", "make", "a.ts"), sym("A", "A", "a.ts", "class"), sym("Am", "run", "a.ts", "method", "A.run"), sym("x", "run", "x.ts", "method", "X.run")]
    s, _, k, b, links = frames(spark, symbols, calls=[call(1, "me", "make", start=5), call(2, "me", "run", result_of=5), call(3, "me", "run", result_of=99)])
    returns = spark.createDataFrame([("make", "a.ts", "A")], "owner_id string, file string, type_name string")
    edges, _ = resolve.resolve_calls(k, s, b, links, returns)
    assert sorted((e.evidence_line, e.target_id, e.confidence) for e in edges.collect()) == [(1, "make", 0.99), (2, "Am", 0.99)]
    none, _ = resolve.resolve_calls(k, s, b, links, returns.limit(0))
    assert [e.evidence_line for e in none.collect()] == [1]


def test_inline_callbacks_wait_for_their_owner(spark):
    s, _, k, b, links = frames(spark, [sym("me", "me", "a.ts"), sym("f", "f", "a.ts")], calls=[call(1, "inline", "f", fallback="me")])
    edges, targets = resolve.resolve_calls(k, s, b, links)
    assert edges.count() == 0
    none = spark.createDataFrame([], "id string")
    assert pairs(resolve.deferred_inline(targets, none)) == [("me", "f", 0.99)]


def test_ambiguous_inheritance_is_silent(spark):
    make = spark.createDataFrame
    asked = make([("D", "m"), ("E", "m"), ("L", "m")], "type_id string, name string")
    links = make([("D", "X", "extends"), ("D", "Y", "extends"), ("E", "F", "extends"), ("F", "G", "extends"), ("L", "L2", "extends"), ("L2", "L", "extends")], LINK)
    methods = make([("X", "m", "x.m"), ("Y", "m", "y.m"), ("G", "m", "g.m")], "type_id string, name string, member_id string")
    got = {r.type_id: (r.state, r.member_id) for r in resolve.inherited_members(asked, links, methods).collect()}
    assert got == {"D": ("ambiguous", None), "E": ("unique", "g.m"), "L": ("ambiguous", None)}


@pytest.mark.parametrize("n, hits", [(8, 8), (9, 0)])
def test_interface_fanout(spark, n, hits):
    symbols = [sym("I", "Handler", "i.ts", "interface"), sym("Im", "handle", "i.ts", "method", "Handler.handle")]
    for i in range(n):
        symbols += [sym(f"C{i}", f"C{i}", "c.ts", "class"), sym(f"m{i}", "handle", "c.ts", "method", f"C{i}.handle")]
    s, *_ = frames(spark, symbols)
    links = spark.createDataFrame([(f"C{i}", "I", "implements") for i in range(n)], LINK)
    found = resolve.interface_dispatch(s, links).collect()
    assert len(found) == hits and all(e.confidence == 0.94 for e in found)


@pytest.mark.parametrize("n, hits", [(6, 6), (7, 0)])
def test_event_fanout(spark, n, hits):
    rows = [(f"e{i}", "a.ts", "own", "bus", "ready", "register", f"h{i}", "a.ts", i) for i in range(n)] + [("d", "a.ts", "sender", "bus", "ready", "dispatch", None, "a.ts", 99), ("o", "b.ts", "far", "bus", "ready", "dispatch", None, "b.ts", 5)]
    events = spark.createDataFrame(rows, "event_id string, file string, owner_id string, receiver string, channel string, action string, callback_name string, evidence_file string, evidence_line long")
    targets = spark.createDataFrame([("own", f"h{i}", f"t{i}") for i in range(n)], "owner_id string, callback_name string, target_id string")
    found = resolve.event_dispatch(events, targets).collect()
    assert len(found) == hits and all((e.source_id, e.confidence) == ("sender", 0.92) for e in found)


def test_callbacks(spark):
    make = spark.createDataFrame
    symbols = make([sym("me", "me", "a.ts"), sym("run", "run", "a.ts"), sym("inner", "inner", "a.ts"), sym("cb", "cb", "a.ts"), sym("dup", "dup", "a.ts"), sym("dup2", "dup", "a.ts")], SYMBOL)
    arguments = make([("a.ts", "me", "run", 0, None, "cb", 1, 10), ("a.ts", "me", "run", 0, None, "dup", 2, 10), ("a.ts", "me", "run", None, "f", "cb", 3, 20)], "file string, caller_id string, callee_name string, argument_index long, formal_name string, target_name string, line long, call_start_byte long")
    targets = make([("a.ts", "me", 10, "run"), ("a.ts", "me", 20, "inner"), ("a.ts", "run", 30, "inner")], "file string, source_id string, start_byte long, target_id string")
    formals = make([("inner", "f", 1)], "owner_id string, formal_name string, parameter_index long")
    invocations = make([("inner", 1)], "owner_id string, parameter_index long")
    delegations = make([("run", 0, "a.ts", 30, 1)], "owner_id string, parameter_index long, file string, call_start_byte long, argument_index long")
    b = make([], BINDING)
    got = sorted((e.source_id, e.target_id, e.confidence, e.evidence_line) for e in resolve.callback_edges(arguments, targets, formals, invocations, delegations, symbols, b).collect())
    assert got == [("inner", "cb", 0.94, 1), ("inner", "cb", 0.96, 3)]


def test_exports_converge(spark):
    make = spark.createDataFrame
    literals = make([("lit.ts", "X", "", "s:ready"), ("b.ts", "Y", "", "s:1"), ("c.ts", "Y", "", "s:2")], "file string, export_name string, member_path string, channel string")
    exports = make([("a.ts", "Z", "lit.ts", "X", False), ("a.ts", "*", "b.ts", "*", True), ("a.ts", "*", "c.ts", "*", True), ("loop.ts", "*", "loop.ts", "*", True)], "file string, export_name string, target_file string, target_name string, is_star boolean")
    asked = make([("a.ts", "Z", ""), ("a.ts", "Y", ""), ("loop.ts", "Q", "")], "file string, export_name string, member_path string")
    assert [tuple(r) for r in resolve.exported_values(literals, exports, asked).collect()] == [("a.ts", "Z", "", "s:ready")]


def test_includes(spark):
    make = spark.createDataFrame
    files = make([("src/a.c",), ("src/a.h",), ("inc/a.h",), ("inc/only.h",)], "path string")
    includes = make([("src/a.c", "a.h", True), ("src/a.c", "only.h", False), ("x/b.c", "a.h", True), ("x/b.c", "none.h", True)], "file string, include string, quoted boolean")
    assert sorted(map(tuple, resolve.resolve_includes(includes, files).collect())) == [("src/a.c", "a.h", "src/a.h"), ("src/a.c", "only.h", "inc/only.h")]


def test_upsert_last_wins(spark):
    row = lambda c, x: spark.createDataFrame([("a", "b", "calls", "p", c, x, "f", 1, 0)], "source_id string, target_id string, kind string, provenance string, confidence double, explanation string, evidence_file string, evidence_line long, evidence_site long")
    got = resolve.upsert_edges([row(0.9, "old"), row(0.1, "new")]).collect()
    assert len(got) == 1 and got[0].explanation == "new"


def test_targets_beyond_the_limit(spark):
    seeds = [("full", t) for t in range(301)] + [("a", t) for t in range(200)] + [("b", t) for t in range(150, 350)] + [("own", t) for t in range(400, 700)]
    flows = [("full", "x"), ("a", "y"), ("b", "y"), ("y", "z"), ("a", "w"), ("w", "w2"), ("a", "own"), ("a", "a")]
    got = {}
    for r in resolve.propagate_targets(spark.createDataFrame(seeds, "slot string, target int"), spark.createDataFrame(flows, "from_slot string, to_slot string")).collect():
        got.setdefault(r.slot, set()).add(r.target)
    # full keeps its seeds and passes none on; y and own get too many and end with none; z got nothing in the meantime
    assert {k: len(v) for k, v in got.items()} == {"full": 301, "a": 200, "b": 200, "w": 200, "w2": 200}


def test_common_names_need_a_place(spark):
    """Names with many symbols: without a hint no answer, with one those of the place it names."""
    symbols = [sym("me", "me", "main.ts")] + [sym(f"g{i}", "get", f"lib/m{i}.ts") for i in range(30)] + [sym("gi", "get", "pkg/index.ts"), sym("few1", "few", "p.ts"), sym("few2", "few", "q.ts")]
    rows = [("1", "get", None), ("2", "get", "lib/m3"), ("3", "get", "m4"), ("4", "get", "lib"), ("5", "get", "./m5"), ("6", "few", None), ("7", "get", "lib/m6.ts"), ("8", "get", "pkg"), ("9", "get", "  "), ("10", "me", None)]
    references = spark.createDataFrame([(i, "main.ts", "me", n, n, h, "imports", "p", 0.95, "x", "main.ts", int(i)) for i, n, h in rows], "ref_id string, file string, source_id string, target_name string, binding_name string, target_file_hint string, kind string, provenance string, confidence double, explanation string, evidence_file string, evidence_line long")
    s = frames(spark, symbols)[0]
    edges, _ = resolve.resolve_imports(references, s)
    assert sorted((e.evidence_line, e.target_id, e.confidence) for e in edges.collect()) == [(2, "g3", 0.95), (3, "g4", 0.95), (6, "few1", 0.55), (6, "few2", 0.55), (7, "g6", 0.95), (8, "gi", 0.95)]


def test_hint_keys_are_hint_matches(spark):
    files = ["a.ts", "src/a.ts", "src/lib/index.ts", "index.ts", "x/y/z.py", "src/lib/b.c.ts", "./q.ts", "src/a"]
    hints = ["a", "a.ts", "src", "src/a", "lib", "lib/index", "index", "y", "y/z", "x/y", "z", "b.c", "src/lib/b.c.ts", "./a", "../a", "'a'", " a ", "src\\a", "", "b", "lib/b.c", "q"]
    rows = spark.createDataFrame([(f, h) for f in files for h in hints], "file string, hint string")
    both = rows.select("file", "hint", resolve.hint_matches(F.col("hint"), F.col("file")).alias("plain"), F.array_contains(resolve.place_keys(F.col("file")), resolve.hint_key(F.col("hint"))).alias("key"))
    for r in both.collect():
        if r.hint:
            assert bool(r.plain) == bool(r.key), r
