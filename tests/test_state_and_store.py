import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import epochs, state
from loomgraph.sources import project
from loomgraph.streaming import watch


def empty(spark, name):
    return spark.createDataFrame([], state.SCHEMAS[name])


def test_sessions(spark):
    w = state.create_workspace(empty(spark, "workspaces"), "w1", " Main ", 1)
    w = state.rename_workspace(state.create_workspace(w, "w2", "Two", 2), "w1", "First", 3)
    assert [(r.id, r.name) for r in state.listed(w).collect()] == [("w1", "First"), ("w2", "Two")]
    s = state.create_session(empty(spark, "sessions"), w, "s1", "w1", "T", 5)
    with pytest.raises(state.StateError):
        state.create_session(s, w, "s2", "none", "T", 5)
    new = spark.createDataFrame([("e1", "s1", "note", "one", 10), ("e2", "s1", "note", "two", 11), ("x", "gone", "note", "no", 1)], "id string, session_id string, kind string, body string, created_at_ms long")
    events, s = state.append_events(empty(spark, "session_events"), s, new)
    more = spark.createDataFrame([("e3", "s1", "plan", "three", 12)], new.schema)
    events, s = state.append_events(events, s, more)
    assert [(r.sequence, r.body) for r in state.session_events(events, "s1").collect()] == [(1, "one"), (2, "two"), (3, "three")]
    s = state.complete_session(state.complete_session(s, "s1", 20), "s1", 30)
    assert (s.first().status, s.first().ended_at_ms, s.first().updated_at_ms) == ("completed", 20, 30)
    assert state.append_events(events, s, more)[0].count() == 3
    texts = state.recap_texts(s, events)
    assert texts.first().summary == "- [note] one\n- [note] two\n- [plan] three" and texts.first().event_count == 3
    first = state.save_recaps(empty(spark, "recaps"), texts, 40)
    again = state.save_recaps(first, texts, 50).first()
    assert (again.id, again.created_at_ms, again.updated_at_ms) == (first.first().id, 40, 50)
    assert state.recap_texts(s, events.limit(0)).first().summary == state.NO_EVENTS
    assert state.get(w, "w2").name == "Two" and state.get(s, "s1").title == "T" and state.get(first, "s1", "session_id").event_count == 3
    with pytest.raises(state.StateError):
        state.get(w, "none")


def test_memories(spark):
    w = state.create_workspace(empty(spark, "workspaces"), "w", "W", 1)
    m = state.remember(empty(spark, "memories"), w, "m1", "w", "body", ["a", "a", "b"], 1)
    assert m.first().tags == ["a", "b"] and state.forget(m, "m1").count() == 0
    for bad in (["x" * 200], ["t"] * 33, [" "]):
        with pytest.raises(state.StateError):
            state.remember(m, w, "m2", "w", "body", bad, 1)


def test_truncation_at_characters(spark):
    texts = ["a" * 9, "é" * 9, "中" * 9, "😀" * 9, "aé中😀" * 3, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(0, 12):
        got = [r.x for r in df.select(state.truncate_utf8(F.col("t"), most).alias("x")).collect()]
        assert got == [t.encode()[:most].decode(errors="ignore") for t in texts]


def test_epochs(spark, tmp_path):
    store = epochs.EpochStore(spark, str(tmp_path / "store"))
    table = lambda *ids: spark.createDataFrame([(i, f"f{i}") for i in ids], "id int, file string")
    assert store.epoch == 0
    assert store.publish({"t": table(1, 2)}, 0) == 1
    pinned = store.meta()
    assert store.publish({"t": table(3)}, 1) == 2
    assert sorted(r.id for r in store.read("t", pinned).collect()) == [1, 2] and [r.id for r in store.read("t").collect()] == [3]
    with pytest.raises(epochs.EpochError):
        store.publish({"t": table(4)}, 1)
    assert [r.id for r in store.read("t").collect()] == [3]
    tries = []

    def work(epoch):
        tries.append(epoch)
        return store.publish({"t": table(5)}, epoch - (len(tries) == 1))

    assert store.with_retry(work) == 3 and len(tries) == 2
    store.backup(str(tmp_path / "copy"))
    assert [r.id for r in epochs.EpochStore(spark, str(tmp_path / "copy")).read("t").collect()] == [5]
    store._replace("current.json", json.dumps({"epoch": 9, "tables": {}, "schema_version": 99}))
    with pytest.raises(epochs.EpochError):
        store.meta()
    store._replace("current.json", "{")
    with pytest.raises(epochs.EpochError):
        store.meta()
    assert store.quarantine() and store.epoch == 0


def test_one_of_two_writers_wins(spark, tmp_path):
    stores = [epochs.EpochStore(spark, str(tmp_path / "store")) for _ in range(4)]
    ends = []

    def write(k):
        try:
            ends.append(stores[k].publish({"t": spark.range(k, k + 1)}, 0))
        except epochs.EpochError:
            ends.append(None)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(ends, key=str) == [1, None, None, None] and stores[0].epoch == 1 and stores[0].read("t").count() == 1
    stores[0]._claim(2)  # a writer that died
    with pytest.raises(epochs.EpochError):
        stores[1].publish({"t": spark.range(9)}, 1)
    stores[1].repair()
    assert stores[1].publish({"t": spark.range(9)}, 1) == 2


def test_backup_and_restore(spark, tmp_path):
    store, copy, other = (epochs.EpochStore(spark, str(tmp_path / n)) for n in ("store", "copy", "other"))
    store.publish({"t": spark.range(3)}, 0)
    store.backup(copy.root)
    assert copy.validate() == {"t": 3}
    assert other.restore(copy.root) == 1 and other.read("t").count() == 3
    store.publish({"t": spark.range(8)}, 1)
    with pytest.raises(epochs.EpochError):
        store.restore(copy.root)
    assert store.restore(copy.root, force=True) == 3 and store.read("t").count() == 3
    with pytest.raises(epochs.EpochError):
        store.restore(str(tmp_path / "none"))
    copy._fs.delete(copy._path(copy.meta()["tables"]["t"]), True)
    with pytest.raises(epochs.EpochError):
        copy.validate()


def test_edges_of_deleted_files(spark):
    symbols = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, file string")
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "c", "z"), ("c", "c", "y")], "source_id string, target_id string, evidence_file string")
    gone = spark.createDataFrame([("y",)], "path string")
    assert [tuple(r) for r in epochs.drop_edges_of(edges, symbols, gone).collect()] == [("c", "c", "z")]


def test_fingerprint_ignores_order_and_spans(spark):
    rows = [("f", "a", 1), ("f", "b", 2)]
    make = lambda x: epochs.fingerprint(spark.createDataFrame(x, "file string, name string, start_byte long")).first().semantic_fingerprint
    assert make(rows) == make([("f", "b", 7), ("f", "a", 9)]) != make([("f", "b", 7), ("f", "c", 9)])


def test_tree(spark, tmp_path):
    root = tmp_path / "p"
    files = {"src/a.py": b"x", "src/.hidden.ts": b"y", "node_modules/m.js": b"z", "build/keep.py": b"k", "gen/g.py": b"g", "logs/l.py": b"l", "logs/keep.py": b"k", "README.md": b"# T", "bad.md": b"\xff\xfe", "nul.txt": b"a\0b", "src/l.rs": b"ok \xff\n\xfe!", "Makefile": b"all:", "x.bin": b"1", "big.py": b"#" * (1 << 20) + b"##", "my.tpl": b"t"}
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    tree = project.tree(spark, str(root)).cache()
    config = project.ProjectConfig.parse('{"extensions": {".tpl": "php"}, "exclude": ["gen/**"], "include": ["logs/keep.py"]}')
    rules = project.ignore_rules("logs/\n# no\n!README.md\n")
    got = {r.path: (r.language, r.source) for r in project.project_files(tree, config, rules).collect()}
    assert got == {"src/a.py": ("python", "x"), "src/.hidden.ts": ("typescript", "y"), "src/l.rs": ("rust", "ok  \n !"), "logs/keep.py": ("python", "k"), "my.tpl": ("php", "t")}
    content = {r.path: r.format for r in project.content_files(tree, rules).collect()}
    assert content["README.md"] == "document" and content["Makefile"] == "text" and content["gen/g.py"] == "python"
    assert not {"bad.md", "nul.txt", "x.bin", "big.py", "logs/l.py", "my.tpl"} & set(content)
    for bad in ("[]", '{"extensions": {"x": "nope"}}', '{"exclude": "a"}', "{"):
        with pytest.raises(project.ConfigError):
            project.ProjectConfig.parse(bad)


def test_delta(spark):
    make = lambda x: spark.createDataFrame(x, "path string, content_hash string")
    seen, indexed = make([("a", "1"), ("b", "2"), ("n", "3")]), make([("a", "1"), ("b", "0"), ("d", "4")])
    assert {r.path: r.change for r in project.delta(seen, indexed).collect()} == {"b": "changed", "n": "added", "d": "deleted"}
    assert {r.path: r.change for r in project.delta(seen, indexed, force=True).collect()}["a"] == "changed"


def test_sync_and_watch(spark, tmp_path):
    store = epochs.EpochStore(spark, str(tmp_path / "store"))
    make = lambda x: spark.createDataFrame(x, "path string, content_hash string, text string")
    build = lambda f: {"t": f.select(F.col("path").alias("file"), F.upper("text").alias("text"))}
    run = lambda rows: watch.sync(store, make(rows), build, {"t": "file"})
    assert run([("a", "1", "x"), ("b", "1", "y")]) == 1
    assert run([("a", "1", "x"), ("b", "1", "y")]) == 1
    assert run([("a", "2", "z"), ("c", "1", "w")]) == 2
    assert sorted(map(tuple, store.read("t").collect())) == [("a", "Z"), ("c", "W")]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "f.txt").write_text("one")
    calls = []
    query = watch.watch(spark, str(folder), lambda: calls.append(1) or 1, str(tmp_path / "cp"), once=True)
    query.awaitTermination(60)
    assert calls == [1]
    query = watch.watch(spark, str(folder), lambda: calls.append(1) or 1, str(tmp_path / "cp"), once=True)
    query.awaitTermination(60)
    assert calls == [1]


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:20:00", "b")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "e"))
    query = watch.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.event_type, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
