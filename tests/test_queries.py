"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from loomgraph.plans import catalog

SF = "/root/testdata/sf0.001"
FAST = ("content_chunks", "content_search", "symbol_search", "callers_named", "resolve_imports", "interface_dispatch", "event_dispatch", "upsert_edges", "delta_inventory", "recaps", "memory_search", "quality", "materialize_routes")


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = (frame[c].round(6) if frame[c].dtype.kind == "f" else frame[c]).astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from '{SF}/{file}'")
    got, want = normal(catalog.QUERIES[name](spark, SF).toPandas()), normal(con.execute(catalog.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_registry_imports_without_the_optional_part():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); sys.modules['loomgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'content_search' in q and not any(n.startswith('op') for n in q); assert 'pipeline' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A session started elsewhere, without this repository on its path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {os.path.join(root, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from loomgraph.plans.shipping import ship
from loomgraph.sources import extract
ship(spark)
rows = spark.createDataFrame([("a.py", "python", "def f(): g()")], "path string, language string, source string")
print("calls", extract.extract(rows).first().calls[0].callee_name)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "calls g" in done.stdout, done.stderr[-2000:]
