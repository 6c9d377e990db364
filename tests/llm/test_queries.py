"""The registered queries over the whole smallest tables: against their SQL, or against plain versions."""

import hashlib
import json
import os
import zlib

import numpy as np
import pytest

from loomgraph.llm import license_scan, queries
from loomgraph.llm.queries import as_files, tokenizer_path

from .test_text_operators import plain_base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = run(spark, name).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda frame: sorted(map(repr, frame[sorted(got.columns)].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_packing(spark, library, texts):
    frame = run(spark, "op2_packing")
    assert frame.columns[:8] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place"]
    by_doc, by_sequence = {}, {}
    for r in frame.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        ends = np.cumsum([0] + [r.length for r in sorted(rows, key=lambda r: r.offset)])
        assert sorted(r.offset for r in rows) == ends[:-1].tolist() and ends[-1] <= 2048
    assert sum(map(len, (library.encode(t, add_special_tokens=False).ids for t in texts.values()))) / (2048 * len(by_sequence)) > 0.9


def test_classifier(spark, texts):
    rows = run(spark, "op4_quality_classifier").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_secrets(spark, texts):
    rows = run(spark, "op5_secret_scan").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[0] == k for b in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= {*r.spans.split(","), *told} and set(told) - {""} <= set(r.spans.split(","))


def test_licences(spark, texts):
    rows = {r.doc_id: r for r in run(spark, "op6_license_scan").collect()}
    assert set(rows) == set(texts)
    paths = {r.doc_id: r.path for r in as_files(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    holders = {}
    for i, r in rows.items():
        if r.declared and "/LICENSE." in paths[i]:
            folder = paths[i].rpartition("/")[0]
            holders[folder] = min(holders.get(folder, (1, "", "")), (-r.cosine, paths[i], r.declared))
    for i, r in rows.items():
        if r.declared:
            assert r.license == r.declared and r.cosine >= license_scan.MIN_COSINE
            continue
        parts = paths[i].split("/")[:-1]
        near = next((holders["/".join(parts[:n])] for n in range(len(parts), -1, -1) if "/".join(parts[:n]) in holders), None)
        assert (r.license, r.inherited_from) == ((near[2], near[1]) if near else (None, None))


def test_token_files_and_counts(spark, library, texts):
    rows, at = run(spark, "op7_token_files").orderBy("start").collect(), 0
    assert [r.doc_id for r in rows] == sorted(texts)
    counts = {r.doc_id: r for r in run(spark, "op8_token_counts").collect()}
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += r.n_tokens
        c = counts[r.doc_id]
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len(texts[r.doc_id].encode()), len(ids), len(ids) > 512)


def test_columns_are_those_of_the_contract(spark):
    want = {
        "op3_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op5_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op8_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op9_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for name, columns in want.items():
        frame = run(spark, name)
        assert frame.columns == columns and "void" not in json.dumps([t for _, t in frame.dtypes])
