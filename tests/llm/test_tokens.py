"""Packing, token files and token counts against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, packing, token_counts, token_files
from loomgraph.llm.workspace import shared_folder

from .conftest import ODD


@pytest.fixture(scope="module")
def library(bpe_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_path)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(5)
    marks = list("ab's tmdrevlTl1 2'\n\t\r\x0b\x85\xa0!?-é€ßʼ　​٣²½,'\x1c\x00中") + [" "] * 6 + ["'ll", "'re", "\n\n", "  ", "<|endoftext|>", "aaaa"]
    return ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]


def test_encoder_gives_the_librarys_ids(bpe_path, library, odd_texts):
    ids, ends = bpe.Encoder(bpe_path).encode(odd_texts)
    for i, text in enumerate(odd_texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_forgets_and_goes_on(bpe_path, library, odd_texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    encoder = bpe.Encoder(bpe_path)
    for at in range(0, 400, 40):
        ids, ends = encoder.encode(odd_texts[at : at + 40])
        assert ids.tolist() == [t for x in odd_texts[at : at + 40] for t in library.encode(x, add_special_tokens=False).ids]


def test_encoder_tells_words_with_equal_hashes_apart(bpe_path, library, odd_texts):
    """Rows whose hash is taken by another word are encoded anew."""
    encoder = bpe.Encoder(bpe_path)
    encoder.encode(odd_texts[:50])
    size = encoder._points.n
    encoder._hashes = np.sort(encoder._hashes)
    encoder._old, encoder._new = (encoder._hashes, np.arange(size)[::-1].copy()), (np.empty(0, np.uint64), np.empty(0, np.int64))
    ids, _ = encoder.encode(odd_texts[:80])
    assert ids.tolist() == [t for x in odd_texts[:80] for t in library.encode(x, add_special_tokens=False).ids]


def test_merger_counts_as_the_library(bpe_path, library, odd_texts):
    texts = odd_texts + ["a" * n for n in range(40)] + ["ab" * 500]
    assert token_counts.Counter(bpe_path).count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_rows(spark, odd_documents, no_documents, bpe_path, library):
    got = sorted(map(tuple, token_counts.token_counts(odd_documents, bpe_path, 512).collect()))
    want = []
    for i, t in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.token_counts(no_documents, bpe_path).count() == 0


def test_token_files_round_trip(spark, odd_documents, no_documents, bpe_path, library):
    folder = shared_folder(spark, "test")
    files = token_files.write_token_files(odd_documents, folder, bpe_path, end_id=2, length=16)
    got = sorted(map(tuple, token_files.read_token_files(files).collect()))
    by_id = {}
    for i, t in ODD:
        by_id.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r[0] for r in got] == sorted(i for i, _ in ODD)
    at = 0
    for i, start, n, code in got:
        assert start == at
        at += n
        assert (n, code) in [(len(x), crc(x)) for x in by_id[i]]
    assert token_files.token_files(no_documents, bpe_path).count() == 0
    first = files.orderBy("part").first()
    reader = token_files.TokenFile(first["path"])
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 16
    assert ids[mask].tolist() == reader.ids(0, int(mask.sum())).tolist()


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_token_files_take_any_id(spark, bpe_path, library, kind):
    texts = ["one", "two words", None, "four of them here"]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "n long, body string")
    key = {"string": F.concat(F.lit("d"), F.col("n").cast("string")), "int": F.col("n").cast("int"), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("n").cast("int"))}[kind]
    got = token_files.token_files(docs.select(key.alias("name"), "body"), bpe_path, id_col="name", text_col="body")
    assert got.columns == ["name", "start", "n_tokens", "ids_crc32"] and got.schema["name"].dataType.simpleString() == kind
    rows = got.orderBy("name").collect()
    assert [r.ids_crc32 for r in rows] == [crc(library.encode(t or "", add_special_tokens=False).ids + [2]) for t in texts]
    with_null = docs.select(F.when(F.col("n") > 1, key).alias("name"), "body")
    assert token_files.token_files(with_null, bpe_path, id_col="name", text_col="body").where("name IS NULL").count() == 1


def test_compositions_fill_the_window():
    assert sorted(packing.compositions(6, 3)) == sorted({tuple(sorted((a, b, c), reverse=True)[: 3 - (a, b, c).count(0)]) for a in range(7) for b in range(7) for c in range(7) if a + b + c == 6})


def test_nnls_solves():
    rnd = np.random.default_rng(1)
    a, x = rnd.random((12, 8)), np.array([0, 2, 0, 1, 3, 0, 0, 5.0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = rnd.normal(size=12)
    got = packing.nnls(a, b)
    gain = a.T @ (b - a @ got)
    assert (got >= 0).all() and gain.max() < 1e-6 and np.abs(gain[got > 0]).max(initial=0) < 1e-6


def test_plan_uses_every_piece_once():
    rnd = np.random.default_rng(2)
    for _ in range(5):
        h = rnd.integers(0, 50, 33) * (rnd.random(33) < 0.6)
        h[0] = 0
        used = np.zeros(33, int)
        for parts, n in packing.plan(h):
            assert sum(parts) <= 32 and n > 0
            np.add.at(used, list(parts), n)
        assert (used == h).all()
    assert packing.plan(np.zeros(9, int)) == []


@pytest.mark.parametrize("window", [64, 2048])
def test_pack(spark, odd_documents, no_documents, bpe_path, library, window):
    packed = packing.pack(odd_documents, bpe_path, window=window, end_id=1, with_ids=True).cache()
    rows = packed.collect()
    docs = {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length > 0
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in ODD]
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    for i, ids in want:
        own = sorted(docs[i, len(ids)], key=lambda r: r.start)
        assert {r.start for r in own} == set(range(0, len(ids), window))
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in own if (i, len(ids)) != (6, 2))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    out = packing.sequences(packed, window).collect()
    assert {(r.sequence_id, r.n_ids) for r in out} == {(k, sum(n for _, n in v)) for k, v in by.items()}
    assert all(len(r.input_ids) == 4 * (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else window) for r in out)
    assert packing.pack(no_documents, bpe_path).count() == 0


@pytest.mark.parametrize("window", [64, 2048])
def test_rows_are_read_from_padded_sequences(spark, odd_documents, no_documents, bpe_path, window):
    made = packing.pack_sequences(odd_documents, bpe_path, window=window).cache()
    rows = packing.read_back(made, with_sequences=True).collect()
    plain = packing.pack(odd_documents, bpe_path, window=window)
    assert sorted(map(tuple, packing.read_back(made).select(*plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    whole = {r.sequence_id: np.frombuffer(r.input_ids, "<u4") for r in rows if r.place == 0}
    assert len(whole) == len({r.sequence_id for r in rows}) and all((r.input_ids is None) == (r.place > 0) for r in rows)
    for k, ids in whole.items():
        own = [r for r in rows if r.sequence_id == k]
        n = sum(r.length for r in own)
        assert len(ids) == (n if n & (n - 1) == 0 else window) and not ids[n:].any()
        assert all(crc(ids[r.offset : r.offset + r.length]) == r.ids_crc32 for r in own)
    assert packing.read_back(packing.pack_sequences(no_documents, bpe_path)).count() == 0


def test_pack_pads_little(spark, bpe_path):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, "word " * int(rnd.expovariate(1 / 500))) for i in range(1500)], "doc_id long, text string")
    rows = packing.pack(docs, bpe_path, window=2048).collect()
    tokens, windows = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert tokens / (windows * 2048) > 0.97
