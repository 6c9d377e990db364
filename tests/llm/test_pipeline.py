"""Each stage of the pipeline on its own input, and the whole run."""

import random
import zlib

import pytest

import corpus_pipeline
from loomgraph.llm.queries import tokenizer_path

from .test_ngram_join import plain as plain_groups
from .test_text_operators import plain_base, plain_hits, plain_quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    vocabulary = [f"word{i}" for i in range(500)]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = sentence(25)
    rows = []
    for i in range(30):
        rows.append((i, "\n".join(sentence(15) for _ in range(6))))
    rows.append((100, rows[3][1]))
    rows.append((101, rows[4][1] + " extra."))
    rows.append((102, rows[5][1] + "\n" + item))
    rows.append((103, rows[6][1].replace("word1", "token = abcdef0123456789 word1", 1) + "\n" + sentence(90)))
    rows.append((104, "!!! " + " ".join(f"{rnd.choice(vocabulary)}###" for _ in range(80))))
    rows.append((105, "short text"))
    rows.append((106, None))
    rows.append((107, ""))
    rows.append((108, sentence(20000)))
    rows.append((109, sentence(60) + "\na | b | c | d\nHome"))
    path = tmp_path_factory.mktemp("pipeline")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], columns).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), item


def test_stages(spark, folder):
    sf, item = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_join", "decontamination", "secret_scan", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [r for r in stage["quality_rules"](spark, docs, sf).collect()]
    given = {r.doc_id: r.text for r in docs.collect()}
    for i, text in given.items():
        if plain_quality(text)[5]:
            assert i not in {r.doc_id for r in kept}
    assert {r.doc_id for r in kept} == set(range(30)) | {100, 101, 102, 103, 108, 109}
    cleaned = {r.doc_id: r.text for r in kept}
    assert cleaned[109] == given[109].split("\n")[0] and cleaned[3] == given[3] and all(r.n_chars == len(r.text) for r in kept)

    docs = spark.createDataFrame(kept, docs.schema)
    kept = stage["ngram_join"](spark, docs, sf).collect()
    least = {i: c for i, c, _ in plain_groups(list(cleaned.items()))}
    assert sorted(r.doc_id for r in kept) == sorted(i for i, c in least.items() if i == c)
    assert {100, 101}.isdisjoint(r.doc_id for r in kept)

    docs = spark.createDataFrame(kept, docs.schema)
    kept = stage["decontamination"](spark, docs, sf).collect()
    clean = [r.doc_id for r in docs.collect() if not plain_hits(r.text, [("q1", item)], 10)[1]]
    assert sorted(r.doc_id for r in kept) == sorted(clean) and 102 not in clean

    docs = spark.createDataFrame(kept, docs.schema)
    kept = stage["secret_scan"](spark, docs, sf).collect()
    before = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) == len(before)
    for r in kept:
        assert not plain_base(r.text) and (r.text == before[r.doc_id]) == (not plain_base(before[r.doc_id])) and r.n_chars == len(r.text)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    packed = stage["packing"](spark, spark.createDataFrame(kept, docs.schema), sf).collect()
    assert {(r.doc_id, r.doc_tokens) for r in packed} == {(r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in kept}


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    ids = {r.doc_id for r in rows}
    assert ids.isdisjoint({100, 101, 102, 104, 105, 106, 107}) and {0, 3, 4, 108, 109} <= ids
    assert sum(r.length for r in rows if r.doc_id == 108) == next(r.doc_tokens for r in rows if r.doc_id == 108)


def test_run_returns_the_sequences(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    whole = {r.sequence_id: r.input_ids for r in rows if r.place == 0}
    assert {r.sequence_id for r in rows} == set(whole)
    for r in rows:
        assert zlib.crc32(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32
