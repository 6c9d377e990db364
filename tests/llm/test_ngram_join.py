"""The chosen-path join against all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import ngram_join

from .conftest import ODD


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs, similarity=0.8):
    sets = [shingle_set(t) for _, t in docs]
    n = len(docs)
    near = [[x for x in range(n) if x != y and sets[x] and sets[y] and len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y]) - 1e-9] for y in range(n)]
    out = []
    for y in range(n):
        seen, todo = {y}, [y]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out.append((docs[y][0], min(docs[x][0] for x in seen), len(near[y])))
    return sorted(out)


def near_copies(seed=1, groups=12, size=9):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, passage = [], " ".join(rnd.choice(vocabulary) for _ in range(8))
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 12, 60, 150]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            docs.append(" ".join(own) + rnd.choice(["", ".", " " + passage]))
    return list(enumerate(docs))


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("cid", F.lit(1)).repartition(3)
    return sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df, **options).collect())


def test_all_links_are_found(spark):
    docs = near_copies()
    assert run(spark, docs) == plain(docs)


def test_large_buckets_split_and_blocks_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    docs = near_copies(seed=2, groups=3, size=30)
    assert run(spark, docs) == plain(docs)


def test_odd_rows(spark, odd_documents, no_documents):
    got = {r.doc_id: r for r in ngram_join.ngram_join(odd_documents).collect()}
    assert {r: got[r].n_links for r in (2, 3, 7)} == {2: 0, 3: 0, 7: 0} and got[2].class_id == 2
    six = [r for r in ngram_join.ngram_join(odd_documents).collect() if r.doc_id == 6]
    assert sorted(r.n_links for r in six) == [0, 1, 1]
    assert ngram_join.ngram_join(no_documents).count() == 0
    with_null = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.class_id, r.n_links) for r in ngram_join.ngram_join(with_null).collect()) == [(False, 1, 0), (True, None, 0)]
    kept = ngram_join.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    # Of repeated rows one stays; the texts that share an id but not the words all do, as do wordless ones.
    worded = {(i, " ".join(words(t))) for i, t in ODD if words(t)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, _ in worded] + [i for i, t in ODD if not words(t)])


def test_components_on_random_graphs(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = list(range(200))

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in nodes}


def test_runs_reach_the_recall():
    assert ngram_join.runs_for(0.8, 0.999) > ngram_join.runs_for(0.9, 0.999) >= 1


def test_embedding_estimates_similarity():
    rnd = np.random.default_rng(3)
    h = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = h[:2700], h[300:]
    m = ngram_join.embed(np.concatenate([a, b]), np.array([0, 2700, 5400]))
    assert abs((m[0] == m[1]).mean() - 0.8) < 0.15
