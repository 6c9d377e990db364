"""Hashed word n-gram logistic regression, trained by follow the regularised leader.

A text is cut into tokens: runs of letters and digits, runs of other marks.  Its
features are the token and token-pair hashes in ``2 ** BITS`` buckets, a pair whose
first token is a word that comes again at once or after one other token having one
bucket of its own whatever the word, each with its share of all features as value.  Training goes over at most ``TRAIN_ROWS``
labelled rows (per label the half with the lowest hashes of their id) in one
task and follows the proximal update with per-coordinate rates; a model is an
array of ``2 ** BITS`` floats (1 MB).  A score is the sparse dot product of a
whole text's features with it.

Only labels of rows that are not held out are read.  Labels, language, source and
id are never features; the id's hash only chooses and orders the sample.

Defined results: null and empty texts have no features and score the intercept;
labels that contradict each other are averaged and rounded; a label without a
document is unused; without any label of either kind all scores are 0.5; repeated
rows are scored alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import SPACES, mix64, slices, span_hash, utf8

BITS = 18
TRAIN_ROWS = 4096
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.1
SCALE = 8.0
#: Ids whose crc32 leaves this remainder by 4 are held out.
HELD_OUT = 2

_KIND = np.ones(256, np.uint8)  # 0 white space, 1 marks, 2 letters and digits
_KIND[SPACES] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 2
_SAME = np.uint32((1 << BITS) - 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts, one after another, and the offset of each text's (one more entry than texts)."""
    if not len(data):
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = edge.copy()
    change[1:-1] |= kind[1:] != kind[:-1]
    bounds = np.flatnonzero(change)
    if bounds[-1] != len(data):
        bounds = np.append(bounds, len(data))
    word = kind[bounds[:-1]] != 0
    starts, ends = bounds[:-1][word], bounds[1:][word]
    h = span_hash(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    single = (h >> np.uint64(64 - BITS)).astype(np.uint32)
    pair = (mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(64 - BITS)).astype(np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inner = owner[:-1] == owner[1:]  # pairs within one text
    pair[h[:-1] == h[1:]] = _SAME
    over = (h[:-2] == h[2:]) & (owner[:-2] == owner[2:]) & (kind[starts[:-2]] == 2)  # a word again after a mark
    pair[:-1][over] = _SAME
    out = np.empty((len(h), 2), np.uint32)
    out[:, 0] = single
    out[:-1, 1] = pair
    keep = np.ones((len(h), 2), bool)
    keep[:-1, 1] = inner
    keep[-1:, 1] = False
    total = np.concatenate([[0], np.cumsum(keep.sum(1))])
    return out[keep], total[first]


def fit(examples: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights by the per-coordinate proximal update; the last entry past the buckets is the intercept."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    compact = []
    for buckets, label in examples:
        at, count = np.unique(buckets, return_counts=True)
        compact.append((np.append(at, size - 1), np.append(SCALE * count / max(len(buckets), 1), 1.0), label))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(compact)):
            at, x, label = compact[i]
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            rate = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - rate * w
            n[at] += gradient**2
    return weights(np.arange(size)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The weights, fitted in one task on a bounded sample."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(label_col)).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(*order).limit(TRAIN_ROWS // 2)
        sample = part if sample is None else sample.union(part)
    # At most TRAIN_ROWS ids: small enough to be sent everywhere.
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("order", F.xxhash64("id")).select("id", "order", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in slices(batches):
            buckets, ends = features(*utf8(batch.column(3)))
            for i, (key, order, label) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True)):
                rows.append((order, str(key), label, buckets[ends[i] : ends[i + 1]]))
        rows.sort(key=lambda r: r[:2])
        yield pa.RecordBatch.from_pydict({"weights": [fit([(b, y) for _, _, y, b in rows]).tobytes()]})

    fitted = texts.repartition(1).mapInArrow(run, "weights binary").first()
    return np.frombuffer(fitted["weights"], np.float32) if fitted else fit([])


def score(documents: DataFrame, weights: np.ndarray, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (id_col, held_out, score, predicted), without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    rows = documents.select(F.col(id_col), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches):
            buckets, ends = features(*utf8(batch.column(1)))
            total = np.concatenate([[0.0], np.cumsum(w[buckets], dtype=np.float64)])
            n = np.diff(ends)
            z = w[-1] + SCALE * (total[ends[1:]] - total[ends[:-1]]) / np.maximum(n, 1)
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **columns: str) -> DataFrame:
    """Trains on the labels that aren't held out and scores every document."""
    label = {"label_col": columns.pop("label_col")} if "label_col" in columns else {}
    return score(documents, train(documents, labels, **columns, **label), threshold, **columns)
