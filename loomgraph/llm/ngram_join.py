"""N-gram Jaccard self-join by chosen paths.

Texts are sets of ``SHINGLE`` consecutive normalised words (A-Z lower-cased; all
but digits, a-z and non-ASCII characters parts words; a text of fewer words is one
shingle).  Two texts are linked if their sets' Jaccard similarity is at least
``similarity``.

1. Texts with the same words become one class; only classes are joined.
2. Each set is embedded as ``BINS`` minima of its hashed shingles (one permutation,
   split in bins); the minima are its tokens.
3. A run starts with all classes in one bucket.  A bucket splits on sampled shared
   tokens: a class goes to the sub-bucket (path, token) of each token that a hash of
   path and token picks, with chance ``1 / (SPLIT_AT * tokens)``.  Buckets of one
   class end; those of at most ``SMALL`` are leaves, larger ones split again, up to
   ``DEPTH`` times, unless their members are so alike (``SPLIT_AT`` on average, by
   ``SAMPLE`` of them) that the sub-buckets would have no fewer pairs: these are leaves
   as they stand.  Runs repeat (``runs_for``) until a pair at the threshold has met in
   some leaf with the target recall.
4. Leaves with the same members are one leaf.  Large leaves that share most members,
   as those of a large group of near-copies do, are joined into one, which compares
   every pair that any of them would.
5. A leaf is brute-forced: all its pairs are compared by their minima first, with a
   margin of ``MARGIN`` standard deviations, then by their whole sets, exactly.  A
   pair that meets in several leaves is compared in the first of them only, which the
   classes' lists of leaves tell.  A leaf of more than ``BLOCK`` classes, or of
   ``BLOCK_SHINGLES`` shingles, is dealt out as pairs of blocks.
6. Between the comparisons goes one bit per pair of a leaf; what leaves them is, per
   class, its number of links and the least class of its component there: never a
   row per pair.  Components over these stars are merged by alternating star
   contractions, a written table per round.

A group of n different near-copies costs n * n / 2 comparisons, as its links are
counted one by one; they are spread over (n / BLOCK) ** 2 / 2 tasks, and each class
travels n / BLOCK times.

Defined results: texts without a word (null, empty) have no shingle and are linked
to nothing, not even to one another; each is a class of its own.  Rows with a null
id are returned with null class and 0 links.  Repeated rows are copies of one
another; rows that share an id but not the words are judged each on its own.  An
empty table gives an empty table; extra columns are not read.  One text's shingles
must fit a worker.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textscan import mix64, ragged, slices, span_hash, tidy, utf8
from .workspace import forget, keep

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
BINS, DEPTH, SMALL, SAMPLE, MARKS, MARGIN, SALTS = 128, 3, 200, 8, 4, 4.5, 32
#: Most classes and shingles, about, on either side of a comparison.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Rows of (path, two numbers) that are sent to all executors, 2.4 MB; more are joined by salted keys.
SENT = 100_000
#: Splits keep a little more than similarity 0.8 asks for, since the minima's similarity strays around the sets'.
SPLIT_AT = 0.7
_EMPTY = np.uint32(0xFFFFFFFF)
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def runs_for(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with chance ``recall`` even at full depth: each split keeps Poisson(similarity / SPLIT_AT) shared tokens."""
    mean = max(similarity - 0.04, 0.01) / SPLIT_AT  # a standard deviation of the minima's similarity less
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(mean * (lost - 1))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, one after another, and the offset of each text's (one more entry than texts).

    ``data`` is normalised: words with single blanks between, one blank at each end of a text.
    """
    blanks = np.flatnonzero(data == 0x20)
    first_blank = np.searchsorted(blanks, offsets)
    n_words = np.maximum(np.diff(first_blank) - 1, 0)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    if not ends[-1]:
        return np.empty(0, np.uint64), ends
    at = ragged(first_blank[:-1], n)
    span = np.repeat(np.minimum(n_words, size), n)
    return span_hash(data, blanks[at], blanks[at + span] + 1), ends


def normalised(raw: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Each text's normalised form, and all of them as one array with offsets."""
    raw = raw.translate(_NORMAL)
    texts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = raw[a:b].split()
        texts.append(b" " + b" ".join(own) + b" " if own else b"")
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return texts, np.frombuffer(b"".join(texts), np.uint8), ends


def embed(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text the least hash of each bin, _EMPTY where a bin has none."""
    out = np.full((len(ends) - 1) * BINS, _EMPTY, np.uint32)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    bin_ = (hashes >> np.uint64(57)).astype(np.int64)
    value = np.minimum((hashes >> np.uint64(20)).astype(np.uint32), _EMPTY - np.uint32(1))
    np.minimum.at(out, owner * BINS + bin_, value)
    return out.reshape(-1, BINS)


def _split(paths: np.ndarray, owner: np.ndarray, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sub-paths picked by each (path, row of minima) and which of the input paths they come from."""
    tokens = minima.astype(np.uint64) * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)
    token_hash = mix64(tokens + np.uint64(0x5851F42D4C957F2D))
    full = minima != _EMPTY
    most = (2.0**64 - 1) / (SPLIT_AT * np.maximum(full.sum(1), 1))
    most = np.minimum(most, 2.0**64 - 4096).astype(np.uint64)
    subs, source = [], []
    step = 4096
    for at in range(0, len(paths), step):
        own = owner[at : at + step]
        sub = mix64(token_hash[own] ^ mix64(paths[at : at + step] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[:, None])
        row, col = np.nonzero((sub <= most[own][:, None]) & full[own])
        subs.append(mix64(sub[row, col] + np.uint64(0xA0761D6478BD642F)))
        source.append(row + at)
    return np.concatenate(subs) if subs else np.empty(0, np.uint64), np.concatenate(source) if source else np.empty(0, np.int64)


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BINS)


def classes_of(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of the rows, key being null where there is no word, and (cid, key, rep, n, shingles, minima) of the classes; both are written tables."""
    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offs = utf8(batch.column(1))
            texts, data, ends = normalised(raw.tobytes(), offs)
            hashes, bounds = shingles(data, ends)
            keys, minima = [key_of(t) for t in texts], embed(hashes, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(bounds)), pa.array([m.tobytes() if k else None for m, k in zip(minima, keys, strict=True)], pa.binary())], ["doc_id", "key", "shingles", "minima"])

    members = keep(rows.mapInArrow(tidy(run), f"doc_id {id_type}, key binary, shingles long, minima binary"))
    classes = members.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("shingles").alias("shingles"), F.first("minima").alias("minima"))
    return members, keep(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "rep", "n", "shingles", "minima"), shuffled=True)


def key_of(text: bytes) -> bytes | None:
    """What tells a normalised text from others; null for one without a word."""
    return hashlib.blake2b(text, digest_size=16).digest() if text else None


def _level_one(classes: DataFrame, runs: int) -> DataFrame:
    """(path, cid, shingles) of the first splits of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                minima = _minima(part.column(2))
                for r in range(runs):
                    sub, source = _split(np.full(part.num_rows, r, np.uint64), np.arange(part.num_rows), minima)
                    taken = pa.array(source)
                    yield pa.RecordBatch.from_arrays([pa.array(sub.view(np.int64)), part.column(0).take(taken), part.column(1).take(taken)], ["path", "cid", "shingles"])

    return classes.select("cid", "shingles", "minima").mapInArrow(tidy(run), "path long, cid long, shingles long")


def _deeper(level: DataFrame, big: DataFrame, classes: DataFrame) -> DataFrame:
    """(parent, path, cid, shingles): the splits of the ``big`` buckets of the first level, whose parent is null, and the splits of those again."""
    own = _meet(level.withColumnRenamed("path", "parent"), big, "parent", "left_semi")
    paths = own.groupBy("cid").agg(F.collect_list("parent").alias("paths"))  # bounded by the runs and splits
    rows = paths.join(classes.select("cid", "shingles", "minima"), "cid").select("cid", "shingles", "minima", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists, minima = part.column(3), _minima(part.column(2))
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy().astype(np.int64))
                path, parent = lists.flatten().to_numpy().view(np.uint64), None
                for _ in range(DEPTH - 1):
                    sub, source = _split(path, owner, minima)
                    taken = pa.array(owner[source])
                    from_ = pa.nulls(len(sub), pa.int64()) if parent is None else pa.array(path[source].view(np.int64))
                    yield pa.RecordBatch.from_arrays([from_, pa.array(sub.view(np.int64)), part.column(0).take(taken), part.column(1).take(taken)], ["parent", "path", "cid", "shingles"])
                    path, parent, owner = sub, path, owner[source]

    return rows.mapInArrow(tidy(run), "parent long, path long, cid long, shingles long")


def _sizes(level: DataFrame) -> DataFrame:
    """(path, size, shingles, s, x) of the buckets of two classes or more; s and x tell sets of members apart."""
    member = F.xxhash64("cid")
    found = level.groupBy("path").agg(F.count("*").alias("size"), F.sum("shingles").alias("shingles"), F.sum(F.pmod(member, F.lit(1_000_003_579))).alias("s"), F.bit_xor(member).alias("x"))
    return keep(found.where("size > 1"), shuffled=True)


def _meet(level: DataFrame, paths: DataFrame, key: str = "path", how: str = "inner") -> DataFrame:
    """The rows of ``level`` in (or, left_anti, outside) the given large buckets, with the columns of ``paths`` (path, ...).

    Large buckets are few, and where that holds they are sent to the rows; else the rows
    are dealt out by a salt as well, for which the paths are repeated.
    """
    paths = paths.withColumnRenamed("path", key)
    if paths.limit(SENT + 1).count() <= SENT:
        return level.join(F.broadcast(paths), key, how)
    salt = F.pmod(F.xxhash64(F.col("cid")), F.lit(SALTS))
    salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return level.withColumn("salt", salt).join(salted, [key, "salt"], how).drop("salt")


def _drawn(level: DataFrame, large: DataFrame) -> DataFrame:
    """(path, size, shingles, m0 ..., drawn) of the large buckets: the least hashes of their members, and as many members."""
    hashed = [F.xxhash64("cid", F.lit(k)) for k in range(SAMPLE)]
    least = [F.min(h).alias(f"m{k}") for k, h in enumerate(hashed[:MARKS])]
    rows = _meet(level.select("path", "cid"), large.select("path"), how="left_semi")
    told = rows.groupBy("path").agg(*least, F.array(*(F.min_by("cid", h) for h in hashed)).alias("drawn"))
    return keep(told.join(large.select("path", "size", "shingles"), "path"), shuffled=True)


def _alike_ones(drawn: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, alike) of the large buckets; alike: splitting it would leave as many pairs."""
    asked = drawn.select("path", F.explode("drawn").alias("cid"))
    few = drawn.limit(SENT // SAMPLE + 1).count() <= SENT // SAMPLE
    told = classes.select("cid", "minima").join(F.broadcast(asked) if few else asked, "cid")
    told = told.groupBy("path").agg(F.collect_list("minima").alias("minima"))  # SAMPLE of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for own in batch.column(1).to_pylist():
                m = np.frombuffer(b"".join(own), np.uint32).reshape(-1, BINS)
                a, b = np.triu_indices(len(m), 1)
                used = np.maximum(((m[a] != _EMPTY) | (m[b] != _EMPTY)).sum(1), 1)
                alike.append(bool((((m[a] == m[b]) & (m[a] != _EMPTY)).sum(1) / used).mean() >= SPLIT_AT))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(alike)], ["path", "alike"])

    return keep(told.mapInArrow(tidy(run), "path long, alike boolean"), shuffled=True)


def leaves_of(classes: DataFrame, runs: int) -> tuple[DataFrame, list[DataFrame]]:
    """(path, cid, size, shingles): the leaves of all runs, with the numbers of each leaf; and the tables that they are read from."""
    level, large = keep(_level_one(classes, runs)), F.col("size") > SMALL
    levels, sizes, drawn, alike, deeper = [level], [], [], [], None
    for depth in range(1, DEPTH + 1):
        sizes.append(_sizes(levels[-1]))
        drawn.append(_drawn(levels[-1], sizes[-1].where(large)))
        if depth < DEPTH:
            alike.append(_alike_ones(drawn[-1], classes))
            split = alike[-1].where("NOT alike").select("path")
            if depth == 1:
                deeper = keep(_deeper(level, split, classes), shuffled=True)
                levels.append(deeper.where("parent IS NULL").drop("parent"))
            else:
                levels.append(keep(_meet(deeper.where("parent IS NOT NULL"), split, "parent", "left_semi").drop("parent")))
    every, found = _union(levels).select("path", "cid"), _union(sizes)
    # Small leaves, once each; rows of large buckets are left out before the others meet their leaves.
    small = found.where(~large).groupBy("size", "s", "x").agg(F.min("path").alias("path"), F.first("shingles").alias("shingles"))
    out = _meet(every, found.where(large).select("path"), how="left_anti").join(small.select("path", "size", "shingles"), "path")
    unsplit = [d.join(a.where("alike"), "path", "left_semi") for d, a in zip(drawn, alike, strict=False)] + drawn[-1:]
    names = keep(_joined(_union(unsplit)), shuffled=True)
    joined = _meet(every, names).select(F.col("to.path").alias("path"), "cid", F.col("to.size").alias("size"), F.col("to.shingles").alias("shingles"))
    return out.unionByName(joined), [level, deeper, *levels[2:], names, *sizes, *drawn, *alike]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _joined(large: DataFrame) -> DataFrame:
    """(path, to: path, size, shingles) of the large leaves; those that share most members go to the largest of them.

    Leaves that have the least hash of their members in common, and so a class, go
    together if two of three other least hashes agree as well.
    """
    numbers = ["path", "size", "shingles"]
    marks = [f"m{k}" for k in range(MARKS)]
    first = F.first(F.struct(*numbers, *marks[1:])).over(Window.partitionBy(marks[0]).orderBy(F.desc("size"), "path"))
    agree = sum((F.col(m) == F.col(f"first.{m}")).cast("int") for m in marks[1:])
    to = F.when(agree >= 2, F.struct(*(F.col(f"first.{c}").alias(c) for c in numbers))).otherwise(F.struct(*numbers))
    return large.withColumn("first", first).select("path", to.alias("to"))


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal values in the first ``n_keys`` (long) columns, as one batch each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy() for k in range(n_keys)])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if last is not None and (keys[0] != last).any():
            yield pa.concat_batches(held)
            held = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(a, b - a))
        last = keys[-1]
    if held:
        yield pa.concat_batches(held)


def _alike(code: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows may have sets as similar as that, by their bytes (255: an empty bin), as a square matrix."""
    m = len(code)
    if m <= 24:
        same = (code[:, None, :] == code[None, :, :]).sum(2, dtype=np.int64)
    else:
        same = np.zeros((m, m), np.uint8)  # BINS are few enough
        for column in np.ascontiguousarray(code.T):
            same += column[:, None] == column[None, :]
    empty = (code == 255).astype(np.float32)
    both = (empty @ empty.T).astype(np.int32)
    used = BINS - both
    margin = MARGIN * math.sqrt(similarity * (1 - similarity)) / np.sqrt(np.maximum(used, 1))
    return same.astype(np.int32) - both >= (similarity - margin) * used


def _met_before(lists: pa.ListArray, path: int) -> np.ndarray | None:
    """Which rows have a leaf before ``path`` in common."""
    size = lists.value_lengths().to_numpy().astype(np.int64)
    leaf, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
    known, at, times = np.unique(leaf, return_inverse=True, return_counts=True)
    use = (known[at] < path) & (times[at] > 1)
    if not use.any():
        return None
    column = np.cumsum((known < path) & (times > 1)) - 1
    member = np.zeros((len(size), int(column[-1]) + 1), np.float32)
    member[owner[use], column[at[use]]] = 1
    return member @ member.T > 0


def candidates(leaves: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(path, i, j, rank, key, rep, n, partners): per compared pair of blocks the classes with a pair that may be linked, and a bit for each of the group's ranks that is a partner of greater rank."""
    own = leaves.groupBy("cid").agg(F.collect_set(F.struct("path", "size", "shingles")).alias("at"))  # bounded by the runs and splits
    rows = own.join(classes.drop("shingles"), "cid").select("cid", "key", "rep", "n", "minima", F.sort_array("at.path").alias("leaves"), "at")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = _minima(batch.column(4))
            small = np.where(minima == _EMPTY, 255, minima % 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes() for m in small], pa.binary()) if k == 4 else c for k, c in enumerate(batch.columns)], batch.schema.names)

    rows = rows.mapInArrow(tidy(narrow), ", ".join(f"{k} {v}" for k, v in fields.items()))
    rows = rows.select("*", F.explode("at").alias("leaf")).select("cid", "key", "rep", "n", "minima", "leaves", "leaf.*")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid", "path"), blocks).cast("long"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("path", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), "block", "key", "rep", "n", "minima", "leaves")
    rows = rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_held = 0
        for group in _groups(batches, 3):
            m = group.num_rows
            if m < 2:
                continue
            path, i, j = (group.column(k)[0].as_py() for k in range(3))
            code = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint8).reshape(m, BINS)
            pair = np.triu(_alike(code, similarity), 1)
            if i != j:
                block = group.column(3).to_numpy()
                pair &= block[:, None] != block[None, :]
            if not pair.any():
                continue
            before = _met_before(group.column(8), path)
            if before is not None:
                pair &= ~before
            rank = np.flatnonzero(pair.any(0) | pair.any(1))
            if not len(rank):
                continue
            taken = pa.array(rank)
            bits = [b.tobytes() for b in np.packbits(pair[rank], axis=1)]
            held.append(pa.RecordBatch.from_arrays([*(group.column(k).take(taken) for k in range(3)), taken, *(group.column(k).take(taken) for k in (4, 5, 6)), pa.array(bits, pa.binary())], names))
            n_held += len(rank)
            if n_held > 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n_held = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    names = ["path", "i", "j", "rank", "key", "rep", "n", "partners"]
    return rows.mapInArrow(tidy(run), f"path long, i long, j long, rank long, key binary, rep {fields['rep']}, n long, partners binary")


def _bits(ids: DataFrame) -> tuple[bytes, int]:
    """A bitmap of the hashes ``h``: 16 bits an id, from 64 KB to 32 MB; more ids than that make it let more rows through, not lose any."""
    n = max(1, ids.count())
    width = min(28, max(19, math.ceil(math.log2(16 * n))))
    at = F.shiftrightunsigned("h", 64 - width)
    parts = ids.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767)).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = bytearray(1 << (width - 3))
    for row in parts.collect():  # the bitmap, in parts of 4 KB
        bits[row["part"] << 12 : (row["part"] + 1) << 12] = row["bits"]
    return bytes(bits), width


def _common(group: pa.RecordBatch, rank: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows a, rows b, common shingles) of the group's candidate pairs, in parts."""
    size = np.array([len(x) for x in own])
    vocabulary, at, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = times[at] > 1  # a shingle of one text only is common to none
    owner = np.repeat(np.arange(len(own)), size)[shared]
    column = np.cumsum(times > 1) - 1
    at = column[at[shared]]
    n = int(column[-1]) + 1
    bits = [np.unpackbits(np.frombuffer(b, np.uint8)) for b in group.column(7).to_pylist()]
    place = np.full(max(map(len, bits)), -1)
    place[rank] = np.arange(len(rank))
    pairs = [(r := place[np.flatnonzero(b)])[r >= 0] for b in bits]
    total = sum(map(len, pairs))
    if 16 * total >= len(own) ** 2 and len(own) * n <= 1 << 24:
        member = np.zeros((len(own), n), np.float32)
        member[owner, at] = 1
        a, b = np.repeat(np.arange(len(own)), [len(p) for p in pairs]), np.concatenate(pairs)
        yield a, b, (member @ member.T)[a, b].astype(np.int64)
        return
    first = np.searchsorted(owner, np.arange(len(own) + 1))
    mine = np.zeros(n, np.int64)
    for a, b in enumerate(pairs):
        if len(b):
            mine[at[first[a] : first[a + 1]]] = 1
            length = first[b + 1] - first[b]
            total = np.concatenate([[0], np.cumsum(mine[at[ragged(first[b], length)]])])
            upto = np.cumsum(length)
            yield np.full(len(b), a), b, total[upto] - total[upto - length]
            mine[at[first[a] : first[a + 1]]] = 0


def links(documents: DataFrame, pairs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(key, rep, n_class_links, n_doc_links, root_key, root_rep): exact links per comparison, and the least class of the component there."""
    bitmap, width = _bits(pairs.select(F.xxhash64("rep").alias("h")))
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)
    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - width)
            hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(hit == 1))
            for part in slices(iter([batch])):
                raw, offs = utf8(part.column(1))
                texts, data, ends = normalised(raw.tobytes(), offs)
                hashes, bounds = shingles(data, ends)
                own = [np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([key_of(t) for t in texts], pa.binary()), pa.array(own, pa.binary())], ["rep", "key", "own"])

    found = rows.mapInArrow(tidy(sets), f"rep {id_type}, key binary, own binary")
    wide = pairs.join(found, ["key", "rep"]).select("path", "i", "j", "rank", "key", "rep", "n", "partners", "own")
    wide = wide.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            rank = group.column(3).to_numpy()
            if (once := np.flatnonzero(np.diff(rank, prepend=-1))).size < len(rank):  # a repeated row of the input comes twice
                group, rank = group.take(pa.array(once)), rank[once]
            own = [np.frombuffer(s, np.uint64) for s in group.column(8).to_pylist()]
            size, weight, m = np.array([len(x) for x in own]), group.column(6).to_numpy(), len(rank)
            near, docs, root = np.zeros(m, np.int64), np.zeros(m, np.int64), np.empty(m, np.int64)
            name = list(zip(group.column(5).to_pylist(), group.column(4).to_pylist(), strict=True))
            by_name = np.array(sorted(range(m), key=name.__getitem__))
            root[by_name] = np.arange(m)
            ends = []
            for a, b, common in _common(group, rank, own):
                linked = common >= similarity * (size[a] + size[b] - common) - 1e-9
                a, b = a[linked], b[linked]
                near += np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
                np.add.at(docs, a, weight[b])
                np.add.at(docs, b, weight[a])
                ends.append(np.stack([a, b]))
            a, b = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), np.int64)
            while True:
                least = np.minimum(root[a], root[b])
                if (least == root[a]).all() and (least == root[b]).all():
                    break
                np.minimum.at(root, a, least)
                np.minimum.at(root, b, least)
            rows = np.flatnonzero(near)
            if len(rows):
                taken, top = pa.array(rows), pa.array(by_name[root[rows]])
                yield pa.RecordBatch.from_arrays([group.column(4).take(taken), group.column(5).take(taken), pa.array(near[rows]), pa.array(docs[rows]), group.column(4).take(top), group.column(5).take(top)], ["key", "rep", "n_class_links", "n_doc_links", "root_key", "root_rep"])

    return wide.mapInArrow(tidy(run), f"key binary, rep {id_type}, n_class_links long, n_doc_links long, root_key binary, root_rep {id_type}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (u, v), root being the component's least node.

    A round joins each node's greater neighbours, and then its lesser ones, to the least
    of its neighbourhood; the first round in which nothing moves ends it.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    last = None
    while True:
        # A node may have many greater neighbours: the least of them is found before they meet it.
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        # Lesser ones are few by now: the least nodes of different neighbourhoods.
        once = moved.repartition("u").groupBy("u", "v").agg(F.max("moved").alias("moved"))
        own = Window.partitionBy("u")
        once = once.select("u", "v", F.min("v").over(own).alias("m"), F.max("moved").over(own).alias("moved"))
        stays = F.col("v") == F.col("m")
        edges = keep(once.select(F.when(stays, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (~stays | F.col("moved")).alias("moved")), shuffled=True)
        if last is not None:
            forget(last)
        last = edges
        if edges.where("moved").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _judged(documents: DataFrame, similarity: float, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of the rows with an id, and per class (key, copy_id, n, n_class_links, n_doc_links, class_id, class_key), the last two null where it has no link."""
    members, classes = classes_of(documents, id_col, text_col)
    leaves, used = leaves_of(classes, runs_for(similarity, recall))
    pairs = keep(candidates(leaves, classes, similarity), shuffled=True)
    forget(*used)
    found = keep(links(documents, pairs, similarity, id_col, text_col), shuffled=True)
    forget(pairs)
    node = lambda key, rep: F.struct(F.col(rep).alias("rep"), F.col(key).alias("key"))
    group = components(found.select(node("key", "rep").alias("u"), node("root_key", "root_rep").alias("v")))
    none = F.lit(None)
    root_type = group.schema["root"].dataType.simpleString()
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_class_links", "n_doc_links")]
    parts = classes.select("key", F.col("rep").alias("copy_id"), "n", *zero, none.cast(root_type).alias("root"))
    id_type = classes.schema["rep"].dataType
    linked = found.select("key", none.cast(id_type).alias("copy_id"), none.cast("long").alias("n"), "n_class_links", "n_doc_links", none.cast(root_type).alias("root"))
    rooted = group.select("node.key", none.cast(id_type).alias("copy_id"), none.cast("long").alias("n"), *zero, "root")
    told = parts.union(linked).union(rooted).groupBy("key").agg(F.max("copy_id").alias("copy_id"), F.max("n").alias("n"), F.sum("n_class_links").alias("n_class_links"), F.sum("n_doc_links").alias("n_doc_links"), F.max("root").alias("root"))
    told = keep(told.select("key", "copy_id", "n", "n_class_links", "n_doc_links", F.col("root.rep").alias("class_id"), F.col("root.key").alias("class_key")), shuffled=True)
    forget(classes, found)
    return members.select("doc_id", "key"), told


def ngram_join(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, class_id, copy_id, n_links, n_class_links).

    class_id is the least id of its component of linked documents, copy_id the least id with the same words,
    n_links the number of other documents linked to it (copies too), n_class_links that of different texts.
    """
    members, told = _judged(documents, similarity, recall, id_col, text_col)
    zero = F.lit(0).cast("long")
    # Rows without a word meet no class; many of them would share the null key.
    worded = members.where(F.col("key").isNotNull()).join(told, "key")
    rows = worded.select(F.col("doc_id").alias(id_col), F.coalesce("class_id", "copy_id").alias("class_id"), "copy_id", (F.col("n") - 1 + F.col("n_doc_links")).alias("n_links"), "n_class_links")
    empty = members.where(F.col("key").isNull()).select(F.col("doc_id").alias(id_col), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), zero.alias("n_links"), zero.alias("n_class_links"))
    unnamed = documents.where(F.col(id_col).isNull()).select(F.col(id_col), F.col(id_col).alias("class_id"), F.col(id_col).alias("copy_id"), zero.alias("n_links"), zero.alias("n_class_links"))
    return rows.union(empty).union(unnamed)


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each group keeps the one with the least id.

    Rows that share an id but not the words are judged each on its own: an id may stay
    with several texts.  Of repeated rows one stays; rows without a word or an id all do.
    """
    _, told = _judged(documents, similarity, recall, id_col, text_col)
    kept = told.where(F.col("class_key").isNull() | (F.col("class_key") == F.col("key"))).select(F.col("key").alias("__key"), F.col("copy_id").alias("__id"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    at = documents.columns.index(text_col)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            raw, offs = utf8(batch.column(at))
            keys = [key_of(t) for t in normalised(raw.tobytes(), offs)[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "__key"])

    rows = documents.mapInArrow(tidy(keyed), f"{fields}, `__key` binary").withColumn("__id", F.col(id_col))
    judged = F.col("__key").isNotNull() & F.col("__id").isNotNull()
    one = rows.where(judged).join(kept, ["__key", "__id"], "left_semi").dropDuplicates(["__key", "__id"])
    return one.select(*documents.columns).union(rows.where(~judged).select(*documents.columns))
