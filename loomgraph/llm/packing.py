"""Packing token pieces into fixed windows by non-negative least squares.

Lengths are counted in units of ``UNIT`` tokens.  All ways of filling a window
exactly with at most ``DEPTH`` pieces are the columns of a matrix; non-negative
least squares finds how often to use each so that the pieces used match the
length histogram.  Repeat counts are rounded and cut to what there is; what
remains is packed greedily, largest first, on the histogram.  So the plan is a
short list of (composition, repeat count), however many pieces there are: only
the histogram (one count per length class) reaches the driver.

Each piece then finds its sequence from its rank within its length class.  Ranks
are made of a running number within the partition and the counts of the
partitions before, hence no class is gathered in one task.

The ids go along, compressed on the way; those of a sequence are laid end to end
and padded with 0 to the window, except where they number a power of two.  What is
told of a piece is read back from its sequence.

Defined results: a null text counts as empty; a document that ends on a window's
border has no empty piece; equal ids are kept apart; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, texts_of
from .textscan import slices, tidy
from .workspace import keep

UNIT, DEPTH = 8, 3
#: Sequences that a worker builds at a time.
BLOCK = 256


def compositions(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``depth`` positive parts that sum to ``units``."""

    def rest(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for k in range(min(left, most), 0, -1):
                if k * parts < left:
                    break
                for tail in rest(left - k, k, parts - 1):
                    yield (k, *tail)

    return list(rest(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |ax - b| with x >= 0."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        passive[best] = True
        while True:
            own = np.flatnonzero(passive)
            part = a[:, own]
            try:
                z = np.linalg.solve(part.T @ part, part.T @ b)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(part, b, rcond=None)[0]
            if z.min(initial=1) > 0:
                break
            at = own[z <= 0]
            step = np.min(x[at] / (x[at] - z[z <= 0] + 1e-300))
            x[own] += step * (z - x[own])
            x[own[x[own] <= 1e-12]] = 0
            passive &= x > 0
            if not passive.any():
                break
        x[:] = 0
        if not passive.any():
            break
        x[own] = z
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(composition, repeats) that use each length class exactly as often as ``histogram[units]`` says."""
    units = len(histogram) - 1
    left = np.asarray(histogram, np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...], most: int) -> None:
        need = np.bincount(parts, minlength=units + 1)
        n = int(min(most, (left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left[:] -= n * need
            out.append((parts, n))

    if left[units]:
        take((units,), int(left[units]))
    scale = float(left.max(initial=0))
    if scale > 0:
        combos = [c for c in compositions(units, depth) if len(c) > 1 and all(left[k] for k in c)]
        if combos:
            a = np.zeros((units + 1, len(combos)))
            for j, c in enumerate(combos):
                np.add.at(a[:, j], list(c), 1)
            # A long piece left over costs a window's padding, a short one little.
            weight = 0.1 + 0.9 * np.arange(units + 1) / units
            x = nnls(a * weight[:, None], left / scale * weight) * scale
            for j in np.argsort(-x, kind="stable"):
                if x[j] < 0.5:
                    break
                take(combos[j], int(np.floor(x[j] + 0.5)))
    while left.any():
        parts, spare, have = [], units, left.copy()
        while spare and have[1 : spare + 1].any():
            k = int(np.flatnonzero(have[: spare + 1])[-1])
            parts.append(k)
            have[k] -= 1
            spare -= k
        take(tuple(parts), int(left.max()))
    return out


def slots(steps: list[tuple[tuple[int, ...], int]], units: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length class, by rank: (first rank, first sequence, place in it) of each run of slots."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(units + 1)]
    used, sequence = [0] * (units + 1), 0
    for parts, n in steps:
        for place, k in enumerate(parts):
            runs[k].append((used[k], sequence, place))
            used[k] += n
        sequence += n
    return [tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) if r else (np.zeros(0, np.int64),) * 3 for r in runs]


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def pieces(documents: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into whole windows and a rest, with its length class and running number in its partition; ``ids`` are compressed."""
    rows = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema[id_col].dataType.simpleString()
    units = -(-window // UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compress = encoder(tokenizer_path).encode, _codec().compress
        part, seen = TaskContext.get().partitionId(), np.zeros(units + 1, np.int64)
        for batch in slices(batches):
            ids, ends = encode(texts_of(batch.column(1)))
            owner, start, length, crc, total, raw = [], [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[ends[i] : ends[i + 1]], end_id).astype("<u4")
                for at in range(0, len(own), window):
                    piece = own[at : at + window].tobytes()
                    owner.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(own))
                    raw.append(compress(piece, asbytes=True) if with_ids else None)
            size = -(-np.array(length, np.int64) // UNIT)
            order = np.argsort(size, kind="stable")
            by_size = size[order]
            number = np.empty(len(size), np.int64)
            number[order] = np.arange(len(size)) - np.searchsorted(by_size, by_size) + seen[by_size]
            seen += np.bincount(size, minlength=units + 1)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total)), pa.array(np.full(len(size), part, np.int64)), pa.array(size), pa.array(number)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "units", "number"]
            if with_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(tidy(run), f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, part long, units long, number long" + ", ids binary" * with_ids)


def assign(made: DataFrame, window: int, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and the offset in it to ``pieces`` rows, which must be stable (read from a written table)."""
    units = -(-window // UNIT)
    per_part = made.groupBy("part", "units").agg(F.count("*").alias("n"))
    histogram = np.zeros(units + 1, np.int64)
    for row in per_part.groupBy("units").agg(F.sum("n").alias("n")).collect():  # at most window / UNIT rows
        histogram[row["units"]] = row["n"]
    table = slots(plan(histogram, depth), units)
    before = F.sum("n").over(Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = per_part.select("part", "units", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    # The base has a row per partition and class; sending it to the pieces leaves their ids where they are.
    ranked = made.join(F.broadcast(base), ["part", "units"]).withColumn("rank", F.col("base") + F.col("number")).drop("base", "number", "part")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("units", "rank"))
            sequence, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k in np.unique(size).tolist():
                at = np.flatnonzero(size == k)
                first, seq, slot = table[k]
                run_no = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = seq[run_no] + rank[at] - first[run_no]
                place[at] = slot[run_no]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(place)], [*batch.schema.names, "sequence_id", "place"])

    placed = ranked.mapInArrow(tidy(run), f"{fields}, sequence_id long, place long").drop("rank", "units")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long"))
    return placed.select(*(c for c in placed.columns if c != "place"), "place")


def _unpressed(packed: DataFrame) -> DataFrame:
    """Rows with the ids themselves in ``ids``."""
    names = packed.columns
    at = names.index("ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, size = _codec(), names.index("length")
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = [codec.decompress(x, 4 * n, asbytes=True) for x, n in zip(part.column(at).to_pylist(), part.column(size).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()) if k == at else c for k, c in enumerate(part.columns)], names)

    return packed.mapInArrow(tidy(run), fields)


def pack(documents: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, place (and the ids themselves)."""
    packed = assign(keep(pieces(documents, tokenizer_path, window, end_id, id_col, text_col, with_ids)), window, depth)
    return _unpressed(packed) if with_ids else packed


def pack_sequences(documents: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences of the documents, as ``sequences`` gives them."""
    return sequences(assign(keep(pieces(documents, tokenizer_path, window, end_id, id_col, text_col, with_ids=True)), window, depth), window, id_col, compressed=True)


def sequences(packed: DataFrame, window: int = 2048, id_col: str = "doc_id", compressed: bool = False) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: (sequence_id, n_ids, input_ids binary of little-endian uint32, piece_starts, pieces: id_col, start, length, doc_tokens, place and offset of each).  A sequence is padded with 0 to the window, except where its ids number a power of two."""
    told = ["place", "offset", id_col, "start", "length", "doc_tokens"]
    # At most a window of ids; a place occurs once in a sequence, so no later field decides the order.
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct(*told, "ids")), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("p"))
    rows = parts.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda s, p: s + p["length"]).alias("n_ids"), F.transform("p", lambda p: p["ids"]).alias("ids"), F.transform("p", lambda p: p["length"]).alias("lengths"), F.transform("p", lambda p: F.struct(*(p[c].alias(c) for c in told))).alias("pieces"))
    piece_type = rows.schema["pieces"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec()
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                out = []
                for n, ids, lengths in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    raw = b"".join(codec.decompress(x, 4 * k, asbytes=True) if compressed else x for x, k in zip(ids, lengths, strict=True))
                    out.append(raw if n & (n - 1) == 0 else raw.ljust(4 * window, b"\0"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary()), part.column(4)], ["sequence_id", "n_ids", "input_ids", "pieces"])

    made = rows.mapInArrow(tidy(run), f"sequence_id long, n_ids long, input_ids binary, pieces {piece_type}")
    return made.select("sequence_id", "n_ids", "input_ids", F.transform("pieces", lambda p: p["offset"]).alias("piece_starts"), "pieces")


def read_back(made: DataFrame, id_col: str = "doc_id", with_sequences: bool = False) -> DataFrame:
    """``pack``'s rows, each piece read from its place in its sequence of ``sequences``; ``with_sequences``: the row of a sequence's first piece has it as ``input_ids``, the others null."""
    rows = made.select("sequence_id", "input_ids", F.explode("pieces").alias("p"))
    ids = F.expr("substring(input_ids, int(4 * p.offset + 1), int(4 * p.length))")
    columns = [F.col("p")[id_col].alias(id_col), F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.crc32(ids).alias("ids_crc32"), F.col("p.doc_tokens").alias("doc_tokens"), F.col("sequence_id"), F.col("p.offset").alias("offset"), F.col("p.place").alias("place")]
    return rows.select(*columns, *([F.when(F.col("p.place") == 0, F.col("input_ids")).alias("input_ids")] if with_sequences else []))
