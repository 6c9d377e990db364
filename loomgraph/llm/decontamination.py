"""Benchmark decontamination with one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z are lower-cased and
everything but digits, a-z and non-ASCII characters parts words.  A window is
``size`` consecutive words of an item (all its words, if it has fewer).  Any window
holds one of the blocks of half that many words into which its item falls, so the
automaton holds these blocks, as strings with blanks around the words, and items of
fewer words than a window whole: a tenth of the symbols that all windows have.  One
scan of a document's normalised text finds them all; around a block the words of
document and item are compared, and where they agree over a window or more, these
are hit.  A match is a run of word numbers, and word numbers lead back to offsets in
the original text.

The benchmark is sent to the executors in blocks of at most ``BLOCK_BYTES`` of
text, an automaton each, which a worker builds once (some 60 MB a MB of text).  A
usual test set is one block; a larger one passes the documents through several scans
in a row, so that no worker holds more than ``KEPT`` of them, whatever the
benchmark's size.

Defined results: null and wordless texts have no words, hits or items; null item
ids are left out of the item list; repeated items and rows are each reported; an
empty benchmark contaminates nothing; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import slices, tidy, utf8

BLOCK_BYTES, KEPT = 2_000_000, 2
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8."""
    return text.encode().translate(_NORMAL).split() if text else []


class Scanner:
    """The automaton over one block of (item id, text)."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        import ahocorasick

        self.size, self.half = size, (size + 1) // 2
        self.ids = [i for i, _ in items]
        same: dict[bytes, bytes] = {}  # one object a word
        self.words = [[same.setdefault(w, w) for w in words(text)] for _, text in items]
        found: dict[bytes, list[tuple[int, int]]] = {}
        for k, own in enumerate(self.words):
            if len(own) >= size:
                for q in range(0, len(own) - self.half + 1, self.half):
                    found.setdefault(b" " + b" ".join(own[q : q + self.half]) + b" ", []).append((k, q))
            elif own:
                found.setdefault(b" " + b" ".join(own) + b" ", []).append((k, 0))
        self.automaton = ahocorasick.Automaton()
        for w, holders in found.items():
            self.automaton.add_word(w.decode("latin-1"), (w.count(b" ") - 1, holders))  # one character a byte
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint runs [start, end) of hit word numbers, in order, and the items that occur."""
        if self.empty or not own:
            return [], set()
        normal = b" " + b" ".join(own) + b" "
        matches = list(self.automaton.iter(normal.decode("latin-1")))
        if not matches:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20)
        upto = np.searchsorted(blanks, [end for end, _ in matches]).tolist()
        runs, held = [], set()
        for end, (_, (n, holders)) in zip(upto, matches, strict=True):
            for k, q in holders:
                item = self.words[k]
                if len(item) < self.size:
                    if len(item) == n:
                        runs.append((end - n, end))
                        held.add(k)
                elif n == self.half:
                    # Windows reach size - n words beyond their block.
                    a, most = end - n, min(self.size - n, end - n, q)
                    before = 0
                    while before < most and own[a - before - 1] == item[q - before - 1]:
                        before += 1
                    most = min(self.size - n, len(own) - end, len(item) - q - n)
                    after = 0
                    while after < most and own[end + after] == item[q + n + after]:
                        after += 1
                    if before + n + after >= self.size:
                        runs.append((a - before, end + after))
                        held.add(k)
        return merged(runs), held


#: The automata that this worker built last.
_built: dict[tuple[str, int], Scanner] = {}


def scanner(name: str, items: list[tuple[object, str | None]], size: int) -> Scanner:
    """The automaton of a block, by its name, built once per worker."""
    if (name, size) not in _built:
        while len(_built) >= KEPT:
            _built.pop(next(iter(_built)))
        _built[name, size] = Scanner(items, size)
    return _built[name, size]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs as disjoint runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where runs of word numbers stand in the original text, in code points."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 0x20
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(point[starts[a]]), int(point[ends[b - 1]])) for a, b in runs]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in parts of at most BLOCK_BYTES (or one item), by a running sum of sizes."""
    total = benchmark.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    if total <= BLOCK_BYTES:
        return [benchmark]
    parts = -(-2 * total // BLOCK_BYTES)
    return [benchmark.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(parts)) == k) for k in range(parts)]


def scan(documents: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document (id_col, n_words, runs of hit words, spans of them in code points, items), items as text."""
    id_type = documents.schema[id_col].dataType.simpleString()
    run_type = "array<struct<start:int,end:int>>"
    rows = documents.select(F.col(id_col), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(run_type).alias("runs"), F.array().cast(run_type).alias("spans"), F.array().cast("array<string>").alias("items"))
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    context = documents.sparkSession.sparkContext
    blocks = _blocks(benchmark, item_col, item_text_col)
    for number, block in enumerate(blocks):
        items = context.broadcast([(str(r[0]) if r[0] is not None else None, r[1]) for r in block.select(F.col(item_col), F.col(item_text_col)).collect()])  # at most BLOCK_BYTES
        last = number == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], items=items, last=last, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            found_by = scanner(name, items.value, size)
            for batch in slices(batches):
                n_words, runs, spans, found = [], batch.column(3).to_pylist(), [], batch.column(5).to_pylist()
                raw, offs = utf8(batch.column(1))
                raw = raw.tobytes().translate(_NORMAL)
                for i in range(batch.num_rows):
                    own = raw[offs[i] : offs[i + 1]].split()
                    hits, held = found_by.scan(own)
                    n_words.append(len(own))
                    if hits:
                        runs[i] = merged([*((r["start"], r["end"]) for r in runs[i]), *hits])
                        found[i] = [*found[i], *(found_by.ids[k] for k in held if found_by.ids[k] is not None)]
                    else:
                        runs[i] = [(r["start"], r["end"]) for r in runs[i]]
                    spans.append(char_spans(batch.column(1)[i].as_py(), runs[i]) if last and runs[i] else [])
                as_rows = lambda x: pa.array([[{"start": a, "end": b} for a, b in r] for r in x], pair)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1) if not last else pa.nulls(batch.num_rows, pa.string()), pa.array(n_words, pa.int64()), as_rows(runs), as_rows(spans), pa.array(found, pa.list_(pa.string()))], names)

        schema = f"`{id_col}` {id_type}, text string, n_words long, runs {run_type}, spans {run_type}, items array<string>"
        names = [id_col, "text", "n_words", "runs", "spans", "items"]
        rows = rows.mapInArrow(tidy(run), schema)
    return rows.drop("text")


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, **columns: str) -> DataFrame:
    """``scan`` with the counts and digests: n_hit, n_items, items_sha256, contaminated."""
    found = scan(documents, benchmark, size, **columns)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    items = F.sort_array(F.array_distinct("items"))
    return (
        found.withColumn("items", items)
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def clean(documents: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, all their columns; one pass per block of the benchmark, no shuffle."""
    context = documents.sparkSession.sparkContext
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    at = documents.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):
        items = context.broadcast([(str(r[0]) if r[0] is not None else None, r[1]) for r in block.select(F.col(item_col), F.col(item_text_col)).collect()])  # at most BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch], items=items, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            found_by = scanner(name, items.value, size)
            for batch in slices(batches, text_col):
                yield batch.filter(pa.array([not found_by.scan(words(t))[0] for t in batch.column(at).to_pylist()]))

        documents = documents.mapInArrow(tidy(run), fields)
    return documents
