"""Token ids as Arrow files of equal-length sequences.

Documents are put in ascending id order, tokenised, ended with an end id and
laid end to end.  Each partition writes one Arrow IPC file whose record batches
hold two fixed-size-list columns, ``input_ids`` and ``mask`` (1 for an id, 0 for
the padding of the file's last sequence), and one index file (document id, start
within the file, number of ids).  All batches but the last have the same number
of sequences, so any sequence is found by arithmetic and read from the mapped
file without a copy.

Files go to any folder that ``pyarrow.fs`` can open by its URI.  Names hold the
partition and a random part: a repeated task attempt writes files of its own,
and only those of the attempt that succeeded are listed in the result.

Defined results: a null text counts as empty and yields just its end id; rows
with equal ids stay apart, ordered by text; an empty table yields no file; extra
columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, texts_of
from .textscan import slices, tidy
from .workspace import shared_folder

ROWS_PER_BATCH = 64


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; Spark's ``file:/x`` counts as ``file:///x``."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else f"file://{uri[5:]}")


class _Writer:
    """Cuts a stream of ids into fixed-size-list batches."""

    def __init__(self, sink, length: int, width: np.dtype):
        self.length, self.width = length, width
        kind = pa.list_(pa.from_numpy_dtype(width), length)
        self.schema = pa.schema([("input_ids", kind), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.rest, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.width))
        self.size += len(ids)
        full = self.length * ROWS_PER_BATCH
        if self.size >= full:
            joined = np.concatenate(self.rest)
            cut_at = len(joined) // full * full
            for at in range(0, cut_at, full):
                self._write(joined[at : at + full], full)
            self.rest, self.size = [joined[cut_at:]], len(joined) - cut_at

    def _write(self, ids: np.ndarray, filled: int) -> None:
        mask = np.arange(len(ids)) < filled
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.rest)
            self._write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()


def write_token_files(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns (part, path, index_path, n_docs, n_ids, first_id) per file, first_id being the number of ids in all files before it."""
    width = np.dtype(np.uint16 if max(encoder(tokenizer_path).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else np.uint32)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        writer, n_docs, n_ids = None, 0, 0
        part = TaskContext.get().partitionId()
        stem = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        for batch in slices(batches):
            if writer is None:
                system, path = _open(f"{stem}.arrow")
                system.create_dir(path.rpartition("/")[0], recursive=True)
                sink, index_sink = system.open_output_stream(path), system.open_output_stream(path.replace(".arrow", ".index.arrow"))
                writer = _Writer(sink, length, width)
                index_schema = pa.schema([("id", batch.schema.field("id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(index_sink, index_schema)
            ids, ends = encode(texts_of(batch.column(1)))
            ends = ends + np.arange(len(ends))
            with_end = np.full(len(ids) + batch.num_rows, end_id, np.int64)
            keep = np.ones(len(with_end), bool)
            keep[ends[1:] - 1] = False
            with_end[keep] = ids
            writer.add(with_end)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_ids + ends[:-1]), pa.array(np.diff(ends))], schema=index_schema))
            n_docs, n_ids = n_docs + batch.num_rows, n_ids + len(with_end)
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{stem}.arrow"], "index_path": [f"{stem}.index.arrow"], "n_docs": [n_docs], "n_ids": [n_ids]})

    # One row per file comes to the driver, no document; what is listed has been written.
    schema = "part long, path string, index_path string, n_docs long, n_ids long"
    listed = sorted((tuple(r) for r in rows.mapInArrow(tidy(run), schema).collect()), key=lambda r: r[0])
    before = [0, *accumulate(r[4] for r in listed)]
    return documents.sparkSession.createDataFrame([(*r, first) for r, first in zip(listed, before, strict=False)], f"{schema}, first_id long")


class TokenFile:
    """Random access to one written file."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self._at, self._batch = -1, None

    def _column(self, batch: int, name: str) -> pa.Array:
        if batch != self._at:
            self._at, self._batch = batch, self.reader.get_batch(batch)
        return self._batch.column(self.reader.schema.get_field_index(name))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        batch, row = divmod(i, ROWS_PER_BATCH)
        ids, mask = (self._column(batch, name)[row].values for name in ("input_ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the file's start-th on, over sequence bounds."""
        per, out = ROWS_PER_BATCH * self.length, []
        while n > 0:
            batch, at = divmod(start, per)
            got = self._column(batch, "input_ids").flatten().to_numpy()[at : at + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.int64)


def read_token_files(files: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """Per document (id_col, start, n_tokens, ids_crc32) as found in the files; ``id_type`` is the type that the ids had when written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["path"])
                system, path = _open(row["index_path"])
                with system.open_input_file(path) as f:
                    index = pa.ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        start, n = (docs.column(k).to_numpy() for k in (1, 2))
                        crc = [zlib.crc32(tokens.ids(a, b).astype("<u4").tobytes()) for a, b in zip(start.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(start + row["first_id"]), docs.column(2), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    # A row names a whole file, so each wants a task of its own.
    per_file = files.select("path", "index_path", "first_id", "part").repartitionByRange(max(files.count(), 1), "part")
    return per_file.mapInArrow(tidy(run), f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``documents`` below the shared folder and reads the files back."""
    folder = shared_folder(documents.sparkSession, "tokens")
    files = write_token_files(documents, folder, tokenizer_path, end_id, length, id_col, text_col)
    return read_token_files(files, id_col, documents.schema[id_col].dataType.simpleString())
