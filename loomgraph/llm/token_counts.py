"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged array of symbols.  Each
round looks up the merge rank of every neighbouring pair, takes the lowest rank
of each sequence and merges all its occurrences (left to right where they
overlap) in every sequence at once.  Sequences without a mergeable pair leave;
the symbols they still have are their token count.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings inside texts count as the library's default has them, one token each;
rows are handled one by one, so repeated rows, ties and extra columns have no
influence; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Pretokens, _spec, texts_of
from .textscan import ragged, slices, tidy

_NONE = np.int64(1) << 40
CACHE = 500_000


class RankMerger:
    """Merges of one byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        model = _spec(path)["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("needs a plain BPE model")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.vocab = vocab
        # Byte-level files write bytes as printable characters: printable Latin-1 stands for itself, the others follow from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        as_char = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.of_byte = np.array([vocab[as_char[b]] for b in range(256)], np.int64)
        self.byte_of = {c: b for b, c in as_char.items()}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols survive in each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = sizes.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        live = np.flatnonzero(sizes > 1)
        if not len(live):
            return out
        starts = np.cumsum(sizes) - sizes
        symbols = symbols[ragged(starts[live], sizes[live])]
        length = sizes[live]
        rank: np.ndarray | None = None
        while len(live):
            begin = np.cumsum(length) - length
            if rank is None:
                rank = np.full(len(symbols), _NONE)
                rank[:-1] = self._rank(symbols[:-1], symbols[1:])
                rank[begin + length - 1] = _NONE
            lowest = np.minimum.reduceat(rank, begin)
            done = lowest == _NONE
            if done.any():
                out[live[done]] = length[done]
                stay = np.repeat(~done, length)
                symbols, rank = symbols[stay], rank[stay]
                live, length, lowest = live[~done], length[~done], lowest[~done]
                if not len(live):
                    break
                begin = np.cumsum(length) - length
            per_symbol = np.repeat(lowest, length)
            hit = np.flatnonzero(rank == per_symbol)
            # Of overlapping occurrences every other one counts, from the left.
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            if not fresh.all():
                group = np.cumsum(fresh) - 1
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(fresh)[group]) % 2 == 0]
            symbols[hit] = self.merged[per_symbol[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            owner = np.repeat(np.arange(len(live)), length)
            length = length - np.bincount(owner[hit], minlength=len(live))
            moved = np.cumsum(keep) - 1
            at = moved[hit]
            symbols, rank = symbols[keep], rank[keep]
            # Only the pairs beside a merge have a new rank.
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(length) - 1] = True
            for i in (at, at[at > 0] - 1):
                rank[i] = np.where(last[i], _NONE, self._rank(symbols[i], symbols[np.minimum(i + 1, len(symbols) - 1)]))
        return out


class Counter:
    def __init__(self, path: str):
        self.pretokens, self.merger = Pretokens(path), RankMerger(path)
        self._known: dict[str, int] = {}
        added = {t["content"]: t for t in _spec(path).get("added_tokens", [])}
        self._odd = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added.values())

    def _split_odd(self, text: str) -> tuple[int, list[bytes]]:
        """Special strings and pre-tokens of one text that the array split doesn't take."""
        parts, n = [text], 0
        for s in self.pretokens.special:
            cut = [p.split(s) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        split = self.pretokens.tokenizer.pre_tokenizer.pre_tokenize_str
        to_byte = self.merger.byte_of
        return n, [bytes(to_byte[c] for c in piece) for p in parts if p for piece, _ in split(p)]

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        plain = np.array(self.pretokens.plain(texts), bool)
        joined, points, starts, per_text = self.pretokens.split([t for t, p in zip(texts, plain, strict=True) if p])
        if len(starts) > 1:
            first, which, _ = Pretokens.distinct(points, starts)
            words = [joined[i:j] for i, j in zip(starts[first].tolist(), starts[first + 1].tolist(), strict=True)]
            if len(self._known) + len(words) > CACHE:
                self._known = {}
            counts = list(map(self._known.get, words))
            if None in counts:
                new = [w for w, k in zip(words, counts, strict=True) if k is None]
                for i in range(0, len(new), 50_000):
                    part = new[i : i + 50_000]
                    self._known.update(zip(part, self.merger.counts([w.encode() for w in part]).tolist(), strict=True))
                counts = list(map(self._known.get, words))
            total = np.zeros(len(which) + 1, np.int64)
            np.cumsum(np.array(counts, np.int64)[which], out=total[1:])
            out[plain] = np.diff(total[per_text])
        for i in np.flatnonzero(~plain).tolist():
            if self._odd:
                raise ValueError("special tokens that take white space with them")
            n, words = self._split_odd(texts[i])
            out[i] = n + int(self.merger.counts(words).sum()) if words else n
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle."""
    rows = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            n = count(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(tidy(run), f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
