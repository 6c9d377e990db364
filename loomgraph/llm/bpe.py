"""Byte-level BPE helpers over batches of texts.

``Pretokens`` splits texts into the tokenizer's pre-tokens with array
operations.  The character classes it needs are read off the loaded tokenizer's
own pre-tokenizer, so the two cannot disagree; texts with a character beyond
``KNOWN`` or with a special string take the library's own path.

``Encoder`` turns texts into ids.  Every id comes from the tokenizers library:
each distinct pre-token is encoded by it once and remembered per Python worker,
in a table of at most ``CACHE`` entries.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .textscan import ragged, span_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KNOWN = 0x3000
CACHE = 600_000
LETTER, NUMBER, OTHER, SPACE = range(4)


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Pretokens:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        spec = _spec(path)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("needs a plain byte-level tokenizer without normaliser or prefix space")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.full(KNOWN, OTHER, np.uint8)
        for c in range(KNOWN):
            at = [end for _, (_, end) in split(f"a{chr(c)}1")]
            if at[0] == 2:
                self.classes[c] = LETTER
            elif at == [1, 3]:
                self.classes[c] = SPACE if c == 0x20 else NUMBER
            elif len(split(f"{chr(c)}!")) > 1:
                self.classes[c] = SPACE

    def plain(self, texts: list[str]) -> list[bool]:
        """Which of the texts ``split`` may take."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points) or points.max() < KNOWN:
            return [not any(s in t for s in self.special) for t in texts]
        return [max(t, default="") < chr(KNOWN) and not any(s in t for s in self.special) for t in texts]

    def split(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, their code points, the start of each pre-token with the end of all, and per text the index of its first pre-token (one more entry than texts)."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(points)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        if not n:
            return joined, points, np.zeros(1, np.int64), np.zeros(len(bounds), np.int64)
        kind = self.classes[points]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        start = edge.copy()
        start[1:-1] |= kind[1:] != kind[:-1]
        # The last white space before something else stands apart; if it is a blank, it opens the pre-token that follows.
        tail = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1])
        start[tail] = True
        start[tail[points[tail] == 0x20] + 1] = False
        # A lone apostrophe that opens a pre-token takes one of the fixed endings with it.
        mark = np.flatnonzero(points[:-1] == 0x27)
        mark = mark[start[mark] & start[mark + 1] & ~edge[mark + 1] & (kind[mark + 1] == LETTER)]
        padded = np.append(points, [0, 0])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1])) & ~edge[np.minimum(mark + 2, n)]
        for hit, size in ((short, 2), (long & ~short, 3)):
            at = mark[hit]
            start[at + 1] = False
            start[at + size] = True
        starts = np.flatnonzero(start)
        return joined, points, starts, np.searchsorted(starts, bounds)

    @staticmethod
    def distinct(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct pre-token the index of its first occurrence; for each pre-token which of them it is; the distinct ones' hashes, ascending.  Exact: equal hashes are compared symbol by symbol."""
        a, b = starts[:-1], starts[1:]
        hashes, first, which = np.unique(span_hash(points, a, b), return_index=True, return_inverse=True)
        lengths, other = b - a, a[first][which]
        if not np.array_equal(lengths, lengths[first][which]) or not np.array_equal(points[ragged(other, lengths)], points[: starts[-1]]):
            raise ArithmeticError("two pre-tokens share a hash")
        return first, which, hashes


class _Growing:
    """Ragged rows of numbers, appended at the end."""

    def __init__(self, kind: type):
        self.data, self.ends, self.n = np.empty(1 << 16, kind), np.zeros(1 << 14, np.int64), 0

    def append(self, data: np.ndarray, lengths: np.ndarray) -> None:
        n, end = self.n, int(self.ends[self.n])
        while n + len(lengths) + 1 > len(self.ends):
            self.ends = np.resize(self.ends, 2 * len(self.ends))
        while end + len(data) > len(self.data):
            self.data = np.resize(self.data, 2 * len(self.data))
        self.data[end : end + len(data)] = data
        self.ends[n + 1 : n + len(lengths) + 1] = end + np.cumsum(lengths)
        self.n = n + len(lengths)

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows + 1] - self.ends[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of the given rows, one row after another."""
        return self.data[ragged(self.ends[rows], self.lengths(rows))]


class Encoder:
    def __init__(self, path: str):
        self.pretokens = Pretokens(path)
        self.tokenizer = self.pretokens.tokenizer
        self._newline = self._one("\n")
        self._forget()

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        """Rows of the table: ids, symbols, hash and uses of a pre-token.  They are found by hash in two sorted lists, of old rows and of new ones."""
        self._ids, self._points = _Growing(np.uint32), _Growing(np.uint32)
        self._hashes, self._uses = np.empty(0, np.uint64), np.empty(0, np.uint16)
        self._old = self._new = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def _append(self, hashes: np.ndarray, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rows = np.arange(self._ids.n, self._ids.n + len(hashes))
        self._ids.append(ids, lengths)
        self._points.append(points, sizes)
        self._hashes = np.concatenate([self._hashes, hashes])
        self._uses = np.concatenate([self._uses, np.zeros(len(hashes), np.uint16)])
        self._new = self._merged(self._new, (hashes, rows))
        if len(self._new[0]) > 4096 + len(self._old[0]) // 8:
            self._old, self._new = self._merged(self._old, self._new), (np.empty(0, np.uint64), np.empty(0, np.int64))
        return rows

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes, rows = (np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.argsort(hashes, kind="stable")
        return hashes[order], rows[order]

    def _find(self, hashes: np.ndarray, points: np.ndarray, a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The table's row of each pre-token, -1 where it has none; equal hashes are compared symbol by symbol."""
        found = np.full(len(hashes), -1)
        for known, rows in (self._old, self._new):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                found[hit] = rows[at[hit]]
        held = np.flatnonzero(found >= 0)
        held = held[self._points.lengths(found[held]) == sizes[held]]
        out = np.full(len(hashes), -1)
        out[held] = found[held]
        other = points[ragged(a[held], sizes[held])] != self._points.take(found[held])
        if other.any():
            out[held[np.repeat(np.arange(len(held)), sizes[held])[other]]] = -1
        return out

    def _thin(self) -> None:
        """Keeps the pre-tokens that most batches used, half of the table at most."""
        least = max(2, int(np.sort(self._uses)[-(CACHE // 2) :][0]) + 1) if len(self._uses) > CACHE // 2 else 2
        kept = np.flatnonzero(self._uses >= least)
        rows = self._hashes[kept], self._points.take(kept), self._points.lengths(kept), self._ids.take(kept), self._ids.lengths(kept)
        self._forget()
        self._append(*rows)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pre-tokens, one after another, and how many each has; a line each where white space is not part of the question."""
        alone = [k for k, w in enumerate(words) if w.isspace()]
        lines = [k for k, w in enumerate(words) if not w.isspace()] if alone else list(range(len(words)))
        parts, start, lengths, end = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for i in range(0, len(lines), 4096):
            own = lines[i : i + 4096]
            ids = np.array(self._one("\n".join([words[k] for k in own])), np.uint32) if len(self._newline) == 1 else np.empty(0, np.uint32)
            cut = np.flatnonzero(ids == self._newline[0])
            if len(cut) == len(own) - 1:
                first = np.concatenate([[0], cut + 1])
                start[own], lengths[own] = end + first, np.append(cut, len(ids)) - first
                parts.append(ids)
                end += len(ids)
            else:
                alone = alone + own
        for k in alone:
            ids = np.array(self._one(words[k]), np.uint32)
            start[k], lengths[k] = end, len(ids)
            parts.append(ids)
            end += len(ids)
        return np.concatenate(parts)[ragged(start, lengths)], lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offset of each (one more entry than texts)."""
        plain = self.pretokens.plain(texts)
        ids, bounds = self._plain([t for t, p in zip(texts, plain, strict=True) if p])
        if all(plain):
            return ids, bounds
        parts, at = [], 0
        for t, p in zip(texts, plain, strict=True):
            if p:
                parts.append(ids[bounds[at] : bounds[at + 1]])
                at += 1
            else:
                parts.append(np.array(self._one(t), np.uint32))
        ends = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=ends[1:])
        return np.concatenate(parts), ends

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, points, starts, per_text = self.pretokens.split(texts)
        if len(starts) < 2:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        first, which, hashes = Pretokens.distinct(points, starts)
        a = starts[first]
        sizes = starts[first + 1] - a
        if self._ids.n + len(first) > CACHE:
            self._thin()
        index = self._find(hashes, points, a, sizes)
        new = np.flatnonzero(index < 0)
        if len(new):
            ids, lengths = self._learn([joined[i:j] for i, j in zip(a[new].tolist(), (a + sizes)[new].tolist(), strict=True)])
            index[new] = self._append(hashes[new], points[ragged(a[new], sizes[new])], sizes[new], ids, lengths)
        self._uses[index] += 1
        index = index[which]
        ends = np.zeros(len(index) + 1, np.int64)
        np.cumsum(self._ids.lengths(index), out=ends[1:])
        return self._ids.take(index), ends[per_text]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The Python worker's own encoder, kept between tasks."""
    return Encoder(path)


def texts_of(column) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]
