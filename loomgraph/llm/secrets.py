"""Secret scans with one deterministic automaton for all rules.

Rules are regular expressions over bytes.  They are parsed into one
nondeterministic automaton, made deterministic by subset construction and
minimised; the result is an array of transitions per state.  A text is read once,
byte by byte; whenever a state accepts, which is at a match's first possible end, the rule's own two small automata (one
forwards, one backwards, made the same way) give the match's start and its
longest end.  That is the leftmost match, as no rule here has two ways to read a
text from one start.  A rule's ``tail`` carries a match on: that of a private key's
first line runs to its last line, or over the body where that line is missing.

Defined results: a null or empty text has no spans; spans of one rule don't
overlap, those of different rules may; offsets are code points, end exclusive;
rows are handled one by one, extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import slices, utf8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Whether a match counts; one that doesn't still takes its text.
    check: Callable[[bytes], bool] = lambda m: True
    ignore_case: bool = False
    #: Where a match ends that the pattern lets end at the given place.
    tail: Callable[[bytes, int], int] = lambda data, end: end


_VALUE = re.compile(rb"[A-Za-z0-9+/_.=-]+\Z")


def _assigned(match: bytes) -> bool:
    """Whether the assigned value, the part after the sign, has 6 characters."""
    sign = re.search(rb"[:=]", match).end()
    return len(_VALUE.search(match[sign:].lstrip(b" "))[0]) >= 6


_ARMOUR = re.compile(rb"-----(?:BEGIN|END) ")
_LAST = re.compile(rb"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: A line such as ``Proc-Type: 4,ENCRYPTED``; line ends can be escaped, as in JSON.
_FIELD = re.compile(rb"""(?:[\s"'>#*]|\\[nrt])[A-Za-z][A-Za-z0-9-]*: [^\r\n\\]*""")
#: base64 and what quoting, comments, string literals and escapes put around its lines
_BODY = re.compile(rb"""[A-Za-z0-9+/=\s"'`\\,;|>#*%&<-]*""")
_GAP = rb"""(?:[\s"'`,>#*]|\\[nrt])"""
_OPEN = re.compile(rb"(?:" + _GAP + rb"++[A-Za-z][A-Za-z0-9-]*+: [^\r\n\\]*+)*+(?:" + _GAP + rb"*+[A-Za-z0-9+/]{20,}+={0,2}+)++(?:" + _GAP + rb"++[A-Za-z0-9+/]++={0,2}+(?=[ \t]*+(?:\Z|[\r\n\\\"'`])))?+")


def _key_end(data: bytes, end: int) -> int:
    """The end of the private key whose first line ends at ``end``: that of its last line, or of the lines of base64 where that is missing."""
    stop = _ARMOUR.search(data, end)
    if stop and (last := _LAST.match(data, stop.start())) and _BODY.fullmatch(_FIELD.sub(b"", data[end : stop.start()])):
        return last.end()
    lines = _OPEN.match(data, end)
    return lines.end() if lines else end


#: The base rules; their order is that of the digests.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _assigned, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of well-known credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", lambda m: len(m) >= 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m) >= 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", lambda m: len(m) == 39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", lambda m: len(m) >= 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", tail=_key_end),
)
RULES = BASE + MORE


# --- regular expressions to automata -------------------------------------------------


class _Parser:
    """Literals, escapes, classes, groups, alternatives and ``? * + {m} {m,} {m,n}``, as a tree."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def parse(self):
        tree = self.either()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} in {self.p!r}")
        return tree

    def either(self):
        options = [self.row()]
        while self.peek() == "|":
            self.take()
            options.append(self.row())
        return options[0] if len(options) == 1 else ("or", options)

    def row(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("row", parts)

    def repeated(self):
        item = self.single()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                low, comma, high = self.p[self.i : (end := self.p.index("}", self.i))].partition(",")
                self.i = end + 1
                item = ("rep", item, int(low), int(high) if high else None if comma else int(low))
            else:
                item = ("rep", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def single(self):
        c = self.take()
        if c == "(":
            tree = self.either()
            if self.peek() != ")":
                raise ValueError(f"open group in {self.p!r}")
            self.take()
            return tree
        if c == "[":
            out, invert = set(), self.peek() == "^"
            self.i += invert
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    out |= set(range(low, self.char() + 1))
                else:
                    out.add(low)
            self.take()
            return self.set(set(range(256)) - out if invert else out)
        self.i -= 1
        return self.set({self.char()})

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            c = {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)
        return ord(c)

    def set(self, chars: set[int]):
        if self.fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()}
        return ("set", frozenset(chars))


def _backwards(tree):
    if tree[0] == "row":
        return ("row", [_backwards(t) for t in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_backwards(t) for t in tree[1]])
    return ("rep", _backwards(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


def _shortest(tree):
    """The tree whose matches are the first possible ends of the tree's: a repeat at its end stops at its least count."""
    if tree[0] == "row" and tree[1]:
        return ("row", [*tree[1][:-1], _shortest(tree[1][-1])])
    return ("rep", *tree[1:3], tree[2]) if tree[0] == "rep" and tree[2] else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Builds the tree from ``start`` on; its end state."""
        if tree[0] == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if tree[0] == "row":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if tree[0] == "or":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end


@dataclass
class Dfa:
    #: next state by state and byte; state 0 starts
    moves: np.ndarray
    #: rules that accept in each state, as bits
    accepts: np.ndarray


def compile_dfa(trees: list, anywhere: bool) -> Dfa:
    """One minimal automaton for all trees; tree k is bit k.  ``anywhere``: matches may start at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[root].append(first)
        final[nfa.add(tree, first)] = 1 << k
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))
    # Bytes that no set tells apart share a column.
    sets = {s for moves in nfa.moves for s, _ in moves}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    column_of = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
    column = np.array([column_of[s] for s in signature])
    sample = [int(np.flatnonzero(column == c)[0]) for c in range(len(column_of))]

    def reach(state: int) -> frozenset:
        seen, todo = {state}, [state]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        # Only states that read a byte or accept tell subsets apart.
        return frozenset(s for s in seen if nfa.moves[s] or s in final)

    closures = [reach(s) for s in range(len(nfa.empty))]
    step = [[frozenset().union(*(closures[t] for chars, t in moves if b in chars)) for b in sample] if moves else None for moves in nfa.moves]
    subsets = {closures[root]: 0}
    table, order = [], list(subsets)
    for subset in order:  # grows
        row = []
        own = [step[s] for s in subset if step[s]]
        for c in range(len(sample)):
            to = frozenset().union(*(s[c] for s in own))
            if to not in subsets:
                subsets[to] = len(order)
                order.append(to)
            row.append(subsets[to])
        table.append(row)
    moves = np.array(table)
    accepts = np.array([sum({final[s] for s in subset if s in final}) for subset in order], np.int64)
    # Minimise: part states by what they accept, then by the parts they lead to, until nothing changes.
    _, part = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    names = np.argsort(np.unique(part, return_index=True)[1])  # in order of appearance, so that 0 starts
    number = np.empty(len(names), np.int64)
    number[names] = np.arange(len(names))
    part = number[part]
    first = np.unique(part, return_index=True)[1]
    return Dfa(part[moves[first]][:, column], accepts[first])


class _Accepting:
    """Stands in the transition lists for an accepting state; reading on from it raises TypeError."""

    def __init__(self, state: int):
        self.state = state


class Automaton:
    """All rules together."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [_Parser(r.pattern, r.ignore_case).parse() for r in rules]
        self.all = compile_dfa([_shortest(t) for t in trees], anywhere=True)
        self.forward = [self._lists(compile_dfa([t], anywhere=False)) for t in trees]
        self.backward = [self._lists(compile_dfa([_backwards(t)], anywhere=False)) for t in trees]
        self.accepts = self.all.accepts.tolist()
        self.moves = self.all.moves.tolist()
        rows: list = [_Accepting(s) if a else [] for s, a in enumerate(self.accepts)]
        for s, row in enumerate(rows):
            if not self.accepts[s]:
                row.extend(rows[t] for t in self.moves[s])
        self.rows = rows

    @staticmethod
    def _lists(dfa: Dfa) -> tuple[list, list, int]:
        """Transitions, what is accepted, and the state without a way on (or -1)."""
        dead = [s for s in range(len(dfa.moves)) if (dfa.moves[s] == s).all() and not dfa.accepts[s]]
        return dfa.moves.tolist(), dfa.accepts.tolist(), dead[0] if dead else -1

    @staticmethod
    def _longest(dfa: tuple[list, list, int], data: bytes, positions: range) -> int | None:
        """How many bytes the longest match along ``positions`` has."""
        moves, accepts, dead = dfa
        state, longest, n = 0, None, 0
        for i in positions:
            state = moves[state][data[i]]
            if state == dead:
                break
            n += 1
            if accepts[state]:
                longest = n
        return longest

    def _resolve(self, k: int, data: bytes, end: int, floor: int) -> tuple[int, int] | None:
        """The match of rule k of which ``end`` is the first possible end, not reaching below ``floor``."""
        back = self._longest(self.backward[k], data, range(end - 1, floor - 1, -1))
        if back is None:
            return None
        start = end - back
        return start, self.rules[k].tail(data, start + self._longest(self.forward[k], data, range(start, len(data))))

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then rule."""
        out: list[tuple[int, int, int]] = []
        taken = [0] * len(self.rules)

        def accepted(state: int, end: int) -> None:
            mask = self.accepts[state]
            while mask:
                k = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if end > taken[k] and (m := self._resolve(k, data, end, taken[k])):
                    taken[k] = m[1]
                    if self.rules[k].check(data[m[0] : m[1]]):
                        out.append((*m, k))

        row, it, n = self.rows[0], iter(data), len(data)
        while True:
            try:
                for b in it:
                    row = row[b]
            except TypeError:
                # ``row`` accepts and ``b`` is the byte after.
                at, state = n - it.__length_hint__() - 1, row.state
                accepted(state, at)
                while True:
                    state = self.moves[state][b]
                    at += 1
                    if not self.accepts[state]:
                        row = self.rows[state]
                        break
                    accepted(state, at)
                    if at == n:
                        return sorted(out, key=lambda m: (m[0], m[2]))
                    b = next(it)
                continue
            if isinstance(row, _Accepting):
                accepted(row.state, n)
            return sorted(out, key=lambda m: (m[0], m[2]))


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    """The Python worker's own automaton."""
    return Automaton(rules)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans with code points for bytes."""
    if not spans or data.isascii():
        return spans
    point = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(point[a]), int(point[b]), k) for a, b, k in spans]


def _joined(spans, kinds) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)


def secret_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (id_col, n_assign, n_access, n_hex, base_sha256, spans); ``spans`` lists kind:start:end of all rules by start, then rule."""
    rows = documents.select(F.col(id_col), F.col(text_col).alias("text"))
    id_type = rows.schema[id_col].dataType.simpleString()
    kinds = [r.kind for r in RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(RULES).find
        for batch in slices(batches):
            raw, offs = utf8(batch.column(1))
            raw, counts, digests, spans = raw.tobytes(), [], [], []
            for i in range(batch.num_rows):
                data = raw[offs[i] : offs[i + 1]]
                found = in_code_points(data, find(data))
                base = [s for s in found if s[2] < len(BASE)]
                counts.append([sum(s[2] == k for s in base) for k in range(len(BASE))])
                digests.append(hashlib.sha256(_joined(base, kinds).encode()).hexdigest())
                spans.append(_joined(found, kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))), pa.array(digests), pa.array(spans)], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every secret's span (overlapping ones as one) replaced by ``mark``; null stays null."""
    names = documents.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(RULES).find
        for batch in slices(batches, text_col):
            out = []
            for text in batch.column(at).to_pylist():
                data = text.encode() if text else b""
                if data and (spans := find(data)):
                    parts, done = [], 0
                    for a, b, _ in spans:
                        if a >= done:
                            parts += [data[done:a], mark.encode()]
                        done = max(done, b)
                    text = b"".join([*parts, data[done:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, fields)
