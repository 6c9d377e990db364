"""Text functions as Spark columns, and the same for query strings on the driver."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words that a symbol query drops unless nothing else is left.
STOP_WORDS = ("a", "after", "an", "and", "are", "before", "does", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "what", "where", "why", "with", "work", "works")

_NON_WORD = r"[^\p{IsAlphabetic}\p{N}]+"
#: Between two characters of one token: lower to upper, letter to number and back, and before an upper case letter that starts a word.
_BOUNDARY = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters of the basic plane that are a base letter with marks, and the base letters; made from the Unicode rules."""
    marked, plain = [], []
    for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0xFB00)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.category(c)[0] == "L" and all(unicodedata.category(p) == "Mn" for p in parts[1:]) and parts[0] not in marked:
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    marked, plain = _accents()
    low = F.lower(text)
    full = F.regexp_replace(F.translate(low, marked, plain), r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(full)  # ASCII has none


def fold_text(text: str) -> str:
    marked, plain = _accents()
    return re.sub(r"[̀-ͯ]+", "", text.lower().translate(str.maketrans(marked, plain)))


def search_tokens(text: Column) -> Column:
    """Tokens of the full-text index: folded runs of letters and numbers."""
    return F.array_remove(F.split(fold(text), _NON_WORD), "")


def content_terms(text: Column) -> Column:
    """Lower-cased alphanumeric runs, repeats and all."""
    return F.array_remove(F.split(F.lower(text), _NON_WORD), "")


def identifier_segments(text: Column) -> Column:
    """Each alphanumeric run in lower case, then its camel-case, digit and acronym parts; every one once, in order."""
    runs = F.array_remove(F.split(text, _NON_WORD), "")
    parts = F.flatten(F.transform(runs, lambda r: F.concat(F.array(F.lower(r)), F.transform(F.split(r, _BOUNDARY), F.lower))))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def split_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_+", text) if w]


def segments_of(text: str) -> list[str]:
    """``identifier_segments`` of a query string."""
    out: dict[str, None] = {}
    for run in split_words(text):
        out[run.lower()] = None
        start = 0
        for i in range(1, len(run)):
            before, here, after = run[i - 1], run[i], run[i + 1 : i + 2]
            if (before.islower() and here.isupper()) or (before.isalpha() and here.isnumeric()) or (before.isnumeric() and here.isalpha()) or (before.isupper() and here.isupper() and after.islower()):
                out[run[start:i].lower()] = None
                start = i
        out[run[start:].lower()] = None
    return list(out)


def search_terms(query: str) -> list[str]:
    """Segments of a symbol query without stop words, or all if only those are there."""
    terms = segments_of(query)
    return [t for t in terms if t not in STOP_WORDS] or terms


def memory_terms(query: str) -> list[str]:
    """Up to 20 lower-cased terms of a memory query; underscores stay."""
    return [w.lower() for w in re.split(r"[^\w]+", query) if w][:20]


def prefix_hits(tokens: Column, term: str) -> Column:
    """Places where the term matches a token array as a phrase whose last word is a prefix."""
    words = split_words(fold_text(term))
    if not words:
        return F.lit(0).cast("long")
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda t: t.startswith(words[0]))).cast("long")
    n = len(words)
    at = F.sequence(F.lit(0), F.size(tokens) - n)

    def match(i: Column) -> Column:
        full = F.lit(True)
        for k, w in enumerate(words[:-1]):
            full = full & (F.get(tokens, i + k) == w)
        return full & F.get(tokens, i + (n - 1)).startswith(words[-1])

    return F.when(F.size(tokens) >= n, F.size(F.filter(at, match))).otherwise(F.lit(0)).cast("long")


def common_prefix(left: Column, right: str) -> Column:
    """Bytes both start with; ``right`` is a constant."""
    raw = right.encode()
    size = F.lit(0)
    for n in range(1, len(raw) + 1):
        size = size + F.when(F.substring(F.encode(left, "utf-8"), 1, n) == F.lit(raw[:n]), 1).otherwise(0)
    return size


def morphologically_related(left: Column, right: str) -> Column:
    """At least 6 bytes in common at the start, and four fifths of the shorter."""
    shorter = F.least(F.octet_length(left), F.lit(len(right.encode())))
    common = common_prefix(left, right)
    return (shorter >= 6) & (common >= 6) & (common * 5 >= shorter * 4)


def module_key(path: Column) -> Column:
    """A module path without its source extension."""
    return F.regexp_replace(path, r"\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|vue|svelte|astro|ets)$", "")


def glob_regex(pattern: str) -> str:
    """A Java regex for a path glob: * within a segment, ** across, ? one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (pattern[i] if pattern[i].isalnum() or pattern[i] in "/_-" else "\\" + pattern[i]), i + 1
    return f"^{out}$"


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 1.0 for an empty whole."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)
