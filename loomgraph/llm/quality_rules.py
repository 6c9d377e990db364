"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: too little punctuation of sentences and too much
of other marks, navigation, boilerplate.  Lines that fail go; a document that
loses too much of its text this way, or fails the base rules, is rejected.

Everything is computed inside the row, so nothing is shuffled.  Repeated 3-word
windows are found by hashing each window to 64 bits and sorting one long array
per text, in which the window's place takes the low bits and the upper part of
its hash the others.  Neighbours with equal upper parts are compared by their
whole hashes; should two different ones meet, or a text have too many words for
the low bits, (hash, place) pairs are sorted instead.

Defined results: a null text has no words, all its counts are 0 and it is
rejected (fewer than ``MIN_WORDS``), as is an empty one; rows are judged one by
one; extra columns pass through ``clean`` and are dropped by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"

#: Production thresholds of the line rules.
MAX_SYMBOLS_PER_WORD = 0.2
MAX_SHOUTS_PER_WORD = 0.3
MAX_UNPUNCTUATED_WORDS = 6
MAX_BARS = 2
MIN_KEPT = 0.6
#: Phrases of page furniture, matched in lower case.
BOILERPLATE = ("privacy policy", "terms of use", "terms of service", "all rights reserved", "cookie policy", "use cookies", "lorem ipsum", "enable javascript", "skip to content", "sign up for our newsletter", "click here to")
#: A line of one of these entries alone is navigation.
NAVIGATION = ("home", "menu", "contact", "contact us", "about", "about us", "log in", "login", "sign in", "sign up", "search", "next", "previous", "back to top", "read more", "share")

_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1
_SPACE = r"[ \t\n\x0B\f\r]"


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in text)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{_SPACE}+"), "")


def count_of(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word in it goes.

    punctuation: many symbols or "!!" for its words, or a longer line without any sentence mark;
    navigation: entries parted by bars, or a lone menu entry; boilerplate: a phrase of page furniture.
    """
    n = F.regexp_count(line, F.lit(r"[^ \t\n\x0B\f\r]+"))
    low = F.lower(F.btrim(line, F.lit(BLANKS)))
    symbols = count_of(line, SYMBOLS)
    shouts = F.regexp_count(line, F.lit("!!"))
    bars = count_of(line, "|")
    no_sentence = (n > MAX_UNPUNCTUATED_WORDS) & ~line.rlike("[.!?:;,…。！？]")
    phrase = low.rlike("|".join(_literal(p) for p in BOILERPLATE))
    entry = low.isin(*NAVIGATION)
    return (symbols > MAX_SYMBOLS_PER_WORD * n) | (shouts > MAX_SHOUTS_PER_WORD * n) | no_sentence | (bars > MAX_BARS) | entry | phrase


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows at these places."""
    seed = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        F.sort_array(places),
        seed,
        lambda s, p: F.struct((s["n"] + p + F.lit(3) - F.greatest(p, s["end"])).alias("n"), (p + F.lit(3)).cast("long").alias("end")),
        lambda s: s["n"],
    )


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) and the share of text kept."""
    return _judged(documents.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_share")


def _judged(documents: DataFrame, text_col: str) -> DataFrame:
    # Names of our own, so that no column of the input is hidden.
    t, w, h = "__text", "__words", "__hashes"
    df = documents.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(w, words_of(F.col(t)))
    df = df.withColumn("n_words", F.size(w).cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
    df = df.withColumn("n_symbols", count_of(F.col(t), SYMBOLS).cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn(h, F.when(F.size(w) >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.drop(w)
    df = _with_repeats(df, h)
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    df = df.withColumn("__lines", lines)
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    df = df.withColumn("__kept", F.array_join(F.filter("__lines", lambda x: ~line_fails(x)), "\n"))
    whole = F.length(F.array_join("__lines", "\n"))
    df = df.withColumn("kept_share", F.when(whole > 0, F.length("__kept") / whole).otherwise(F.lit(0.0)))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= MIN_KEPT))


def _with_repeats(df: DataFrame, h: str) -> DataFrame:
    """Adds n_repeat_words from the windows' hashes and drops them."""
    upper = F.lit(~_PLACE).cast("long")
    high = lambda v: v.bitwiseAND(upper)
    place = lambda v: v.bitwiseAND(F.lit(_PLACE).cast("long"))
    df = df.withColumn("__packed", F.sort_array(F.transform(h, lambda x, i: high(x).bitwiseOR(i.cast("long")))))
    beside = lambda i, v, d: high(F.get("__packed", i + d)).eqNullSafe(high(v))
    df = df.withColumn("__twins", F.filter("__packed", lambda v, i: beside(i, v, -1) | beside(i, v, 1)))
    # Equal upper parts of different hashes, or places that don't fit: sort the pairs themselves.
    mixed = F.exists(F.sequence(F.lit(1), F.size("__twins") - 1), lambda i: (high(F.get("__twins", i)) == high(F.get("__twins", i - 1))) & (F.get(h, place(F.get("__twins", i)).cast("int")) != F.get(h, place(F.get("__twins", i - 1)).cast("int"))))
    unsafe = (F.size(h) > _PLACE) | ((F.size("__twins") > 1) & F.when(F.size("__twins") > 1, mixed).otherwise(F.lit(False)))
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
    df = df.withColumn("__pairs", F.when(unsafe, pairs))
    slow = F.transform(F.filter("__pairs", lambda v, i: F.get(F.col("__pairs"), i - 1)["h"].eqNullSafe(v["h"]) | F.get(F.col("__pairs"), i + 1)["h"].eqNullSafe(v["h"])), lambda v: v["i"])
    n = F.when(F.col("__pairs").isNotNull(), _covered(slow)).otherwise(_covered(F.transform("__twins", place)))
    return df.withColumn("n_repeat_words", n).drop(h, "__packed", "__twins", "__pairs")


def clean(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents kept, all their columns, with the failing lines taken out of the text."""
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("__row"), F.col(text_col).alias("__given"))
    # The numbering keeps the optimiser from pushing the verdict below the steps that make it, which would write all of them out again and again.
    numbered = _judged(rows, "__given").withColumn("__number", F.monotonically_increasing_id())
    kept = numbered.where(F.col("kept") & (F.col("__number") >= 0))
    return kept.select(*(F.col("__kept").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in documents.columns))
