"""Cutting texts into line chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MAX_LINES, MAX_BYTES, MAX_CHUNKS, MAX_FILE_BYTES = 80, 4096, 512, 1 << 20

_STATE = "struct<done:array<struct<start:int,n:int>>,start:int,n:int,bytes:long>"


def content_chunks(files: DataFrame) -> DataFrame:
    """(path, ordinal, title, text, start_line, end_line) of files (path, text).

    Chunks take lines greedily up to 80 lines and 4096 bytes, a line end being one
    byte; a longer single line stands alone; at most 512 chunks a file.  The title
    is the first heading line.  All within the row: no shuffle.
    """
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\n$", "")
    lines = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))
    rows = files.select("path", lines.alias("lines"))
    seed = F.struct(F.array().cast("array<struct<start:int,n:int>>").alias("done"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes")).cast(_STATE)

    def step(s, line):
        size = (F.octet_length(line) + 1).cast("long")
        full = (s["n"] > 0) & ((s["n"] >= MAX_LINES) | (s["bytes"] + size > MAX_BYTES))
        closed = F.struct(F.array_append(s["done"], F.struct(s["start"].alias("start"), s["n"].alias("n"))).alias("done"), (s["start"] + s["n"]).alias("start"), F.lit(1).alias("n"), size.alias("bytes")).cast(_STATE)
        more = F.struct(s["done"].alias("done"), s["start"].alias("start"), (s["n"] + 1).alias("n"), (s["bytes"] + size).alias("bytes")).cast(_STATE)
        return F.when(full, closed).otherwise(more)

    def finish(s):
        last = F.array_append(s["done"], F.struct(s["start"].alias("start"), s["n"].alias("n")))
        return F.slice(F.when(s["n"] > 0, last).otherwise(s["done"]), 1, MAX_CHUNKS)

    rows = rows.withColumn("cuts", F.aggregate("lines", seed, step, finish))
    rows = rows.select("path", "lines", F.posexplode("cuts").alias("ordinal", "cut"))
    own = rows.select("path", F.col("ordinal").cast("long"), F.slice("lines", F.col("cut.start") + 1, F.col("cut.n")).alias("own"), F.col("cut.start").alias("s"), F.col("cut.n").alias("n"))
    heads = F.filter(F.transform("own", lambda x: F.when(F.trim(x).startswith("#"), F.trim(F.substr(F.trim(x), F.lit(2))))), lambda h: h.isNotNull() & (h != ""))
    return own.select(
        "path",
        "ordinal",
        F.coalesce(F.get(heads, F.lit(0)), F.lit("")).alias("title"),
        F.array_join("own", "\n").alias("text"),
        (F.col("s") + 1).cast("long").alias("start_line"),
        (F.col("s") + F.col("n")).cast("long").alias("end_line"),
    )
