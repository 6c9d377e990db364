"""The generated tables seen as the engine's own: files, symbols, relationships, sessions, memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import EDGE, upsert_edges


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def content_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (path, language, text)."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("lang").alias("language"), "text")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the star schema as symbols; a symbol's file is its table, its owner's name qualifies it."""
    r, n, c, s, o, p = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "part"))

    def made(df: DataFrame, letter: str, key: str, kind: str, name, owner, table: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"),
            F.lit("sql").alias("language"),
            F.lit(kind).alias("kind"),
            name.alias("name"),
            (name if owner is None else F.concat(owner, F.lit("."), name)).alias("qualified_name"),
            F.lit(table).alias("file"),
            (F.col(key) * 100).cast("long").alias("start_byte"),
            (F.col(key) * 100 + 99).cast("long").alias("end_byte"),
            (F.col(key) + 1).cast("long").alias("start_line"),
            (F.col(key) + 1).cast("long").alias("end_line"),
        )

    names = n.select("n_nationkey", "n_name")
    parts = [
        made(r, "r_", "r_regionkey", "module", F.col("r_name"), None, "region"),
        made(n.join(r, n.n_regionkey == r.r_regionkey), "n_", "n_nationkey", "class", F.col("n_name"), F.col("r_name"), "nation"),
        made(c.join(names, c.c_nationkey == names.n_nationkey), "c_", "c_custkey", "class", F.col("c_name"), F.col("n_name"), "customer"),
        made(s.join(names, s.s_nationkey == names.n_nationkey), "s_", "s_suppkey", "class", F.col("s_name"), F.col("n_name"), "supplier"),
        made(o, "o_", "o_orderkey", "function", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")), "orders"),
        made(p, "p_", "p_partkey", "function", F.concat("p_name", F.lit(" "), "p_brand"), F.col("p_type"), "part"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contains: region-nation-customer/supplier; calls: customer-order-part; references: part-supplier.  One row per evidence key, the greatest confidence of equal ones."""
    n, c, s, o = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders"))
    li = read(spark, sf_dir, "lineitem")

    def made(df: DataFrame, a: str, ka: str, b: str, kb: str, kind: str, table: str, confidence=None, line=None) -> DataFrame:
        return df.select(
            F.concat(F.lit(a), F.col(ka).cast("string")).alias("source_id"),
            F.concat(F.lit(b), F.col(kb).cast("string")).alias("target_id"),
            F.lit(kind).alias("kind"),
            F.lit(table).alias("provenance"),
            (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
            F.lit(f"{kind} by {table}").alias("explanation"),
            F.lit(table).alias("evidence_file"),
            (F.lit(0) if line is None else line).cast("long").alias("evidence_line"),
            F.lit(0).cast("long").alias("evidence_site"),
        )

    items = li.groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max(1 - F.col("l_discount")).alias("confidence"))
    parts = [
        made(n, "r_", "n_regionkey", "n_", "n_nationkey", "contains", "nation"),
        made(c, "n_", "c_nationkey", "c_", "c_custkey", "contains", "customer"),
        made(s, "n_", "s_nationkey", "s_", "s_suppkey", "contains", "supplier"),
        made(o, "c_", "o_custkey", "o_", "o_orderkey", "calls", "orders"),
        made(items, "o_", "l_orderkey", "p_", "l_partkey", "calls", "lineitem", F.col("confidence"), F.col("l_linenumber")),
        made(li.select("l_partkey", "l_suppkey").distinct(), "p_", "l_partkey", "s_", "l_suppkey", "references", "lineitem"),
    ]
    out = parts[0].select(*EDGE)
    for part in parts[1:]:
        out = out.union(part.select(*EDGE))
    return out


def sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """conversations as sessions and their events."""
    chats = read(spark, sf_dir, "conversations")
    own = chats.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), F.lit("w").alias("workspace_id"), F.concat(F.lit("Session "), F.col("conv_id").cast("string")).alias("title"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("started_at_ms"), F.lit(0).cast("long").alias("updated_at_ms"), F.lit(None).cast("long").alias("ended_at_ms"))
    events = chats.select(F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit("e"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.col("role").alias("kind"), F.col("text").alias("body"), F.col("turn").cast("long").alias("created_at_ms"))
    return own, events


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("workspace_id"), F.col("text").alias("body"), F.array("lang").alias("tags"), F.lit(0).cast("long").alias("created_at_ms"), F.col("doc_id").alias("updated_at_ms"))


__all__ = ["content_files", "memories", "read", "relationships", "sessions", "symbols", "upsert_edges"]
