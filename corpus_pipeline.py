"""The corpus pipeline: documents through five operators, each stage written and read again.

1. quality rules: failing lines go from the texts, rejected documents go altogether;
2. n-gram Jaccard join: of each group of near-duplicates the document with the least id stays;
3. benchmark decontamination: documents with a benchmark window go;
4. secret scans: secrets are replaced by a mark;
5. packing: what is left becomes padded token sequences, each on the row of its first piece.

All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, ngram_join, packing, quality_rules, secrets
from loomgraph.llm.queries import tokenizer_path
from loomgraph.llm.workspace import forget, keep


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has it, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(quality_rules.clean(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged in place, so repeated ids need no join back."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece; that of a sequence's first piece has the sequence in ``input_ids``."""
    return packing.read_back(packing.pack_sequences(docs, tokenizer_path(), window=2048, end_id=1), with_sequences=True)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scan", redact),
    ("packing", pack),
]

#: Chosen paths, tokenizers and automata are not SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written below the shared folder and read again, and go when the next one's are there."""
    given, docs = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        made = keep(stage(spark, docs, sf_dir))
        if given is not None:
            forget(given)
        given = docs = made
    return docs
