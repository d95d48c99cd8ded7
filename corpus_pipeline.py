"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All
but the last return the columns of ``documents``; the last returns the rows that the mix
takes, with ``copies`` (how often each is repeated) and the figures of its source.

Defined results, the same in every stage: an empty table gives an empty one with the same
columns; columns beside those of ``documents`` are left out first, so no name clashes; null
and empty texts fail the quality rules, and a stage that meets one all the same passes it on
(the mix takes none of it); null ids, sources and languages are values like others, and rows
that repeat an id with unlike texts are documents of their own; of rows equal in id and text
one is left after near_dedup; of ties the smallest id stays, and without ids the smallest
fingerprint of the text; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import op2_secrets, op4_near_dedup, op6_decontaminate, op9_mixing, op10_quality
from corpusmill.llm.shared import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines over the limit; n_chars counts the new text."""
    from pyspark.sql import functions as F

    return op10_quality.keep_good_rows(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return op4_near_dedup.drop_near_duplicates(docs.select(*COLUMNS), shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return op6_decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars counts the new text."""
    from pyspark.sql import functions as F

    clean = op2_secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with their number of copies."""
    return op9_mixing.mixed_rows(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: Components, seeds and random directions can't be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
