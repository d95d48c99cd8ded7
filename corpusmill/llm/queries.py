"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op1_warc,
    op2_secrets,
    op3_toxicity,
    op4_near_dedup,
    op5_substrings,
    op6_decontaminate,
    op7_pii,
    op8_chat,
    op9_mixing,
    op10_quality,
    op11_lm,
    op12_divergence,
    op13_merkle,
    oracles,
)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    _QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_warc(spark: SparkSession, sf_dir: str, op=op1_warc) -> DataFrame:
    return op.read_archives(op.normalise_archives(op.write_archives(_table(spark, sf_dir, "pages")))).drop("url")


@_query
def op2_secrets(spark: SparkSession, sf_dir: str, op=op2_secrets) -> DataFrame:
    return op.secrets(_table(spark, sf_dir, "documents"))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str, op=op3_toxicity) -> DataFrame:
    return op.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op4_near_dedup(spark: SparkSession, sf_dir: str, op=op4_near_dedup) -> DataFrame:
    return op.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


@_query
def op5_substrings(spark: SparkSession, sf_dir: str, op=op5_substrings) -> DataFrame:
    return op.deduplicate_substrings(_table(spark, sf_dir, "documents"), keep_text=False)


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str, op=op6_decontaminate) -> DataFrame:
    return op.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row_key")


@_query
def op7_pii(spark: SparkSession, sf_dir: str, op=op7_pii) -> DataFrame:
    return op.pii_digest(_table(spark, sf_dir, "documents"))


@_query
def op8_chat(spark: SparkSession, sf_dir: str, op=op8_chat) -> DataFrame:
    """All conversations and one more, whose texts imitate the template's control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), roles.alias("x"))
    more = more.select("conv_id", F.col("x.turn").cast("long").alias("turn"), "x.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    return op.chat_digest(rows.unionByName(more))


@_query
def op9_mixing(spark: SparkSession, sf_dir: str, op=op9_mixing) -> DataFrame:
    return op.mixture(_table(spark, sf_dir, "documents")).drop("n", "source")


@_query
def op10_quality(spark: SparkSession, sf_dir: str, op=op10_quality) -> DataFrame:
    return op.quality(_table(spark, sf_dir, "documents")).drop("row_key")


@_query
def op11_lm(spark: SparkSession, sf_dir: str, op=op11_lm) -> DataFrame:
    return op.score_documents(_table(spark, sf_dir, "documents"), held_out=op.fold())


@_query
def op12_divergence(spark: SparkSession, sf_dir: str, op=op12_divergence) -> DataFrame:
    return op.divergence(_table(spark, sf_dir, "documents"))


@_query
def op13_merkle(spark: SparkSession, sf_dir: str, op=op13_merkle) -> DataFrame:
    """Rows whose id has an even crc32 lose the line breaks of their texts after the manifest was made."""
    docs = _table(spark, sf_dir, "documents")
    return op.manifest(docs, tampered={"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
