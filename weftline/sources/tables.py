"""Canonical views over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, path, hash, size, language, content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("hash"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a savings ledger: session_id, bucket, model, ts_ms, tokens_saved, dollars_saved.

    The bucket is the event type; the model comes from the properties' number.
    """
    # Models that ledger rows are spread over; the last has no price.
    models = F.array(*[F.lit(m) for m in ("opus", "sonnet", "haiku", "gpt-4o", "gemini-1.5-pro", "unpriced")])
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("bucket"),
        F.element_at(models, (k % 6 + 1).cast("int")).alias("model"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.floor(F.col("value") * 10).cast("long").alias("tokens_saved"),
        k.alias("k"),
    )
