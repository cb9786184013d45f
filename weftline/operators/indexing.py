"""Incremental maintenance of indexed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """(path, status): added, modified, unchanged or deleted; both sides have hash, and mtime and size where known.

    Equal time and size are enough to be unchanged, and so is an equal hash.
    """
    quick = F.lit(False)
    if "mtime" in before.columns and "mtime" in now.columns:
        quick = (F.col("b.mtime") == F.col("n.mtime")) & (F.col("b.size") == F.col("n.size"))
    joined = before.alias("b").join(now.alias("n"), F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    status = (
        F.when(F.col(f"n.{key}").isNull(), "deleted")
        .when(F.col(f"b.{key}").isNull(), "added")
        .when(F.coalesce(quick, F.lit(False)) | (F.col("b.hash") == F.col("n.hash")), "unchanged")
        .otherwise("modified")
    )
    return joined.select(F.coalesce(f"b.{key}", f"n.{key}").alias(key), status.alias("status"))


def scan_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "unchanged", "deleted")])


def to_heal(files: DataFrame) -> DataFrame:
    """Files whose chunks were never, or not from this content, written."""
    return files.where(~F.col("vector_index_hash").eqNullSafe(F.col("hash")))


def upsert(existing: DataFrame, new: DataFrame, key: str = "path", order: str | None = None) -> DataFrame:
    """The next snapshot: new rows replace those of the same key; of repeated new keys the last in ``order`` counts."""
    if order:
        new = new.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The next snapshot where a key that is there already stays as it is."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def without(existing: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return existing.join(gone.select(key), key, "left_anti")


def acknowledge(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """``files`` with vector_index_hash set to the hash that ``done`` (path, hash) says was written."""
    new = done.select(key, F.col("hash").alias("_done"))
    return files.join(new, key, "left").withColumn("vector_index_hash", F.coalesce("_done", "vector_index_hash")).drop("_done")


def cleared(rows: DataFrame) -> DataFrame:
    """The next snapshot after everything was deleted: the same columns, no rows."""
    return rows.where(F.lit(False))


def replace_chunks(chunks: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """Chunks of the files in ``new`` replaced as a whole."""
    return chunks.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def consistency(vector_ids: DataFrame, text_ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(chunk_id, missing_in): keys that one of the two indexes lacks."""
    left, right = vector_ids.select(key).distinct(), text_ids.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("missing_in", F.lit("text")).unionByName(right.join(left, key, "left_anti").withColumn("missing_in", F.lit("vector")))


def repaired(text_index: DataFrame, vector_ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The text index without rows that the vector index lacks."""
    return text_index.join(vector_ids.select(key).distinct(), key, "left_semi")


def file_chunks(chunks: DataFrame, paths: DataFrame, key: str = "file_path") -> DataFrame:
    """The chunks of the given files, in order."""
    return chunks.join(paths.select(key).distinct(), key, "left_semi").orderBy(key, "chunk_index")


def younger_than(cache: DataFrame, now_ms: int, most_ms: int, written: str = "written_at") -> DataFrame:
    """The cache without entries that are older than ``most_ms``."""
    return cache.where(F.col(written) >= now_ms - most_ms)


def graph_states(files: DataFrame, states: DataFrame) -> DataFrame:
    """(path, hash, status): skipped where the language has no extractor, indexed or error where the hash has been tried, else pending."""
    known = states.select("path", F.col("hash").alias("_hash"), F.col("status").alias("_status"))
    fits = F.lower(F.substring_index("path", ".", -1)).isin("ts", "tsx", "js", "jsx")
    tried = F.col("_hash").eqNullSafe(F.col("hash")) & F.coalesce(F.col("_status").isin("indexed", "error"), F.lit(False))
    return files.join(known, "path", "left").select("path", "hash", F.when(~fits, "skipped").when(tried, F.col("_status")).otherwise("pending").alias("status"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")


def write_snapshot(df: DataFrame, root: str, version: int, *keys: str, buckets: int | None = None) -> str:
    """Write a version's folder, then the pointer to it; readers see the old version or the new one, whole."""
    path = f"{root.rstrip('/')}/v{version}"
    rows = df.repartition(buckets, *keys) if buckets and keys else df
    (rows.sortWithinPartitions(*keys) if keys else rows).write.mode("errorifexists").parquet(path)
    df.sparkSession.createDataFrame([(version, path)], "version int, path string").coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/_versions")
    return path


def read_snapshot(spark, root: str) -> DataFrame:
    newest = spark.read.schema("version int, path string").json(f"{root.rstrip('/')}/_versions").orderBy(F.col("version").desc()).first()
    return spark.read.parquet(newest["path"])
