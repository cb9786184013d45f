"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.lineage import Scratch, clean_up, discard, fresh_path, named, shared_dir, written

__all__ = ["HOT_SHARE", "Scratch", "clean_up", "discard", "free_name", "fresh_path", "left_join_hot", "named", "shared_dir", "table", "texts", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot if it has more than one in so many of the rows; so there are at most so many hot keys.
HOT_SHARE = 1000


def left_join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """``left`` joined with the columns of ``right`` by ``key``, the rows of hot keys without a shuffle.

    ``right`` has each key once, with the number of its rows in ``left`` as ``weight``.
    The hot keys' rows of ``right``, at most ``HOT_SHARE`` of them, are broadcast; the
    left rows that they serve go through the other join under a key that is equal
    to none and is spread by ``spread``, so no task gets a hot key's rows together.
    """
    others = [c for c in right.columns if c not in (key, weight)]
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = right.where(F.col(weight) > F.lit(total / HOT_SHARE)).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in others]).limit(HOT_SHARE)
    cold = right.where(F.col(weight) <= F.lit(total / HOT_SHARE)).select(F.concat(F.lit("k"), key).alias("_key"), *others)
    served = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    own = F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), F.concat(F.lit("s"), F.coalesce(F.col(spread).cast("string"), F.lit("")))).otherwise(F.concat(F.lit("k"), key))
    joined = served.withColumn("_key", own).join(cold, "_key", "left")
    return joined.select(*left.columns, *[F.coalesce(c, f"_hot_{c}").alias(c) for c in others])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores after it until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and text alone, a null text as the empty one."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
