"""Queries of the similarity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import near, topk, yinyang
from weftline.llm.common import table


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
    return found.withColumnRenamed("id", "vec_id")


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = yinyang.cluster(vectors)
    if found is None:
        schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    return yinyang.with_inertia(found).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
