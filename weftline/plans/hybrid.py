"""The retrieval pipeline composed: recall, fusion, penalty, filters, cap, cut-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import generated_penalty, path_matches
from weftline.operators.filters import field_filter
from weftline.operators.retrieval import bm25, hybrid, nearest, per_group_cap, ranked, rerank, smart_cutoff


def hybrid_search(
    files: DataFrame,
    vectors: DataFrame,
    query_vector: DataFrame,
    terms: list[str],
    languages: list[str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    filters: dict | None = None,
    top_k: int = 80,
    fused_top: int = 60,
    cap: int = 5,
) -> DataFrame:
    """doc_id, path, score, source of the fused candidates.

    ``files`` has doc_id, path, language, content and source_name; a file's vector
    has the file's id. The language holds before recall; path and field filters
    after it, so they can leave less than was asked for. Lists are limited before
    they are ranked, so nothing but the recalled rows is ever in one task.
    """
    rows = files.where(F.col("language").isin(languages)) if languages else files
    lexical = ranked(bm25(rows.select("doc_id", "content"), terms, {"content": 1.0}).select("doc_id", "score"), top_k, F.col("score").desc(), "doc_id")
    vector = nearest(vectors.join(rows.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), query_vector, top_k).withColumnRenamed("vec_id", "doc_id")
    fused = hybrid(vector.select("doc_id", "score", "rank"), lexical.select("doc_id", "score", "rank"), ["doc_id"])
    joined = fused.join(rows.select("doc_id", "path", "language", "source_name"), "doc_id").withColumn("score", generated_penalty(F.col("path"), F.col("score")))
    if include or exclude:
        joined = joined.where(path_matches(F.col("path"), include or [], exclude or []))
    if filters:
        joined = field_filter(joined.withColumn("breadcrumb", F.col("path")), filters, path="path").drop("breadcrumb")
    top = joined.orderBy(F.col("score").desc(), "doc_id").limit(fused_top)
    return per_group_cap(top, "source_name", cap, F.col("score").desc(), "doc_id").select("doc_id", "path", "score", "source")


#: Expansion of a thorough search: two neighbours to each side, three siblings, no imports.
THOROUGH = {"hops": 2, "siblings": 3, "files_per_seed": 0}


def seeds(candidates: DataFrame, scorer, top: int = 10) -> DataFrame:
    """Reranked candidates after the adaptive cut-off."""
    return smart_cutoff(rerank(candidates, scorer, top, "doc_id"), "doc_id")
