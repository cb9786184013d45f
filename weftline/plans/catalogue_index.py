"""Queries of the stored index and of tables that change in part, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.postings import TrigramIndex
from weftline.plans.catalogue import BM25, TERMS, _bm25_sql, query
from weftline.plans.catalogue_code import _FIELDED, FIELDS, fielded
from weftline.plans.lineage import fresh_path
from weftline.sources.keyed import KeyedTable
from weftline.sources.tables import files, table


def _index(spark: SparkSession, docs: DataFrame, fields: tuple[str, ...]) -> TrigramIndex:
    index = TrigramIndex(spark, fresh_path(spark, "index"), fields, buckets=16)
    index.upsert(docs)
    return index


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    found = _index(spark, table(spark, sf, "documents").select("doc_id", "text"), ("text",)).search(TERMS)
    return found.orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_FIELDED}, {_bm25_sql(FIELDS, 'low', 'doc_id')} SELECT doc_id, round(score, 6) AS score, matched_all FROM scored")
def index_search_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = _index(spark, fielded(spark, sf), tuple(FIELDS)).search(TERMS, FIELDS)
    return found.select("doc_id", F.round("score", 6).alias("score"), "matched_all")


# A third of the documents change, a fifth go, some come back, some are new.
_CHANGED = """low AS (SELECT doc_id, lower(CASE WHEN doc_id % 3 = 0 THEN lang || ' ' || right(coalesce(text, ''), 200) || ' licensed' ELSE coalesce(text, '') END) AS body FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0
    UNION ALL SELECT -1 - doc_id, lower(source || ' ' || left(coalesce(text, ''), 300)) FROM documents WHERE doc_id % 4 = 1)"""


@query(f"WITH {_CHANGED}, {_bm25_sql({'body': 1.0}, 'low', 'doc_id')} SELECT doc_id, round(score, 6) AS score, matched_all FROM scored")
def index_search_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    index = _index(spark, docs, ("text",))
    index.delete(docs.where("doc_id % 5 = 0"))
    index.upsert(docs.where("doc_id % 3 = 0 and (doc_id % 5 <> 0 or doc_id % 10 = 0)").withColumn("text", F.concat_ws(" ", "lang", F.right("text", F.lit(200)), F.lit("licensed"))))
    index.upsert(docs.where("doc_id % 10 = 0 and doc_id % 3 <> 0"))
    index.compact(most_segments=2)
    index.upsert(docs.where("doc_id % 4 = 1").select((-1 - F.col("doc_id")).alias("doc_id"), F.concat_ws(" ", "source", F.left("text", F.lit(300))).alias("text")))
    return index.search(TERMS).select("doc_id", F.round("score", 6).alias("score"), "matched_all")


@query(
    """WITH f AS (SELECT doc_id, sha256(text) AS hash, strlen(text)::BIGINT AS size FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN md5(hash) ELSE hash END AS hash, CASE WHEN doc_id % 4 = 1 THEN size + 2 WHEN doc_id % 10 = 7 THEN -1 ELSE size END AS size FROM f WHERE doc_id % 7 <> 0 OR doc_id % 4 = 1
    UNION ALL SELECT -1 - doc_id, hash, size FROM f WHERE doc_id % 9 = 2"""
)
def keyed_table_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf).select("doc_id", "hash", "size")
    changed = KeyedTable(spark, fresh_path(spark, "keyed"), ("doc_id",), buckets=16)
    changed.create(rows)
    changed.upsert(rows.where("doc_id % 10 = 7").withColumn("size", F.lit(-1).cast("long")), batch=0)
    changed.delete(rows.where("doc_id % 7 = 0"), batch=1)
    steps = F.explode(F.array(F.lit(1), F.lit(2)))
    changed.upsert(rows.where("doc_id % 4 = 1").withColumn("k", steps).select("doc_id", F.md5("hash").alias("hash"), (F.col("size") + F.col("k")).alias("size")), order="size", batch=2)
    changed.compact(most_deltas=1)
    changed.upsert(rows.where("doc_id % 9 = 2").withColumn("doc_id", -1 - F.col("doc_id")), batch=3)
    changed.upsert(rows.withColumn("size", F.lit(0).cast("long")), batch=3)  # a batch that runs again changes nothing
    return changed.read()
