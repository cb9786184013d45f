"""Queries of the toxicity, personal-data and licence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import licences, personal, toxicity
from weftline.llm.common import table

#: A text is predicted toxic from this score on.
TOXIC_FROM = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % 4 == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_secret, n_iban, n_other (counts of the added spans) and has_personal (any span at all)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.all_spans(docs, personal.fit(docs))
    count = lambda n: F.size(F.filter("_spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id", *(count(n).alias(f"n_{k}") for n, k in enumerate(personal.KINDS)), F.sha2(personal.as_text("_base"), 256).alias("base_sha256"), personal.as_text("_spans").alias("spans"), (F.size("_spans") > 0).cast("int").alias("has_personal")
    )


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each document, and all of them as name:dice:first_word:n_words, by place."""
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["licence"], F.format_string("%.6f", m["dice"]), m["first_word"].cast("string"), m["n_words"].cast("string")))
    return licences.scan(table(spark, sf_dir, "documents")).withColumn("matches", F.array_join(shown, ","))
