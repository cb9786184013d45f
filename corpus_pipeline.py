"""The corpus pipeline: toxicity, near duplicates, personal data, packing.

Defined cases of every stage: a null or empty text counts as one without content;
rows that repeat, null ids and further columns, whatever their names, are passed on;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import near, packing, personal, toxicity
from weftline.llm.common import clean_up, free_name, fresh_path, named, table
from weftline.llm.queries_labels import TOXIC_FROM, held_out
from weftline.llm.queries_text import vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels of held-out documents aren't learned from.

    Without usable labels every document stays.
    """
    voters = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = free_name(docs, "_score")
    return toxicity.with_score(docs, voters, score_col=score).where(F.col(score) < TOXIC_FROM).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id.

    Each document without words is a class of its own; of rows that repeat one stays;
    rows without id stay where no row of their class has one.
    """
    return near.keep_one(docs)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars, where there is such a column, to match.

    A null text stays null, with n_chars null.
    """
    out = personal.redact(docs, personal.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids; a document without text has the end id alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("near_duplicates", keep_one_of_each), ("personal_data", redact_personal), ("packing", pack)]

#: Label models, boosted trees and tokenizers are no SQL; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again; what a stage no longer needs is deleted."""
    docs, others = table(spark, sf_dir, "documents"), named()
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clean_up(spark, keep=(*others, path))
    return docs
