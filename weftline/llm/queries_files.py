"""Queries of the archive, sharding and fingerprint operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import imatch, sharding, warc
from weftline.llm.common import fresh_path, table

#: The layout that is resharded: documents by their text's checksum, as 16 shards, which copies make unequal.
OLD_SHARDS, NEW_SHARDS = 16, 24


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")) % OLD_SHARDS
    rows, moves = sharding.reshard(docs, old, OLD_SHARDS, NEW_SHARDS)
    files = sharding.rewrite(rows, fresh_path(spark, "shards"), moves, all_shards=True)
    text = F.coalesce("text", F.lit(""))
    # what is asked of the texts is taken before the slots are joined, so texts aren't shuffled again
    files = files.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(F.encode(text, "utf-8"))}).drop("text", "_size", "_spread")
    return sharding.slots(files).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.join_revisits(warc.read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs, frequencies = imatch.document_frequencies(docs)
    band = spark.sparkContext.broadcast(imatch.lexicon(n_docs, frequencies))

    def make():
        own = imatch.Fingerprints(band.value)
        known: list = [None, None]  # the next document's fingerprint serves when its own turn comes

        def row(doc_id, text: str, after: str) -> dict:
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            first = known[1] if known[0] == text else own.of(text)
            then = own.of(after)
            known[:] = after, then
            changed = own.of(edited)
            return {
                "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": first, "edited_fingerprint": changed,
                "near_edited": imatch.likeness(first, changed), "near_next": imatch.likeness(first, then),
            }

        return row

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next"))])
    return imatch.with_next(docs, make, schema, n_docs)
