"""The stored trigram index and tables that change in part."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import postings, retrieval
from weftline.operators.postings import TrigramIndex
from weftline.sources.keyed import KeyedTable


def shown(df):
    return sorted((r.doc_id, round(r.score, 9), r.matched_all) for r in df.collect())


def texts(n=120, seed=2):
    rng = random.Random(seed)
    parts = ["lic", "ense", "License", "aaaa", "é🙂é🙂é", "the ", "token", "_x", "\n", "ab", "ba", "NULL", "thion"]
    return [(k, "".join(rng.choices(parts, k=rng.randrange(40))), rng.choice(["license", "", None, "toKEN license token"])) for k in range(n)]


SCHEMA = "doc_id long, body string, title string"
ASKED = [["license"], ["aaa"], ["abab", "é🙂é"], ["token", "license", "ens"], ["nothing here"], ["xy"], ["xy", "license"], ["LICENSE", "the token"], ["aaaaaaa"], []]


@pytest.mark.parametrize("weights", [{"body": 1.0}, {"body": 1.5, "title": 6.0}])
def test_search_equals_the_scan(spark, tmp_path, weights):
    docs = spark.createDataFrame([*texts(), (900, None, None), (901, "ab", "")], SCHEMA)
    index = TrigramIndex(spark, str(tmp_path / "i"), ("body", "title"), buckets=4)
    index.upsert(docs)
    for k, terms in enumerate(ASKED):
        assert shown(index.search(terms, weights, k % 2 == 0)) == shown(retrieval.bm25(docs, terms, weights, k % 2 == 0)), terms


def test_changes_touch_their_buckets(spark, tmp_path):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA)
    index = TrigramIndex(spark, str(tmp_path / "i"), ("body", "title"), buckets=64)
    index.upsert(docs)
    changed = spark.createDataFrame([(7, "zqz", None), (1000, "zqz license", None)], SCHEMA)
    need = {int(b) for t in ("zqz", "zqz license") for b in postings.bucket_of(postings.grams_of(t), 64)}
    assert set(index.upsert(changed)) == need
    assert len(index.delete(changed.where("doc_id = 1000").select("doc_id"))) == 1  # no bucket of postings, one of lengths
    index.delete(spark.createDataFrame([(3,), (5555,)], "doc_id long"))
    now = spark.createDataFrame([r for r in rows if r[0] not in (3, 7)] + [(7, "zqz", None)], SCHEMA)
    for terms in (["zqz"], ["license", "token"]):
        assert shown(index.search(terms)) == shown(retrieval.bm25(now, terms, {"body": 1.0, "title": 1.0}))
    assert set(index.compact(most_segments=1)) == need
    stale = index.occurrences(["license"]).where("doc_id = 1000").count()
    assert stale == 0
    assert shown(index.search(["license", "token"])) == shown(retrieval.bm25(now, ["license", "token"], {"body": 1.0, "title": 1.0}))
    assert index.compact(most_segments=1) == []


def test_search_reads_its_trigrams_alone(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"), ("body", "title"), buckets=64)
    index.upsert(spark.createDataFrame(texts(), SCHEMA))
    found = index.occurrences(["thion"])
    buckets = {int(p.split("bucket=")[1].split("/")[0]) for p in found.inputFiles()}
    assert buckets <= {int(b) for b in postings.bucket_of(postings.grams_of("thion"), 64)}
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "In(gram," in plan
    assert [k for _, k in postings.cover("abcdefgh")] == [0, 3, 5]


def test_empty_index(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"), ("body",))
    index.upsert(spark.createDataFrame([], "doc_id long, body string"))
    assert index.search(["license"]).count() == 0


def files_of(folder):
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_one_key_touches_one_bucket(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = KeyedTable(spark, folder, ("k",), buckets=64)
    table.create(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    before = files_of(folder)
    assert len(table.upsert(spark.createDataFrame([(5, "b")], "k long, v string"), batch=0)) == 1
    new = files_of(folder) - before
    assert len({f.split("_bucket=")[1].split("/")[0] for f in new}) == 1 and before <= files_of(folder)
    assert table.upsert(spark.createDataFrame([(5, "c")], "k long, v string"), batch=0) == []
    assert files_of(folder) == before | new
    assert table.read().where("k = 5").first().v == "b" and table.read().count() == 1000
    assert table.lookup(spark.createDataFrame([(5,), (77,), (5000,)], "k long")).count() == 2


def test_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    table = KeyedTable(spark, str(tmp_path / "t"), ("a", "b"), buckets=4, most_deltas=2)
    rows = {(k, str(k % 3)): "0" for k in range(50)} | {(None, "x"): "0"}
    schema = "a long, b string, v string, seq int"
    as_rows = lambda d: spark.createDataFrame([(*k, v, 0) for k, v in d.items()], schema)
    table.create(as_rows(rows))
    for n in range(8):
        if n % 3 == 2:
            gone = rng.sample(list(rows), 6) + [(-1, "none")]
            table.delete(spark.createDataFrame(gone, "a long, b string"), batch=n)
            rows = {k: v for k, v in rows.items() if k not in gone}
        else:
            changes = [(*rng.choice([*rows, (100 + n, "new")]), str(n), s) for s in range(12)]
            table.upsert(spark.createDataFrame([(a, b, f"{v}-{s}", s) for a, b, v, s in changes], schema), order="seq", batch=n)
            rows |= {(a, b): f"{v}-{s}" for a, b, v, s in changes}
        if n % 2:
            table.compact()
        if n == 5:
            table.vacuum()
        assert {(r.a, r.b): r.v for r in table.read().collect()} == rows
    assert all(len(v) <= 3 for v in table.version()["buckets"].values())


def test_readers_see_a_version_whole(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = KeyedTable(spark, folder, ("k",), buckets=4)
    table.create(spark.range(10).withColumnRenamed("id", "k"))
    staged = table.staged(spark.range(10, 20).withColumnRenamed("id", "k"), table.version())  # written, and lost before it was published
    assert table.read().count() == 10
    table.upsert(spark.range(50, 52).withColumnRenamed("id", "k"))
    assert sorted(r.k for r in table.read().collect()) == [*range(10), 50, 51]
    with pytest.raises(FileExistsError):
        table.publish(staged)


def test_positions_are_packed_and_read_back():
    rng = random.Random(5)
    rows = [sorted(rng.sample(range(1 << 31), rng.choice([0, 1, 3, 40]))) for _ in range(50)] + [[0, 127, 128, 16511, 2_113_663], []]
    found = postings.packed(np.array([v for r in rows for v in r], dtype=np.int64), np.array([len(r) for r in rows]))
    values, counts = postings.unpacked(found.slice(2, 53))
    assert values.tolist() == [v for r in rows[2:55] for v in r] and counts.tolist() == [len(r) for r in rows[2:55]]


def test_neither_upsert_nor_compact_shuffles_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "GROUP", 300)  # several groups in each task
    plans = []
    monkeypatch.setattr(TrigramIndex, "_write", lambda self, rows, segment, write=TrigramIndex._write: plans.append(rows) or write(self, rows, segment))
    rows = texts(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    index = TrigramIndex(spark, str(tmp_path / "i"), ("body", "title"), buckets=4)
    index.upsert(docs)
    index.delete(docs.where("doc_id % 3 = 0"))
    index.upsert(docs.where("doc_id % 5 = 0").withColumn("body", F.lit("token license")))
    index.compact(most_segments=1)
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    postings_side = plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
    assert "Exchange" not in postings_side.replace("BroadcastExchange", "") and "FileScan" in postings_side
    now = docs.where("doc_id % 3 <> 0 or doc_id % 5 = 0").withColumn("body", F.when(F.col("doc_id") % 5 == 0, "token license").otherwise(F.col("body")))
    assert index.occurrences(["license"]).where("doc_id % 3 = 0 and doc_id % 5 <> 0").count() == 0
    for terms in (["license", "token"], ["aaa"], ["é🙂é", "the token"]):
        assert shown(index.search(terms)) == shown(retrieval.bm25(now, terms, {"body": 1.0, "title": 1.0}))
