import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import retrieval as rt


def test_bm25_prefers_symbols(spark):
    docs = spark.createDataFrame([("a", "AuthService auth_service", "x", "body", ""), ("b", "", "x", "body", "AuthService AuthService AuthService"), ("c", "", "", "none", "")], "id string, symbol_tokens string, breadcrumb string, body string, comments string")
    got = rt.bm25(docs, ["AuthService"], rt.FIELD_WEIGHTS).orderBy(F.col("score").desc()).collect()
    assert [r.id for r in got] == ["a", "b"] and all(r.score > 0 for r in got)


def test_bm25_formula_and_overlapping_hits(spark):
    docs = spark.createDataFrame([(1, "banana"), (2, "ananas x"), (3, "cherry"), (4, "cherry pie"), (5, None)], "id int, t string")
    got = {r.id: r.score for r in rt.bm25(docs, ["ana"], {"t": 1.0}).collect()}
    size = {1: 4, 2: 6, 3: 4, 4: 8, 5: 0}
    mean, idf = sum(size.values()) / 5, math.log((5 - 2 + 0.5) / 2.5)
    assert got == {k: pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * size[k] / mean))) for k in (1, 2)}


def test_short_terms_void_the_strict_tier(spark):
    docs = spark.createDataFrame([(1, "authservice go"), (2, "authservice")], "id int, t string")
    got = rt.bm25(docs, ["authservice", "go"], {"t": 1.0}).collect()
    assert len(got) == 2 and not any(r.matched_all for r in got) and rt.bm25(docs, ["go"], {"t": 1.0}).count() == 0
    assert rt.bm25(docs, ["authservice", "go"], {"t": 1.0}, every=True).count() == 0


def test_relaxed_rows_fill_up(spark):
    rows = spark.createDataFrame([(k, float(k), k in (1, 2)) for k in range(30)], "id int, score double, matched_all boolean")
    got = [r.id for r in rt.strict_then_relaxed(rows, 5, "id").collect()]
    assert got == [29, 28, 27, 2, 1]
    enough = rows.withColumn("matched_all", F.lit(True))
    assert [r.id for r in rt.strict_then_relaxed(enough, 3, "id").collect()] == [29, 28, 27]


def test_fusion(spark):
    one = spark.createDataFrame([("a", 0, 0.9)], "k string, rank int, score double")
    assert [tuple(r) for r in rt.hybrid(one, one, ["k"]).collect()] == [("a", pytest.approx(1.0 / 20), "both")]
    assert [tuple(r) for r in rt.hybrid(one, one.limit(0), ["k"]).collect()] == [("a", 0.9, "vector")]


def test_cap(spark):
    rows = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 0.8), ("b", 0, 0.7), ("a", 2, 0.6), ("c", 0, 0.5)], "f string, i int, score double")
    keys = lambda cap: [(r.f, r.i) for r in rt.per_group_cap(rows, "f", cap, F.col("score").desc()).orderBy(F.col("score").desc()).collect()]
    assert keys(2) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)] and len(keys(0)) == 5 and keys(1) == [("a", 0), ("b", 0), ("c", 0)]


@pytest.mark.parametrize("scores,kept", [([0.05, 0.04], 1), ([0.9, 0.8, 0.46, 0.44, 0.9], 4), ([0.9, 0.2, 0.8], 2), ([0.3, 0.2, 0.1], 1), ([0.5] * 12, 8), ([], 0)])
def test_cutoff(spark, scores, kept):
    rows = spark.createDataFrame(list(enumerate(scores)), "id int, score double")
    assert rt.smart_cutoff(rows, "id").count() == kept


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<float>")
    got = rt.nearest(rows, rows.where("vec_id = 1"), 2).collect()
    assert [(r.vec_id, r.distance, r.score, r["rank"]) for r in got] == [(1, 0.0, 1.0, 0), (3, 0.0, 1.0, 1)]


def test_fallback(spark):
    files = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 9.0)], "path string, score double")
    chunks = spark.createDataFrame([("a", 0, "a", "match token"), ("a", 1, "a", "other token"), ("a", 2, "a", "token match token"), ("b", 0, "b", "match"), ("c", 0, "c", "nothing")], "file_path string, chunk_index int, breadcrumb string, display_code string")
    got = [(r.file_path, r.chunk_index, r.score) for r in rt.lexical_fallback(files, chunks, ["match", "token"]).orderBy("file_path", "chunk_index").collect()]
    assert got == [("a", 0, 4.0), ("a", 2, 4.0), ("b", 0, 1.5)]
    assert rt.lexical_fallback(files, chunks, ["match", "token"], total=1).count() == 1


def test_rerank(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.7)], "id int, score double")
    assert [r.id for r in rt.rerank(rows, F.col("score") * 2, 1, "id").collect()] == [2]
