"""The n-gram join and exact top-k against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import near, queries_near, topk


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(class, links, copies) by id."""
    sets = {}
    for i, t in rows:
        if s := shingles(t):
            sets.setdefault(s, []).append(i)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            if len(keys[a] & keys[b]) >= 0.8 * len(keys[a] | keys[b]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, s in enumerate(keys):
        least[find(k)] = min([least.get(find(k), 1 << 60), *sets[s]])
    out = {i: (i, 0, 1) for i, t in rows if not shingles(t)}
    for k, s in enumerate(keys):
        out |= {i: (least[find(k)], links[k], len(sets[s])) for i in sets[s]}
    return out


def test_ids_that_repeat_or_are_null(spark):
    """Ids of one value, or of none, on texts that differ: classes follow the texts, and each text crosses the join once."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    bases = [rng.choices(words, k=80) for _ in range(30)]
    near_copy = lambda b: " ".join([*b[:40], "changed", *b[41:]])
    texts = [" ".join(b) for b in bases] + [near_copy(b) for b in bases]
    for shared in (None, 5):
        rows = [(shared, t) for t in texts] + [(shared, texts[0])] * 50 + [(9, texts[1])]
        got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all(r.n_links == 1 for r in got)
        assert sorted({r.n_copies for r in got}) == [1, 2, 51]
        assert sum(r.n_copies == 51 for r in got) == 51
        assert all(r.class_id == shared for r in got if r.doc_id == shared and shared is not None)
    docs = spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string")
    signed = near.signatures(docs, 5, 2, 3, "doc_id", "text")
    wanted = signed.groupBy("set_hash").agg(F.min("doc_id").alias("from_id"), F.min("_text_hash").alias("from_text"), F.min("bands").alias("bands"))
    found = near._grams_of(docs, wanted, 5, "doc_id", "text")
    assert found.count() == len(texts)


def planted(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.randrange(60, 160))
        for c in range(rng.choice([1, 2, 5, 40])):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
        rows.append((len(rows), " ".join(base)))
        rows.append((len(rows), " ".join(base).upper()))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "", "one", "One", "two words", "one two three four", "one two three four five"])]
    rows.append((len(rows), "long " * 20000 + "end"))
    return rows


def test_classes_equal_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "c", 1.0) for i, t in rows], "doc_id long, text string, set_hash string, bands double").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near.near_classes(docs).collect()}
    assert got == brute(rows)


def test_split_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_ROWS", 8)
    rows = planted(2)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("grams", [300, 4000])
def test_empty_blocks_count_nothing_twice(spark, monkeypatch, grams):
    monkeypatch.setattr(near, "BLOCK_GRAMS", grams)
    rng = random.Random(5)
    rows = []
    for copies in (2, 2, 2, 3, 5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        for k in range(copies):
            rows.append((len(rows), " ".join([*base[: 700 + k], "edited", *base[701 + k :]])))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_join_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in queries_near.op10_ngram_join(spark, data).collect()}
    assert got == brute(rows)


def test_join_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in near.near_classes(docs).collect()), key=str)
    assert got == sorted([(None, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1), (None, None, 1)], key=str)
    assert near.near_classes(docs.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "y"), (4, "other words in here today ok", "z"), (5, "", "e"), (6, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string").withColumn("_copy", F.lit(2))
    got = near.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 6]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (101, 102), (200, 201)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100, 201: 200}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_meet_the_recall():
    for similarity in (0.7, 0.8, 0.95):
        bands, rows = near.bands_for(similarity, 0.999, 128)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999 and bands * rows <= 128


def brute_top(vectors, k, scale=64):
    good = [(i, np.floor(scale * np.array(v, dtype=float)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-int(np.dot(np.pad(a, (0, max(0, len(b) - len(a)))), np.pad(b, (0, max(0, len(a) - len(b)))))), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_query(spark, data):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries_near.op4_exact_top_k(spark, data).collect())
    assert got == brute_top(vectors, 20)


@pytest.mark.parametrize("group", [16, 4096])
def test_top_k_of_odd_rows(spark, group):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(90)] + [(100 + k, [0.5] * 8) for k in range(60)] + [(200, [0.5] * 3), (220, None), (240, [float("nan")] * 8), (260, [None] * 8), (None, [1.0] * 8), (280, [float("inf")] + [0.0] * 7), (300, [])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, code int")
    got = sorted(tuple(r) for r in topk.exact_top_k(vectors, F.col("id") % 20 == 0, 5, group=group).collect())
    assert got == brute_top(rows, 5)


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [0.1])], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(few, F.col("id") % 20 == 0).count() == 4
    assert topk.exact_top_k(few.limit(0), F.col("id") % 20 == 0).count() == 0


def test_large_components_are_exact(spark):
    big = float(2**25)
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 2.0]), (3, [-big, 0.0])]
    got = [(r.id, r.score) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, 3).collect()]
    assert got == [(2, (2**31) ** 2 + 64 * 128), (1, (2**31) ** 2 + 64 * 64), (3, -((2**31) ** 2))]
