"""Sharding, WARC archives and I-Match against brute force."""

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import common, imatch, queries_files, sharding, warc
from weftline.llm.common import fresh_path
from weftline.plans import lineage


def test_intermediate_tables_can_be_deleted(spark):
    import os

    df = common.written(spark.range(3).toDF("a"), "t")
    path = lineage.named()[-1]
    assert df.count() == 3 and os.path.isdir(path)
    others = lineage.named()[:-1]
    common.clean_up(spark, keep=tuple(others))
    assert not os.path.exists(path) and lineage.named() == others


def test_hot_keys_join_like_others(spark):
    rows = [(k, "hot" if k % 2 else f"k{k % 40}" if k % 5 else None) for k in range(4000)]
    left = spark.createDataFrame(rows, "id long, key string")
    right = left.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    got = {r.id: r.most for r in common.left_join_hot(left, right.where("key <> 'k4'"), "key", "n", "id").collect()}
    most = {r.key: r.most for r in right.collect() if r.key != "k4"}
    assert got == {i: most.get(k) for i, k in rows}


def test_moves_are_the_fewest():
    rng = random.Random(3)
    for _ in range(30):
        old = [rng.randrange(0, 90) for _ in range(rng.randrange(1, 5))]
        new = rng.randrange(1, 6)
        caps = [-(-sum(old) // new)] * new
        moves = sharding.cheapest_moves(old, caps)
        assert [sum(row) for row in moves] == old
        assert all(sum(row[j] for row in moves) <= caps[j] for j in range(new))
        stays = sum(row[i] for i, row in enumerate(moves) if i < new)
        assert stays == sum(min(o, caps[i]) for i, o in enumerate(old) if i < new)
    with pytest.raises(ValueError):
        sharding.cheapest_moves([5], [4])


def check_shards(rows, texts, shards):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        by_shard.setdefault(r.shard, []).append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert set(by_shard) <= set(range(shards))
    return [sum(r["size"] for r in by_shard.get(j, [])) for j in range(shards)]


def test_sharding_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sizes = check_shards(queries_files.op5_sharding(spark, data).collect(), texts, 24)
    longest = max(len((t or "").encode()) for t in texts.values()) + 8
    assert max(sizes) - min(sizes) <= 2 * longest


def test_sharding_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, 9, 7) for k, t in enumerate([None, "", "aé", "same", "same", "x" * 9000] * 20)] + [(None, "n", 9, 7)], "doc_id long, text string, _size int, keep int")
    rows, moves = sharding.reshard(docs, F.lit(0), 1, 4)
    out = sharding.slots(sharding.rewrite(rows, fresh_path(spark, "t"), moves, all_shards=True))
    got = out.collect()
    assert len(got) == 121 and {r.keep for r in got} == {7} and sum(r._size for r in got) == sum(map(sum, moves))
    for j in range(4):
        own = sorted(r._slot for r in got if r._shard == j)
        assert own == list(range(len(own)))
    assert sharding.slots(rows.limit(0)).count() == 0
    empty, none = sharding.reshard(docs.limit(0), F.lit(0), 1, 4)
    assert empty.count() == 0 and sum(map(sum, none)) == 0


def test_equal_texts_stay_together(spark):
    rows = [(k, f"text {k % 1500} " * 3) for k in range(6000)] + [(6000 + k, "one large group of copies") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found, moves = sharding.reshard(docs, F.crc32(F.encode("text", "utf-8")) % 3, 3, 4)
    got = found.select("text", "_shard", "_size").collect()
    shards, sizes = {}, [0] * 4
    for r in got:
        shards.setdefault(r.text, set()).add(r._shard)
        sizes[r._shard] += r._size
    assert len(got) == 9000 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 4
    split = [t for t, s in shards.items() if len(s) > 1]
    assert split == ["one large group of copies"] and len(shards[split[0]]) > 1


def test_groups_that_fit_a_shard_stay_whole(spark):
    """Groups between a 64th of a shard and a whole one, among them copies of one id, are in one shard each, and shards are near equal."""
    rng = random.Random(4)
    rows = [(k, f"own text {k} " * rng.randrange(1, 9)) for k in range(4000)]
    for g, n in enumerate([900, 700, 400, 300, 200, 90, 60]):
        rows += [(g if g % 2 else 10_000 + k, f"group {g} of copies " * 6) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found, moves = sharding.reshard(docs, F.crc32(F.encode("text", "utf-8")) % 3, 3, 4)
    out = sharding.slots(sharding.rewrite(found, fresh_path(spark, "t"), moves, all_shards=True)).select("text", "_shard", "_slot", "_size", "_block").collect()
    shards, sizes = {}, [0] * 4
    for r in out:
        shards.setdefault(r.text, set()).add(r._shard)
        sizes[r._shard] += r._size
    assert len(out) == len(rows) and all(len(s) == 1 for t, s in shards.items() if t.startswith("group"))
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes)
    for j in range(4):
        assert sorted(r._slot for r in out if r._shard == j) == list(range(sum(r._shard == j for r in out)))
    assert [sum(m[j] for m in moves) for j in range(4)] == pytest.approx(sizes, rel=0.01)
    assert len({r._block for r in out if r.text.startswith("group 1 ")}) > 4  # copies of one id too are spread over blocks


def test_groups_are_placed_where_they_lie_or_fit():
    assert sharding.placed_groups([(1, {0: 50}), (2, {1: 40, 0: 5}), (3, {2: 500}), (4, {2: 30})], [100, 100, 60]) == ({1: 0, 2: 1, 4: 2}, [50, 55, 30])
    assert sharding.placed_groups([(1, {5: 60}), (2, {5: 60}), (3, {5: 60})], [70, 70]) == ({1: 0, 2: 1}, [10, 10])


def test_only_changed_shards_are_written(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"))
    rows, moves = sharding.reshard(docs, F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 200, 1).otherwise(2), 3, 4, capacities=[1200, 1200, 1200, 1200])
    written = sharding.rewrite(rows, fresh_path(spark, "t"), moves)
    assert {r[0] for r in written.select("_shard").distinct().collect()} == {2, 3}
    assert all(moves[i][i] == 1200 for i in range(3)) and moves[2][3] == 1200


def test_warc_query(spark, data):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    best = {}
    for p, h in pages.items():
        best[h] = max(best.get(h, p), p)
    got = queries_files.op6_warc_revisits(spark, data).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        h = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if best[h] == r.page_id else ("revisit", best[h]))


def test_warc_of_odd_rows(spark):
    rows = [(1, "u\r\n1", "a\r\n\r\nWARC/1.1\r\nb", 1), (2, None, None, 2), (3, "u3", "", 3), (4, "u4", "a\r\n\r\nWARC/1.1\r\nb", 4), (None, "u5", "é", 5), (6, "u6", "x" * 70000, 6), (6, "u6", "x" * 70000, 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kept long")
    path = fresh_path(spark, "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.digest_holds) for r in warc.join_revisits(records).collect()), key=str)
    assert got == sorted([(1, "revisit", 4, 16, True), (2, "revisit", 3, 0, True), (3, "response", None, 0, True), (4, "response", None, 16, True), (0, "response", None, 2, True), (6, "response", None, 70000, True), (6, "response", None, 70000, True)], key=str)
    few = fresh_path(spark, "warc")
    warc.write_archives(pages, few, least_bytes=10)
    types = {r.page_id: r.record_type for r in warc.read_archives(spark, few).collect()}
    assert types[2] == types[3] == "response" and types[1] == "revisit"
    none = fresh_path(spark, "warc")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def brute(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for k, d in enumerate(order):
        t, n = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        c = len(t) // 3
        out[d] = (len(t), hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest())
    return out


def test_imatch_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries_files.op7_imatch(spark, data).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute(texts)
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)


def test_frequencies_count_every_document(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "b")], "doc_id long, text string")
    n, freq = imatch.document_frequencies(docs)
    slot = lambda w: int(imatch._slots(imatch.distinct_terms(w))[0])
    assert n == 4 and [int(freq[slot(w)]) for w in "abc"] == [1, 3, 1]
    assert imatch.document_frequencies(docs.limit(0))[0] == 0


@pytest.mark.parametrize("most", [None, 500])
def test_lexicon_is_exact_for_many_terms(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(imatch, "MOST_TERMS", most)
    # 200 000 terms of one document each, 300 of two, one of all
    rows = [(k, " ".join(["all", *[f"only{k}x{j}" for j in range(5000)], *[f"pair{k // 2}x{j}" for j in range(15)]])) for k in range(40)]
    n, freq = imatch.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = {int(imatch.distinct_terms(f"pair{p}x{j}")[0]) for p in range(20) for j in range(15)}
    got = imatch.lexicon(n, freq)
    assert n == 40 and got.tolist() == sorted(want)
    own = imatch.Fingerprints(got)
    assert own.of(rows[0][1]) == own.of(rows[0][1] + " unique") == own.of(rows[1][1]) != own.of(rows[2][1])


@pytest.mark.parametrize("rows", [[], [(5, "only one")], [(1, None), (2, ""), (3, "!!"), (3, "!!"), (None, "n"), (9, "x " * 20000), (7, "tie a"), (7, "tie b")]])
def test_imatch_of_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries_files.op7_imatch(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    if len(rows) == 1:
        assert got[0].near_next == 1.0
    assert {r.fingerprint for r in got if r.doc_id == 3} == {r.fingerprint for r in got if r.doc_id == 3 and r.n_chars == 2}


def test_ranges_meet_at_their_ends(spark, tmp_path):
    rows = [(k * k, f"text {k} " * (k % 5 + 1)) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries_files.op7_imatch(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute(dict(rows))
