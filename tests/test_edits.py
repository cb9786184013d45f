"""Line differences, patches and the feedback stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import analytics, diffs
from weftline.streaming import feedback


def longest(a, b):
    """Length of a longest common subsequence, by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_scripts_are_shortest_and_lead_to_the_other_text():
    rng = random.Random(5)
    for _ in range(600):
        size = rng.randrange(1, 6)
        a, b = ("\n".join(rng.choices("abcde"[:size], k=rng.randrange(14))) for _ in range(2))
        found = diffs.hunks(a, b)
        lines = a.split("\n")
        for start, removed, new in reversed(found):
            lines[start - 1 : start - 1 + removed] = new
        assert "\n".join(lines) == b
        x, y = a.split("\n"), b.split("\n")
        assert sum(r + len(n) for _, r, n in found) == len(x) + len(y) - 2 * longest(x, y)
        places = diffs.common(x, y)
        assert all(x[i] == y[j] for i, j in places) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:], strict=False))


def test_long_texts_take_little():
    rng = random.Random(2)
    a = [str(rng.randrange(50)) for _ in range(6000)]
    b = list(a)
    for _ in range(60):
        b[rng.randrange(len(b))] = "new" + str(rng.randrange(9))
    assert len(diffs.common(a, b)) >= 5940
    assert diffs.common([str(k) for k in range(5000)], [f"x{k}" for k in range(5000)]) == []


def test_patches(spark):
    texts = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "a"), (4, None), (5, ""), (6, "a\nb")], "id int, text string")
    rows = [(1, 3, 0, ["x"]), (1, 1, 1, ["A", "AA"]), (1, 4, 0, ["end"]), (2, 1, 2, []), (2, 2, 1, ["q"]), (3, 3, 1, ["z"]), (4, 1, 0, ["z"]), (5, 1, 1, ["now", "this"]), (6, 1, 1, None), (6, 2, 1, ["B"])]
    patches = spark.createDataFrame(rows, "id int, start int, removed int, lines array<string>").repartition(3)
    got = {r.id: (r.patch_status, r.text) for r in diffs.patched(texts, patches, "id").collect()}
    assert got == {1: ("ok", "A\nAA\nb\nx\nc\nend"), 2: ("overlap", "a\nb\nc"), 3: ("out of range", "a"), 4: ("out of range", None), 5: ("ok", "now\nthis"), 6: ("ok", "B")}
    assert {r.patch_status for r in diffs.patched(texts, patches.limit(0), "id").collect()} == {"none"}


def test_patch_of_a_difference_is_the_other_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("old"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("old").alias("new")), "doc_id")
    after = diffs.patched(docs.withColumnRenamed("old", "text"), diffs.line_diffs(pairs, "doc_id").select("doc_id", F.inline("hunks")), "doc_id")
    wrong = after.join(pairs, "doc_id").where("text <> new")
    assert pairs.count() > 100 and wrong.count() == 0


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


SCHEMA = "session string, ts timestamp, event_id string, text string, seed_count int, chunks array<struct<file_path:string,chunk_index:int>>"


def asked(n=60, seed=3):
    rng = random.Random(seed)
    words = ["find", "auth", "service", "login", "token", "in", "the", "client"]
    rows = []
    for k in range(n):
        chunks = [(f"src/{rng.choice(['auth_service', 'login', 'tok', 'x'])}.ts", rng.randrange(2)) for _ in range(rng.randrange(3))]
        rows.append((f"s{k % 4}", at(k * 2), f"e{k:03}", " ".join(rng.choices(words, k=rng.randrange(1, 7))) + rng.choice(["", " authservice", " Login"]), rng.choice([0, 0, 3]), chunks))
    return rows


def streamed(spark, tmp_path, batches, **options):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = feedback.feedback_stream(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        del k
    out = spark.read.schema(feedback.SIGNALS).parquet(str(tmp_path / "out")).collect()
    return sorted((r.event_id, r.signal, r.weight, None if r.similarity is None else round(r.similarity, 4), r.file_path, r.chunk_index, r.matched_by) for r in out if not r.event_id.startswith("z"))


def test_stream_equals_the_batch_out_of_order(spark, tmp_path):
    rows = asked()
    late = list(rows)
    for k in range(0, 56, 4):  # each four events arrive in reverse, within the watermark
        late[k : k + 4] = late[k : k + 4][::-1]
    end = [("zz", at(10_000), "z", "the end", 1, [])]
    got = streamed(spark, tmp_path, [late[:25], late[25:], end], late="30 minutes", expiry=None)
    df = spark.createDataFrame(rows, SCHEMA)
    rewrites = analytics.rewrite_signals(df, "session", "event_id")
    before = {}
    previous = []
    for s, _, e, t, *_ in rows:
        previous.append((e, before.get(s), t))
        before[s] = e
    pins = analytics.pin_signals(spark.createDataFrame(previous, "event_id string, previous_id string, text string"), df.select("event_id", F.inline("chunks")))
    want = [(r.event_id, r.signal, r.weight, r.similarity, None, None, None) for r in rewrites.collect()] + [(r.event_id, r.signal, r.weight, None, r.file_path, r.chunk_index, r.matched_by) for r in pins.collect()]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3], r[4] or "", r[5] or 0)) and len(got) > 10


def test_silent_sessions_are_forgotten(spark, tmp_path):
    ask = lambda m, e: ("s", at(m), e, "find auth login", 0, [("src/auth.ts", 0)])
    got = streamed(spark, tmp_path, [[ask(0, "a"), ask(5, "b"), ask(90, "c")], [ask(100, "d"), ("zz", at(10_000), "z", "", 1, [])]], late="10 minutes")
    assert {(r[0], r[1]) for r in got} == {("b", "no_hit_rewrite"), ("b", "path_pin"), ("d", "no_hit_rewrite"), ("d", "path_pin")}


@pytest.mark.parametrize("before", [None, {"text": "", "seed_count": 0, "chunks": []}])
def test_first_and_empty_events(before):
    assert feedback.signals_of(before, {"event_id": "e", "text": "", "seed_count": 0, "chunks": []}) == []
