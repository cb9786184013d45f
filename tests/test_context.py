import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import chunking, context


def brute_chunks(text, most):
    size = lambda s: len([c for c in s if c not in " \t\r\n"])
    out, lines = [], []
    for line in text.split("\n"):
        if lines and size("".join(lines)) + size(line) > most:
            out.append(lines)
            lines = []
        lines.append(line)
    return ["\n".join(x) for x in [*out, lines]]


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80))
def test_line_chunks(spark, text):
    got = chunking.line_chunks(spark.createDataFrame([(1, text)], "id int, content string"), 6).orderBy("chunk_index").collect()
    assert [text[r.start_index : r.end_index] for r in got] == brute_chunks(text, 6)
    assert "".join(text[r.raw_start : r.raw_end] for r in got) == text


def test_line_chunks_bound_what_they_repeat(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunking, "REPEATED", 4000)
    rows = [(k, "a b\nccc\n" * (k % 7) * 9 + "d") for k in range(60)] + [(99, "x\n" * 400)]
    docs = spark.createDataFrame(rows, "id int, content string").coalesce(1)
    sizes = []
    real = pa.RecordBatch.from_arrays
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema, of=type(docs).mapInArrow: sizes.append(run) or of(self, run, schema))
    found = chunking.line_chunks(docs, 6, code="code").collect()
    texts = dict(rows)
    assert len(found) == sum(len(brute_chunks(t, 6)) for t in texts.values())
    assert all(r.content == texts[r.id] and r.code == r.content[r.raw_start : r.raw_end] for r in found)
    batch = real([pa.array([i for i, _ in rows], pa.int32()), *[pa.array([t for _, t in rows])] * 2], names=["id", "content", "_content"])
    out = list(sizes[0](iter([batch])))
    assert sum(b.num_rows for b in out) == len(found) and max(sum(map(len, b.column(1).to_pylist())) for b in out) <= 4000


def test_fallback_chunks_the_found_files_alone(spark, data):
    from weftline.plans import catalogue_code

    plan = catalogue_code.lexical_fallback_chunks(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    made = plan.split("MapInArrow")[1]
    assert "content#" not in made.split("\n")[0].split("[")[1].split("]")[0] and "LeftSemi" in made


def test_search_document(spark):
    code = "/* block */\nclass AuthService { login_user() {} } // trailing\nx = 1 # hash\nurl = 'a#b'"
    got = chunking.search_document(spark.createDataFrame([("a.ts", code), ("b", "// only")], "breadcrumb string, display_code string")).collect()
    assert got[0].comments == "/* block */\n// trailing\n# hash" and "block" not in got[0].body and "a#b" in got[0].body
    assert {"AuthService", "auth_service", "loginUser"} <= set(got[0].symbol_tokens.split()) and got[1].body == "// only"


def test_python_chunks(spark):
    text = "import os\n\n" + "".join(f"class C{k}:\n" + "".join(f"    def m{j}(self):\n        return '{'x' * 60}'\n\n" for j in range(12)) for k in range(3))
    rows = spark.createDataFrame([("a.py", "python", text), ("bad.py", "python", "def ("), ("c.md", "markdown", "x")], "path string, language string, content string")
    assert [(r.path, r.raw_end) for r in chunking.semantic_chunks(rows).where("path <> 'a.py'").collect()] == [("bad.py", 5)]
    got = chunking.semantic_chunks(rows).where("path = 'a.py'").orderBy("chunk_index").collect()
    assert {r.path for r in got} == {"a.py"} and len(got) > 3
    assert "".join(text[r.raw_start : r.raw_end] for r in got) == text
    assert any("class C1 > def m" in r.breadcrumb for r in got) and all(r.vec_start <= r.raw_start for r in got)
    assert any(r.vec_start < r.raw_start for r in got)


def seeds(spark, rows):
    return spark.createDataFrame(rows, "file_path string, chunk_index int, score double, source string")


def test_expansions(spark):
    chunks = spark.createDataFrame([("a", k, f"a > class A > m{k}" if k < 3 else "a > other", k) for k in range(6)] + [("b", 0, "b", 0), ("index.ts", 0, "i", 0), ("c", 0, "c", 0), ("c", 1, "c", 0)], "file_path string, chunk_index int, breadcrumb string, overlap int")
    s = seeds(spark, [("a", 1, 1.0, "vector"), ("a", 4, 0.5, "vector")])
    assert context.neighbours(s, chunks, 0).count() == 0 and context.siblings(s, chunks, 0).count() == 0
    near = {r.chunk_index: r.score for r in context.neighbours(s, chunks, 1).collect()}
    assert near == {0: 0.8, 2: 0.8, 3: 0.4, 5: 0.4}
    both = {r.chunk_index: round(r.score, 6) for r in context.neighbours(s, chunks, 2).collect()}
    assert both[3] == 0.4 and both[0] == 0.8 and both[5] == 0.4
    assert [(r.chunk_index, r.score) for r in context.siblings(s, chunks, 1).where("chunk_index < 3").collect()] == [(0, 0.7)]
    edges = spark.createDataFrame([("a", "b", 0), ("a", "index.ts", 1), ("index.ts", "c", 0), ("b", "c", 0), ("a", "a", 2)], "from_path string, to_path string, position int")
    got = {(r.file_path, r.chunk_index): round(r.score, 6) for r in context.imported(s, edges, chunks).collect()}
    assert got == {("b", 0): 0.6, ("index.ts", 0): 0.6, ("c", 0): 0.42, ("c", 1): 0.42}
    assert context.imported(s, edges, chunks, files_per_seed=0).count() == 0
    all_ = context.expanded(s, context.neighbours(s, chunks, 1), context.siblings(s, chunks, 1))
    assert all_.groupBy("file_path", "chunk_index").count().where("count > 1").count() == 0 and all_.where("chunk_index = 1 and source = 'vector'").count() == 1


def test_touching_spans_merge(spark):
    rows = spark.createDataFrame([("a", 0, 11, 0.5, "x"), ("a", 8, 18, 0.9, "y"), ("a", 18, 20, 0.1, "z"), ("a", 25, 30, 0.2, "w"), ("b", 0, 3, 0.3, "v")], "file_path string, raw_start int, raw_end int, score double, breadcrumb string")
    got = sorted(tuple(r) for r in context.merged_segments(rows).select("file_path", "raw_start", "raw_end", "score", "breadcrumb", "n_chunks").collect())
    assert got == [("a", 0, 20, 0.9, "x", 3), ("a", 25, 30, 0.2, "w", 1), ("b", 0, 3, 0.3, "v", 1)]
    files = spark.createDataFrame([("a", "one\ntwo\nthree four five six seven"), ("b", "bee")], "path string, content string")
    lines = {r.raw_start: (r.text, r.start_line, r.end_line) for r in context.with_lines(context.merged_segments(rows).where("file_path = 'b'"), files).collect()}
    assert lines == {0: ("bee", 1, 1)}


@pytest.mark.parametrize("budget,want", [(19, [("a", 0)]), (30, [("a", 0), ("b", 0), ("c", 0)]), (5, [("c", 0)]), (100, [("a", 0), ("a", 20), ("b", 0), ("c", 0)])])
def test_budget(spark, budget, want):
    rows = spark.createDataFrame([("a", 0, 18, 0.9), ("a", 20, 60, 0.8), ("b", 0, 10, 0.5), ("c", 0, 2, 0.1)], "file_path string, raw_start int, raw_end int, score double")
    got = sorted((r.file_path, r.raw_start) for r in context.packed(rows, 3, budget).collect())
    assert got == want


def brute_packed(rows, per_file, budget):
    files = {}
    for f, a, b, s in rows:
        files.setdefault(f, []).append((-s, a, b))
    top = {f: sorted(x)[:per_file] for f, x in files.items()}
    used, out = 0, []
    for f in sorted(top, key=lambda f: (top[f][0][0], f)):
        for _, a, b in sorted(top[f], key=lambda x: x[1]):
            if used >= budget or used + b - a > budget:
                break
            used += b - a
            out.append((f, a))
    return out


@pytest.mark.parametrize("round_of", [1, 7, 10_000])
def test_budget_looks_at_every_file(spark, round_of):
    rng = random.Random(round_of)
    rows = [(f"f{k:03}", a, a + rng.choice([0, 0, 3, 8, 20, 40]), rng.choice([0.1, 0.2, 0.9])) for k in range(60) for a in (0, 50, 100, 150)]
    given = spark.createDataFrame(rows, "file_path string, raw_start int, raw_end int, score double").repartition(5)
    for budget in (0, 1, 45, 130):
        got = [(r.file_path, r.raw_start) for r in context.packed(given, 3, budget, most_segments=round_of).collect()]
        assert got == brute_packed(rows, 3, budget)


def test_budget_with_more_files_than_characters(spark):
    rows = [(f"f{k:05}", 0, 40, 0.5) for k in range(10_500)] + [("last", 0, 3, 0.1), ("last", 3, 3, 0.05)]
    got = context.packed(spark.createDataFrame(rows, "file_path string, raw_start int, raw_end int, score double"), 3, 43).collect()
    assert [(r.file_path, r.raw_start) for r in got] == [("f00000", 0), ("last", 0)]


@pytest.mark.parametrize("sizes,limit,want", [([3, 2, 4, 1], 5, [0, 0, 1, 1]), ([500, 3], 50, [0, 1]), ([], 5, [])])
def test_greedy_batches(spark, sizes, limit, want):
    rows = spark.createDataFrame([("g", k, s) for k, s in enumerate(sizes)], "g string, k int, s int")
    assert [r.batch for r in context.greedy_batches(rows, "g", "k", "s", limit).orderBy("k").collect()] == want


def brute_batches(rows, limit):
    """Batch of each row, by one walk through each group."""
    out, at, used, n = {}, None, 0, -1
    for g, k, s in sorted(rows, key=lambda r: (r[0], r[1])):
        if g != at:
            at, used, n = g, 0, -1
        if n < 0 or used + (s or 0) > limit:
            used, n = 0, n + 1
        used += s or 0
        out[(g, k)] = n
    return out


@pytest.mark.parametrize("limit", [1, 7, 40])
def test_batches_of_groups_in_many_ranges(spark, limit):
    rng = random.Random(limit)
    rows = [("hot", k, rng.choice([0, 0, 1, 2, 3, 9, 50, None])) for k in range(3000)] + [(f"g{k % 60:02}", k, rng.randrange(5)) for k in range(400)] + [("zero", k, 0) for k in range(50)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = context.greedy_batches(spark.createDataFrame(rows, "g string, k int, s int").repartition(5), "g", "k", "s", limit).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and {(r.g, r.k): r.batch for r in got} == brute_batches(rows, limit)


def test_effects_are_few_and_right():
    rng = random.Random(1)
    for _ in range(300):
        limit, sizes = rng.randrange(1, 20), [rng.randrange(8) for _ in range(rng.randrange(1, 40))]
        found = context.batch_effects(np.array(sizes), limit)
        for used in [*range(limit + 1), limit + 30]:
            u, n = used, 0
            for s in sizes:
                if u + s > limit:
                    u, n = 0, n + 1
                u += s
            upto, begun, left = next(f for f in found if f[0] is None or used + f[0] > limit)
            assert (begun, left + (used if upto is None else 0)) == (n, u)
    assert len(context.batch_effects(np.array([rng.randrange(1, 9) for _ in range(100_000)]), 1000)) < 60


def test_runs(spark):
    rows = spark.createDataFrame([("c", k, v) for k, v in enumerate(["x", "x", "y", None, None, "x"])], "c string, k int, v string")
    got = sorted(((r.v, r.run_start, r.run_end, r.n) for r in context.runs(rows, "c", "k", "v").collect()), key=lambda r: r[1])
    assert got == [("x", 0, 1, 2), ("y", 2, 2, 1), (None, 3, 4, 2), ("x", 5, 5, 1)]
    assert context.runs(rows.where(F.lit(False)), "c", "k", "v").count() == 0
