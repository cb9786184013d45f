import datetime

import pytest
from pyspark.sql import functions as F

from weftline.operators import analytics, graph, imports, indexing
from weftline.plans import catalogue
from weftline.sources import readers
from weftline.sources.keyed import KeyedTable
from weftline.streaming import sessions


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", 5, 1), ("b", "1", 5, 1), ("c", "1", 5, 1), ("d", "1", 5, 1)], "path string, hash string, mtime long, size long")
    new = spark.createDataFrame([("a", "x", 5, 1), ("b", "2", 6, 1), ("c", "1", 7, 1), ("e", "1", 5, 1)], "path string, hash string, mtime long, size long")
    diff = indexing.snapshot_diff(old, new)
    assert sorted(tuple(r) for r in diff.collect()) == [("a", "unchanged"), ("b", "modified"), ("c", "unchanged"), ("d", "deleted"), ("e", "added")]
    assert tuple(indexing.scan_counts(diff).first()) == (5, 1, 1, 2, 1)
    files = old.select("path", "hash").withColumn("vector_index_hash", F.when(F.col("path") == "a", "1").when(F.col("path") == "b", "0"))
    assert sorted(r.path for r in indexing.to_heal(files).collect()) == ["b", "c", "d"]
    assert indexing.to_heal(indexing.acknowledge(files, files.select("path", "hash"))).count() == 0
    twice = spark.createDataFrame([("a", "8", 1), ("a", "9", 2)], "path string, hash string, seq int")
    assert [r.hash for r in indexing.upsert(old.select("path", "hash"), twice, order="seq").where("path = 'a'").collect()] == ["9"]
    assert indexing.insert_missing(old.select("path", "hash"), new.select("path", "hash"), "path").count() == 5
    assert indexing.without(old, new.select("path")).count() == 1
    root = str(tmp_path / "snap")
    indexing.write_snapshot(old, root, 1, "path")
    indexing.write_snapshot(new, root, 2, "path", buckets=2)
    assert sorted(r.path for r in indexing.read_snapshot(spark, root).collect()) == ["a", "b", "c", "e"]


def test_consistency(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chunk_id string")
    vector, text = ids("a#h#0", "a#h#1", "b#h#0"), ids("a#h#0", "c#h#0")
    got = {(r.chunk_id, r.missing_in) for r in indexing.consistency(vector, text).collect()}
    assert got == {("a#h#1", "text"), ("b#h#0", "text"), ("c#h#0", "vector")}
    assert [r.chunk_id for r in indexing.repaired(text, vector).collect()] == ["a#h#0"]


def test_feedback(spark):
    events = spark.createDataFrame([(1, 1, "find auth login", 0), (1, 2, "find auth login now", 2), (1, 3, "something else", 1), (2, 1, "", 0), (2, 2, "", 0)], "c int, k int, text string, seed_count int")
    got = analytics.rewrite_signals(events, "c", "k").collect()
    assert [(r.c, r.k, r.weight, r.similarity) for r in got] == [(1, 2, -0.6, 0.75)]
    asked = spark.createDataFrame([("e2", "e1", "look at AuthService please"), ("e3", "e2", "none")], "event_id string, previous_id string, text string")
    chunks = spark.createDataFrame([("e1", "src/auth_service.ts", 0), ("e1", "src/auth_service.ts", 0), ("e1", "src/look.ts", 1), ("e1", "src/zzz.ts", 0)], "event_id string, file_path string, chunk_index int")
    pins = analytics.pin_signals(asked, chunks)
    assert sorted((r.event_id, r.file_path, r.matched_by) for r in pins.collect()) == [("e2", "src/auth_service.ts", "token"), ("e2", "src/look.ts", "token")]
    assert [(r.file_path, r.hits) for r in analytics.top_files(pins, 1).collect()] == [("src/auth_service.ts", 1)]
    none = analytics.feedback_summary(spark.createDataFrame([], "created_at long, seed_count int"), spark.createDataFrame([], "created_at long, signal string, source_event_id int")).first()
    assert none.total_events == 0 and none.zero_hit_rate == 0.0


def test_ledger(spark):
    rows = spark.createDataFrame([("s1", "a", " OPUS ", 10, 1_000_000), ("s1", "b", "none", 20, 500_000), ("s2", "a", "haiku", 5, 500_000)], "session_id string, bucket string, model string, ts_ms long, tokens_saved long")
    led = analytics.with_cost(rows, "tokens_saved", out="dollars_saved")
    assert tuple(analytics.savings_summary(led).first()) == (2_000_000, 15.125, 5, 20, 2)
    assert {r.bucket: r.percentage for r in analytics.savings_by(led, "bucket").collect()} == {"a": 75, "b": 25}
    sess = spark.createDataFrame([("s1", 1), ("s3", 2)], "session_id string, started_at long")
    assert [(r.session_id, r.events) for r in analytics.sessions_with_counts(sess, led).collect()] == [("s3", 0), ("s1", 2)]
    assert analytics.savings_summary(led.limit(0)).first().tokens_saved == 0


def test_metrics(spark):
    retrieved = spark.createDataFrame([("q1", i, p) for p, i in enumerate("xaby")] + [("q2", i, p) for p, i in enumerate("zcc")], "case_id string, item string, pos int")
    relevant = spark.createDataFrame([("q1", "a", 1.0), ("q1", "b", 2.0), ("q2", "c", 1.0), ("q2", "n", 0.0)], "case_id string, item string, gain double")
    got = {r.case_id: r for r in analytics.ranking_metrics(retrieved, relevant, [1, 3], ["case_id"]).collect()}
    assert (got["q1"].rr, got["q1"].recall_1, got["q1"].recall_3) == (0.5, 0.0, 1.0) and got["q2"].recall_3 == 1.0
    summary = analytics.evaluation_summary(analytics.ranking_metrics(retrieved, relevant, [1, 3], ["case_id"])).first()
    assert summary.mrr == 0.5 and summary.cases == 2
    assert analytics.evaluation_summary(analytics.ranking_metrics(retrieved.limit(0), relevant.limit(0), [1], ["case_id"])).first().mrr == 0.0


def test_tuning(spark):
    lists = spark.createDataFrame([("c1", "good", 0, "vector"), ("c1", "bad", 1, "vector"), ("c1", "bad", 0, "lexical"), ("c1", "good", 2, "lexical"), ("c1", "x", 1, "lexical")], "case_id string, item string, pos int, channel string")
    relevant = spark.createDataFrame([("c1", "good", 1.0)], "case_id string, item string, gain double")
    board = analytics.auto_tune(lists, relevant, analytics.grid(spark, [0.2, 0.8], [20], [3]), [1]).collect()
    assert board[0].w_vec == 0.8 and board[0].mrr > board[1].mrr
    with pytest.raises(ValueError):
        analytics.grid(spark, [1.0], [20], [3])


def test_impact(spark):
    nodes = spark.createDataFrame([("file:a", "file", "src/a.ts", "src/a.ts"), ("file:b", "file", "src/b.ts", "src/b.ts"), ("symbol:a:foo", "function", "foo", "src/a.ts"), ("test:t", "test", "covers foo", "src/t.ts")], "id string, kind string, name string, file_path string")
    edges = spark.createDataFrame([("file:b", "file:a", "high"), ("test:t", "file:b", "medium"), ("file:a", "file:b", "low")], "from_id string, to_id string, confidence string")
    for target, want in (("src/a.ts", "file:a"), ("src/a.ts:foo", "symbol:a:foo"), ("foo", "symbol:a:foo")):
        best, missing = graph.resolved_targets(nodes, [target])
        assert [r.id for r in best.collect()] == [want] and not missing
    assert graph.resolved_targets(nodes, ["nope"])[1] == ["nope"]
    start = spark.createDataFrame([("file:a",)], "id string")
    one = {r.id: r.hop for r in graph.impact(edges, start, 1).collect()}
    two = {r.id: (r.hop, round(r.score, 6)) for r in graph.impact(edges, start, 2, tests=nodes.where("kind = 'test'")).collect()}
    assert one == {"file:a": 0, "file:b": 1} and two == {"file:a": (0, 1.0), "file:b": (1, 0.75), "test:t": (2, round(0.65 * 0.5625 + 0.2, 6))}
    with pytest.raises(ValueError):
        graph.impact(edges, start, 11)


def test_script_graph(spark):
    src = "import { h } from './helper'\nexport class Calculator {\n  add(a, b) {\n    return a + b\n  }\n  double(a) {\n    return multiply(a, 2)\n  }\n}\nexport function multiply(a, b) {\n  return a * b\n}\ntest('adds: up', () => {\n  multiply(1, 2)\n})\n"
    nodes, edges = graph.script_graph(spark.createDataFrame([("src/c.ts", src), ("src/x.py", "x")], "path string, content string"))
    assert {(r.kind, r.name) for r in nodes.collect()} >= {("class", "Calculator"), ("method", "add"), ("function", "multiply"), ("test", "adds: up"), ("file", "src/c.ts")}
    kinds = [r.kind for r in edges.collect()]
    assert kinds.count("contains") >= 4 and "imports" in kinds and "calls" in kinds
    held = {(r.from_id, r.to_id) for r in edges.where("kind = 'contains'").collect()}
    assert ("symbol:src/c.ts:Calculator:2", "symbol:src/c.ts:add:3") in held


CASES = [
    ("src/a.ts", "import x from './b.js'\nconst y = require('../lib')\n", ["src/b.ts", "lib/index.ts"], ["src/b.ts", "lib/index.ts"]),
    ("p/q/m.py", "from ..u import a\nimport p.v\nimport os\n", ["p/u.py", "x/p/v.py", "p/v.py"], ["p/u.py", "p/v.py"]),
    ("a/main.go", 'import (\n  "fmt"\n  "ex.com/util"\n)\n', ["z/ex.com/util/a_test.go", "z/ex.com/util/u.go"], ["z/ex.com/util/u.go"]),
    ("a/B.java", "import static c.D;\nimport e.f.*;\n", ["s/c/D.java", "s/e/f/G.java"], ["s/c/D.java", "s/e/f/G.java"]),
    ("a/b.kt", "import c.d.E as X\n", ["s/c/d/E.kt"], ["s/c/d/E.kt"]),
    ("a.php", "use \\A\\B as C;\nuse D\\{E, F as G};\n", ["s/A/B.php", "s/D/E.php", "t/F.php"], ["s/A/B.php", "s/D/E.php", "t/F.php"]),
    ("a/b.rb", "require_relative '../c'\nautoload :X, 'd/e'\n", ["c.rb", "lib/d/e.rb"], ["c.rb", "lib/d/e.rb"]),
    ("a/b.swift", "@testable import Kit\n", ["s/Kit/x.swift", "s/Kit.swift"], ["s/Kit.swift"]),
    ("a/b.dart", "import '../c.dart';\npart './d';\n", ["c.dart", "a/d.dart"], ["c.dart", "a/d.dart"]),
    ("k/src/m/n.rs", "mod o;\nuse crate::p::q;\nuse super::r;\n", ["k/src/m/o.rs", "k/src/p/q/mod.rs", "k/src/r.rs"], ["k/src/m/o.rs", "k/src/p/q/mod.rs", "k/src/r.rs"]),
    ("a/b.cpp", '#include "c.h"\n#include "d/e.h"\n#include <f.h>\n', ["a/c.h", "y/d/e.h", "a/z/d/e.h"], ["a/c.h", "a/z/d/e.h"]),
    ("a/b.cs", "using static global::C.@D;\nusing Z.Lone;\n", ["s/C/D.cs", "s/Lone.cs"], ["s/C/D.cs", "s/Lone.cs"]),
]


@pytest.mark.parametrize("path,content,others,want", CASES, ids=[c[0].rsplit(".", 1)[1] for c in CASES])
def test_imports(spark, path, content, others, want):
    files = spark.createDataFrame([(path, content), *[(o, "") for o in others]], "path string, content string")
    assert sorted(r.to_path for r in imports.resolved(files).where(F.col("from_path") == path).collect()) == sorted(want)


def test_sources(spark, tmp_path):
    (tmp_path / "tree/src").mkdir(parents=True)
    for name, data in (("src/a.py", b"x = 1"), ("src/b.min.js", b"x"), ("src/u.ts", "é".encode("utf-16")), ("src/l.py", "é".encode("latin-1")), ("src/n.c", b"a\x00b"), ("x-lock.json", b"{}"), ("odd.xyz", b"?"), ("keep.abc", b"!")):
        (tmp_path / "tree" / name).write_bytes(data)
    got = {r.path: r for r in readers.file_tree(spark, str(tmp_path / "tree"), ["*.min.js"], ["keep.*"]).collect()}
    assert got.keys() == {"src/a.py", "src/u.ts", "src/l.py", "src/n.c", "x-lock.json", "keep.abc"}
    assert got["src/u.ts"].content == "é" == got["src/l.py"].content and got["src/a.py"].language == "python"
    assert (got["src/n.c"].status, got["x-lock.json"].status, got["src/a.py"].status) == ("skipped:binary", "skipped:json", "ok")
    (tmp_path / "tree/node_modules/deep").mkdir(parents=True)
    (tmp_path / "tree/node_modules/deep/a.js").write_bytes(b"x")
    (tmp_path / "tree/big.ts").write_bytes(b"x" * (600 << 10))
    rules = ["*.min.js", "node_modules/"]
    assert [p for p, _ in readers.listed(spark, str(tmp_path / "tree"), rules)] == ["big.ts", "keep.abc", "odd.xyz", "src/a.py", "src/l.py", "src/n.c", "src/u.ts", "x-lock.json"]
    assert [p for p, _ in readers.listed(spark, str(tmp_path / "tree"), [*rules, "!a.js"])] == ["big.ts", "keep.abc", "node_modules/deep/a.js", "odd.xyz", "src/a.py", "src/l.py", "src/n.c", "src/u.ts", "x-lock.json"]
    kept = readers.file_tree(spark, str(tmp_path / "tree"), rules)
    assert {(r.path, r.status, r.size) for r in kept.collect() if r.status == "skipped:large"} == {("big.ts", "skipped:large", 600 << 10)}
    assert {f.split("/tree/")[1] for f in kept.inputFiles() if "/tree/" in f} == {"src/a.py", "src/u.ts", "src/l.py", "src/n.c", "x-lock.json"}  # and nothing else is opened
    tasks = readers.project_tasks(spark.createDataFrame([("package.json", '{"scripts": {"build": "x"}}'), ("Makefile", "all: x\n\tfoo\nA := 1\n"), ("Cargo.toml", ""), ("justfile", "run a:\n  x\n")], "path string, content string"))
    assert {(r.name, r.command) for r in tasks.where("type <> 'cargo'").collect()} == {("build", "npm run build"), ("all", "make all"), ("run", "just run")}
    assert [r.description for r in tasks.where("type = 'npm'").collect()] == ["x"]
    cache = spark.createDataFrame([("5d41402abc4b2a76b9719d911017c592", [1.0])], "key string, vector array<float>")
    texts = spark.createDataFrame([("hello",), ("new",), ("new",)], "text string")
    assert [r.text for r in readers.embedding_misses(texts, cache, width=2).collect()].count("hello") == 1
    assert [r.text for r in readers.embedding_misses(texts, cache).collect()] == ["new"] and readers.cached_embeddings(texts, cache).where("vector is not null").count() == 1


def test_character_sets(spark):
    from weftline.functions import charset
    from weftline.plans.catalogue_edits import SENTENCES

    for name, sentences in SENTENCES.items():
        for text in sentences:
            assert charset.decoded(f"// {text}\nx = 1\n".encode(name))[1] == f"// {text}\nx = 1\n", (name, text)
    assert charset.decoded("Καλημέρα κόσμε, τι κάνεις σήμερα".encode("cp1253")) == ("cp1253", "Καλημέρα κόσμε, τι κάνεις σήμερα")
    assert charset.decoded(b"\x81\x8d\x8f\x90\x9d\xff")[1] is not None and charset.decoded(b"") == ("latin_1", "")
    rows = spark.createDataFrame([(1, bytearray("Привет, как дела сегодня".encode("cp1251"))), (2, bytearray("plain é".encode())), (3, None), (4, bytearray(b"")), (5, bytearray("é".encode("utf-16")))], "id int, raw binary")
    assert {r.id: r.t for r in rows.select("id", readers.decoded(F.col("raw")).alias("t")).collect()} == {1: "Привет, как дела сегодня", 2: "plain é", 3: None, 4: "", 5: "é"}


def test_datasets(spark, tmp_path):
    line = '{"id": "a", "query": "q", "retrieved": ["x"], "relevant": {"x": 1}}'
    for name, body in (("a.jsonl", line + "\n" + line), ("b.json", f'{{"cases": [{line}]}}'), ("c.json", f"[{line}]")):
        (tmp_path / name).write_text(body)
        got = readers.evaluation_cases(spark, str(tmp_path / name)).collect()
        assert got and got[0].relevant == {"x": 1.0}
    (tmp_path / "d.jsonl").write_text('{"id": "", "query": "q", "retrieved": [], "relevant": {}}')
    with pytest.raises(Exception, match="bad case"):
        readers.evaluation_cases(spark, str(tmp_path / "d.jsonl")).collect()


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, at(0), "a", 1.0), (1, at(10), "a", 1.0), (1, at(50), "a", 1.0), (2, at(0), "b", 2.0)]
    events = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    batch = sessions.sessions(events)
    assert sorted((r.user_id, r.events) for r in batch.collect()) == [(1, 1), (1, 2), (2, 1)]
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.windowed_counts(stream, width="30 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.events for r in spark.table("counts").collect()) == 4
    for n, seq in (("one", 1), ("two", 2)):
        spark.createDataFrame([("a", n, seq), (n, n, seq)], "path string, hash string, seq int").write.mode("append").parquet(str(tmp_path / "changes"))
        changes = spark.readStream.schema("path string, hash string, seq int").parquet(str(tmp_path / "changes"))
        into = KeyedTable(spark, str(tmp_path / "out"), ("path",), buckets=8)
        sessions.upsert_stream(changes, into, str(tmp_path / "check")).start().awaitTermination()
    assert {r.path: r.hash for r in into.read().collect()} == {"a": "two", "one": "one", "two": "two"}
    assert sum(len(v) for v in into.version()["buckets"].values()) <= 4  # two keys a batch, a bucket each at most


def test_scripts_are_asked_for_once_whatever_their_extension(spark):
    text = "import a from './x';\nimport b from './x.js';\nimport c from './y.mjs';\nimport d from './z';\nimport e from './w.ts';\nimport f from './up';\nimport g from './q.jsx'\nimport h from 'react'\n"
    names = ["x.jsx", "x.tsx", "x.js", "x/index.ts", "y.ts", "y.mjs", "z/index.cjs", "z/index.tsx", "w.tsx", "w.ts.js", "up.TS", "q.ts", "q.jsx", "q.tsx"]
    files = spark.createDataFrame([("a/m.ts", text), *((f"a/{n}", "") for n in names)], "path string, content string")
    found = {r["import"]: r.to_path for r in imports.resolved(files).collect()}
    assert found == {"./x": "a/x.tsx", "./x.js": "a/x.tsx", "./y.mjs": "a/y.mjs", "./z": "a/z/index.tsx", "./q.jsx": "a/q.tsx"}
    asked = spark.createDataFrame([("a/m.ts", "./x"), ("a/m.ts", "./x.js"), ("a/m.ts", "react")], "file string, name string")
    assert [r.n for r in asked.select(F.size(imports._script(F.col("file"), F.col("name"))).alias("n")).collect()] == [2, 1, 0]


@pytest.mark.parametrize("language", ["c", "csharp", "kotlin", "php", "python", "ruby", "swift"])
def test_imports_send_no_table_through_the_driver(spark, data, language):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")  # no room for any table that is broadcast
    try:
        assert len(catalogue.QUERIES[f"imports_{language}"](spark, data).collect()) > 0
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
