from pyspark.sql import functions as F

from weftline.operators import access, indexing, reports


def test_around_hit():
    text = "\n".join(f"line {k} filler" for k in range(40)).replace("line 20 filler", "the TOKEN here")
    got = reports.around_hit(text, ["token"], 60)
    assert "TOKEN" in got and got.startswith("...") and got.endswith("...") and len(got) <= 66
    assert reports.around_hit("short", ["x"], 60) == "short" and reports.around_hit("a" * 100, ["x"], 10) == "a" * 6 + "..." + "a"


def test_rerank_texts(spark):
    rows = spark.createDataFrame([("b" * 300, "code"), (None, "x" * 2000)], "breadcrumb string, display_code string")
    got = reports.rerank_texts(rows, ["code"]).collect()
    assert got[0].rerank_text == "b" * 123 + "..." + "b" * 123 + "\ncode" and len(got[1].rerank_text) <= 1001


def test_markdown(spark):
    rows = spark.createDataFrame([("a.py", 1, 2, "a > f", "def f", 0.9), ("a.py", 5, 6, "", "x", 0.2), ("b.ts", 1, 1, None, "y", 0.5)], "file_path string, start_line int, end_line int, breadcrumb string, text string, score double")
    text = reports.response_markdown(rows, 2).first().text
    assert text.startswith("Found 2 relevant code blocks | Files: 2 | Total segments: 3\n\n## a.py (L1-2)\n> a > f\n```python\ndef f\n```")
    assert text.index("a.py") < text.index("---") < text.index("b.ts")


def test_impact_report(spark):
    impact = spark.createDataFrame([("t1", 1, 0.9), ("t2", 2, 0.5), ("f", 1, 0.4), ("s", 0, 1.0), ("fn", 1, 0.4)], "id string, hop int, score double")
    nodes = spark.createDataFrame([("t1", "test", "a", "a.test"), ("t2", "test", "b", "b.test"), ("f", "file", "f", "f"), ("s", "file", "s", "s"), ("fn", "function", "x", "f")], "id string, kind string, name string, file_path string")
    assert sorted((r.section, r.name) for r in reports.impact_report(impact, nodes).collect()) == [("direct tests", "a"), ("files", "f"), ("indirect tests", "b")]
    assert reports.impact_report(impact, nodes, tests=0).count() == 1


def test_changes(spark):
    rows = spark.createDataFrame([("c1", 0, "src/a.ts", 10, 1), ("c1", 1, "src/b.ts", 1, 0), ("c1", 2, "docs/x.md", 0, 0), ("c2", 0, "README.md", 1, 1), ("c3", 0, "tests/a.py", 1, 9)], "change string, position int, path string, insertions int, deletions int")
    got = {r.change: r.message for r in reports.change_summaries(rows).collect()}
    assert got == {"c1": "feat(core): add 3 ts files", "c2": "docs: update README.md", "c3": "refactor(tests): remove tests/a.py"}
    one = spark.range(1).select(reports.truncated_diff(F.lit("a" * 10), 4).alias("d"), reports.diff_stats(F.lit(" 3 files changed, 12 insertions(+), 1 deletion(-)")).alias("s")).first()
    assert one.d == "aa\n\n... (truncated 6 characters) ...\n\naa" and tuple(one.s) == (3, 12, 1)


def test_access(spark):
    calls = [("edit-file", "../x", "", "/w"), ("edit-file", "/etc/passwd", "", None), ("edit-file", "/other/x", "", "/w"), ("edit-file", "a/.ssh/id", "", "/w"), ("run", "", "rm -rf / now", "/w"), ("edit-file", "package.json", "", "/w"), ("delete-file", "a", "", None), ("delete-file", "a", "", "/w"), ("run", "", "sudo ls", "/w"), ("read", "a.py", "", "/w")]
    rows = spark.createDataFrame(calls, "tool string, path string, command string, root string")
    got = [(r.s.risk, r.s.restriction) for r in rows.select(access.call_safety(F.col("tool"), F.col("path"), F.col("command"), F.col("root"), ["/etc"], [".ssh"], ["rm -rf /"], ["package.json"]).alias("s")).collect()]
    assert got == [("denied", "path_traversal_blocked"), ("denied", "system_path_blocked"), ("denied", "outside_workspace"), ("denied", "user_sensitive_path_blocked"), ("denied", "dangerous_command_blocked"), ("warning", "modifying_config_file"), ("denied", "missing_repo_path"), ("warning", "file_deletion"), ("safe", "sudo_usage"), ("safe", "")]


def test_states_and_caches(spark):
    files = spark.createDataFrame([("a.ts", "1"), ("b.ts", "2"), ("c.py", "1")], "path string, hash string")
    states = spark.createDataFrame([("a.ts", "1", "indexed"), ("b.ts", "1", "indexed")], "path string, hash string, status string")
    assert {r.path: r.status for r in indexing.graph_states(files, states).collect()} == {"a.ts": "indexed", "b.ts": "pending", "c.py": "skipped"}
    cache = spark.createDataFrame([("a", 5), ("b", 50)], "key string, written_at long")
    assert [r.key for r in indexing.younger_than(cache, 60, 20).collect()] == ["b"]


def test_tables_of_a_thread_are_its_own(spark):
    import threading

    from weftline.plans import lineage

    mine = lineage.fresh_path(spark, "mine")
    spark.range(3).write.parquet(mine)
    seen = []

    def other():
        lineage.written(spark.range(2), "other")
        seen.append(len(lineage.named()))
        lineage.clean_up(spark)
        seen.append(len(lineage.named()))

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert seen == [1, 0] and mine in lineage.named() and spark.read.parquet(mine).count() == 3
    lineage.discard(spark, mine)
    scratch = lineage.Scratch(spark, "s")
    a, b = scratch.written(spark.range(3), "a"), scratch.written(spark.range(4), "b")
    scratch.drop("a")
    assert b.count() == 4 and list(scratch.paths) == ["b"] and a is not None
    scratch.close()
    assert scratch.folder not in lineage.named()
