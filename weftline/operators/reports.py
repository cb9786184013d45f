"""What is shown: raw blocks, rerank texts, markdown, impact reports, change summaries."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import language_of, line_of, truncate_middle


def raw_blocks(seeds: DataFrame, chunks: DataFrame, files: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` best seeds, one of each file and breadcrumb, each widened to the run of chunks with its breadcrumb.

    Blocks are clamped to their file; of equal ranges the first stays, blank ones go.
    """
    key = ["file_path", "chunk_index"]
    named = seeds.select(*key, "score", "source").join(chunks.select(*key, "breadcrumb"), key)
    best = named.withColumn("_k", F.row_number().over(Window.partitionBy("file_path", "breadcrumb").orderBy(F.col("score").desc(), "chunk_index"))).where("_k = 1").drop("_k")
    w = Window.partitionBy("file_path").orderBy("chunk_index")
    fresh = F.when(F.col("breadcrumb").eqNullSafe(F.lag("breadcrumb").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = chunks.join(best.select("file_path").distinct(), "file_path", "left_semi").withColumn("_new", fresh).withColumn("_run", run)
    spans = numbered.groupBy("file_path", "_run").agg(F.min("raw_start").alias("_from"), F.max("raw_end").alias("_to"))
    placed = best.join(numbered.select(*key, "_run"), key).join(spans, ["file_path", "_run"]).join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    size = F.length("content")
    start = F.greatest(F.lit(0), F.least("_from", size))
    cut = placed.withColumns({"start": start, "end": F.greatest(start, F.least("_to", size))}).withColumn("text", F.col("content").substr(F.col("start") + 1, F.col("end") - F.col("start"))).where(F.col("text").rlike(r"\S"))
    once = cut.withColumn("_k", F.row_number().over(Window.partitionBy("file_path", "start", "end").orderBy(F.col("score").desc(), "chunk_index"))).where("_k = 1")
    lines = once.withColumns({"start_line": line_of(F.col("content"), F.col("start")), "end_line": line_of(F.col("content"), F.col("end"))})
    return lines.orderBy(F.col("score").desc(), "file_path", "chunk_index").limit(top).select("file_path", "start_line", "end_line", "breadcrumb", "text", "score", "source")


def around_hit(text: str, tokens: list[str], most: int, head: float = 0.67) -> str:
    """The lines around the one with most tokens, one more above and one more below in turn while they fit in ``most``.

    A side that no longer fits stops, and the other goes on alone. Without any token
    in the text, its head and tail.
    """
    if len(text) <= most:
        return text
    lines = text.split("\n")
    hits = [sum(t in line for t in tokens) for line in text.lower().split("\n")]
    if not any(hits):
        tail = most - int(most * head) - 3
        return text[:most] if tail <= 0 else f"{text[: int(most * head)]}...{text[-tail:]}"
    top = bottom = max(range(len(lines)), key=hits.__getitem__)
    left = most - len(lines[top])
    sides = deque(["above", "below"])
    while sides and left > 0:
        side = sides.popleft()
        at = top - 1 if side == "above" else bottom + 1
        if not 0 <= at < len(lines) or len(lines[at]) + 1 > left:
            continue
        left -= len(lines[at]) + 1
        top, bottom = min(top, at), max(bottom, at)
        sides.append(side)
    marks = ("..." if top else "", "..." if bottom + 1 < len(lines) else "")
    return marks[0] + "\n".join(lines[top : bottom + 1]) + marks[1]


def rerank_texts(chunks: DataFrame, tokens: list[str], most: int = 1000, most_breadcrumb: int = 250) -> DataFrame:
    """``chunks`` with rerank_text: the shortened breadcrumb and the code around the best line."""
    rows = chunks.withColumn("_crumb", truncate_middle(F.col("breadcrumb"), most_breadcrumb))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [f"{b or ''}\n{around_hit(t or '', tokens, max(0, most - len(b or '') - 1))}" for b, t in zip(batch.column("_crumb").to_pylist(), batch.column("display_code").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "rerank_text"])

    return rows.mapInArrow(run, rows.schema[:-1].add("rerank_text", "string"))


def segment_markdown() -> Column:
    """One segment with its heading and fenced text."""
    head = F.format_string("## %s (L%d-%d)", "file_path", "start_line", "end_line")
    code = F.concat(F.lit("```"), language_of(F.col("file_path")), F.lit("\n"), "text", F.lit("\n```"))
    return F.concat_ws("\n", head, F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.concat(F.lit("> "), "breadcrumb")), code)


def response_markdown(segments: DataFrame, n_seeds: int) -> DataFrame:
    """One row: the summary line and all segments; ``segments`` are packed, so a budget bounds them."""
    rows = segments.withColumn("_best", F.max("score").over(Window.partitionBy("file_path"))).select("file_path", "_best", "start_line", segment_markdown().alias("md"))
    by_file = rows.groupBy("file_path").agg(F.max("_best").alias("best"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "md"))), lambda s: s["md"]), "\n\n").alias("md"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("minus"), "file_path", "md")))
    summary = F.format_string("Found %d relevant code blocks | Files: %d | Total segments: %d", F.lit(n_seeds), F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)))
    return by_file.agg(F.concat_ws("\n\n", summary, F.array_join(F.transform(listed, lambda s: s["md"]), "\n\n---\n\n")).alias("text"))


def impact_report(impact: DataFrame, nodes: DataFrame, tests: int = 20, files: int = 30) -> DataFrame:
    """(section, place, name, file_path, score, hop): direct tests, other tests and files, each up to its limit."""
    joined = impact.where("hop > 0").join(nodes.select("id", "kind", "name", "file_path"), "id")
    section = F.when((F.col("kind") == "test") & (F.col("hop") == 1), "direct tests").when(F.col("kind") == "test", "indirect tests").when(F.col("kind") == "file", "files")
    order = Window.partitionBy("section").orderBy(F.col("score").desc(), "id")
    rows = joined.withColumn("section", section).where("section is not null").withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= F.when(F.col("section") == "files", files).otherwise(tests)).select("section", "place", "name", "file_path", F.round("score", 3).alias("score"), "hop")


def truncated_diff(diff: Column, most: int = 8000) -> Column:
    half = most // 2
    left_out = F.format_string("\n\n... (truncated %d characters) ...\n\n", F.length(diff) - most)
    return F.when(F.length(diff) <= most, diff).otherwise(F.concat(F.left(diff, F.lit(half)), left_out, F.right(diff, F.lit(half))))


def diff_stats(stat: Column) -> Column:
    """struct<files, insertions, deletions> of the last line of a change statistic."""
    of = lambda regex: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(stat, regex, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(of(r"(\d+) files? changed").alias("files"), of(r"(\d+) insertions?").alias("insertions"), of(r"(\d+) deletions?").alias("deletions"))


# Scopes of leading folders.
SCOPES = {"src": "core", "tests": "test", "docs": "docs", "scripts": "build", "api": "api", "ui": "ui", "lib": "lib"}


def change_summaries(changes: DataFrame, key: str = "change") -> DataFrame:
    """(key, message) of changes with key, position, path, insertions, deletions, in the conventional style.

    The commonest extension and leading folder count, of equally common ones the first.
    """
    folder = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1))
    total = changes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("insertions").alias("added"), F.sum("deletions").alias("gone"), F.max(F.col("path").rlike("test|spec")).alias("tests"), F.max(F.col("path").rlike(r"README|\.md")).alias("docs"), F.min_by("path", "position").alias("first"), F.min_by(folder, "position").alias("first_folder")
    )
    ext = first_mode(changes.withColumn("ext", F.lower(F.substring_index("path", ".", -1))), key, "ext", "position")
    top = first_mode(changes.withColumn("top", F.substring_index("path", "/", 1)), key, "top", "position")
    rows = total.join(ext, key).join(top, key)
    grows, shrinks = F.col("added") > 2 * F.col("gone"), F.col("gone") > 2 * F.col("added")
    kind = F.when(grows, "feat").when(shrinks, "refactor").when(F.col("tests"), "test").when(F.col("docs"), "docs").otherwise("fix")
    action = F.when(grows, "add").when(shrinks, "remove").when(F.col("tests"), "update tests for").otherwise("update")
    known = F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair])
    scope = F.when(F.col("n") == 1, F.col("first_folder")).otherwise(F.coalesce(F.try_element_at(known, F.col("top")), F.col("top")))
    what = F.when(F.col("n") == 1, F.col("first")).otherwise(F.format_string("%d %s files", "n", "ext"))
    return rows.select(key, F.concat(kind, F.when(scope.isNotNull(), F.concat(F.lit("("), scope, F.lit(")"))).otherwise(""), F.lit(": "), action, F.lit(" "), what).alias("message"))


def first_mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the commonest value of each key, of equally common ones the first in order."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct((-F.col("_n")).alias("a"), F.col("_first").alias("b"))).alias(value))
