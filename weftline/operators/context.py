"""From seed chunks to packed context: expansion, interval merge, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import line_of, parent_prefix
from weftline.operators.retrieval import per_group_cap
from weftline.plans.lineage import Scratch, written

# Score decays of the expansions.
NEIGHBOUR, BREADCRUMB, IMPORT, DEPTH = 0.8, 0.7, 0.6, 0.7


def neighbours(seeds: DataFrame, chunks: DataFrame, hops: int = 1, file: str = "file_path") -> DataFrame:
    """Chunks within ``hops`` of a seed of the same file, from the nearest seed, then the best one.

    Each seed is spread to the positions around it, so the join is on equal keys.
    """
    if hops <= 0:
        return chunks.limit(0).select(file, "chunk_index").withColumns({"score": F.lit(0.0), "source": F.lit("neighbor")})
    around = seeds.select(file, F.col("chunk_index").alias("_seed"), F.col("score").alias("_score"), F.explode(F.sequence(F.col("chunk_index") - hops, F.col("chunk_index") + hops)).alias("chunk_index"))
    around = around.join(seeds.select(file, "chunk_index"), [file, "chunk_index"], "left_anti").withColumn("_dist", F.abs(F.col("chunk_index") - F.col("_seed")))
    nearest = around.groupBy(file, "chunk_index").agg(F.min(F.struct("_dist", (-F.col("_score")).alias("_minus"))).alias("_b"))
    found = chunks.select(file, "chunk_index").join(nearest, [file, "chunk_index"])
    return found.select(file, "chunk_index", (-F.col("_b._minus") * F.pow(F.lit(NEIGHBOUR), F.col("_b._dist"))).alias("score"), F.lit("neighbor").alias("source"))


def siblings(seeds: DataFrame, chunks: DataFrame, limit: int = 1, file: str = "file_path") -> DataFrame:
    """Chunks of the seed's file under the same parent breadcrumb, the first ``limit`` that are no seeds."""
    if limit <= 0:
        return chunks.limit(0).select(file, "chunk_index").withColumns({"score": F.lit(0.0), "source": F.lit("breadcrumb")})
    keyed = chunks.select(file, "chunk_index", parent_prefix(F.col("breadcrumb")).alias("_prefix")).where("_prefix <> ''")
    best = seeds.select(file, "chunk_index", "score").join(keyed, [file, "chunk_index"]).groupBy(file, "_prefix").agg(F.max("score").alias("_best"))
    found = keyed.join(seeds.select(file, "chunk_index"), [file, "chunk_index"], "left_anti").join(best, [file, "_prefix"])
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy(file, "_prefix").orderBy("chunk_index"))).where(F.col("_k") <= limit)
    return first.select(file, "chunk_index", (F.col("_best") * BREADCRUMB).alias("score"), F.lit("breadcrumb").alias("source"))


def is_barrel(path):
    """Whether a file re-exports a folder."""
    return path.rlike(r"(?:^|/)(?:index\.[^/]+|__init__\.py|mod\.rs)$")


def imported(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, files_per_seed: int = 5, per_file: int = 2, file: str = "file_path") -> DataFrame:
    """Leading chunks of the files that seed files import, and of those that imported barrel files import.

    ``edges`` has from_path, to_path and position; ``chunks`` may have ``overlap``, by
    which they are taken first.
    """
    if files_per_seed <= 0 or per_file <= 0:
        return chunks.limit(0).select(file, "chunk_index").withColumns({"score": F.lit(0.0), "source": F.lit("import")})
    order = [F.col("overlap").desc(), "chunk_index"] if "overlap" in chunks.columns else ["chunk_index"]
    best = per_group_cap(chunks, file, per_file, *order).select(file, "chunk_index")
    score = seeds.groupBy(file).agg(F.max("score").alias("_seed"))
    unique = edges.where("to_path <> from_path").groupBy("from_path", "to_path").agg(F.min("position").alias("position"))
    near = per_group_cap(score.join(unique, score[file] == unique["from_path"]), "from_path", files_per_seed, "position").select("to_path", "_seed", "from_path")
    barrels = near.where(is_barrel(F.col("to_path"))).join(score.select(F.col(file).alias("to_path")), "to_path", "left_anti").groupBy(F.col("to_path").alias("_barrel")).agg(F.max("_seed").alias("_seed"))
    far = per_group_cap(barrels.join(unique, barrels["_barrel"] == unique["from_path"]), "from_path", min(files_per_seed, 2), "position")
    reached = near.select(F.col("to_path").alias(file), (F.col("_seed") * IMPORT).alias("score")).unionByName(far.select(F.col("to_path").alias(file), (F.col("_seed") * IMPORT * DEPTH).alias("score")))
    found = reached.groupBy(file).agg(F.max("score").alias("score")).join(best, file)
    return found.join(seeds.select(file, "chunk_index"), [file, "chunk_index"], "left_anti").select(file, "chunk_index", "score", F.lit("import").alias("source"))


def expanded(seeds: DataFrame, *more: DataFrame, file: str = "file_path") -> DataFrame:
    """Seeds and expansions, each chunk once: a seed before an expansion, an earlier expansion before a later."""
    rows = seeds.select(file, "chunk_index", "score", "source").withColumn("_step", F.lit(0))
    for k, part in enumerate(more):
        rows = rows.unionByName(part.select(file, "chunk_index", "score", "source").withColumn("_step", F.lit(k + 1)))
    first = rows.groupBy(file, "chunk_index").agg(F.min(F.struct("_step", (-F.col("score")).alias("_minus"), "source")).alias("_b"))
    return first.select(file, "chunk_index", (-F.col("_b._minus")).alias("score"), F.col("_b.source").alias("source"))


def merged_segments(chunks: DataFrame, file: str = "file_path") -> DataFrame:
    """Overlapping or touching raw spans of a file as one segment: raw_start, raw_end, score, breadcrumb, n_chunks."""
    order = ["raw_start", "raw_end"]
    before = F.max("raw_end").over(Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_new").over(Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = chunks.withColumn("_new", F.when(F.col("raw_start") <= before, 0).otherwise(1)).withColumn("_island", island)
    return (
        marked.groupBy(file, "_island")
        .agg(F.min("raw_start").alias("raw_start"), F.max("raw_end").alias("raw_end"), F.max("score").alias("score"), F.min_by("breadcrumb", F.struct(*order)).alias("breadcrumb"), F.count(F.lit(1)).alias("n_chunks"))
        .drop("_island")
    )


def with_lines(segments: DataFrame, files: DataFrame, file: str = "file_path") -> DataFrame:
    """Segments with their text and 1-based first and last line."""
    joined = segments.join(files.select(F.col("path").alias(file), "content"), file)
    return joined.select(*segments.columns, F.col("content").substr(F.col("raw_start") + 1, F.col("raw_end") - F.col("raw_start")).alias("text"), line_of(F.col("content"), F.col("raw_start")).alias("start_line"), line_of(F.col("content"), F.col("raw_end")).alias("end_line"))


def packed(segments: DataFrame, per_file: int = 3, budget: int = 48_000, file: str = "file_path", most_segments: int = 10_000) -> DataFrame:
    """Segments within a budget of characters, best files first.

    A file's best ``per_file`` segments go in order of position until one is too
    long; the next file goes on with what is left. The files of which something could
    still fit are read in rounds of ``most_segments`` at most, until nothing is left
    of the budget or no such file is; the driver holds one round and the files that
    took a character, at most as many as the budget has.
    """
    top = per_group_cap(segments, file, per_file, F.col("score").desc(), "raw_start")
    # ascending in the order of files: null scores last, as in a descending order
    best = F.max("score").over(Window.partitionBy(file))
    in_file = Window.partitionBy(file).orderBy("raw_start", "raw_end")
    rows = top.withColumns({"_best": best, "_n": F.row_number().over(in_file), "_size": (F.col("raw_end") - F.col("raw_start")).cast("long")})
    rows = rows.withColumns({"_place": F.struct(F.col("_best").isNull().alias("a"), (-F.col("_best")).alias("b"), F.col(file).alias("c")), "_sum": F.sum("_size").over(in_file.rowsBetween(Window.unboundedPreceding, 0))}).drop("_best")
    rows = written(rows, "ranked")
    # what a file takes at least if it takes a character; a file's empty segments before that always fit
    least = rows.where("_sum > 0").groupBy("_place").agg(F.min("_sum").alias("_least"))
    sums = rows.where("_sum > 0").select("_place", "_n", "_sum").join(least, "_place")

    left, place, chosen, end = budget, None, [], None
    while left > 0:
        fits = sums.where((F.col("_least") <= left) & (F.col("_sum") <= left))
        if place is not None:
            fits = fits.where(F.col("_place") > place)
        files = fits.groupBy("_place").agg(F.sort_array(F.collect_list(F.struct("_n", "_sum"))).alias("s")).orderBy("_place").limit(most_segments).collect()
        for r in files:
            before, taken = 0, 0
            for n, total in r["s"]:
                if total > left or before >= left:
                    break
                before, taken = total, n
            if taken:
                chosen.append((r["_place"], taken))
                left -= before
            if left <= 0:
                end = r["_place"]
                break
        if len(files) < most_segments:
            break
        place = _literal(files[-1]["_place"], rows.schema["_place"].dataType)

    kind = T.StructType([rows.schema["_place"], T.StructField("_taken", T.IntegerType())])
    taken = F.broadcast(rows.sparkSession.createDataFrame(chosen, kind).withColumnRenamed("_place", "_chosen"))
    if end is not None:
        rows = rows.where(F.col("_place") <= _literal(end, rows.schema["_place"].dataType))
    kept = rows.join(taken, F.col("_place").eqNullSafe(F.col("_chosen")), "left").where((F.col("_n") <= F.col("_taken")) | (F.col("_sum") == 0) & F.lit(budget > 0))
    return kept.orderBy("_place", "_n").select(segments.columns)


def _literal(row: Row, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind, strict=True)])


def greedy_batches(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """(group, order, batch), batches from 0 in each group: rows in order, a batch closing before it would exceed ``limit``.

    A row larger than the limit is a batch of its own; a null size is 0. Where a batch
    ends depends on all rows before it, but only through what is in the open batch.
    So a group is cut into ranges, and each range tells, for what may be in the batch
    that is open before it, how many batches begin in it and what is in the last one.
    Batches that begin at different rows soon begin at the same ones, so that is a few
    rows a range. Those alone pass in order through one task a group; then every range
    numbers its own rows.
    """
    tables = Scratch(rows.sparkSession, "batches")
    narrow = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("s"))
    number = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    kept = T.StructType([*(T.StructField(f.name, f.dataType) for f in narrow.schema.fields), *number("part", "upto", "begun", "left"), T.StructField("is_row", T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def told(kind: tuple, g, sizes: list[int]) -> pa.RecordBatch:
            found = batch_effects(np.array(sizes, dtype=np.int64), limit)
            n = len(found)
            columns = [pa.array([g] * n, kind[0]), pa.nulls(n, kind[1]), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)), pa.array([False] * n)]
            return pa.RecordBatch.from_arrays(columns, names=kept.names)

        at, sizes, kind = None, [], ()
        for batch in batches:
            kind = (batch.schema.field(0).type, batch.schema.field(1).type)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), *[pa.nulls(n, pa.int64())] * 3, pa.array([True] * n)], names=kept.names)
            for g, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != (g,):
                    if at:
                        yield told(kind, at[0], sizes)
                    at, sizes = (g,), []
                sizes.append(s)
        if at:
            yield told(kind, at[0], sizes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, used, n, done = None, 0, 0, True
        for batch in batches:
            out = []
            for g, part, upto, begun, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here is None or here[0] != g:
                    used, n = limit + 1, -1  # a group's first row begins a batch
                if here != (g, part):
                    here, done = (g, part), False
                    out.append((g, part, used, n))
                    before = used
                if not done and (upto is None or before + upto > limit):
                    used, n, done = (before if upto is None else 0) + left, n + begun, True
            columns = [[o[k] for o in out] for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, *[pa.int64()] * 3), strict=True)], names=["g", "part", "used", "n"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = n = 0
        for batch in batches:
            keep, out = [], []
            for s, had, begun in zip(*(batch.column(c).to_pylist() for c in ("s", "used", "n")), strict=True):
                keep.append(had is None)
                if had is not None:
                    used, n = had, begun
                    continue
                if used + s > limit:
                    used, n = 0, n + 1
                used += s
                out.append(n)
            rows_ = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rows_.column("g"), rows_.column("o"), pa.array(out, pa.int32())], names=[group, order, "batch"])

    ranged = tables.written(narrow.repartitionByRange("g", "o").sortWithinPartitions("g", "o").mapInArrow(cut, kept), "ranges", partition_by=("is_row",))
    # what a range does is in order of what has to be in the open batch for it; a null one is for all else
    effects = ranged.where("not is_row").select("g", "part", "upto", "begun", "left").repartition("g").sortWithinPartitions("g", "part", F.col("upto").asc_nulls_last())
    starts = effects.mapInArrow(fold, T.StructType([T.StructField("g", narrow.schema["g"].dataType), *number("part", "used", "n")]))
    both = ranged.where("is_row").select("g", "o", "s", "part").unionByName(starts, allowMissingColumns=True)
    dealt = both.repartition("part").sortWithinPartitions("part", "g", F.col("used").isNull(), "o").select("g", "o", "s", "used", "n")
    return dealt.mapInArrow(numbered, T.StructType([T.StructField(group, narrow.schema["g"].dataType), T.StructField(order, narrow.schema["o"].dataType), T.StructField("batch", T.IntegerType())]))


def batch_effects(sizes: np.ndarray, limit: int) -> list[tuple[int | None, int, int]]:
    """What rows do to the batches: (upto, begun, left) in order; the first with used + upto > limit holds.

    ``used`` is what the batch that is open before the rows has, ``begun`` the batches
    that begin in them and ``left`` what the last one has. The last entry, without
    ``upto``, is for a batch that takes all rows in; ``left`` is then what they add.
    """
    sums = np.cumsum(sizes)
    before = sums - sizes
    # the batch after one that begins at a row, and, from the last row back, how many follow and what the last has
    after = np.maximum(np.searchsorted(sums, before + limit, side="right"), np.arange(len(sizes)) + 1).tolist()
    begun, left, n = [1] * len(sizes), (sums[-1] - before).tolist() if len(sizes) else [], len(sizes)
    for k in range(n - 1, -1, -1):
        if after[k] < n:
            begun[k], left[k] = begun[after[k]] + 1, left[after[k]]
    out: list[tuple[int | None, int, int]] = []
    for k in np.flatnonzero((before <= limit) & ((sizes > 0) | (np.arange(n) == 0))).tolist():
        if out and out[-1][1:] == (begun[k], left[k]):
            out.pop()  # one entry for neighbours that do the same
        out.append((int(sums[k]), begun[k], left[k]))
    return [*out, (None, 0, int(sums[-1]) if n else 0)]


def runs(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Contiguous runs of equal values along an order: run_start, run_end, n."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "_run", value).agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("n")).drop("_run")
