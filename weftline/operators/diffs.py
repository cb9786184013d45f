"""Line differences of texts, and texts changed by patches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HUNK = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("lines", T.ArrayType(T.StringType()))])


def _middle(a: Sequence[int], b: Sequence[int]) -> tuple[int, int]:
    """A point on a shortest path of edits, half of them before it, by searching from both ends at once."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and -d < delta - k < d and x <= n and 0 <= x - k <= m and x + back[delta - k] >= n:
                return x, x - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            while x < n and x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                x += 1
            back[k] = x
            if delta % 2 == 0 and -d <= delta - k <= d and x <= n and 0 <= x - k <= m and x + ahead[delta - k] >= n:
                return n - x, m - x + k
    raise AssertionError("paths from both ends meet")


def common(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by divide and conquer in linear memory."""
    # what only one side has is in none
    there = set(a) & set(b)
    ai, bi = [k for k, x in enumerate(a) if x in there], [k for k, x in enumerate(b) if x in there]
    left, right, out = [a[k] for k in ai], [b[k] for k in bi], []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and left[i] == right[j]:
            out.append((ai[i], bi[j]))
            i, j = i + 1, j + 1
        while i < n and j < m and left[n - 1] == right[m - 1]:
            n, m = n - 1, m - 1
            out.append((ai[n], bi[m]))
        if i < n and j < m:
            x, y = _middle(left[i:n], right[j:m])
            todo += [(i, i + x, j, j + y), (i + x, n, j + y, m)]
    return sorted(out)


def hunks(old: str, new: str) -> list[tuple[int, int, list[str]]]:
    """(first line from 1, lines removed, lines put in their place) of a shortest edit script, in order."""
    a, b = old.split("\n"), new.split("\n")
    number: dict[str, int] = {}
    a_, b_ = ([number.setdefault(x, len(number)) for x in side] for side in (a, b))
    out, i, j = [], 0, 0
    for x, y in [*common(a_, b_), (len(a), len(b))]:
        if x > i or y > j:
            out.append((i + 1, x - i, b[j:y]))
        i, j = x + 1, y + 1
    return out


def line_diffs(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """(key, hunks array<start, removed, lines>): what turns each old text into the new one; a null text is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("removed", pa.int32()), ("lines", pa.list_(pa.string()))]))
        for batch in batches:
            found = [[{"start": s, "removed": r, "lines": ls} for s, r, ls in hunks(a, b)] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "hunks"])

    rows = pairs.select(key, F.coalesce(old, F.lit("")).alias("_old"), F.coalesce(new, F.lit("")).alias("_new"))
    return rows.mapInArrow(run, T.StructType([pairs.schema[key], T.StructField("hunks", T.ArrayType(_HUNK))]))


def patched(texts: DataFrame, patches: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``texts`` after their patches (key, start, removed, lines), with ``patch_status``: ok, none, overlap or out of range.

    Patches of a text are put in from the last line up, so none moves another's
    lines. Where two take the same line, or one lies beyond the text, the text stays.
    """
    own = patches.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "removed", "lines"))).alias("_hunks"))
    joined = texts.join(own, F.col(key).eqNullSafe(F.col("_key")), "left")
    lines = F.split(F.col(text), "\n", -1)
    h, n = F.col("_hunks"), F.size(F.split(F.col(text), "\n", -1))
    beside = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(1))), lambda a, b: (a["start"] + a["removed"] > b["start"]) | ((a["start"] == b["start"]) & (a["removed"] == 0) & (b["removed"] == 0)))
    overlap = F.exists(beside, lambda x: F.coalesce(x, F.lit(False)))
    outside = F.exists(h, lambda x: (x["start"] < 1) | (x["removed"] < 0) | (x["start"] + x["removed"] > n + 1))
    status = F.when(h.isNull(), "none").when(F.col(text).isNull() | outside, "out of range").when(overlap, "overlap").otherwise("ok")
    put = lambda done, x: F.concat(F.slice(done, F.lit(1), x["start"] - 1), F.coalesce(x["lines"], F.array().cast("array<string>")), F.slice(done, x["start"] + x["removed"], F.size(done)))
    after = F.array_join(F.aggregate(F.reverse(h), lines, put), "\n")
    return joined.withColumn("patch_status", status).withColumn(text, F.when(F.col("patch_status") == "ok", after).otherwise(F.col(text))).drop("_key", "_hunks")
