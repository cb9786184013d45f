"""Centroid clustering in integers, by Yinyang grouping.

Vectors are packed once, where they are read, into blocks of one matrix each; no
vector is shuffled. Centroids are cut into groups once. A block keeps for each vector
its cluster, an upper bound of the distance to that centroid, and a lower bound for
each group of the distance to every other centroid of it. When centroids have moved,
bounds move with them. A vector whose upper bound lies below all its lower bounds
keeps its cluster (global filter); else its own distance is made exact, groups whose
bound lies above it are skipped (group filter), within the others so are centroids
whose own bound does, and those that are left are scanned exactly. Bounds only skip
what can't be nearest, ties included, so each round equals a full scan.

Each round writes the blocks anew with the sums of the vectors that moved; the
driver gets one number for each component of each centroid.

Defined cases: vectors that are null, of another length, or hold a null or non-finite
component take no part; scaled components beyond 2^27 in size count as 2^27, so that
distances fit 64 bits; a null id takes part but is a start only after all others;
rows that repeat are vectors each, and starts each; equal starts leave all but the
first of them empty; with fewer vectors than clusters each is a start; a sum that
doesn't fit 64 bits is null; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import Scratch

#: Vectors of a block, centroids of a group on average, largest component, by which a bound is widened against rounding.
BLOCK, PER_GROUP, LARGEST, SLACK = 4096, 4, 2**27, 1e-12
KINDS = (np.int8, np.int16, np.int32)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, scale: int = 64) -> DataFrame:
    """(id, vector array<int>) of the vectors that take part, components floor(scale * x)."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.lit(scale) * x.cast("double")), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.where(fine).select(F.col(id_col).alias("id"), whole.alias("vector"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests, as rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "id", "vector").limit(k).select("vector").collect()
    return np.array([r[0] for r in rows], dtype=np.int64)


def grouped(centroids: np.ndarray, n_groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, from a few rounds of clustering the centroids themselves."""
    heads = centroids[np.linspace(0, len(centroids) - 1, n_groups).astype(int)].astype(float)
    of = np.zeros(len(centroids), dtype=int)
    for _ in range(rounds):
        of = ((centroids[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(of):
            heads[g] = centroids[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def _squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid."""
    away = x - centroid
    return np.einsum("ij,ij->i", away, away)


@dataclass
class Bounds:
    """Clusters, upper bounds, and lower bounds by group, of the vectors of a block."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_bounds(x: np.ndarray, centroids: np.ndarray, group_of: np.ndarray) -> Bounds:
    """A full scan; of equal distances the smaller number wins."""
    squares = np.stack([_squares(x, c) for c in centroids], axis=1)
    cluster = squares.argmin(axis=1)
    return _bounds_of(np.sqrt(squares.astype(float)), cluster, group_of)


def _bounds_of(distances: np.ndarray, cluster: np.ndarray, group_of: np.ndarray) -> Bounds:
    rows = np.arange(len(cluster))
    upper = distances[rows, cluster] * (1 + SLACK)
    others = distances.copy()
    others[rows, cluster] = np.inf
    lower = np.stack([others[:, group_of == g].min(axis=1) for g in range(group_of.max() + 1)], axis=1) * (1 - SLACK)
    return Bounds(cluster, upper, lower)


def next_bounds(x: np.ndarray, old: Bounds, centroids: np.ndarray, before: np.ndarray, group_of: np.ndarray) -> tuple[Bounds, int]:
    """The bounds after centroids have moved from ``before``, and the number of distances that were computed."""
    moved = np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
    most = np.array([moved[group_of == g].max() for g in range(group_of.max() + 1)])
    cluster, upper, lower = old.cluster.copy(), (old.upper + moved[old.cluster]) * (1 + SLACK), (old.lower - most) * (1 - SLACK) - SLACK
    # global filter, once as it is and once with the own distance made exact
    open_rows = np.flatnonzero(upper >= lower.min(axis=1))
    best = np.zeros(len(x), dtype=x.dtype)
    for c in np.unique(cluster[open_rows]):
        at = open_rows[cluster[open_rows] == c]
        best[at] = _squares(x[at], centroids[c])
    scanned = len(open_rows)
    upper[open_rows] = np.sqrt(best[open_rows].astype(float)) * (1 + SLACK)
    rows = open_rows[upper[open_rows] >= lower[open_rows].min(axis=1)]
    if not len(rows):
        return Bounds(cluster, upper, lower), scanned
    own, near = cluster[rows], best[rows]
    # what is known of each centroid: a bound until it is scanned
    known = lower[rows][:, group_of]
    known[np.arange(len(rows)), own] = np.sqrt(near.astype(float)) * (1 - SLACK)
    for g in range(group_of.max() + 1):
        into = lower[rows, g] <= np.sqrt(near.astype(float)) * (1 + SLACK)  # group filter
        for c in np.flatnonzero(group_of == g):
            alone = (old.lower[rows, g] - moved[c]) * (1 - SLACK) - SLACK
            known[:, c] = np.where(into & (own != c), np.maximum(known[:, c], alone), known[:, c])
            at = np.flatnonzero(into & (own != c) & (alone <= np.sqrt(near.astype(float)) * (1 + SLACK)))
            if not len(at):
                continue
            squares = _squares(x[rows[at]], centroids[c])
            scanned += len(at)
            known[at, c] = np.sqrt(squares.astype(float)) * (1 - SLACK)
            wins = (squares < near[at]) | ((squares == near[at]) & (c < cluster[rows[at]]))
            cluster[rows[at[wins]]], near[at[wins]] = c, squares[wins]
    found = _bounds_of(known, cluster[rows], group_of)
    upper[rows], lower[rows] = np.sqrt(near.astype(float)) * (1 + SLACK), found.lower
    return Bounds(cluster, upper, lower), scanned


def _close(x: np.ndarray) -> bytes:
    """A matrix in the narrowest integers, after a byte that names them."""
    size = int(np.abs(x).max(initial=0))
    kind = next(k for k, t in enumerate(KINDS) if size <= np.iinfo(t).max)
    return bytes([kind]) + x.astype(KINDS[kind]).tobytes()


def _open(data: bytes, width: int) -> np.ndarray:
    """The matrix, in floats where all squared distances are exact in them."""
    x = np.frombuffer(data, dtype=KINDS[data[0]], offset=1).reshape(-1, width)
    return x.astype(np.float64 if data[0] < 2 and width < 2**20 else np.int64)


def _summed(x: np.ndarray, to: np.ndarray, since: np.ndarray | None, k: int) -> np.ndarray:
    """By cluster, what rows that moved add to the sums and, in the last column, to the counts."""
    out = np.zeros((k, x.shape[1] + 1), dtype=np.int64)
    at = np.arange(len(to)) if since is None else np.flatnonzero(to != since)
    moving = np.concatenate([x[at].astype(np.int64), np.ones((len(at), 1), dtype=np.int64)], axis=1)
    np.add.at(out, to[at], moving)
    if since is not None:
        np.subtract.at(out, since[at], moving)
    return out


@dataclass
class Clustering:
    """The blocks after the last round, in which ``scanned`` counts computed distances, and the centroids."""

    blocks: DataFrame
    centroids: np.ndarray
    id_type: T.DataType


def _schema(id_type: T.DataType) -> T.StructType:
    binary = [T.StructField(c, T.BinaryType()) for c in ("matrix", "cluster", "upper", "lower")]
    return T.StructType([T.StructField("ids", T.ArrayType(id_type)), *binary, T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("scanned", T.LongType())])


def _row(ids: pa.Array, matrix: bytes, b: Bounds, sums: np.ndarray, scanned: int) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, pa.array(sums.ravel()))]
    state = [matrix, b.cluster.astype(np.int32).tobytes(), b.upper.tobytes(), b.lower.tobytes()]
    return pa.RecordBatch.from_arrays([lists[0], *[pa.array([s], pa.binary()) for s in state], lists[1], pa.array([scanned])], names=["ids", "matrix", "cluster", "upper", "lower", "sums", "scanned"])


def packed(vectors: DataFrame, centroids: np.ndarray, group_of: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Blocks of vectors with their first clusters and bounds."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(part: pa.Table) -> pa.RecordBatch:
            flat = part.column("vector").combine_chunks().flatten().to_numpy()
            matrix = _close(flat.reshape(-1, width))
            x = _open(matrix, width)
            b = first_bounds(x, centroids, group_of)
            return _row(part.column("id").combine_chunks(), matrix, b, _summed(x, b.cluster, None, len(centroids)), x.shape[0] * len(centroids))

        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= block:
                rows = pa.Table.from_batches(waiting)
                for k in range(0, n - n % block, block):
                    yield closed(rows.slice(k, block))
                waiting, n = rows.slice(n - n % block).to_batches(), n % block
        if n:
            yield closed(pa.Table.from_batches(waiting))

    return vectors.mapInArrow(run, _schema(vectors.schema["id"].dataType))


def moved_on(blocks: DataFrame, centroids: np.ndarray, before: np.ndarray, group_of: np.ndarray) -> DataFrame:
    """The blocks with clusters and bounds for centroids that have moved from ``before``."""
    width, n_groups = centroids.shape[1], int(group_of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, (matrix, cluster, upper, lower) = batch.column("ids")[k].values, (batch.column(c)[k].as_py() for c in ("matrix", "cluster", "upper", "lower"))
                x = _open(matrix, width)
                old = Bounds(np.frombuffer(cluster, np.int32).astype(np.int64), np.frombuffer(upper), np.frombuffer(lower).reshape(-1, n_groups))
                b, scanned = next_bounds(x, old, centroids, before, group_of)
                yield _row(ids, matrix, b, _summed(x, b.cluster, old.cluster, len(centroids)), scanned + batch.column("scanned")[k].as_py())

    return blocks.mapInArrow(run, blocks.schema)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> Clustering | None:
    """``rounds`` rounds of assigning and averaging, and one more assignment; None without a usable vector.

    The driver holds the centroids, ``k`` by ``width`` numbers.
    """
    rows = usable(vectors, id_col, vector_col, width, scale)
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return None
    group_of = grouped(centroids, -(-len(centroids) // PER_GROUP))
    tables = Scratch(vectors.sparkSession, "yinyang")
    blocks = tables.written(packed(rows, centroids, group_of, block), "blocks-0")
    totals = [[0] * (width + 1) for _ in centroids]
    for n in range(1, rounds + 1):
        sums = blocks.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        for r in sums:
            totals[r["at"] // (width + 1)][r["at"] % (width + 1)] += r["x"]
        before, centroids = centroids, np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(totals, centroids.tolist(), strict=True)], dtype=np.int64)
        blocks = tables.written(moved_on(blocks, centroids, before, group_of), f"blocks-{n}")
        tables.drop(f"blocks-{n - 1}")
    return Clustering(blocks, centroids, vectors.schema[id_col].dataType)


def assigned(found: Clustering) -> DataFrame:
    """(id, cluster, distance) of each vector, the distance squared."""
    width, centroids = found.centroids.shape[1], found.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, of = _open(batch.column("matrix")[k].as_py(), width), np.frombuffer(batch.column("cluster")[k].as_py(), np.int32)
                far = np.zeros(len(of), dtype=np.int64)
                for c in np.unique(of):
                    far[of == c] = _squares(x[of == c], centroids[c])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(of), pa.array(far)], names=["id", "cluster", "distance"])

    return found.blocks.select("ids", "matrix", "cluster").mapInArrow(run, T.StructType([T.StructField("id", found.id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def with_inertia(found: Clustering) -> DataFrame:
    """``assigned`` with each cluster's and all vectors' summed distance and the digest of the cluster's centroid."""
    rows = assigned(found)
    spark = rows.sparkSession
    sums = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}
    every = None if None in sums.values() or sum(sums.values()) >= 2**63 else sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    facts = spark.createDataFrame([(c, sums.get(c), every, d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster")
