"""Exact top-k by integer inner product, with block-at-a-time pruning.

Vectors are quantised and dealt, similar ones together, to blocks with a forward
index (their components as one matrix) and the maximum and minimum of each
component. For a query, a block's bound is the sum over components of the larger
of component times maximum and component times minimum. Blocks are scored in
descending order of bound, until bounds fall below the query's k-th score.

A first pass scores each query against its own group of blocks and gives it a k-th
score to start from. Then queries meet the bounds of all other groups, a few numbers
for each block; only a query that a group's bounds let through goes on to the
group's vectors, which are sent once to each group's tasks in the narrowest integers
that hold them. All are packed rows of bounded size.

Defined cases: vectors that are null or hold a null or non-finite component, and
rows with a null id, take no part; shorter vectors count as if zeros followed; rows
that repeat an id are scored each, and none is a candidate for a query of that id;
with fewer than k candidates all are returned; ties go to the smaller id; an empty
table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

#: Rows of a group of blocks, rows of a block, hyperplanes by which similar vectors meet, partitions that groups are dealt over at most.
GROUP, BLOCK, PLANES, MOST_PARTS = 4096, 128, 12, 8192


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, vector array<long>) of the usable vectors, components floor(scale * x)."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).cast("array<long>").alias("vector"))


def _code(width: int = 64) -> Column:
    """Signs of fixed random projections of the first components, as one number."""
    rng = np.random.default_rng(5)
    out = F.lit(0)
    for k in range(PLANES):
        signs = F.array(*[F.lit(int(s)) for s in rng.choice([-1, 1], width)])
        side = F.aggregate(F.zip_with(F.slice("vector", 1, width), F.slice(signs, 1, F.size("vector")), lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
        out = out + F.when(side > 0, 1 << k).otherwise(0)
    return out


KINDS = (np.int8, np.int16, np.int32, np.int64)


def _close(matrix: np.ndarray) -> bytes:
    """A matrix in the narrowest integers, after a byte that names them."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    kind = next(k for k, t in enumerate(KINDS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([kind]) + matrix.astype(KINDS[kind]).tobytes()


def _matrix(rows: list[list[int]]) -> np.ndarray:
    width = max(map(len, rows), default=0)
    return np.array([r + [0] * (width - len(r)) for r in rows], dtype=np.int64).reshape(len(rows), width)


def _open(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=KINDS[data[0]], offset=1).reshape(n, -1).astype(np.int64) if n else np.zeros((0, 0), dtype=np.int64)


def _bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """By query and block, a score that no vector of the block exceeds; vectors end in zeros up to the width of both."""
    width = max(queries.shape[1], top.shape[1])
    queries, top, low = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, top, low))
    exact = float(np.abs(queries).max(initial=0)) * float(max(np.abs(top).max(initial=0), np.abs(low).max(initial=0))) * max(width, 1) >= 2**53
    return _product(np.maximum(queries, 0), top.T, exact) + _product(np.minimum(queries, 0), low.T, exact)


PACKED = ["block_group", "n", "ids", "matrix", "n_queries", "query_ids", "query_matrix", "n_blocks", "top", "low"]


def groups(vectors: DataFrame, is_query: Column, n_vectors: int, group: int = GROUP) -> DataFrame:
    """Packed rows: a group's ids and vectors, those of them that are queries, and its blocks' bounds; queries also stay candidates."""
    parts = max(1, -(-n_vectors // group))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32

        def packed(rows: list[tuple], k: int) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[3], r[0]))
            own = [r for r in rows if r[2]]
            matrix = _matrix([r[1] for r in rows])
            cuts = range(0, len(rows), BLOCK)
            top, low = (np.array([f(matrix[c : c + BLOCK]) for c in cuts], dtype=np.int64) for f in (lambda m: m.max(axis=0), lambda m: m.min(axis=0)))
            ids_of = lambda rs: np.array([r[0] for r in rs], dtype=np.int64).tobytes()
            cells = [key + k, len(rows), ids_of(rows), _close(matrix), len(own), ids_of(own), _close(_matrix([r[1] for r in own])), len(cuts), _close(top), _close(low)]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=PACKED)

        rows, k = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "vector", "query", "code")), strict=True):
                rows.append(row)
                if len(rows) == group:
                    yield packed(rows, k)
                    rows, k = [], k + 1
        if rows:
            yield packed(rows, k)

    dealt = vectors.withColumns({"query": is_query, "code": _code()}).repartitionByRange(parts, "code", "id")
    return dealt.select("id", "vector", "query", "code").mapInArrow(pack, "block_group long, n int, ids binary, matrix binary, n_queries int, query_ids binary, query_matrix binary, n_blocks int, top binary, low binary")


def _product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    return a @ b if exact else (a.astype(float) @ b.astype(float)).astype(np.int64)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, floors: np.ndarray | None = None, block: int = BLOCK) -> list[list[tuple[int, int]]]:
    """Each query's (score, id) among the candidates, at most k, leaving out what scores below its floor."""
    width = max(queries.shape[1], matrix.shape[1], 1)
    queries, matrix = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, matrix))
    # whole numbers below 2**53 are exact in floating point, which is many times faster
    large = float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(width, 1) >= 2**53
    cuts = list(range(0, len(ids), block))
    top = np.array([matrix[c : c + block].max(axis=0) for c in cuts])
    low = np.array([matrix[c : c + block].min(axis=0) for c in cuts])
    bounds = _bounds(queries, top.reshape(-1, width), low.reshape(-1, width))
    forward = [matrix[c : c + block] if large else matrix[c : c + block].astype(float) for c in cuts]
    out = []
    for n, q in enumerate(queries if large else queries.astype(float)):
        floor = int(floors[n]) if floors is not None else None
        scores, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in np.argsort(-bounds[n], kind="stable"):
            if floor is not None and bounds[n, b] < floor:
                break  # no later block can hold a score as high
            own = ids[cuts[b] : cuts[b] + block]
            score = (forward[b] @ q).astype(np.int64)
            keep = own != query_ids[n]
            if floor is not None:
                keep &= score >= floor
            if not keep.any():
                continue
            scores, found = np.concatenate((scores, score[keep])), np.concatenate((found, own[keep]))
            order = np.lexsort((found, -scores))[:k]
            scores, found = scores[order], found[order]
            if len(scores) == k:
                floor = int(scores[-1]) if floor is None else max(floor, int(scores[-1]))
        out.append(list(zip(scores.tolist(), found.tolist(), strict=True)))
    return out


def _rows(query_ids: np.ndarray, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    flat = [(int(q), i, s) for q, own in zip(query_ids, found, strict=True) for s, i in own]
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], pa.int64()) for k in range(3)], names=["query_id", "id", "score"])


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, group: int = GROUP) -> DataFrame:
    """(query_id, rank, id, score): each query's k best rows; ``is_query`` is a condition on ``id``."""
    usable = quantised(vectors, id_col, vector_col, scale)
    packed = written(groups(usable, is_query, usable.count(), group), "blocks")
    QUERIES = "home long, n_queries int, query_ids binary, query_matrix binary, floors binary"

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, matrix = np.frombuffer(r["ids"], dtype=np.int64), _open(r["matrix"], r["n"])
                query_ids, queries = np.frombuffer(r["query_ids"], dtype=np.int64), _open(r["query_matrix"], r["n_queries"])
                if not len(query_ids):
                    continue
                found = best(query_ids, queries, ids, matrix, k)
                floors = np.array([own[-1][0] if len(own) == k else -(2**63) for own in found], dtype=np.int64)
                scores = np.concatenate([np.array(own, dtype=np.int64).reshape(-1, 2) for own in found])
                cells = [[r["block_group"]], [r["n_queries"]], [r["query_ids"]], [r["query_matrix"]], [floors.tobytes()], [np.array([len(own) for own in found], dtype=np.int64).tobytes()], [scores.tobytes()]]
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["home", "n_queries", "query_ids", "query_matrix", "floors", "counts", "scores"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts, scores = np.frombuffer(r["counts"], dtype=np.int64), np.frombuffer(r["scores"], dtype=np.int64).reshape(-1, 2).tolist()
                ends = np.cumsum(counts).tolist()
                yield _rows(np.frombuffer(r["query_ids"], dtype=np.int64), [[tuple(s) for s in scores[e - c : e]] for e, c in zip(ends, counts.tolist(), strict=True)])

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                queries, floors = _open(r["query_matrix"], r["n_queries"]), np.frombuffer(r["floors"], dtype=np.int64)
                good = np.flatnonzero(_bounds(queries, _open(r["top"], r["n_blocks"]), _open(r["low"], r["n_blocks"])).max(axis=1) >= floors)
                if len(good):
                    out.append((r["block_group"], len(good), np.frombuffer(r["query_ids"], dtype=np.int64)[good].tobytes(), _close(queries[good]), floors[good].tobytes()))
            if out:
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["block_group", "n_queries", "query_ids", "query_matrix", "floors"])

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                r = batch.slice(j, 1).to_pylist()[0]
                query_ids, floors = np.frombuffer(r["query_ids"], dtype=np.int64), np.frombuffer(r["floors"], dtype=np.int64)
                yield _rows(query_ids, best(query_ids, _open(r["query_matrix"], r["n_queries"]), np.frombuffer(r["ids"], dtype=np.int64), _open(r["matrix"], r["n"]), k, floors))

    started = written(packed.select("block_group", "n", "ids", "matrix", "n_queries", "query_ids", "query_matrix").repartition("block_group").mapInArrow(home, f"{QUERIES}, counts binary, scores binary"), "queries")
    targets = [r[0] for r in packed.select("block_group").collect()]  # one number for each group of thousands of rows
    parts = min(max(1, len(targets)), MOST_PARTS)
    others = F.array(*[F.lit(t).cast("long") for t in targets]) if len(targets) <= 512 else F.lit(targets)
    sent = started.drop("counts", "scores").withColumn("block_group", F.explode(others if targets else F.array().cast("array<long>"))).where("home <> block_group")
    met = sent.repartition(parts, "block_group").join(packed.select("block_group", "n_blocks", "top", "low").repartition(parts, "block_group").hint("shuffle_hash"), "block_group")
    passed = met.mapInArrow(let_through, "block_group long, n_queries int, query_ids binary, query_matrix binary, floors binary")
    pairs = passed.repartition(parts, "block_group").join(packed.select("block_group", "n", "ids", "matrix").repartition(parts, "block_group").hint("shuffle_hash"), "block_group")
    result = "query_id long, id long, score long"
    scored = started.mapInArrow(at_home, result).unionByName(pairs.mapInArrow(away, result))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
