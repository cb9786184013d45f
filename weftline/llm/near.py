"""Similarity join on word n-grams by MinHash banding, verified on full n-gram sets.

Texts are lower-cased and split at white space; their n-grams are sets of 64-bit
hashes. Texts with equal sets are copies, and one row stands for all of them. The
bands' number and rows come from the wanted recall. Representatives meet where a
band's hash is equal, and every meeting pair is verified on the full sets.

No pair is emitted: the rows of a band bucket are compared inside one task, which
returns for each row the number of its verified partners and one link to its
cluster. A pair that meets in several buckets counts in the first. Buckets whose
members equal those of an earlier bucket are dropped, and a bucket too large for one
task is split into blocks, each pair of which is a task's work of its own.

Defined cases: a null or empty text has no n-gram and is linked to nothing, each
such row a class of its own; a text shorter than n words has one n-gram, its words;
rows that repeat are copies of one another; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe import Remembered
from weftline.llm.common import Scratch, free_name, left_join_hot, texts, written

#: n-gram length, least similarity, recall of a pair just as similar as that, most band hashes of a text.
N, SIMILAR, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 128
#: Words whose hashes a worker remembers, in each of two generations.
KNOWN_WORDS = 200_000
#: n-gram hashes that one block of a bucket should hold (8 bytes each), and rows of it.
BLOCK_GRAMS, BLOCK_ROWS = 1 << 20, 1024


def bands_for(similarity: float = SIMILAR, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false meetings, at which ``recall`` holds with ``most`` hashes.

    Where no number of rows has the recall within ``most`` hashes, as many bands of
    one row are taken as it needs.
    """
    if not (0 < similarity <= 1 and 0 < recall < 1):
        raise ValueError("similarity lies above 0, recall between 0 and 1")
    best = (math.ceil(math.log(1 - recall) / math.log1p(-similarity)) if similarity < 1 else 1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity**rows < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


@lru_cache(maxsize=1)
def _word_hashes() -> Remembered:
    import xxhash

    return Remembered(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), KNOWN_WORDS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    length = min(n, len(h))
    out = np.full(len(h) - length + 1, length, dtype=np.uint64)
    for k in range(length):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - length + 1 + k])
    return np.unique(out)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, set_hash, n_grams, bands array<long>); the last three null where a text has no n-gram."""
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 2**62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = [ngrams(t, n) for t in part.column(1).to_pylist()]
                live = [s for s in sets if len(s)]
                if live:
                    flat = np.concatenate(live)
                    starts = np.cumsum([0, *map(len, live[:-1])])
                    lows = np.empty((len(live), bands * rows), dtype=np.uint64)
                    for j, f in enumerate(factors):
                        product = flat * f
                        product ^= product >> np.uint64(32)
                        lows[:, j] = np.minimum.reduceat(product, starts)
                    mixed = np.zeros((len(live), bands), dtype=np.uint64)
                    for j in range(rows):
                        mixed = _mix(mixed * np.uint64(31) + lows[:, j::rows][:, :bands])
                found = iter(mixed.view(np.int64).tolist() if live else [])
                out = [[xxhash.xxh3_128_digest(s.tobytes()), len(s), next(found)] if len(s) else [None, None, None] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=[id_col, "_text_hash", "set_hash", "n_grams", "bands"])
        _word_hashes.cache_clear()  # workers go on to other operators

    schema = T.StructType([docs.schema[id_col], T.StructField("_text_hash", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("n_grams", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return texts(docs, id_col, text_col).withColumn("_text_hash", F.xxhash64(text_col)).mapInArrow(run, schema)


def _compare(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; a cell is a pair of blocks of one bucket, or one block with itself."""
    cell, rows = (None, None, None), []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high", "block", "band", "set_hash", "bands", "grams")), strict=True):
            if row[:3] != cell:
                out += _verified(rows, similarity, two=cell[1] != cell[2])
                cell, rows = row[:3], []
            rows.append(row[3:])
        if out:
            yield _links(out)
    if rows and (out := _verified(rows, similarity, two=cell[1] != cell[2])):
        yield _links(out)


def _links(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64())], names=["set_hash", "root", "n_links"])


def _verified(rows: list[tuple], similarity: float, two: bool) -> list[tuple]:
    """(set_hash, root, number of partners) of each row with a verified partner, over the pairs that this cell answers for: with ``two`` those across its two blocks."""
    if len(rows) < 2:
        return []
    rows.sort(key=lambda r: (r[0], r[2]))
    block = np.array([r[0] for r in rows])
    if two and block[0] == block[-1]:
        return []  # the other block is empty, and the pairs inside this one are its own cell's
    band = rows[0][1]
    keys = np.array([r[3] for r in rows], dtype=np.int64)
    sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")  # postings: owners ascending within an n-gram
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    length = np.diff(np.concatenate((first, [len(flat)])))
    shared = length > 1
    column = np.repeat(np.arange(len(first)), length)
    live = shared[column]
    by_row = np.argsort(owner[live], kind="stable")
    row_columns = column[live][by_row]
    row_ends = np.searchsorted(owner[live][by_row], np.arange(len(sets) + 1))
    parent, partners = list(range(len(rows))), np.zeros(len(rows), dtype=np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows) - 1):
        mine = row_columns[row_ends[i] : row_ends[i + 1]]
        if not len(mine):
            continue
        counts = length[mine]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(first[mine], counts)
        common = np.bincount(owner[at], minlength=len(rows))
        alike = common >= similarity * (sizes[i] + sizes - common) - 1e-9
        alike[: i + 1] = False
        if two:  # pairs inside a block are its own cell's
            alike &= block != block[i]
        js = np.flatnonzero(alike)
        if len(js):
            js = js[(keys[js] == keys[i]).argmax(axis=1) == band]  # the first band in which the two meet
        partners[i] += len(js)
        partners[js] += 1
        for j in js.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(rows[k][2], rows[root(k)][2], int(partners[k])) for k in range(len(rows)) if partners[k]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars.

    Each round is a few shuffles of the edges, written to the shared folder; the
    driver sees one number a round.
    """
    tables = Scratch(edges.sparkSession, "components")
    edges = tables.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges-0")
    before, n = None, 0
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: larger neighbours link to the least node of the neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.written(large, "large")
        # small star: smaller neighbours and the node itself link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m").unionAll(low.select(F.col("u").alias("x"), "m"))
        edges, n = tables.written(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), f"edges-{n + 1}"), n + 1
        tables.drop(f"edges-{n - 1}", "large")
        mark = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first()
        if tuple(mark) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(mark)


def near_classes(docs: DataFrame, n: int = N, similarity: float = SIMILAR, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (the least id of its class), n_links (distinct other texts at least so similar), n_copies (rows with its n-gram set).

    Every row has a class; a text like no other is a class of itself.
    """
    n_bands, n_rows = bands_for(similarity, recall)
    docs = docs.select(id_col, text_col)
    signed = written(signatures(docs, n, n_bands, n_rows, id_col, text_col), "signatures")
    full = signed.where("set_hash is not null")
    unique = full.groupBy("set_hash").agg(F.min(id_col).alias("least_id"), F.min(F.struct(F.col(id_col).alias("from_id"), "_text_hash")).alias("from"), F.min(F.struct("n_grams", "bands")).alias("s"), F.count(F.lit(1)).alias("n_copies"))
    unique = unique.select("set_hash", "least_id", "n_copies", "from.from_id", F.col("from._text_hash").alias("from_text"), "s.n_grams", "s.bands")

    spread = unique.select("set_hash", "n_grams", F.posexplode("bands").alias("band", "hash"))
    tag = F.xxhash64("set_hash")
    buckets = spread.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("n_grams").cast("long")).alias("grams"), F.sum(tag % 4_611_686_018_427).alias("sum"), F.bit_xor(tag).alias("xor"), F.min("set_hash").alias("one")).where("members > 1")
    # of buckets with the same members, the earliest
    buckets = buckets.groupBy("members", "grams", "sum", "xor", "one").agg(F.min(F.struct("band", "hash")).alias("k")).select("k.band", "k.hash", "members", "grams")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    buckets = buckets.select("band", "hash", blocks.alias("blocks"))
    meets = written(spread.join(buckets, ["band", "hash"]).select("band", "hash", "blocks", "set_hash"), "meets")

    # the n-grams of one copy of each text that meets another, from a second reading of the texts
    wanted = meets.select("set_hash").distinct().join(unique.select("set_hash", "from_id", "from_text", "bands"), "set_hash")
    grams = _grams_of(docs, wanted, n, id_col, text_col)
    rows = meets.join(grams, "set_hash").withColumn("block", F.pmod(F.xxhash64("set_hash", "hash"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        F.xxhash64("band", "hash").alias("bucket"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "band", "set_hash", "bands", "grams"
    )
    dealt = cells.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    links = written(dealt.mapInArrow(lambda batches: _compare(batches, similarity), "set_hash binary, root binary, n_links long"), "links")

    counts = links.groupBy("set_hash").agg(F.sum("n_links").alias("n_links"))
    found = components(links.select(F.col("set_hash").alias("a"), F.col("root").alias("b")))
    texts_ = unique.select("set_hash", "least_id", "n_copies").join(counts, "set_hash", "left").join(found.withColumnRenamed("node", "set_hash"), "set_hash", "left")
    texts_ = texts_.withColumn("root", F.coalesce("root", "set_hash"))
    # a class may hold a third of all texts: its row is broadcast, as there are few such classes
    texts_ = written(texts_, "rooted")
    classes = texts_.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    classes = written(classes, "classes")
    texts_ = left_join_hot(texts_, classes, "root", "members", "set_hash").select("set_hash", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    # likewise a text may be a third of all rows
    texts_ = written(texts_.withColumn("_rows", F.col("n_copies")), "texts")
    return left_join_hot(signed.select(id_col, "set_hash"), texts_, "set_hash", "_rows", id_col).select(id_col, F.coalesce("class_id", F.col(id_col)).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def _grams_of(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(set_hash, bands, grams) of the wanted sets, each from one row that has it.

    Texts cross the join compressed. Rows join on their id and their text's hash
    together, so an id that many texts share, or none has, brings each text once.
    """

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([shrink(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())], names=["from_id", "from_text", "z"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [ngrams(zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass"), n).tobytes() for z in part.column("z").to_pylist()]
                holds = pa.array([xxhash.xxh3_128_digest(s) == key for s, key in zip(sets, part.column("set_hash").to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([part.column("set_hash"), part.column("bands"), pa.array(sets, pa.binary())], names=["set_hash", "bands", "grams"])
                yield out.filter(holds)
        _word_hashes.cache_clear()

    id_type = docs.schema[id_col].dataType
    small = texts(docs, id_col, text_col).withColumn("_text_hash", F.xxhash64(text_col)).mapInArrow(press, T.StructType([T.StructField("from_id", id_type), T.StructField("from_text", T.LongType()), T.StructField("z", T.BinaryType())]))
    joined = small.join(wanted, small["from_id"].eqNullSafe(wanted["from_id"]) & (small["from_text"] == wanted["from_text"])).select("set_hash", "bands", "z")
    # rows that repeat id and text bring a set again; within a task all but one go before the shuffle
    return joined.mapInArrow(expand, "set_hash binary, bands array<long>, grams binary").dropDuplicates(["set_hash"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that with the least id; all columns stay.

    Of rows that repeat both id and text one stays. Rows with a null id stand for
    their class only where no row of it has an id, and then all stay.
    """
    classes = near_classes(docs, id_col=id_col, text_col=text_col, **options)
    kept_id, copy = free_name(docs, "_kept"), free_name(docs, "_copy")
    kept = classes.where(F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias(kept_id)).distinct()
    rows = docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    same = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(text_col)
    return rows.withColumn(copy, F.row_number().over(same)).where(F.col(id_col).isNull() | (F.col(copy) == 1)).select(docs.columns)
