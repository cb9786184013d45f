"""A stored trigram index: postings by trigram, document lengths by id, searches by phrase.

Documents are taken by the group, one after the other with a gap between them, so a
number tells document and position. A row is a trigram in a field of a group, with its
sorted positions as differences of few bytes; a row of the number ``HEAD`` tells the
group's documents and where they start. Rows lie in buckets by trigram, sorted by it,
so a search opens the buckets of its trigrams and skips what else is in them. A term's
occurrences are the positions at which trigrams that cover it stand at the right
distances. Tasks write the postings of their documents where they are, so no posting
is shuffled.

An upsert adds postings of the changed documents in a folder of its own and gives the
documents a new version; a delete takes documents out of the table of lengths. Either
way old postings have no document of their version any more and drop out of every
search; ``compact`` removes them. One version file publishes lengths and postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.retrieval import bm25_scores
from weftline.plans.lineage import Scratch
from weftline.sources.keyed import KeyedTable

_BITS = 21  # a code point; three of them are a trigram's number
#: Instead of a trigram: the row of a group's documents. Characters of a group, a longer document alone.
HEAD, GROUP = -1, 2_000_000


def grams_of(text: str) -> np.ndarray:
    """The number of the trigram at each position of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:] if len(points) > 2 else np.zeros(0, dtype=np.int64)


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def cover(term: str) -> list[tuple[int, int]]:
    """(trigram, offset) of trigrams that cover every character of a term."""
    grams = grams_of(term)
    return [(int(grams[k]), k) for k in sorted({*range(0, len(grams), 3), len(grams) - 1})]


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Ascending numbers, ``counts`` of them in each row, as differences of seven bits a byte."""
    steps, first = np.diff(values, prepend=0), (np.cumsum(counts) - counts)[counts > 0]
    steps[first] = values[first]
    size = 1 + sum((steps >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(ends[-1], dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        out[ends[more] + k] = steps[more] >> 7 * k & 127 | np.where(size[more] > k + 1, 128, 0)
    offsets = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows one after the other, and how many each row has; a null row has none."""
    rows = rows.fill_null(b"")
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    data = np.frombuffer(rows.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    last = np.flatnonzero(data < 128)
    begin = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    size, steps = last - begin + 1, np.zeros(len(last), dtype=np.int64)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        steps[more] |= (data[begin[more] + k].astype(np.int64) & 127) << 7 * k
    first = np.searchsorted(last, offsets - offsets[0])
    sums, counts = np.concatenate(([0], np.cumsum(steps))), np.diff(first)
    return sums[1:] - np.repeat(sums[first[:-1]], counts), counts


def _group_rows(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(grams, fields, packed positions, starts): the postings of a group of documents, whose texts are given by field."""
    parts, starts = [], []
    for field, own in enumerate(texts):
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        start = np.cumsum(size + 1) - size - 1
        starts.append(start.astype(np.int32))
        grams = grams_of("\n".join(own))
        inside = np.ones(len(grams) + 3, dtype=bool)
        for back in (0, 1, 2):  # trigrams that reach into the gap or over it
            at = start + size - back
            inside[at[(at >= 0) & (at < len(inside))]] = False
        at = np.flatnonzero(inside[: len(grams)])
        grams = grams[at]
        order = np.argsort(grams, kind="stable")  # positions stay in order within a trigram
        ranked = grams[order]
        first = np.flatnonzero(np.diff(ranked, prepend=HEAD))
        parts.append((ranked[first], np.full(len(first), field, dtype=np.int32), packed(at[order], np.diff(np.append(first, len(grams))))))
    grams, fields = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return grams, fields, pa.concat_arrays([p[2] for p in parts]), np.concatenate(starts)


class TrigramIndex:
    """The index of ``fields`` of documents below a folder."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...], id_col: str = "doc_id", buckets: int = 64, most_segments: int = 4):
        self.spark, self.folder, self.fields, self.id_col, self.buckets, self.most_segments = spark, folder.rstrip("/"), fields, id_col, buckets, most_segments
        self.lengths = KeyedTable(spark, f"{self.folder}/lengths", (id_col,))

    # changes

    def _fields(self, id_field: T.StructField) -> list[T.StructField]:
        ids, starts = T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("starts", T.ArrayType(T.IntegerType()))
        return [T.StructField("gram", T.LongType()), T.StructField("field", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("positions", T.BinaryType()), ids, starts]

    def _postings(self, docs: DataFrame) -> DataFrame:
        """(bucket, gram, field, docs, positions, ids, starts): rows of trigrams of groups of documents, and of the groups themselves."""
        n_fields, buckets = len(self.fields), self.buckets
        schema = T.StructType([T.StructField("bucket", T.IntegerType()), *self._fields(docs.schema[self.id_col])])

        def group(number: int, ids: pa.Array, texts: list[list[str]]) -> pa.RecordBatch:
            grams, fields, positions, starts = _group_rows(texts)
            own = bucket_of(grams, buckets)
            met = np.unique(own)
            n, m = len(met), len(grams)
            ends = lambda size: pa.array(np.concatenate((np.arange(n + 1), np.full(m, n))) * size, pa.int32())
            lists = lambda values: pa.ListArray.from_arrays(ends(len(values)), pa.concat_arrays([values] * n) if n else values[:0])
            columns = [
                np.concatenate((met, own)), np.concatenate((np.full(n, HEAD), grams)), np.concatenate((np.full(n, HEAD, dtype=np.int32), fields)), np.full(n + m, number),
                pa.concat_arrays([pa.array([b""] * n, pa.binary()), positions]), lists(ids), lists(pa.array(starts)),
            ]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [[] for _ in range(n_fields)], 0
            for batch in batches:
                for row, own in enumerate(zip(*(batch.column(f + 1).to_pylist() for f in range(n_fields)), strict=True)):
                    for field, text in zip(texts, own, strict=True):
                        field.append(text)
                        size += len(text)
                    ids.append(batch.column(0).slice(row, 1))
                    if size >= GROUP:
                        yield group(number, pa.concat_arrays(ids), texts)
                        number, ids, texts, size = number + 1, [], [[] for _ in range(n_fields)], 0
            if ids:
                yield group(number, pa.concat_arrays(ids), texts)

        low = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"_f{k}") for k, c in enumerate(self.fields)]
        return docs.select(self.id_col, *low).mapInArrow(run, schema)

    def _write(self, rows: DataFrame, segment: int) -> list[int]:
        into = f"{self.folder}/postings/segment={segment}"
        # each task's own rows in order; the rows of groups are the first of a file
        dealt = rows.sortWithinPartitions("bucket", "gram", "version", "docs", "field")
        dealt.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#positions", "false").partitionBy("bucket").parquet(into)
        return [int(n.split("=")[1]) for n in self.lengths.files.names(into) if n.startswith("bucket=")]

    def _sizes(self, docs: DataFrame, segment: int) -> DataFrame:
        size = lambda c: F.greatest(F.length(F.lower(F.coalesce(F.col(c), F.lit("")))) - 2, F.lit(0)).cast("long")
        return docs.select(self.id_col, F.lit(segment).alias("version"), *[size(c).alias(f"size_{k}") for k, c in enumerate(self.fields)])

    def _publish(self, after: dict, segments: dict) -> None:
        sums = self.lengths.read(after).agg(F.count("*").alias("n"), *[F.sum(f"size_{k}").alias(f"size_{k}") for k in range(len(self.fields))]).first().asDict()
        after["notes"] = {"segments": segments, "sums": {k: v or 0 for k, v in sums.items()}}
        self.lengths.publish(after)

    def upsert(self, docs: DataFrame) -> list[int]:
        """Documents, each id once, that go in or replace those of the same id; the buckets of postings written."""
        before = self.lengths.version()
        segment = before["number"] + 1
        written = self._write(self._postings(docs).withColumn("version", F.lit(segment)), segment)
        segments = {b: list(s) for b, s in before["notes"].get("segments", {}).items()}
        for b in map(str, written):
            segments[b] = [*segments.get(b, []), segment]
        self._publish(self.lengths.staged(self._sizes(docs, segment), before), segments)
        return written

    def delete(self, gone: DataFrame) -> list[int]:
        """Take out the ids of ``gone``; the buckets of lengths written, postings stay as they are."""
        before = self.lengths.version()
        after = self.lengths.staged(self.lengths.markers(gone), before)
        touched = [int(b) for b, v in after["buckets"].items() if v[-1] == after["number"]]
        if touched:
            self._publish(after, before["notes"]["segments"])
        return touched

    def compact(self, most_segments: int | None = None) -> list[int]:
        """Write buckets with more segments than that anew, without the postings that no document has; the buckets."""
        most, before = self.most_segments if most_segments is None else most_segments, self.lengths.version()
        segments = before["notes"]["segments"]
        due = [b for b, s in segments.items() if len(s) > most]
        if due:
            live = self._live({b: segments[b] for b in due}, before)
            segment = before["number"] + 1
            written = self._write(live, segment)
            left = {b: s for b, s in segments.items() if b not in due} | {str(b): [segment] for b in written}
            self._publish(before | {"number": segment}, left)
        return [int(b) for b in due]

    def _live(self, segments: dict[str, list[int]], version: dict) -> DataFrame:
        """The postings of documents that are in a version.

        The number of each live document in its group is sent to all tasks, with the
        rows of groups alone, which come before their postings; a part of a file that
        begins after them keeps its postings as they are.
        """
        rows = self._read(segments)
        heads = rows.where(F.col("gram") == HEAD).groupBy("version", "docs").agg(F.first("ids").alias("ids"))
        own = heads.select("version", "docs", F.posexplode("ids").alias("n", self.id_col))
        known = own.join(self.lengths.read(version).select(self.id_col, "version"), [self.id_col, "version"], "left_semi")
        numbers = known.groupBy("version", "docs").agg(F.collect_list("n").alias("live")).withColumn("gram", F.lit(HEAD).cast("long"))
        columns, n_fields = rows.columns, len(self.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[tuple[int, int], int] = {}  # the place of a group's first field among those of all groups; less than 0 where nothing lives
            starts, alive, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)], 0
            for batch in batches:
                at = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
                keys = list(zip(at["version"].to_pylist(), at["docs"].to_pylist(), strict=True))
                head, field = at["gram"].to_numpy() == HEAD, at["field"].to_numpy()
                for row in np.flatnonzero(head):
                    if keys[row] in met:
                        continue
                    met[keys[row]] = -n_fields - 1
                    if (live := at["live"][row].values) is not None:
                        good = np.zeros(len(at["ids"][row].values), dtype=bool)
                        good[live.to_numpy()] = True
                        met[keys[row]] = places
                        own = at["starts"][row].values.to_numpy().reshape(n_fields, -1)
                        starts.append((own | np.arange(places, places + n_fields)[:, None] << 32).ravel())
                        alive.append(np.tile(good, n_fields))
                        places += n_fields
                if len(starts) > 1:
                    starts, alive = [np.concatenate(starts)], [np.concatenate(alive)]
                unknown = 1 << 30
                place = np.fromiter((met.get(k, unknown) for k in keys), dtype=np.int64, count=len(keys)) + field
                values, counts = unpacked(at["positions"])
                asked = np.repeat(place, counts)
                keep = asked >= unknown - 1
                ours = np.flatnonzero((asked >= 0) & ~keep)
                keep[ours] = alive[0][np.searchsorted(starts[0], asked[ours] << 32 | values[ours], side="right") - 1]
                left = np.bincount(np.repeat(np.arange(len(keys)), counts)[keep], minlength=len(keys))
                at["positions"] = packed(values[keep], left)
                yield pa.RecordBatch.from_arrays([at[c] for c in columns], names=columns).filter(pa.array((left > 0) | (head & (place >= HEAD))))

        return rows.join(F.broadcast(numbers), ["version", "docs", "gram"], "left").select(*columns, "live").mapInArrow(run, rows.schema)

    # searches

    def _read(self, segments: dict[str, list[int]]) -> DataFrame:
        schema = T.StructType([*self._fields(self._id_field()), T.StructField("version", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.folder}/postings/segment={s}/bucket={b}" for b, found in segments.items() for s in found]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("segment")
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/postings").parquet(*paths).drop("segment")

    def _id_field(self) -> T.StructField:
        return self.lengths.read().schema[self.id_col]

    def occurrences(self, terms: list[str], fields: list[str] | None = None) -> DataFrame:
        """(id, version, field, term, n): how often each term, by its place in ``terms``, stands in a field; stale postings too."""
        covers = [cover(t) for t in terms]
        grams = sorted({g for c in covers for g, _ in c})
        asked = [self.fields.index(f) for f in fields or self.fields]
        notes = self.lengths.version()["notes"]
        met = {str(b) for b in bucket_of(np.array(grams, dtype=np.int64), self.buckets)}
        rows = self._read({b: s for b, s in notes["segments"].items() if b in met}).where(F.col("gram").isin([HEAD, *grams]) & F.col("field").isin([HEAD, *asked]))
        schema = T.StructType([self._id_field(), T.StructField("version", T.IntegerType()), *(T.StructField(c, T.IntegerType()) for c in ("field", "term", "n"))])

        def run(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            gram, field = group["gram"].to_numpy(), group["field"].to_numpy()
            head = int(np.flatnonzero(gram == HEAD)[0])
            ids, starts = group["ids"][head].values, group["starts"][head].values.to_numpy()
            values, counts = unpacked(pa.concat_arrays(group["positions"].chunks))
            ends = np.cumsum(counts)
            places = {(int(g), int(f)): values[e - c : e] for g, f, c, e in zip(gram, field, counts, ends, strict=True)}
            out = [(np.zeros(0, dtype=np.int64), 0, 0, np.zeros(0, dtype=np.int64))]
            for f in asked:
                for term, wanted in enumerate(covers):
                    if all((g, f) in places for g, _ in wanted):
                        common = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), [places[g, f] - offset for g, offset in wanted])
                        found = np.searchsorted(starts[f * len(ids) : (f + 1) * len(ids)], common, side="right") - 1
                        own, n = np.unique(found, return_counts=True)
                        out.append((own, f, term, n))
            each = lambda k: pa.array(np.repeat([o[k] for o in out], [len(o[0]) for o in out]), pa.int32())
            own = np.concatenate([o[0] for o in out])
            version = pa.array(np.full(len(own), group["version"][0].as_py()), pa.int32())
            return pa.table([ids.take(pa.array(own)), version, each(1), each(2), pa.array(np.concatenate([o[3] for o in out]), pa.int32())], names=schema.names)

        return rows.select("gram", "field", "docs", "positions", "ids", "starts", "version").groupBy("version", "docs").applyInArrow(run, schema)

    def search(self, terms: list[str], weights: dict[str, float] | None = None, every: bool = False) -> DataFrame:
        """(id, score, matched_all) of the documents that hold a term, by BM25, as ``retrieval.bm25`` scores them."""
        weights = weights or {f: 1.0 for f in self.fields}
        usable = [t.lower() for t in dict.fromkeys(terms) if len(t) >= 3]
        schema = T.StructType([self._id_field(), T.StructField("score", T.DoubleType()), T.StructField("matched_all", T.BooleanType())])
        if not usable:
            return self.spark.createDataFrame([], schema)
        sums = self.lengths.version()["notes"]["sums"]
        weight = reduce(lambda out, f: out.when(F.col("field") == self.fields.index(f), float(weights[f])), weights, F.when(F.lit(False), 0.0))
        tf = {f"_tf{k}": F.coalesce(F.sum(F.when(F.col("term") == k, weight * F.col("n"))), F.lit(0.0)) for k in range(len(usable))}
        found = self.occurrences(usable, list(weights)).groupBy(self.id_col, "version").agg(*[c.alias(name) for name, c in tf.items()])
        size = reduce(lambda a, b: a + b, [F.col(f"size_{self.fields.index(f)}") for f in weights])
        counted = found.join(self.lengths.read().withColumn("_size", size).select(self.id_col, "version", "_size"), [self.id_col, "version"])
        # the matches are read twice, for their number and for their scores
        counted = Scratch(self.spark, "search").written(counted, "matches")
        n = sums["n"]
        mean = sum(sums[f"size_{self.fields.index(f)}"] for f in weights) / n if n else 0.0
        stats = counted.agg(F.lit(n).alias("_n"), F.lit(float(mean)).alias("_mean"), *[F.count_if(F.col(c) > 0).alias(f"_df{k}") for k, c in enumerate(tf)])
        return bm25_scores(counted, stats, list(tf), len(usable) == len(dict.fromkeys(terms)), every).select(self.id_col, "score", "matched_all")
