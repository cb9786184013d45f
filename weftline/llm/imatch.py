"""I-Match fingerprints over randomised lexicons.

Terms are lower-cased word runs. The document frequency of each, by its 64-bit hash,
is counted over all documents; the lexicon is the terms with inverse document
frequencies between two bounds. A fingerprint holds
one signature for each randomised subset of the lexicon: the hash of the sorted,
distinct terms that the subset keeps. Subsets keep from all terms down to one in
1024, so that texts of any length have subsets in which few terms decide.

Defined cases: a null text is the empty text; a text without terms in the band is
fingerprinted by all its terms, one without terms by itself; equal texts have equal
fingerprints, whatever their other columns; with one row only, the next document is
the row itself; rows with a null id come last; repeated ids follow one another in
the order of their texts; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe import Remembered
from weftline.llm.common import texts

#: Least documents and most document share of a term in the band.
LEAST_DOCS, MOST_SHARE = 2, 0.1
#: Terms that a counting task holds, and rows of a batch that it sends.
MOST_TERMS, CHUNK = 1 << 20, 1 << 16
#: Each subset keeps one term in so many; several subsets have the same rate.
KEEPS = [rate for rate, subsets in ((1, 1), (2, 1), (4, 1), (8, 2), (16, 4), (32, 6), (64, 8), (128, 10), (256, 8), (512, 5), (1024, 5)) for _ in range(subsets)]
WORD = re.compile(r"\w+")


@lru_cache(maxsize=1)
def term_hashes() -> Remembered:
    import xxhash

    return Remembered(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


def distinct_terms(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's terms."""
    found = set(WORD.findall(text.lower()))
    out = np.fromiter(map(term_hashes().__getitem__, found), dtype=np.uint64, count=len(found))
    out.sort()
    return out


def _slots(terms: np.ndarray) -> np.ndarray:
    """The terms as Spark's signed 64-bit numbers."""
    return terms.view(np.int64)


class Frequencies:
    """Document frequencies by term; the counts stay in Spark, and asking for one is a query."""

    def __init__(self, counts: DataFrame):
        self.counts = counts

    def __getitem__(self, term: int) -> int:
        found = self.counts.where(F.col("term") == term).first()
        return found["n"] if found else 0


def document_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, Frequencies]:
    """Number of documents, and of documents with each term; every document and every term counts.

    Tasks add up terms before the shuffle and send what they have whenever that is
    ``MOST_TERMS`` terms, so a task's memory doesn't grow with the vocabulary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n, waiting, size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([terms, *waiting])
            weights = np.concatenate([n, np.ones(len(every) - len(n), dtype=np.int64)])
            order = np.argsort(every)
            every, weights = every[order], weights[order]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            return every[first], np.add.reduceat(weights, first)

        def sent() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(terms), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(_slots(terms[k : k + CHUNK])), pa.array(n[k : k + CHUNK])], names=["term", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                waiting.append(distinct_terms(t))
                size += len(waiting[-1])
                if size > MOST_TERMS:
                    terms, n = added()
                    waiting, size = [], 0
                    if len(terms) > MOST_TERMS:
                        yield from sent()
                        terms, n = terms[:0], n[:0]
        if size:
            terms, n = added()
        yield from sent()

    rows = texts(docs, id_col, text_col)
    parts = rows.select(text_col).mapInArrow(count, "term long, n long")
    return rows.count(), Frequencies(parts.groupBy("term").agg(F.sum("n").alias("n")))


def lexicon(n_docs: int, frequencies: Frequencies, least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE) -> np.ndarray:
    """Sorted terms whose document frequency, and so its inverse, lies in the band: 8 bytes a term on the driver."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([terms.tobytes()], pa.binary())], names=["terms"])

    band = frequencies.counts.where(F.col("n").between(least_docs, math.floor(most_share * n_docs + 1e-9))).select("term")
    found = [np.frombuffer(r[0], dtype=np.uint64) for r in band.mapInArrow(packed, "terms binary").collect()]
    return np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *found]))


class Fingerprints:
    """Fingerprints of texts under one lexicon."""

    def __init__(self, band: np.ndarray):
        self.band = band
        rng = np.random.default_rng(7)
        self.factors = (rng.integers(1, 2**63, len(KEEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.limits = np.array([2**32 // k for k in KEEPS], dtype=np.uint64)[:, None]

    def of(self, text: str) -> str:
        terms = distinct_terms(text)
        inside = terms
        if len(terms) and len(self.band):
            inside = terms[self.band[np.minimum(np.searchsorted(self.band, terms), len(self.band) - 1)] == terms]
        if len(inside):
            terms = inside
        if not len(terms):
            return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:8] + "0" * 8 * (len(KEEPS) - 1)
        kept = ((terms[None, :] * self.factors) >> np.uint64(32)) < self.limits
        import xxhash

        return "".join(xxhash.xxh3_64_hexdigest(terms[k].tobytes())[:8] if k.any() else "00000000" for k in kept)


def likeness(a: str, b: str) -> float:
    """Share of equal signatures among the subsets that keep a term of either text."""
    pairs = [(a[k : k + 8], b[k : k + 8]) for k in range(0, len(a), 8)]
    live = [x == y for x, y in pairs if x != "00000000" or y != "00000000"]
    return sum(live) / len(live) if live else float(a == b)


def fingerprint(docs: DataFrame, band: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each document under a lexicon; no shuffle."""

    sent = docs.sparkSession.sparkContext.broadcast(band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprints(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.of(t) for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "fingerprint"])

    schema = T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.StringType())])
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


LOW = -(2**63)


def _ranges(keys: DataFrame, n: int) -> tuple[list[int], dict[int, int]]:
    """Upper ends of ``n`` ranges of ids, and the largest id of each range that has rows.

    What reaches the driver is two numbers for each range, and a range has
    thousands of rows.
    """
    wanted = [k / n for k in range(1, n)]
    found = keys.agg(F.percentile_approx("key", wanted, 10_000)).first()[0] or []
    splits = sorted(set(found))
    return splits, _tops(keys, splits)


def _tops(keys: DataFrame, splits: list[int]) -> dict[int, int]:
    ends = np.array(splits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = np.full(len(ends) + 1, LOW, dtype=np.int64)
        seen = np.zeros(len(ends) + 1, dtype=bool)
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(ends, key)
            np.maximum.at(tops, at, key)
            seen[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(tops[seen])], names=["range", "top"])

    return {r[0]: r[1] for r in keys.mapInArrow(run, "range long, top long").groupBy("range").agg(F.max("top")).collect()}


def with_next(docs: DataFrame, make, schema: T.StructType, n_docs: int, rows_per_range: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``make(previous rows' state)`` over documents in descending id order, each with the one after it.

    ``make()`` is called once a task and returns a function of (id, text, next
    text) that returns a row. Texts cross one shuffle, compressed, to ranges of
    ids; the first rows of a range also go to the range before it, where the last
    row needs them.
    """
    n = max(4 * docs.rdd.getNumPartitions(), -(-n_docs // rows_per_range))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("key")
    keys = docs.select(key)
    splits, tops = _ranges(keys, n)
    full = sorted(tops)
    before = {r: full[(k + 1) % len(full)] for k, r in enumerate(full)}  # the range whose last row is followed by this one's first
    ends = np.array(splits, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            at = np.searchsorted(ends, batch.column(1).to_numpy(zero_copy_only=False))
            for doc, k, r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at.tolist(), batch.column(2).to_pylist(), strict=True):
                z = press(text.encode("utf-8", "surrogatepass"))
                for where, tail in [(r, False), *([(before[r], True)] if tops[r] == k else [])]:
                    for column, value in zip(out, (where, tail, k, doc, z), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), batch.schema.field(0).type, pa.binary()), strict=True)], names=["range", "tail", "key", id_col, "z"])

    dealt_schema = T.StructType([T.StructField("range", T.LongType()), T.StructField("tail", T.BooleanType()), T.StructField("key", T.LongType()), docs.schema[id_col], T.StructField("z", T.BinaryType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, last, place = make(), None, None
        open_text = lambda z: zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")
        for batch in batches:
            out = []
            for r, tail, doc, z in zip(*(batch.column(c).to_pylist() for c in ("range", "tail", id_col, "z")), strict=True):
                if r != place:
                    place, last = r, None
                elif tail and last is None:
                    continue
                text = open_text(z)
                if last is not None:
                    out.append(own(*last, text))
                last = None if tail else (doc, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
            # a range's rows end with the tail, so no row is left waiting

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    source = docs.select(F.col(id_col), key, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    dealt = source.mapInArrow(deal, dealt_schema).repartition("range")
    return dealt.sortWithinPartitions("range", "tail", F.col("key").desc(), "z").mapInArrow(walk, schema)
