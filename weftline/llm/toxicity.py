"""Toxicity by weak supervision.

Voters look at a text: one for each term of a lexicon, which is learned from a
labelled sample as words and word beginnings far commoner in toxic texts, and a few
pattern voters. A generative label model estimates, by expectation maximisation from
the votes, how often each voter fires in either class and, in each round from the
correlations of voters within both classes, how much of each vote is its own evidence. A linear classifier (logistic regression) on the voters' outputs is then
fitted to the model's posterior labels, and scores every whole text.

Human labels pick the lexicon and are, on the labelled sample, one more voter whose
error rates the model estimates: where they are wrong, other votes outweigh them.
Without that vote, posterior labels were worse on every lexicon tried (of sf0.1, 40
to 150 clean texts in 2661 wrong, or 30 to 60 toxic ones in 329), so it stays.
The sample of labelled rows is bounded by ``most_rows``; which terms become voters
follows from their support, the same three rows whatever the sample's size, and their
ratio. The driver holds the sample's votes as lists of those that fire, never a matrix
of rows by voters or of voters by voters.
Scoring reads all documents and needs no shuffle. A score never sees labels,
language, source or id.

Defined cases: a null text is the empty text, which scores as a text without any
vote; labels that are null or of unknown documents are ignored, repeated labels of
a document count as the largest, and of rows that repeat an id the first by text is
learned from; without usable labels every score is 0; a row that repeats gives a row
that repeats; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import texts, written

#: Labelled rows that are learned from at most, lengths of word beginnings.
MOST_ROWS, STEMS = 20_000, (4, 5, 6)
#: Toxic rows in which a term must occur, and how many times commoner it must be in toxic rows.
LEAST_ROWS, LEAST_RATIO = 3, 4.0
WORD = re.compile(r"\w+")
# Pattern voters.
PATTERNS = (r"!{2,}", r"\b[A-Z]{4,}\b", r"(?i)\byou(?:'re| are)? (?:an?|such|all)\b", r"[@#$%&*]{3,}", r"(?i)\b(?:shut up|hate you|go away)\b")
_PATTERNS = [re.compile(p) for p in PATTERNS]


def terms_of(text: str) -> Counter:
    """Counts of lower-cased words and, marked by a leading ^, of longer words' beginnings."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for w, k in words.items():
        for n in STEMS:
            if len(w) > n:
                out["^" + w[:n]] += k
    return out


@dataclass
class Voters:
    """The lexicon and pattern voters, and the fitted weights."""

    terms: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    posterior_share: float = 0.0

    def __post_init__(self) -> None:
        self.at = {t: k for k, t in enumerate(self.terms)}
        self.words = {t for t in self.terms if t[0] != "^"}
        self.stems = {n: {t[1:]: k for t, k in self.at.items() if t[0] == "^" and len(t) == n + 1} for n in STEMS}
        self.stems = {n: s for n, s in self.stems.items() if s}

    @property
    def width(self) -> int:
        return len(self.terms) + len(PATTERNS) + 4

    def votes(self, text: str) -> tuple[list[int], int, int]:
        """Indices of the voters that fire, occurrences of lexicon words, and words."""
        words = WORD.findall(text.lower())
        fired: set[int] = set()
        hits = 0
        distinct = set(words)
        marked = distinct & self.words
        fired.update(self.at[w] for w in marked)
        for n, stems in self.stems.items():
            for w in distinct:
                if len(w) > n and (k := stems.get(w[:n])) is not None:
                    fired.add(k)
                    marked.add(w)
        if marked:
            hits = sum(w in marked for w in words)
        fired.update(len(self.terms) + k for k, p in enumerate(_PATTERNS) if p.search(text))
        return sorted(fired), hits, len(words)

    def row(self, votes: tuple[list[int], int, int]) -> tuple[list[int], list[float]]:
        """Sparse features: the votes, whether and how often lexicon words occur, their share."""
        fired, hits, words = votes
        base = len(self.terms) + len(PATTERNS)
        return [*fired, base, base + 1, base + 2, base + 3], [*[1.0] * len(fired), 1.0, float(hits > 0), math.log1p(hits), min(1.0, 20.0 * hits / (words + 20.0))]

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        at, values = self.row(self.votes(text))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights[at], values))))))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of at most ``most_rows`` labelled documents, picked by a hash of their ids.

    The picked labels, at most ``most_rows`` pairs of numbers, are broadcast, so of
    the documents only the picked ones are shuffled, one for each id.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    return texts(docs, id_col, text_col).join(F.broadcast(picked), id_col).groupBy(id_col).agg(F.min(text_col).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Terms far commoner in toxic rows, strongest first.

    The driver gets those terms: each occurs in at least ``LEAST_ROWS`` toxic rows of
    the sample, so there are at most a third of the terms that those rows hold.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(terms_of(text).keys())
                n[toxic] += 1
        every = list(seen[0].keys() | seen[1].keys())
        for k in range(0, len(every), 50_000):
            part = every[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][t] for t in part], pa.int64()), pa.array([seen[0][t] for t in part], pa.int64())], names=["term", "toxic", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([n[1]], pa.int64()), pa.array([n[0]], pa.int64())], names=["term", "toxic", "clean"])

    counts = written(rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(f"toxic >= {LEAST_ROWS} or term = ''"), "terms")
    total = counts.where("term = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return []
    p, q = F.col("toxic") / F.lit(float(total["toxic"])), (F.col("clean") + 0.5) / F.lit(float(total["clean"]))
    # log-likelihood gain of telling the classes apart by the term
    gain = F.col("toxic") * F.log(p / q)
    scored = counts.where("term <> ''").where(p >= LEAST_RATIO * q)
    found = {r["term"]: (r["toxic"], r["clean"]) for r in scored.orderBy(gain.desc(), "term").collect()}
    # a longer term with the support of its own beginning occurs in the same rows, and its vote would be the same
    shorter = lambda t: ["^" + t.lstrip("^")[:n] for n in STEMS if len(t.lstrip("^")) > n]
    return [t for t, support in found.items() if all(found.get(s) != support for s in shorter(t))]


class Sparse:
    """A matrix by the entries of its rows."""

    def __init__(self, rows: list[np.ndarray], width: int, values: list[np.ndarray] | None = None):
        self.rows, self.width = rows, width
        self.at = np.concatenate([np.zeros(0, dtype=np.int32), *rows])
        self.of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.values = np.ones(len(self.at)) if values is None else np.concatenate([np.zeros(0), *values])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.at] * self.values, minlength=len(self.rows))

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transposed matrix times a vector."""
        return np.bincount(self.at, weights=v[self.of] * self.values, minlength=self.width)

    def columns(self) -> list[np.ndarray]:
        """The rows in which each column has an entry."""
        order = np.argsort(self.at, kind="stable")
        return np.split(self.of[order], np.cumsum(np.bincount(self.at, minlength=self.width))[:-1])


def _shared(votes: Sparse, columns: list[np.ndarray], weights: tuple[np.ndarray, ...], totals: list[float], fired: list[np.ndarray]) -> np.ndarray:
    """By voter, the sum of its positive correlations with all voters, itself included, as the mean over both classes.

    A voter meets those that fire in one of its rows; any other can't correlate
    positively. So one voter's row of the correlations is held at a time.
    """
    out = np.zeros(votes.width)
    rates = [f / t for f, t in zip(fired, totals, strict=True)]
    sds = [np.sqrt(np.maximum(p - p * p, 1e-9)) for p in rates]
    for k, rows in enumerate(columns):
        if not len(rows):
            continue
        beside = [votes.rows[r] for r in rows]
        others, n = np.concatenate(beside), [len(x) for x in beside]
        for w, total, p, sd in zip(weights, totals, rates, sds, strict=True):
            both = np.bincount(others, weights=np.repeat(w[rows], n), minlength=votes.width) / total
            out[k] += np.maximum((both - p[k] * p) / (sd[k] * sd), 0).sum() / 2
    return out


def label_model(votes: Sparse, human: np.ndarray, rounds: int = 25, correlated: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, log evidence of each voter's vote, share of it that is its own).

    ``votes`` is rows by voters; a silent voter abstains, and rows where all abstain
    are a voter of their own. Each round estimates the class shares, each voter's rate
    in either class and its correlation with the others in both, by which correlated
    voters share their evidence. The human label is one more vote, with error rates
    of its own that are estimated like the others, and the start.
    """
    quiet, columns = votes.times(np.ones(votes.width)) == 0, votes.columns()
    post = np.where(human > 0, np.where(quiet, 0.5, 0.9), 0.05)
    own, evidence = np.ones(votes.width), np.zeros(votes.width)
    for _ in range(rounds):
        weights = (post, 1 - post)
        totals = [max(float(w.sum()), 1e-9) for w in weights]
        fired = [votes.back(w) for w in weights]
        evidence = np.log((fired[0] + 0.5) / (totals[0] + 1)) - np.log((fired[1] + 0.5) / (totals[1] + 1))
        if correlated:
            own = 1.0 / np.maximum(1.0, _shared(votes, columns, weights, totals, fired))
        rate = lambda mark, least: [(mark @ w + least) / (total + 2 * least) for w, total in zip(weights, totals, strict=True)]
        yes, none = rate(human, 1.0), rate(quiet, 0.5)
        said = np.where(human > 0, math.log(yes[0] / yes[1]), math.log((1 - yes[0]) / (1 - yes[1])))
        odds = math.log(totals[0] / totals[1]) + votes.times(evidence * own) + said + quiet * math.log(none[0] / none[1])
        before, post = post, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(post - before).max() < 1e-3:
            break
    return post, evidence, own


def logistic(x: Sparse, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, by Newton's method; each step is solved by conjugate gradients."""
    w = np.zeros(x.width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        curve = p * (1 - p) + 1e-6
        left = x.back(target - p) - ridge * w
        step, way, size = np.zeros(x.width), left.copy(), float(left @ left)
        least = 1e-16 * max(size, 1e-12)
        for _ in range(200):
            if size <= least:
                break
            turned = x.back(curve * x.times(way)) + ridge * way
            length = size / float(way @ turned)
            step += length * way
            left = left - length * turned
            size, before = float(left @ left), size
            way = left + size / before * way
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, **names: str) -> Voters:
    """Lexicon, label model and classifier from a bounded sample of labelled rows."""
    rows = written(training_rows(docs, labels, most_rows, **names), "toxic")
    voters = Voters(learn_lexicon(rows))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [voters.votes(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), batch.column(1)], names=["fired", "hits", "words", "toxic"])

    if not voters.terms:
        return voters
    sample = rows.mapInArrow(vote, "fired array<int>, hits int, words int, toxic int").toArrow()  # at most most_rows short rows
    found = [voters.row(v) for v in zip(*(sample.column(c).to_pylist() for c in ("fired", "hits", "words")), strict=True)]
    x = Sparse([np.array(at, dtype=np.int32) for at, _ in found], voters.width, [np.array(values) for _, values in found])
    n_votes = len(voters.terms) + len(PATTERNS)
    votes = Sparse([r[r < n_votes] for r in x.rows], n_votes)
    post, _, _ = label_model(votes, sample.column("toxic").to_numpy().astype(float))
    voters.weights, voters.posterior_share = logistic(x, post), float(post.mean())
    return voters


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([voters.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def with_score(docs: DataFrame, voters: Voters, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """All columns of ``docs`` and the score of each row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([voters.score(t or "") for t in batch.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
