"""Personal data: candidate spans, boosted trees, calibrated thresholds, redaction.

Everything here is DataFrame functions. The base kinds (email, ip, card, phone) are
matched by their patterns and checked by format; those spans always stay.
High-recall generators propose further spans, which overlap each other and the base
spans. Boosted trees score each candidate by the format of its characters and the
shape of its surroundings (quotes, an assignment, what stands next to it). What they
are fitted to is evidence that no feature sees: the name of a key or a document
before the candidate, or a checksum that holds. Three in four distinct candidates
are fitted to, counted by their few thousand possible feature values over all
documents; on the fourth, each generator gets the least threshold from which the
wanted share of its candidates has evidence, and its precision and recall are told. A
chosen candidate joins if it overlaps no base span and no chosen one of an earlier
generator.

Time and memory are in proportion to the text and its hits: repeats that nothing can
follow are possessive, positions are sums over slices of bounded size, overlaps are
found by binary search, and text is cut from blocks of bounded size.

Defined cases: a null text is the empty text, without spans; offsets are code
points, ends exclusive; spans of different base kinds may overlap; the
fixed counts of ``PRIOR`` are fitted with the table's own and calibrate nothing, so a
generator without held-out candidates adds no span; other columns are kept by ``redact``, whatever their names, while
``all_spans`` replaces those that bear the names of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "other")

# Patterns of the base kinds and of the generators.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "assigned": r"(?<=[=:][ ]{0,2}[\"'`]{0,1})[^\s=:\"'`,;<>/\[\](){}]{8,}+",
    "run": r"(?:\G|(?<![A-Za-z0-9_/+=-]))(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{12,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "document": r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,9}+(?![A-Za-z0-9])",
    "groups": r"(?:\G|(?<![0-9A-Za-z]))(?:[A-Z]{2})?[0-9](?:[ ./-]?[0-9A-Z]){7,}+",
}
#: The kind that each generator's spans have.
KIND_OF = {"assigned": "secret", "run": "secret", "iban": "iban", "document": "other", "groups": "other"}
ANY = r"[0-9@=:]"
#: What counts as evidence before a candidate; no feature sees it.
EVIDENCE = r"(?i)(?:token|key|secret|password|passwd|pwd|auth|bearer|credential|iban|account|ssn|passport|licence|license no|id no|identity)\W{0,6}$"
#: Trees, their step, wanted share of candidates with evidence; some right ones have none, so it bounds precision from below.
TREES, STEP, RIGHT = 24, 0.4, 0.9
FEATURES = {"generator": 5, "long": 6, "digits": 5, "diverse": 5, "mixed": 2, "spaced": 2, "hexadecimal": 2, "assigned": 2, "quoted": 2, "closed": 2}
# Counts (wrong, right) that every table is given besides its own, by features; others are 0.
PRIOR = [
    ({"generator": 0, "long": 5, "digits": 2, "diverse": 3, "mixed": 1, "hexadecimal": 1, "assigned": 1, "quoted": 1, "closed": 1}, 0.25, 8.0),
    ({"generator": 1, "long": 5, "digits": 2, "diverse": 3, "mixed": 1, "hexadecimal": 1, "assigned": 1, "quoted": 1, "closed": 1}, 0.25, 8.0),
    ({"generator": 0, "long": 2, "digits": 1, "diverse": 3, "mixed": 1, "assigned": 1, "quoted": 1, "closed": 1}, 0.25, 4.0),
    ({"generator": 2, "long": 2, "digits": 3, "diverse": 2, "mixed": 1}, 0.25, 4.0),
    ({"generator": 0, "long": 1, "diverse": 2, "assigned": 1}, 4.0, 0.25),
    ({"generator": 1, "long": 2, "digits": 1, "diverse": 2, "mixed": 1}, 8.0, 0.25),
    ({"generator": 1, "long": 1, "digits": 3, "diverse": 1}, 4.0, 0.25),
    ({"generator": 3, "long": 1, "digits": 3, "diverse": 1, "mixed": 1}, 4.0, 1.0),
    ({"generator": 4, "long": 1, "digits": 3, "diverse": 1, "spaced": 1}, 8.0, 0.25),
]
#: Elements of a slice over which positions are added, code points of a block from which text is cut.
SLICE, BLOCK = 128, 1024
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _running(docs: DataFrame, values: dict[str, str], largest: bool = False) -> DataFrame:
    """``docs`` with columns that hold, for each element of an array of ints, the sum (or the largest, at least 0) of those before it.

    ``values`` has the arrays by the names of the new columns. By slices: the totals
    of slices, what precedes each slice, and inside it.
    """
    fold = lambda part: F.aggregate(part, F.lit(0), (lambda a, x: F.greatest(a, x)) if largest else (lambda a, x: a + x))
    join = F.greatest if largest else lambda a, b: a + b

    def totals(name: str) -> Column:
        slices = F.sequence(F.lit(0), F.floor(F.greatest(F.size(name) - 1, F.lit(0)) / SLICE).cast("int"))
        return F.transform(slices, lambda b: fold(F.slice(name, b * SLICE + 1, F.lit(SLICE))))

    def inside(out: str, name: str) -> Column:
        # what a lambda reads besides its arguments must not be worth inlining: arrays that it reads once would be made anew for each element
        part = lambda k: F.slice(name, k * SLICE + 1, F.lit(SLICE))
        return F.flatten(F.transform(f"_b_{out}", lambda base, k: F.transform(part(k), lambda _, j: join(base, fold(F.slice(name, k * SLICE + 1, j))))))

    docs = docs.withColumns({f"_t_{out}": totals(name) for out, name in values.items()})
    docs = docs.withColumns({f"_b_{out}": _bases(f"_t_{out}", fold) for out in values})
    return docs.withColumns({out: inside(out, name) for out, name in values.items()}).drop(*(f"_{k}_{out}" for k in "tb" for out in values))


def _bases(totals: str, fold) -> Column:
    return F.transform(totals, lambda _, k: fold(F.slice(totals, F.lit(1), k)))


def _spans(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``docs`` with _found_{name}, array<struct<hit, start, end, before, after>> of each pattern's matches in _some."""
    docs = docs.withColumns({f"_hits_{n}": F.regexp_extract_all("_some", F.lit(p), 0) for n, p in patterns.items()})
    docs = docs.withColumns({f"_gaps_{n}": F.when(F.size(f"_hits_{n}") > 0, F.split("_some", p, -1)).otherwise(F.array().cast("array<string>")) for n, p in patterns.items()})
    docs = docs.withColumns({f"_sizes_{n}": F.zip_with(F.slice(f"_gaps_{n}", F.lit(1), F.size(f"_hits_{n}")), f"_hits_{n}", lambda g, h: F.length(g) + F.length(h)) for n in patterns})
    docs = _running(docs, {f"_starts_{n}": f"_sizes_{n}" for n in patterns})

    def found(name: str) -> Column:
        gaps, hits = F.col(f"_gaps_{name}"), F.col(f"_hits_{name}")

        def one(hit: Column, j: Column) -> Column:
            start = F.col(f"_starts_{name}")[j] + F.length(gaps[j])
            return F.struct(hit.alias("hit"), start.alias("start"), (start + F.length(hit)).alias("end"), _before(gaps, hits, j).alias("before"), F.left(gaps[j + 1], F.lit(1)).alias("after"))

        return F.transform(f"_hits_{name}", one)

    docs = docs.withColumns({f"_found_{n}": found(n) for n in patterns})
    return docs.drop(*(f"_{what}_{n}" for n in patterns for what in ("hits", "gaps", "sizes", "starts")))


#: Characters before a span that are looked at, and matches that have more of them together, as none has fewer than seven.
BEFORE, BACK = 24, 4


def _before(gaps: Column, hits: Column, j: Column) -> Column:
    """The text before a match, earlier matches in it."""
    last = lambda x: F.coalesce(F.right(x, F.lit(BEFORE)), F.lit(""))
    parts = [last(F.get(x, j - k)) for k in range(BACK, 0, -1) for x in (gaps, hits)]
    return F.right(F.concat(*parts, last(gaps[j])), F.lit(BEFORE))


def _overlaps(spans: str, start: Column, end: Column) -> Column:
    """Whether any of the spans, which are in order and apart, meets [start, end): a binary search for the first that ends behind start."""
    n = F.size(spans)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        behind = F.col(spans)[F.least(middle, n - 1)]["end"] > start
        return F.struct(
            F.when((acc["low"] < acc["high"]) & ~behind, middle + 1).otherwise(acc["low"]).alias("low"), F.when((acc["low"] < acc["high"]) & behind, middle).otherwise(acc["high"]).alias("high")
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    hit = lambda acc: (acc["low"] < n) & (F.col(spans)[F.least(acc["low"], n - 1)]["start"] < end)
    return F.when(n > 0, F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, hit)).otherwise(False)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _checked(n: int, kind: str) -> Column:
    good = F.filter(F.col(f"_found_{kind}"), lambda s: _holds(kind, s["hit"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))


def _based(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with the base spans, by kind as _ok_{kind}, and the text that generators look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn("_some", F.when(text.rlike(ANY), text).otherwise(""))
    docs = _spans(docs, PATTERNS).withColumns({f"_ok_{kind}": _checked(n, kind) for n, kind in enumerate(PATTERNS)}).drop(*(f"_found_{k}" for k in PATTERNS))
    return docs.withColumn(out, F.array_sort(F.concat(*(F.col(f"_ok_{k}") for k in PATTERNS))))


def base_spans(docs: DataFrame, text_col: str = "text", out: str = "_base") -> DataFrame:
    """``docs`` with the base spans, array<struct<start, kind, end>> sorted by start and kind; kind counts from 0 in KINDS."""
    return _based(docs, text_col, out).drop("_some", *(f"_ok_{k}" for k in PATTERNS))


def _mod97(hit: Column) -> Column:
    """Whether an account number's check digits hold: letters count from 10, the first four characters last."""
    bare = F.translate(hit, " ", "")
    moved = F.split(F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def _featured(s: Column) -> Column:
    """A found span of a generator with its features."""
    hit, size = s["hit"], F.length(s["hit"])
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    diverse = F.size(F.array_distinct(F.split(hit, "")))
    apart = reduce(lambda a, kind: a & ~_overlaps(f"_ok_{kind}", s["start"], s["end"]), PATTERNS, F.lit(True))
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["generator"].alias("generator"),
        F.least(F.lit(5), F.floor(size / 8)).cast("int").alias("long"),
        F.floor(4 * digits / size).cast("int").alias("digits"),
        F.least(F.lit(4), F.floor(diverse / 4)).cast("int").alias("diverse"),
        (hit.rlike("[A-Za-z]") & hit.rlike("[0-9]")).cast("int").alias("mixed"),
        hit.rlike("[ ./-]").cast("int").alias("spaced"),
        hit.rlike("^[0-9a-fA-F]+$").cast("int").alias("hexadecimal"),
        s["before"].rlike("[=:] ?[\"'`]?$").cast("int").alias("assigned"),
        s["before"].rlike("[\"'`]$").cast("int").alias("quoted"),
        s["after"].rlike("[\"'`;,]").cast("int").alias("closed"),
        (s["before"].rlike(EVIDENCE) | F.when(s["generator"] == list(GENERATORS).index("iban"), _mod97(hit)).otherwise(False)).alias("right"),
        apart.alias("apart"), (F.crc32(F.encode(hit, "utf-8")) % 4 == 3).alias("held"),
    )


def _by(n: int):
    return lambda s: F.struct(F.lit(n).alias("generator"), s["hit"].alias("hit"), s["start"].alias("start"), s["end"].alias("end"), s["before"].alias("before"), s["after"].alias("after"))


def _proposed(based: DataFrame) -> DataFrame:
    """``based`` with all generators' candidates and their features as _candidates."""
    found = _spans(based, GENERATORS)
    found = found.withColumn("_every", F.concat(*(F.transform(f"_found_{g}", _by(n)) for n, g in enumerate(GENERATORS))))
    return found.withColumn("_candidates", F.transform("_every", _featured)).drop("_every", *(f"_found_{g}" for g in GENERATORS))


@dataclass
class Trees:
    """Boosted trees of depth two over binned features, and by generator the calibrated threshold with its precision and recall on held-out candidates."""

    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)
    precision: dict[int, float] = field(default_factory=dict)
    recall: dict[int, float] = field(default_factory=dict)

    def chosen(self, candidate: Column) -> Column:
        """Whether a candidate reaches its generator's threshold; a generator without one chooses nothing."""
        score, out = self.column(lambda f: candidate[f]), F.lit(False)
        for n, least in self.thresholds.items():
            out = F.when(candidate["generator"] == n, score >= F.lit(least)).otherwise(out)
        return out

    def of(self, row: dict) -> float:
        return self.bias + sum(leaves[2 * (row[f] > c) + (row[g] > d)] for f, c, g, d, leaves in self.trees)

    def column(self, features) -> Column:
        """The score as a DataFrame expression of a struct or of columns."""
        out = F.lit(self.bias)
        for f, c, g, d, leaves in self.trees:
            side = F.when(features(g) > d, 1).otherwise(0)
            out = out + F.when(features(f) > c, F.when(side == 1, leaves[3]).otherwise(leaves[2])).otherwise(F.when(side == 1, leaves[1]).otherwise(leaves[0]))
        return out


def boost(fitted: list[tuple[dict, float, float]], held: list[tuple[dict, float, float]], trees: int = TREES, step: float = STEP, right: float = RIGHT) -> Trees:
    """Fit to (features, wrong, right) counts by Newton steps on the logistic loss, and calibrate on others.

    The counts have a row for each combination of binned features, so their size does
    not grow with the documents. ``PRIOR`` is fitted with the others; thresholds come
    from the held-out candidates of their generator alone: they lie halfway between
    the last score of the longest leading part of which ``right`` are right and the
    next score, or, where there is none, at even odds if that is lower.
    """
    prior = [(dict.fromkeys(FEATURES, 0) | row, wrong, yes) for row, wrong, yes in PRIOR]
    table = [*prior, *fitted]
    good, bad = sum(t[2] for t in table), sum(t[1] for t in table)
    model = Trees(bias=math.log(good / bad))
    score = [model.bias] * len(table)
    cuts = [(f, c) for f, n in FEATURES.items() for c in range(n - 1)]
    sides = np.array([[row[f] > c for row, _, _ in table] for f, c in cuts], dtype=float)
    wrong, yes = np.array([t[1] for t in table]), np.array([t[2] for t in table])
    score = np.full(len(table), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        sums = []
        for value in (yes - (wrong + yes) * p, (wrong + yes) * p * (1 - p)):
            both, one, total = (sides * value) @ sides.T, sides @ value, value.sum()
            sums.append((total - one[:, None] - one[None, :] + both, one[None, :] - both, one[:, None] - both, both))
        gain = sum(g * g / (h + 1) for g, h in zip(*sums, strict=True))
        gain[np.tril_indices(len(cuts))] = -1
        a, b = np.unravel_index(int(gain.round(9).argmax()), gain.shape)
        leaves = [float(step * g[a, b] / (h[a, b] + 1)) for g, h in zip(*sums, strict=True)]
        model.trees.append((*cuts[a], *cuts[b], leaves))
        score = score + np.array(leaves)[(2 * sides[a] + sides[b]).astype(int)]
    for n in range(len(GENERATORS)):
        own = [row for row in held if row[0]["generator"] == n]
        seen = said = 0.0
        total = sum(t[2] for t in own)
        # candidates of one score are taken together
        groups = [(score, list(rows)) for score, rows in groupby(sorted(own, key=lambda row: -model.of(row[0])), key=lambda row: model.of(row[0]))]
        for k, (score, rows) in enumerate(groups):
            seen, said = seen + sum(r[1] + r[2] for r in rows), said + sum(r[2] for r in rows)
            if said and said >= right * seen:
                below = (score + groups[k + 1][0]) / 2 if k + 1 < len(groups) else min(score, 0.0) - 1e-9
                model.thresholds[n], model.precision[n], model.recall[n] = below, said / seen, said / total
    return model


def fit(docs: DataFrame, text_col: str = "text") -> Trees:
    """Trees from the candidates of all documents; the driver gets one row for each combination of features.

    Candidates that overlap a base span are left out, as they can't join.
    """
    found = _proposed(_based(docs.select(text_col), text_col, "_base"))
    # outer, as a filter on the arrays would be pushed down to the text, with all expressions on its way copied
    rows = found.select(F.inline_outer("_candidates")).where("apart")
    counts = rows.groupBy("held", *FEATURES).agg(F.count_if(~F.col("right")).alias("wrong"), F.count_if(F.col("right")).alias("yes"))
    table = [(r["held"], {f: r[f] for f in FEATURES}, float(r["wrong"]), float(r["yes"])) for r in sorted(counts.collect(), key=lambda r: tuple(r[f] for f in FEATURES))]
    return boost([t[1:] for t in table if not t[0]], [t[1:] for t in table if t[0]])


def _from(n: int):
    return lambda s: s["generator"] == n


def all_spans(docs: DataFrame, model: Trees, text_col: str = "text", base: str = "_base", out: str = "_spans") -> DataFrame:
    """``docs`` with the base spans and all spans: those that join are chosen candidates apart from base spans and from earlier generators' ones."""
    found = _proposed(_based(docs, text_col, base))
    found = found.withColumn("_chosen", F.filter("_candidates", lambda s: s["apart"] & model.chosen(s)))
    kinds = F.array(*[F.lit(KINDS.index(KIND_OF[g])) for g in GENERATORS])
    found = found.withColumns({f"_new_{n}": F.filter("_chosen", _from(n)) for n in range(len(GENERATORS) - 1)})
    joins = F.filter("_chosen", lambda s: reduce(lambda a, n: a & ~((s["generator"] > n) & _overlaps(f"_new_{n}", s["start"], s["end"])), range(len(GENERATORS) - 1), F.lit(True)))
    added = F.transform(joins, lambda s: F.struct(s["start"].alias("start"), kinds[s["generator"]].alias("kind"), s["end"].alias("end")))
    found = found.withColumn(out, F.array_sort(F.concat(F.col(base), added)))
    return found.drop("_some", "_candidates", "_chosen", *(f"_ok_{k}" for k in PATTERNS), *(f"_new_{n}" for n in range(len(GENERATORS) - 1)))


def as_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _piece(start: Column, end: Column) -> Column:
    """Text from ``start`` to ``end`` out of the blocks of a text."""
    blocks, a, b = F.col("_blocks"), F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    at = lambda k: F.coalesce(F.get("_blocks", k), F.lit(""))
    inside = F.substr(at(a), start % BLOCK + 1, end - start)
    across = F.concat(F.substr(at(a), start % BLOCK + 1), F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.left(at(b), end % BLOCK))
    return F.when(end <= start, "").when(a == b, inside).otherwise(across)


def redact(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans by the first one's.

    A text without spans, a null one too, stays as it is.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = all_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col)), model, text_col)
    found = found.withColumn("_blocks", F.when(F.size("_spans") > 0, F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)))
    found = _running(found.withColumn("_ends", F.transform("_spans", lambda s: s["end"])), {"_done": "_ends"}, largest=True)

    def part(s: Column, j: Column) -> Column:
        done = F.col("_done")[j]
        return F.when(s["start"] >= done, F.concat(_piece(done, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise("")

    rest = _piece(F.array_max("_ends"), F.length(text_col))
    changed = F.when(F.size("_spans") > 0, F.concat(F.array_join(F.transform("_spans", part), ""), rest)).otherwise(F.col(text_col))
    return found.select(*(changed.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))
