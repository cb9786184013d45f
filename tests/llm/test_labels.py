"""Toxicity, personal data and licences."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import licences, personal, queries_labels, toxicity

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, hit):
    digits = [int(c) for c in re.sub("[^0-9]", "", hit)]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


TEXTS = [
    "mail a.b@c.de and x@y.z@w.v then a@b.c%d@e.f", "1.2.3.4 1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1..2", "4432507379035540 4111 1111 1111 1111 4111-1111-1111-1112", "+49 (30) 123-4567 89, +1 2, ++12345678901, +1()()()",
    "🙂 é x@y.zz 🙂 10.0.0.1", "", None, "no data here", "a@b", "@@@ a@b..c", "1" * 3000, "a" * 20000 + "@b.c", "+1" + " " * 5000 + "2", "4 " * 3000, "a." * 4000 + "b@c.d",
]


def test_base_spans_equal_the_patterns(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in personal.base_spans(docs).select("doc_id", personal.as_text("_base").alias("s")).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k] == ",".join(brute(t)), (k, t and t[:60])


def test_personal_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries_labels.op2_personal_data(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(b.startswith(k + ":") for b in base) for k in BASE]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in BASE] == base


def secret_rows():
    rows = [(k, f"text {k} token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" end") for k in range(60)]
    rows += [(100 + k, f"plain abcdefghijklmn{k:03d}opq words and 2024-01-{k % 28 + 1:02d}") for k in range(60)]
    # no name of a key: only the shape of what stands around tells
    return rows + [(200 + k, f"x = \"{hashlib.sha1(str(-k - 1).encode()).hexdigest()}\" y") for k in range(2)]


def test_chosen_candidates_join(spark):
    docs = spark.createDataFrame(secret_rows(), "doc_id long, text string")
    model = personal.fit(docs)
    assert len(model.trees) == personal.TREES and all(p >= personal.RIGHT for p in model.precision.values()) and model.recall[0] > 0.5
    got = {r.doc_id: r.s for r in personal.all_spans(docs, model).select("doc_id", personal.as_text("_spans").alias("s")).collect()}
    assert all("secret:" in got[k] for k in [*range(60), *range(200, 202)]) and not any(got[100 + k] for k in range(60))
    clean = personal.redact(docs, model)
    assert all(not re.search("[0-9a-f]{40}", r.text) and ("[SECRET]" in r.text) == (not 100 <= r.doc_id < 160) for r in clean.collect())


def brute_candidates(text):
    """(start, end, generator, features) of each generator's matches; patterns without what only saves time."""
    plain = {
        "assigned": r"(?:(?<=[=:])|(?<=[=:] )|(?<=[=:]  )|(?<=[=:][\"'`])|(?<=[=:] [\"'`])|(?<=[=:]  [\"'`]))[^\s=:\"'`,;<>/\[\](){}]{8,}", "run": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*[0-9])[A-Za-z0-9_/+=-]{12,}",
        "iban": personal.GENERATORS["iban"], "document": personal.GENERATORS["document"], "groups": r"(?<![0-9A-Za-z])(?:[A-Z]{2})?[0-9](?:[ ./-]?[0-9A-Z]){7,}",
    }
    out = []
    for n, g in enumerate(personal.GENERATORS):
        for m in re.finditer(plain[g], text):
            hit, before, after = m.group(), text[: m.start()][-24:], text[m.end() : m.end() + 1]
            digits = sum(c in "0123456789" for c in hit)
            f = {
                "generator": n, "long": min(5, len(hit) // 8), "digits": 4 * digits // len(hit), "diverse": min(4, len(set(hit)) // 4), "mixed": int(bool(re.search("[A-Za-z]", hit)) and digits > 0), "spaced": int(bool(re.search("[ ./-]", hit))),
                "hexadecimal": int(bool(re.fullmatch("[0-9a-fA-F]+", hit))), "assigned": int(bool(re.search("[=:] ?[\"'`]?$", before))), "quoted": int(before[-1:] in ("\"", "'", "`") and before != ""), "closed": int(after in tuple("\"'`;,")),
            }
            out.append((m.start(), m.end(), n, f))
    return out


def brute_spans(text, model):
    base = [(m.start(), m.end(), n) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(k, m.group())]
    chosen = [c for c in brute_candidates(text or "") if model.of(c[3]) >= model.thresholds.get(c[2], float("inf")) and not any(a < c[1] and c[0] < b for a, b, _ in base)]
    joins = [c for c in chosen if not any(d[2] < c[2] and d[0] < c[1] and c[0] < d[1] for d in chosen)]
    spans = [(a, n, b) for a, b, n in base] + [(a, personal.KINDS.index(list(personal.KIND_OF.values())[n]), b) for a, b, n, _ in joins]
    return ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_all_spans_equal_brute_force(spark):
    more = ["IBAN DE89370400440532013000 and DE89 3704 0044 0532 0130 00, passport C01X00T47 AB1234567", "password: hunter2hunter2, key='0123456789abcdef0123' x@y.zz token=abc@d.ef.gh", "a = \"q1w2e3r4t5z6u7i8\" " * 300, "🙂 key = \"aaaaaaaa11111111bbbbbbbb22222222\""]
    texts = [t for t in [*TEXTS, *more] if t is None or len(t) < 9000] + [t for _, t in secret_rows()]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for model in (personal.boost([], []), personal.fit(docs)):
        got = {r.doc_id: r.s for r in personal.all_spans(docs, model).select("doc_id", personal.as_text("_spans").alias("s")).collect()}
        for k, t in enumerate(texts):
            assert got[k] == brute_spans(t, model), (k, t and t[:60])


def test_check_digits(spark):
    rows = [("DE89370400440532013000", True), ("DE89 3704 0044 0532 0130 00", True), ("GB82WEST12345698765432", True), ("DE88370400440532013000", False)]
    got = {r.t: r.ok for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", personal._mod97(F.col("t")).alias("ok")).collect()}
    assert got == dict(rows)


def test_many_hits_take_time_in_proportion(spark):
    text = " ".join(f"a{k}@b{k}.de" for k in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = personal.boost([], [])
    row = personal.all_spans(docs, model).select(personal.as_text("_spans").alias("s")).first()
    assert row.s == ",".join(brute(text))
    assert personal.redact(docs, model).first().text == " ".join(["[EMAIL]"] * 20_000)


def test_redaction_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a x@y.zz b 1.2.3.4", 5, 6), (2, None, 5, 6), (3, "", 5, 6)], "doc_id long, text string, _text int, _some int")
    out = personal.redact(docs, personal.fit(docs))
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r._text) for r in out.collect()), key=str) == [(1, "a [EMAIL] b [IP]", 5), (2, None, 5), (3, "", 5)]
    assert personal.redact(docs.limit(0), personal.fit(docs.limit(0))).count() == 0


def toxic_rows(n=600):
    rng = np.random.default_rng(4)
    words = [f"wort{k}" for k in range(300)]
    bad = ["schimpf", "grobzeug", "schlumpan", "schlumpen", "schlumpor"]
    rows = []
    for k in range(n):
        text = rng.choice(words, 30).tolist()
        if k % 5 == 0:
            text[3:5] = rng.choice(bad, 2).tolist()
        rows.append((k, " ".join(text), int(k % 5 == 0) if k % 40 else 0))
    return rows


def test_toxicity_learns_words_and_beginnings(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2] + [(None, 1), (1, None), (99999, 1)], "doc_id long, toxic int")
    voters = toxicity.fit(docs, labels)
    assert "^schlu" in voters.terms or "^schl" in voters.terms
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "schlumpix grobzeug"), (-4, "wort1 " * 20000), (-4, "wort1 " * 20000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs.unionByName(extra), voters).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i, _, _ in rows)
    assert got[-1] == got[-2] < 0.3 and got[-3] >= 0.3 and got[-4] < 0.3


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_sample_is_bounded(spark):
    rows = toxic_rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 50).count() == 50


def test_toxicity_query_is_accurate_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = queries_labels.op1_toxicity(spark, data).collect()
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= 0.95 * len(held)


def weak_votes(n=6000, seed=1):
    """Sparse voters: good ones, one that three others copy, and noisy ones that fire in either class."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.2
    fires = lambda a, b: np.where(truth, rng.random(n) < a, rng.random(n) < b)
    copied = fires(0.4, 0.06)
    good = [fires(0.5, 0.004) for _ in range(4)]
    noisy = [fires(0.03, 0.02) for _ in range(3)]
    return np.stack([copied, copied, copied, copied, *good, *noisy], axis=1).astype(np.float32), truth


def noisy_human(truth, share=0.12, seed=9):
    return np.where(np.random.default_rng(seed).random(len(truth)) < share, ~truth, truth).astype(float)


def sparse(matrix):
    at = [np.flatnonzero(r).astype(np.int32) for r in matrix]
    return toxicity.Sparse(at, matrix.shape[1], [r[k].astype(float) for r, k in zip(matrix, at, strict=True)])


def dense_label_model(votes, human, rounds=25):
    """The same model with whole matrices."""
    quiet = votes.sum(axis=1) == 0
    post = np.where(human > 0, np.where(quiet, 0.5, 0.9), 0.05)
    for _ in range(rounds):
        weights = [post, 1 - post]
        totals = [w.sum() for w in weights]
        evidence = np.log((votes.T @ post + 0.5) / (totals[0] + 1)) - np.log((votes.T @ (1 - post) + 0.5) / (totals[1] + 1))
        shared = 0
        for w, t in zip(weights, totals, strict=True):
            mean = votes.T @ w / t
            cov = (votes * w[:, None]).T @ votes / t - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            shared = shared + np.maximum(cov / np.outer(sd, sd), 0).sum(axis=1) / 2
        own = 1 / np.maximum(1, shared)
        rate = lambda m, least: [(m @ w + least) / (t + 2 * least) for w, t in zip(weights, totals, strict=True)]
        yes, none = rate(human, 1.0), rate(quiet, 0.5)
        said = np.where(human > 0, np.log(yes[0] / yes[1]), np.log((1 - yes[0]) / (1 - yes[1])))
        before, post = post, 1 / (1 + np.exp(-np.clip(np.log(totals[0] / totals[1]) + votes @ (evidence * own) + said + quiet * np.log(none[0] / none[1]), -30, 30)))
        if np.abs(post - before).max() < 1e-3:
            break
    return post, evidence, own


def dense_logistic(x, target, rounds=50):
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(x.shape[1]), x.T @ (target - p) - w)
    return w


def test_sparse_model_equals_whole_matrices():
    votes, truth = weak_votes(2000)
    votes = np.concatenate([votes, np.zeros((2000, 1))], axis=1)  # and a voter that never fires
    human = noisy_human(truth)
    for a, b in zip(toxicity.label_model(sparse(votes), human), dense_label_model(votes.astype(float), human), strict=True):
        assert np.allclose(a, b, atol=1e-9)
    x = np.concatenate([votes, np.random.default_rng(3).random((2000, 2)), np.ones((2000, 1))], axis=1).astype(float)
    target = toxicity.label_model(sparse(votes), human)[0]
    assert np.allclose(toxicity.logistic(sparse(x), target), dense_logistic(x, target), atol=1e-4)


def test_scores_equal_brute_force(spark, data):
    """Lexicon by counting, votes, model and classifier with whole matrices, over the rows that may be learned from."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r.doc_id: int(r.toxic > 0) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.toxic is not None}
    rows = [(texts[i], y) for i, y in labels.items() if i in texts]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    counts = [toxicity.Counter(t for text, y in rows if y == k for t in toxicity.terms_of(text)) for k in (0, 1)]
    found = {t: (c, counts[0][t]) for t, c in counts[1].items() if c >= 3 and c / n[1] >= 4.0 * (counts[0][t] + 0.5) / n[0]}
    begins = lambda t: ["^" + t.lstrip("^")[:k] for k in (4, 5, 6) if len(t.lstrip("^")) > k]
    terms = {t for t, c in found.items() if all(found.get(b) != c for b in begins(t))}
    got = queries_labels.op1_toxicity(spark, data).collect()
    voters = toxicity.Voters(sorted(terms))
    matrix = np.zeros((len(rows), voters.width))
    for k, (text, _) in enumerate(rows):
        at, values = voters.row(voters.votes(text))
        matrix[k, at] = values
    post, *_ = dense_label_model(matrix[:, : len(terms) + len(toxicity.PATTERNS)], np.array([y for _, y in rows], dtype=float))
    voters.weights = dense_logistic(matrix, post)
    assert max(abs(r.score - voters.score(texts[r.doc_id])) for r in got) < 1e-3


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (2, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.training_rows(docs, labels, 5).collect()) == [("a", 0), ("text 0", 1)]


def test_support_does_not_grow_with_the_sample(spark):
    rows = [(f"common wort{k} " + ("rareterm" if k < 3 else "schimpf"), 1) for k in range(2000)] + [(f"plain wort{k}", 0) for k in range(3000)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"^rare", "^schi"} <= set(terms)


def test_label_model_discounts_copied_votes():
    votes, truth = weak_votes()
    _, _, own = toxicity.label_model(sparse(votes), noisy_human(truth))
    assert own[:4].max() < 0.4 < 0.6 < own[4:8].min()


def test_posterior_labels_mend_human_labels():
    for seed in range(3):
        votes, truth = weak_votes(seed=seed)
        human = noisy_human(truth, seed=seed)
        right = lambda guess: (guess == truth).mean()
        post, _, _ = toxicity.label_model(sparse(votes), human)
        assert right(post > 0.5) > right(human > 0) + 0.005 and right(post > 0.5) >= right(votes.sum(axis=1) >= 1)
        assert ((post > 0.5) == truth)[(human > 0) != truth].mean() > 0.9


def test_licences(spark):
    mit = licences.TEMPLATES["MIT"]
    half = mit.split()
    rows = [
        (1, "Blah. Released under the MIT License. More"), (2, "x " * 50 + mit.upper() + " tail " * 50), (3, " ".join(half[: len(half) // 2])), (4, None), (5, ""), (6, "license"),
        (7, "word " * 20000 + "Licensed under CC BY-NC 4.0."), (8, mit.replace("Software", "Program")), (9, "nothing to see"), (9, "nothing to see"),
    ]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, dice double")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert got[1].licence == "MIT (notice)" and got[1].dice == 1.0 and (got[1].first_word, got[1].n_words) == (1, 5)
    assert got[2].licence == "MIT" and got[2].first_word == 50
    assert got[3].licence is None and got[4].licence is None and got[5].dice == 0 and got[6].licence is None and got[9].licence is None
    assert got[7].licence == "CC-BY-NC-4.0 (notice)" and got[8].licence == "MIT" and got[8].dice < 1
    assert licences.scan(docs.limit(0)).count() == 0
    assert licences.scan(docs, {}).where("licence is not null").count() == 0


def brute_dice(text, template):
    w = re.findall(r"\w+", template.lower())
    own = set(zip(w, w[1:]))
    v = re.findall(r"\w+", (text or "").lower())
    best = 0.0
    for a in range(len(v)):
        for b in range(a + 2, min(len(v), a + 2 * len(w)) + 1):
            s = set(zip(v[a:b], v[a + 1 : b]))
            best = max(best, 2 * len(s & own) / (len(s) + len(own)))
    return best


def test_licence_query_against_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if len(r.text) < 3000}
    short = {k: t for k, t in licences.TEMPLATES.items() if "notice" in k}
    for r in queries_labels.op9_licence_scan(spark, data).collect():
        if r.doc_id in texts and "icen" in texts[r.doc_id]:
            best = max(brute_dice(texts[r.doc_id], t) for t in short.values())
            assert (r.licence is not None) == (best >= 0.8)
            if r.licence:
                assert r.dice == pytest.approx(best)


def brute_best(text, template):
    """The best Dice of any run of words, by running sets."""
    w, v = (re.findall(r"\w+", x.lower()) for x in (template, text))
    own, grams, best = set(zip(w, w[1:])), list(zip(v, v[1:])), 0.0
    for a in range(len(grams)):
        held, common = set(), 0
        for g in grams[a:]:
            if g not in held:
                held.add(g)
                common += g in own
            best = max(best, 2 * common / (len(own) + len(held)))
    return best


def cut_and_mixed_copies():
    """Long templates cut short or mixed with other words, prose with everyday bigrams behind them."""
    rng = random.Random(3)
    prose = lambda n: " ".join("in the" if rng.random() < 0.04 else f"w{rng.randrange(900)}" for _ in range(n))
    mit = licences.TEMPLATES["MIT"].split()
    yield "MIT", " ".join(mit[: len(mit) * 3 // 4]) + " " + " ".join(f"v{k}" for k in range(14)) + " in the " + prose(150)
    for name, t in licences.TEMPLATES.items():
        words = t.split()
        if len(words) < 40:
            continue
        for share in (0.7, 0.75, 0.9):
            yield name, prose(60) + " " + " ".join(words[: int(len(words) * share)]) + " " + prose(200)
        for block in (9, 20, 40):
            mixed = [w for k in range(0, len(words), block) for w in (*words[k : k + block], *[f"x{rng.randrange(900)}" for _ in range(block * 2 // 5)])]
            yield name, prose(30) + " " + " ".join(mixed) + " " + prose(150)
        yield name, " ".join(words) + " same words" * 300 + " " + " ".join(words)
    half = len(mit) // 2
    yield "MIT", " ".join(mit[:half]) + " filler text" * 200 + " " + " ".join(mit[half:])


def test_passages_of_long_templates_against_brute_force():
    for name, text in cut_and_mixed_copies():
        best = brute_best(text, licences.TEMPLATES[name])
        matches = licences.Scanner({name: licences.TEMPLATES[name]}, 0.8).scan(text)
        found, dice, first, n = matches[0] if matches else (None, 0.0, 0, 0)
        assert (found == name) == (best >= 0.8) and (not found or dice == pytest.approx(best)), (name, best, dice)
        if found:
            assert brute_best(" ".join(re.findall(r"\w+", text)[first : first + n]), licences.TEMPLATES[name]) == pytest.approx(dice)


def test_every_licence_of_a_text():
    t, scanner = licences.TEMPLATES, licences.Scanner(licences.TEMPLATES, 0.8)
    whole = scanner.scan(f"{t['MIT']} and then {t['ISC']} some more words {t['MIT']} {t['Apache-2.0']}")
    assert sorted((name, dice) for name, dice, _, _ in whole) == [("Apache-2.0", 1.0), ("ISC", 1.0), ("MIT", 1.0), ("MIT", 1.0)]
    spans = sorted((first, first + n) for _, _, first, n in whole)
    assert all(a[1] <= b[0] + 1 for a, b in zip(spans, spans[1:]))
    for name, text in t.items():  # each template is known among all, by itself or by one with the same bigrams
        found = scanner.scan(f"before it {text} after it")[0]
        assert found[1] == 1.0 and (found[0] == name or set(licences.bigrams(t[found[0]])) >= set(licences.bigrams(text)))


def test_held_out_rows(spark):
    got = spark.createDataFrame([(k,) for k in range(50)], "doc_id long").select("doc_id", queries_labels.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert spark.createDataFrame([(None,)], "doc_id long").select(F.coalesce(queries_labels.held_out(), F.lit(False))).count() == 1
