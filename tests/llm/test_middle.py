"""Fill-in-middle against brute force and round trips."""

import hashlib
import random
import re

import pytest

from weftline.llm import middle, queries_text

SPACE = set(" \t\n\x0b\x0c\r")
ODD = ["", None, " ", "\t \n", "word", " a  b\nc ", "a b c", "x <P> y", "x<S>y z", "end <M>", "<P", "<", "P> <S <M", "🙂 é\x00\x1f z q", "a b <" * 40, "\n".join(["line of text"] * 3000), "w" * 200_000, " " * 5000, "one " * 50_000]


def units(text):
    """Units by a walk over characters."""
    out, now, word = [], "", False
    for c in text:
        if c in SPACE and word:
            out.append(now)
            now, word = "", False
        now += c
        word = word or c not in SPACE
    return out + ([now] if now else [])


def brute(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in range(0, 32, 8)]
    parts = units(text)
    n = len(parts)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fixture():
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "bc", " ", "\n", "é", "<", ">", "P", "S", "M", " "]) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate([*made, *ODD])]
    return rows + rows[:5] + [(k, "same id twice, another text") for k in range(3)]


def test_rows_equal_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, output string, n int")
    out = middle.fill_in_middle(docs)
    got = out.collect()
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    want = [(k, *brute(k, t)) for k, t in rows]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(want, key=str)
    assert all(r.output_sha256 == digest(r.output) for r in got)
    assert sorted(r.restored_sha256 for r in got) == sorted(digest(t or "") for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = middle.restored(out).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((k, t or "") for k, t in rows)


@pytest.mark.parametrize(("share", "spm_share", "forms"), [(0, 50, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_shares(spark, share, spm_share, forms):
    docs = spark.createDataFrame([(k, f"a text of {k} words") for k in range(50)], "doc_id long, text string")
    assert {r.form for r in middle.fill_in_middle(docs, share=share, spm_share=spm_share).collect()} == forms


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = middle.fill_in_middle(docs).collect()
    assert len(got) == 2 and sorted(r.n for r in got) == [0, 2] and all(r.restored_sha256 in (digest("a b"), digest("")) for r in got)
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_offsets_are_compact():
    ends = middle.unit_ends("one two  three ")
    assert list(ends) == [0, 3, 7, 14, 15] and ends.itemsize == 4


def test_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    df = queries_text.op12_fill_in_middle(spark, data)
    assert "output" not in df.columns
    for r in df.collect():
        n, form, a, b, output = brute(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, digest(output), digest(texts[r.doc_id]))
