"""BPE and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest

from weftline.llm import bpe, packing, queries_text

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    "plain words here", "", None, "  two  spaces \n lines\t tab ", "x<|endoftext|>y", "it's I'LL we'll 1234 ½", "éàü ñ ß Σς İ ʼn", "日本語 テキスト", "🙂🙂 emoji 👩‍👩‍👧", "a" * 5000, "word " * 3000,
    "\x1c\x85　odd spaces", "same text", "same text", "''' \"\"\" ---", "á combining ẛ̣",
]


def library(name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path(name))
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", [1]) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string, open array<int>")


def test_bpe_equals_the_library(spark, docs):
    own = library("byte_bpe_50k.json")
    encoded = bpe.encode_documents(docs, P.path("byte_bpe_50k.json"))
    for r in encoded.collect():
        want = own.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
    decoded = {r.doc_id: r.text for r in bpe.decode_documents(encoded, P.path("byte_bpe_50k.json")).collect()}
    assert decoded == {k: t or "" for k, t in enumerate(TEXTS)}


def test_bpe_query(spark, data):
    own = library("byte_bpe_50k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries_text.op3_bpe_round_trip(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_no_rows(spark, docs):
    assert bpe.round_trip(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def check_packing(pieces, ids_of, size):
    by_doc, by_window = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for doc, own in by_doc.items():
        ids, at = ids_of[doc], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert by_doc.keys() == ids_of.keys()
    filled = []
    for own in by_window.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        filled.append(at)
    return filled


def test_packing(spark, docs):
    own = library("word_bpe_49k.json")
    ids = {k: [*own.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(TEXTS)}
    got = packing.pack(docs.repartition(3), P.path("word_bpe_49k.json"), window=256, most_open=2, keep_ids=True).collect()
    check_packing(got, ids, 256)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_query(spark, data):
    own = library("word_bpe_49k.json")
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    ids = {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    filled = check_packing(queries_text.op8_packing(spark, data).collect(), ids, 2048)
    assert sum(filled) > 0.95 * 2048 * (len(filled) - 1)


def test_leftovers_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MEET", 2)
    docs = spark.createDataFrame([(k, f"word{k} " * (k % 7 + 1)) for k in range(200)], "doc_id long, text string").repartition(5)
    own = library("word_bpe_49k.json")
    ids = {r.doc_id: [*own.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    check_packing(packing.pack(docs, P.path("word_bpe_49k.json"), window=64, most_open=3).collect(), ids, 64)


def test_remembered_keeps_two_generations():
    seen = []
    memory = bpe.Remembered(lambda k: seen.append(k) or k * 2, most=3)
    assert [memory[k] for k in (1, 2, 3, 4, 1)] == [2, 4, 6, 8, 2]
    assert seen == [1, 2, 3, 4] and len(memory) <= 3


def test_packing_encodes_a_word_once_whatever_its_case_and_mark():
    import struct

    import public_tokenizers

    from weftline.llm import packing

    own = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Thion, thion. THION! thion", "İstanbul. ΑΣ. <|ENDOFTEXT|>, <|endoftext|>. word's, 3. é? . .. a.,b 中文, ß:"]
    plain = own.own
    asked = []

    class Counted:
        def encode_batch_fast(self, part, **more):
            asked.extend(part)
            return plain.encode_batch_fast(part, **more)

    own.own = Counted()
    found = own.encode_all(texts)
    for text, ids in zip(texts, found, strict=True):
        expected = plain.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(expected)}I", *expected)
    assert [w for w in asked if w.lower().startswith("thion")] == ["thion"]
