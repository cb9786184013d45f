"""The pipeline's stages one after the other."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import near, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]


def test_decisions_take_effect(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    clean = corpus_pipeline.reject_toxic(spark, docs, data)
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == columns
    assert sum(i in kept for i, y in labels.items() if y == 0) >= 0.97 * sum(y == 0 for y in labels.values())
    assert sum(i in kept for i, y in labels.items() if y == 1) <= 0.3 * sum(y == 1 for y in labels.values())
    one = corpus_pipeline.keep_one_of_each(spark, clean, data)
    classes = near.near_classes(clean).collect()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.class_id for r in classes}
    safe = corpus_pipeline.redact_personal(spark, one, data)
    assert safe.columns == columns and safe.count() == one.count()
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text) for r in safe.collect())
    pieces = corpus_pipeline.pack(spark, safe, data)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in safe.select("doc_id").collect()}


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 0 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_stand_odd_rows(spark, name, stage):
    rows = [(1, None, None, None, None, 1.0), (2, "", "en", "s", 0, 1.0), (3, "x " * 30000, "en", "s", 60000, 1.0), (4, "tie tie tie tie tie", "en", "s", 3, 1.0), (4, "tie tie tie tie tie", "en", "s", 3, 1.0), (None, "no id at all here", "en", "s", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score double")
    out = stage(spark, docs, DATA)
    assert out.count() >= 4
    assert name == "packing" or out.columns == docs.columns
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_scores_ignore_other_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    voters = toxicity.Voters(["some"])
    assert toxicity.with_score(docs, voters).columns == ["doc_id", "text", "lang", "_score"]


def test_run_equals_brute_force(spark, tmp_path):
    """Each stage's rule over the whole small table in plain Python; the fitted models are those that the stages fit."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from test_labels import brute_spans, toxic_rows
    from test_near import brute
    from weftline.llm import personal
    from weftline.llm.queries_labels import held_out
    from weftline.llm.queries_text import vocabulary

    texts = {i: t for i, t, _ in toxic_rows(300)}
    texts |= {1000 + k: texts[k] + (" more" if k % 2 else "") for k in range(1, 60)}
    texts |= {2000 + k: f"mail me{k}@host.de or token = \"{zlib.crc32(b'%d' % k):08x}{zlib.crc32(b'x%d' % k):08x}{k:08d}\" now" for k in range(30)} | {3000: "", 3001: None}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in toxic_rows(300)], "doc_id long, toxic int, quality int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")

    voters = toxicity.fit(docs, labels.where(~held_out()))
    clean = {i: t for i, t in texts.items() if voters.score(t or "") < 0.3}
    assert 0 < len(clean) < len(texts)
    classes = brute(list(clean.items()))
    one = {i: t for i, t in clean.items() if classes[i][0] == i}
    assert len(one) < len(clean)
    model = personal.fit(spark.createDataFrame(list(one.items()), "doc_id long, text string"))

    def redacted(text):
        out, at = "", 0
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in brute_spans(text, model).split(",") if s)):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        return out + text[at:]

    own = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {i: [*own.encode(redacted(t) if t else "", add_special_tokens=False).ids, 1] for i, t in one.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(ids)
    for i, expected in ids.items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert pieces[0].start == 0 and sum(r.length for r in pieces) == len(expected) == pieces[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(np.array(expected[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in pieces)
    by_window = {}
    for r in got:
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_window.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
