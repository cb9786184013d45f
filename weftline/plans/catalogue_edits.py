"""Queries of line differences, question words and places in texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as fx
from weftline.operators import diffs
from weftline.plans.catalogue import RRF, TERMS, _probe, query
from weftline.plans.hybrid import hybrid_search
from weftline.sources import readers
from weftline.sources.tables import files, table


# The patches that lead from each document to the one after it give that one's text.
@query("SELECT a.doc_id, 'ok' AS patch_status, md5(coalesce(b.text, '')) AS text_md5 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE coalesce(a.text, '') <> coalesce(b.text, '')")
def patched_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("old"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("old").alias("new")), "doc_id")
    patches = diffs.line_diffs(pairs, "doc_id").select("doc_id", F.inline("hunks"))
    out = diffs.patched(docs.withColumnRenamed("old", "text"), patches, "doc_id")
    return out.where("patch_status <> 'none'").select("doc_id", "patch_status", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


@query("SELECT doc_id, (length(left(text, doc_id * 37 % (length(text) + 1))) - length(replace(left(text, doc_id * 37 % (length(text) + 1)), chr(10), '')) + 1)::INT AS line FROM documents WHERE text IS NOT NULL")
def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    offset = (F.col("doc_id") * 37 % (F.length("text") + 1)).cast("int")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", fx.line_of(F.col("text"), offset).cast("int").alias("line"))


_SNAKE = "lower(regexp_replace(regexp_replace({t}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'))"
_CAMEL = "array_to_string(list_transform(string_split(lower({t}), '_'), lambda p, i: CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || p[2:] ELSE '_' || p END), '')"
_BARE = "lower(translate({t}, '._-', ''))"
_VARIANTS = f"[lower(t), nullif({_BARE}, lower(t)), CASE WHEN regexp_matches(t, '[a-z][A-Z]') THEN {_SNAKE} END, CASE WHEN contains(t, '_') THEN {_CAMEL} END]".replace("{t}", "t")


# Questions from the first words of each document, with names as programmers write them.
@query(
    rf"""WITH q AS (SELECT doc_id, concat(left(text, 40), ' getUser', upper(lang), 'Name', doc_id % 50, ' and snake_', source, '_case.', lang, ' (NOT "x') AS q FROM documents),
    c AS (SELECT doc_id, q, trim(regexp_replace(regexp_replace(regexp_replace(q, '[():"*^./\\:@#$%&=+\[\]{{}}<>|~`!?,;]', ' ', 'g'), '(?i)\b(AND|OR|NOT|NEAR)\b', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM q),
    t AS (SELECT doc_id, unnest(list_concat(list_filter(string_split_regex(q, '\s+'), lambda t: regexp_matches(t, '[._/]') OR regexp_matches(t, '[a-z][A-Z]')), regexp_extract_all(clean, '[\p{{L}}\p{{N}}_]+'))) AS t FROM c),
    v AS (SELECT doc_id, unnest({_VARIANTS}) AS v FROM t) SELECT doc_id, array_to_string(list_sort(list(DISTINCT v)), ' ') AS tokens FROM v WHERE v IS NOT NULL AND v <> '' GROUP BY doc_id"""
)
def question_words(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.concat(F.left("text", F.lit(40)), F.lit(" getUser"), F.upper("lang"), F.lit("Name"), (F.col("doc_id") % 50).cast("string"), F.lit(" and snake_"), "source", F.lit("_case."), "lang", F.lit(' (NOT "x'))
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", fx.query_tokens(asked).alias("t"))
    return rows.select("doc_id", F.array_join(F.array_sort(F.filter("t", lambda x: x != "")), " ").alias("tokens"))


_CHOSEN = RRF.replace("FROM documents)", "FROM documents WHERE lang IN ('de', 'fr'))", 1).replace("FROM dist QUALIFY", "FROM dist WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')) QUALIFY")


@query(
    f"""WITH {_CHOSEN}, top AS (SELECT f.doc_id, score, src, source FROM fused f JOIN documents USING (doc_id) ORDER BY score DESC, f.doc_id LIMIT 60)
    SELECT doc_id, round(score, 6) AS score, src AS source FROM top QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 5"""
)
def hybrid_search_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The languages hold before recall, for both lists and for the counts of the terms."""
    rows = files(spark, sf).withColumn("source_name", F.substring_index("path", "/", 1))
    found = hybrid_search(rows, table(spark, sf, "embeddings").select("vec_id", "embedding"), _probe(spark, sf), TERMS, languages=["de", "fr"])
    return found.select("doc_id", F.round("score", 6).alias("score"), "source")


# Sentences by character set; a file has two of its set and its document's number.
SENTENCES = {
    "cp1251": ["Сегодня утром на улице было очень холодно", "Программа читает файл и выводит результат", "Он сказал, что вернётся через два часа", "Эта функция возвращает список всех имён"], "koi8_r": ["Мы работаем над новой версией системы", "Проверь, пожалуйста, настройки сервера", "Каждый день приносит что-то новое", "Ошибка в третьей строке исходного текста"],
    "shift_jis": ["これは設定ファイルの読み込みに使う関数です", "今日はとても寒いので家にいました", "エラーが発生した場合は再起動してください", "新しい機能を追加しました"], "euc_jp": ["この関数はリストの長さを返します", "ユーザーの名前を入力してください", "データベースに接続できませんでした", "彼は昨日東京へ行きました"],
    "gb18030": ["这个函数返回所有用户的列表", "今天天气很好我们去公园玩", "如果文件不存在就创建一个新的文件", "他说他明天会来看我们"], "big5": ["這個函數會返回所有使用者的列表", "今天天氣很好我們去公園玩", "如果檔案不存在就建立一個新的", "他說他明天會來看我們"],
    "euc_kr": ["이 함수는 모든 사용자의 목록을 반환합니다", "오늘은 날씨가 아주 좋습니다", "파일이 없으면 새로 만들어 주세요", "서버에 연결할 수 없습니다"], "cp1252": ["Die Änderung wurde für alle Größen übernommen", "L’été dernier, nous étions très fatigués", "El niño preguntó cuándo volvería mañana", "Das Ergebnis muß später geprüft werden"],
}
_SETS = list(SENTENCES)


@query(
    "WITH s AS (SELECT doc_id, CASE doc_id % 8 "
    + " ".join(f"WHEN {k} THEN [{', '.join(repr(x) for x in SENTENCES[name])}]" for k, name in enumerate(_SETS))
    + " END AS x FROM documents) SELECT doc_id, md5(x[doc_id // 8 % 4 + 1] || ' x' || doc_id || chr(10) || x[doc_id // 32 % 4 + 1]) AS text_md5 FROM s"
)
def decoded_charsets(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda by: F.element_at(F.array(*[F.array(*[F.lit(x.encode(name).hex()) for x in SENTENCES[name]]) for name in _SETS])[(d % 8).cast("int")], (F.floor(d / by) % 4 + 1).cast("int"))
    own = F.hex(F.encode(F.concat(F.lit(" x"), d.cast("string"), F.lit("\n")), "utf-8"))
    rows = table(spark, sf, "documents").select("doc_id", F.unhex(F.concat(pick(8), own, pick(32))).alias("raw"))
    return rows.select("doc_id", F.md5(F.encode(readers.decoded(F.col("raw")), "utf-8")).alias("text_md5"))
