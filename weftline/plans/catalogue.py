"""Every query over the input tables, and its SQL.

Numbers that are sums of floating-point parts are rounded to six places on both
sides, since the order of adding differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as fx
from weftline.operators import access, analytics, chunking, context, filters, graph, indexing, reports, retrieval
from weftline.plans.hybrid import hybrid_search
from weftline.plans.lineage import written
from weftline.sources.readers import embedding_misses
from weftline.sources.tables import files, ledger, table
from weftline.streaming.sessions import sessions, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The terms that the lexical queries ask for, and path patterns.
TERMS = ["thion", "license", "ering"]
INCLUDE, EXCLUDE = ["**/doc_*.en", "**/doc_*.d?"], ["src1/*"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FILES = "files AS (SELECT doc_id, source || '/doc_' || doc_id || '.' || lang AS path, sha256(text) AS hash, strlen(text)::BIGINT AS size, lang AS language, source, text AS content FROM documents)"


def _tf(field: str, term: str) -> str:
    return f"((length({field}) - length(replace({field}, '{term}', ''))) / {len(term)})::INT"


def _bm25_sql(weighted: dict[str, float], source: str, key: str, terms: list[str] = TERMS) -> str:
    """CTE ``scored(key, score, matched_all)`` over ``source``."""
    tf = ", ".join(f"{' + '.join(f'{w} * {_tf(f, t)}' for f, w in weighted.items())} AS tf{k}" for k, t in enumerate(terms))
    size = " + ".join(f"greatest(length({f}) - 2, 0)" for f in weighted)
    stats = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    idf = lambda k: f"(CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) > 0 THEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) ELSE 1e-6 END)"
    parts = " + ".join(f"{idf(k)} * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * size / mean))" for k in range(len(terms)))
    return (
        f"counted AS (SELECT *, {tf}, {size} AS size_ FROM {source}), counted2 AS (SELECT * EXCLUDE (size_), size_ AS size FROM counted), "
        f"stats AS (SELECT count(*)::DOUBLE AS n, avg(size)::DOUBLE AS mean, {stats} FROM counted2), "
        f"scored AS (SELECT {key}, ({parts})::DOUBLE AS score, {' AND '.join(f'tf{k} > 0' for k in range(len(terms)))} AS matched_all FROM counted2, stats WHERE {' OR '.join(f'tf{k} > 0' for k in range(len(terms)))})"
    )


LOWERED = "low AS (SELECT doc_id, lang, source, lower(coalesce(text, '')) AS body FROM documents)"
BM25 = f"{LOWERED}, {_bm25_sql({'body': 1.0}, 'low', 'doc_id, lang, source')}"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), TERMS, {"text": 1.0})


def _probe(spark: SparkSession, sf: str) -> DataFrame:
    """The vector that the vector queries ask for: that of the least id."""
    return table(spark, sf, "embeddings").orderBy("vec_id").limit(1)


DISTANCES = "probe AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), dist AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::DOUBLE AS distance FROM embeddings, probe)"


@query(f"WITH {DISTANCES} SELECT vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score, (row_number() OVER (ORDER BY distance, vec_id) - 1)::INT AS rank FROM dist ORDER BY distance, vec_id LIMIT 80")
def knn_l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.nearest(table(spark, sf, "embeddings").select("vec_id", "embedding"), _probe(spark, sf), 80)
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def bm25_doc_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {BM25}, strict AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM scored WHERE matched_all QUALIFY k <= 20),
    missing AS (SELECT 20 - count(*) AS m FROM strict), relaxed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM scored),
    fill AS (SELECT r.*, row_number() OVER (ORDER BY r.score DESC, r.doc_id) AS f FROM relaxed r, missing WHERE m > 0 AND r.k <= m + 10 AND r.doc_id NOT IN (SELECT doc_id FROM strict))
    SELECT doc_id, round(score, 6) AS score, matched_all FROM strict UNION ALL SELECT doc_id, round(score, 6), matched_all FROM fill, missing WHERE f <= m"""
)
def bm25_strict_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.strict_then_relaxed(_scored(spark, sf).select("doc_id", "score", "matched_all"), 20, "doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"), "matched_all")


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scored WHERE lang IN (SELECT DISTINCT lang FROM documents WHERE lang IN ('de', 'fr')) ORDER BY score DESC, doc_id LIMIT 20")
def lexical_language_filter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id")
    return _scored(spark, sf).join(wanted, "doc_id", "left_semi").orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


OVERLAP = " + ".join(f"(CASE WHEN contains(lower(text), '{t}') THEN CASE WHEN regexp_matches(lower(text), '\\b{t}\\b') THEN 1.0 ELSE 0.5 END ELSE 0.0 END)" for t in ("the", "license", "token", "er"))


@query(f"SELECT doc_id, ({OVERLAP})::DOUBLE AS overlap FROM documents")
def token_overlap_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.token_overlap(F.col("text"), ["the", "license", "token", "er"]).alias("overlap"))


RRF = f"""{BM25}, {DISTANCES}, lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM scored QUALIFY rank < 80),
    vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM dist QUALIFY rank < 80),
    fused AS (SELECT doc_id, sum(part)::DOUBLE AS score, CASE WHEN count(DISTINCT src) > 1 THEN 'both' ELSE min(src) END AS src FROM (SELECT doc_id, 0.6::DOUBLE / (20 + rank) AS part, 'vector' AS src FROM vec UNION ALL SELECT doc_id, 0.4::DOUBLE / (20 + rank), 'lexical' FROM lex) GROUP BY doc_id)"""


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lexical = retrieval.ranked(_scored(spark, sf).select("doc_id", "source", "score"), 80, F.col("score").desc(), "doc_id")
    vector = retrieval.nearest(table(spark, sf, "embeddings").select("vec_id", "embedding"), _probe(spark, sf), 80).withColumnRenamed("vec_id", "doc_id")
    return vector, lexical


@query(f"WITH {RRF} SELECT doc_id, round(score, 6) AS score, src AS source FROM fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    vector, lexical = _lists(spark, sf)
    return retrieval.hybrid(vector, lexical, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"), "source")


@query(f"WITH {BM25} SELECT doc_id, source, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 5")
def per_file_cap(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.per_group_cap(_scored(spark, sf), "source", 5, F.col("score").desc(), "doc_id").select("doc_id", "source", F.round("score", 6).alias("score"))


_GENERATED = "|".join(f"(?:{p})" for p in fx.GENERATED)


@query(f"WITH p AS (SELECT page_id, coalesce(url, '') || CASE page_id % 4 WHEN 0 THEN '/vendor/a.go' WHEN 1 THEN '/api.pb.go' WHEN 2 THEN '/main.go' ELSE '' END AS path FROM pages) SELECT page_id, CASE WHEN regexp_matches(replace(path, chr(92), '/'), '{_GENERATED}') THEN round(page_id * 0.3, 6) ELSE page_id::DOUBLE END AS score FROM p")
def generated_file_penalty(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(e) for e in ("/vendor/a.go", "/api.pb.go", "/main.go", "")]), (F.col("page_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.coalesce("url", F.lit("")), ends).alias("path"))
    return rows.select("page_id", F.round(fx.generated_penalty(F.col("path"), F.col("page_id").cast("double")), 6).alias("score"))


@query(
    f"""WITH {DISTANCES}, s AS (SELECT vec_id, 1 / (1 + distance) AS score FROM dist), top AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS k FROM s QUALIFY k <= 8),
    m AS (SELECT *, max(score) OVER () AS best FROM top), g AS (SELECT *, CASE WHEN k <= 2 THEN score >= 0.25 ELSE score >= greatest(0.25, least(best * 0.5, best - 0.25)) END AS good FROM m)
    SELECT vec_id, round(score, 6) AS score FROM (SELECT *, bool_and(good) OVER (ORDER BY k) AS lead_ FROM g) WHERE CASE WHEN best < 0.25 THEN k = 1 ELSE lead_ END"""
)
def smart_topk_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.nearest(table(spark, sf, "embeddings").select("vec_id", "embedding"), _probe(spark, sf), 80)
    return retrieval.smart_cutoff(found, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {RRF.replace("FROM dist QUALIFY", "FROM dist WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY")}, top AS (SELECT f.doc_id, score, src, source FROM fused f JOIN documents USING (doc_id) ORDER BY score DESC, f.doc_id LIMIT 60)
    SELECT doc_id, round(score, 6) AS score, src AS source FROM top QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 5"""
)
def hybrid_search_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf).withColumn("source_name", F.substring_index("path", "/", 1))
    found = hybrid_search(rows, table(spark, sf, "embeddings").select("vec_id", "embedding"), _probe(spark, sf), TERMS)
    return found.select("doc_id", F.round("score", 6).alias("score"), "source")


# Lines are numbered and folded one after the other, as the operator folds them.
CHUNKS = """WITH RECURSIVE lines AS (SELECT doc_id, source, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    sized AS (SELECT doc_id, source, i, length(line) AS chars, length(translate(line, ' ' || chr(9) || chr(10) || chr(13), '')) AS nws FROM lines),
    fold AS (SELECT doc_id, source, i, 0 AS c, 0 AS start_, chars AS end_, nws AS used FROM sized WHERE i = 1
      UNION ALL SELECT s.doc_id, s.source, s.i, CASE WHEN used + nws > 700 THEN c + 1 ELSE c END, CASE WHEN used + nws > 700 THEN end_ + 1 ELSE start_ END, end_ + 1 + chars, CASE WHEN used + nws > 700 THEN nws ELSE used + nws END
      FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
    ends AS (SELECT doc_id, max(end_) AS whole FROM fold GROUP BY doc_id),
    chunks AS (SELECT f.doc_id, any_value(f.source) AS source, c AS chunk_index, any_value(start_) AS raw_start, max(end_)::INT AS end_index, (CASE WHEN max(end_) = any_value(whole) THEN any_value(whole) ELSE max(end_) + 1 END)::INT AS raw_end, max(used) AS nws_size FROM fold f JOIN ends USING (doc_id) GROUP BY f.doc_id, c)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    return chunking.line_chunks(docs, keep=("doc_id", "source"))


@query(f"{CHUNKS} SELECT doc_id, chunk_index, raw_start, end_index, raw_end, nws_size::INT AS nws_size FROM chunks")
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("doc_id", "chunk_index", "raw_start", "end_index", "raw_end", "nws_size")


@query(
    """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS names FROM documents), u AS (SELECT doc_id, unnest(names) AS w FROM t),
    v AS (SELECT doc_id, w AS t FROM u UNION SELECT doc_id, lower(w) FROM u UNION SELECT doc_id, lower(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')) FROM u WHERE regexp_matches(w, '[a-z][A-Z]'))
    SELECT d.doc_id, count(v.t) AS n_symbols, md5(coalesce(string_agg(v.t, ' ' ORDER BY v.t), '')) AS symbols FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id AND NOT contains(v.t, '__none__') GROUP BY d.doc_id"""
)
def fts_doc_symbols(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.array_sort(fx.symbol_tokens(F.coalesce("text", F.lit("")))).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_symbols"), F.md5(F.encode(F.array_join("s", " "), "utf-8")).alias("symbols"))


# Seeds of the expansion queries: of each document, the chunk whose number is the id's remainder by 3.
SEEDS = "seeds AS (SELECT doc_id, chunk_index, 1.0::DOUBLE / (1 + chunk_index) AS score FROM chunks WHERE chunk_index = doc_id % 3)"


def _seeds(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("chunk_index") == F.col("doc_id") % 3).select("doc_id", "chunk_index", (1.0 / (1 + F.col("chunk_index"))).alias("score"), F.lit("vector").alias("source"))


@query(
    f"""{CHUNKS}, {SEEDS}, near AS (SELECT c.doc_id, c.chunk_index, abs(c.chunk_index - s.chunk_index) AS d, s.score FROM chunks c JOIN seeds s ON c.doc_id = s.doc_id AND abs(c.chunk_index - s.chunk_index) BETWEEN 1 AND 2)
    SELECT doc_id, chunk_index, round(score * pow(0.8, d), 6) AS score FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY d, score DESC) = 1"""
)
def neighbor_expand(spark: SparkSession, sf: str) -> DataFrame:
    chunks = written(_chunks(spark, sf), "chunks")
    return context.neighbours(_seeds(chunks), chunks, 2, "doc_id").select("doc_id", "chunk_index", F.round("score", 6).alias("score"))


@query(
    f"""{CHUNKS}, {SEEDS}, best AS (SELECT doc_id, max(score) AS best FROM seeds GROUP BY doc_id), rest AS (SELECT c.doc_id, c.chunk_index, best FROM chunks c JOIN best USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.doc_id = c.doc_id AND s.chunk_index = c.chunk_index))
    SELECT doc_id, chunk_index, round(best * 0.7, 6) AS score FROM rest QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) <= 3"""
)
def breadcrumb_expand(spark: SparkSession, sf: str) -> DataFrame:
    chunks = written(_chunks(spark, sf).withColumn("breadcrumb", F.concat_ws(" > ", "source", F.col("doc_id").cast("string"), F.concat(F.lit("chunk "), F.col("chunk_index").cast("string")))), "chunks")
    return context.siblings(_seeds(chunks), chunks, 3, "doc_id").select("doc_id", "chunk_index", F.round("score", 6).alias("score"))


@query(
    f"""{CHUNKS}, {SEEDS}, near AS (SELECT c.doc_id, c.chunk_index, s.score * 0.8 AS score FROM chunks c JOIN seeds s ON c.doc_id = s.doc_id AND abs(c.chunk_index - s.chunk_index) = 1), later AS (SELECT c.doc_id, c.chunk_index, s.score * 0.7 AS score FROM chunks c JOIN seeds s ON c.doc_id = s.doc_id AND c.chunk_index <> s.chunk_index QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY c.chunk_index) <= 4),
    every AS (SELECT *, 0 AS step FROM seeds UNION ALL SELECT *, 1 FROM near UNION ALL SELECT *, 2 FROM later), picked AS (SELECT e.doc_id, e.chunk_index, raw_start, raw_end, score FROM every e JOIN chunks USING (doc_id, chunk_index) QUALIFY row_number() OVER (PARTITION BY e.doc_id, e.chunk_index ORDER BY step) = 1),
    f AS (SELECT *, max(raw_end) OVER (PARTITION BY doc_id ORDER BY raw_start, raw_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM picked),
    g AS (SELECT *, sum(CASE WHEN raw_start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY raw_start, raw_end ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT doc_id, min(raw_start) AS raw_start, max(raw_end) AS raw_end, round(max(score), 6) AS score, count(*) AS n_chunks FROM g GROUP BY doc_id, island"""
)
def interval_merge_pack(spark: SparkSession, sf: str) -> DataFrame:
    chunks = written(_chunks(spark, sf).withColumn("breadcrumb", F.concat_ws(" > ", "source", F.concat(F.lit("chunk "), F.col("chunk_index").cast("string")))), "chunks")
    seeds = _seeds(chunks)
    every = context.expanded(seeds, context.neighbours(seeds, chunks, 1, "doc_id"), context.siblings(seeds, chunks, 4, "doc_id"), file="doc_id")
    picked = every.drop("source").join(chunks.select("doc_id", "chunk_index", "raw_start", "raw_end", "breadcrumb"), ["doc_id", "chunk_index"])
    return context.merged_segments(picked, "doc_id").select("doc_id", "raw_start", "raw_end", F.round("score", 6).alias("score"), "n_chunks")


@query(
    f"""{CHUNKS}, best AS (SELECT *, 1.0 / (1 + chunk_index) AS score, raw_end - raw_start AS size FROM chunks), top AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, raw_start) <= 3),
    o AS (SELECT *, row_number() OVER (ORDER BY mx DESC, doc_id, raw_start) AS k FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS mx FROM top)),
    w AS (SELECT k, doc_id, chunk_index, CASE WHEN size <= 48000 THEN size ELSE 0 END AS used, size > 48000 AS stopped, size <= 48000 AS fits FROM o WHERE k = 1
      UNION ALL SELECT o.k, o.doc_id, o.chunk_index, w.used + CASE WHEN w.used < 48000 AND NOT (w.stopped AND o.doc_id = w.doc_id) AND w.used + o.size <= 48000 THEN o.size ELSE 0 END,
        (w.stopped AND o.doc_id = w.doc_id) OR NOT (w.used < 48000 AND NOT (w.stopped AND o.doc_id = w.doc_id) AND w.used + o.size <= 48000), w.used < 48000 AND NOT (w.stopped AND o.doc_id = w.doc_id) AND w.used + o.size <= 48000
      FROM w JOIN o ON o.k = w.k + 1)
    SELECT doc_id, chunk_index FROM w WHERE fits"""
)
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chunks(spark, sf).withColumn("score", 1.0 / (1 + F.col("chunk_index")))
    return context.packed(rows.select("doc_id", "chunk_index", "raw_start", "raw_end", "score"), 3, 48_000, "doc_id").select("doc_id", "chunk_index")


@query("WITH n AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT conv_id, role, min(turn) AS run_start, max(turn) AS run_end, count(*) AS n FROM r GROUP BY conv_id, run, role")
def raw_block_runs(spark: SparkSession, sf: str) -> DataFrame:
    return context.runs(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "role", "run_start", "run_end", "n")


BEFORE = "b AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE hash END AS hash FROM files WHERE doc_id % 11 <> 0)"
NOW = "n AS (SELECT path, hash FROM files WHERE doc_id % 13 <> 0)"


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of all files: the later lacks some of the earlier one's and has others."""
    every = files(spark, sf).select("doc_id", "path", "hash")
    before = every.where("doc_id % 11 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash")))
    return before.drop("doc_id"), every.where("doc_id % 13 <> 0").drop("doc_id")


@query(f"WITH {FILES}, {BEFORE}, {NOW} SELECT coalesce(b.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'added' WHEN b.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status FROM b FULL JOIN n ON b.path = n.path")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.snapshot_diff(*_snapshots(spark, sf))


@query(f"WITH {FILES}, {BEFORE}, {NOW}, d AS (SELECT CASE WHEN n.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'added' WHEN b.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS s FROM b FULL JOIN n ON b.path = n.path) SELECT count(*) AS total, count(*) FILTER (s = 'added') AS added, count(*) FILTER (s = 'modified') AS modified, count(*) FILTER (s = 'unchanged') AS unchanged, count(*) FILTER (s = 'deleted') AS deleted FROM d")
def scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.scan_counts(indexing.snapshot_diff(*_snapshots(spark, sf)))


@query(f"WITH {FILES} SELECT path FROM files WHERE (CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'stale' ELSE hash END) IS DISTINCT FROM hash")
def self_heal_set(spark: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("doc_id") % 5 == 1, "stale").when(F.col("doc_id") % 5 != 0, F.col("hash"))
    return indexing.to_heal(files(spark, sf).withColumn("vector_index_hash", known)).select("path")


@query(f"WITH {FILES}, {BEFORE}, {NOW} SELECT path, hash FROM b WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, hash FROM n")
def upsert_files(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.upsert(*_snapshots(spark, sf))


@query("WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels UNION SELECT -1 - vec_id FROM embeddings) SELECT doc_id AS chunk_id, 'text' AS missing_in FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'vector' FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a)")
def index_consistency(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    other = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")).unionByName(table(spark, sf, "embeddings").select((-1 - F.col("vec_id")).alias("chunk_id")))
    return indexing.consistency(vectors, other)


EVENTS = "ev AS (SELECT conv_id, turn, 'where is the licence of ' || coalesce(regexp_extract(text, '[A-Za-z]+'), '') AS text, (turn % 3)::INT AS seed_count FROM conversations WHERE role = 'user'), tok AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS t FROM ev), prev AS (SELECT *, lag(t) OVER w AS p, lag(seed_count) OVER w AS s FROM tok WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), sig AS (SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(p, t))) = 0 THEN 0.0 ELSE len(list_intersect(p, t))::DOUBLE / len(list_distinct(list_concat(p, t))) END AS similarity FROM prev WHERE s = 0)"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as retrieval events that ask for the licence of their first word; the number of hits is the turn's remainder by 3."""
    rows = table(spark, sf, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.concat(F.lit("where is the licence of "), F.coalesce(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(""))).alias("text"), (F.col("turn") % 3).cast("int").alias("seed_count"))


@query(f"WITH {EVENTS} SELECT conv_id, turn, -0.6::DOUBLE AS weight, round(similarity, 4) AS similarity FROM sig WHERE similarity >= 0.4")
def feedback_signals(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.rewrite_signals(_asked(spark, sf), "conv_id", "turn").select("conv_id", "turn", "weight", "similarity")


# A pin: the previous user turn of a conversation had a file whose stem stands in this turn's text.
PINS = "words AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user'), had AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))[1:0] AS none, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}'))) AS stem FROM conversations WHERE role = 'user'), pin AS (SELECT w.conv_id, w.turn, h.stem, list_contains(regexp_extract_all(w.text, '[a-z0-9_]+'), h.stem) AS token FROM words w JOIN had h ON h.conv_id = w.conv_id AND h.turn = w.before WHERE contains(w.text, h.stem))"


def _pins(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    events = asked.withColumn("before", before).select("conv_id", "turn", key.alias("event_id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("before").cast("string")).alias("previous_id"), "text")
    stems = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), 1)))
    chunks = asked.select(key.alias("event_id"), stems.alias("stem")).select("event_id", F.concat(F.lit("src/"), "stem", F.lit(".ts")).alias("file_path"), F.lit(0).alias("chunk_index"))
    found = analytics.pin_signals(events.drop("conv_id", "turn"), chunks)
    return found.withColumn("conv_id", F.substring_index("event_id", "/", 1).cast("long"))


@query(f"WITH {PINS} SELECT conv_id, 'src/' || stem || '.ts' AS file_path, CASE WHEN token THEN 'token' ELSE 'text' END AS matched_by, count(*) AS n FROM pin GROUP BY ALL")
def feedback_path_pins(spark: SparkSession, sf: str) -> DataFrame:
    return _pins(spark, sf).groupBy("conv_id", "file_path", "matched_by").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PINS} SELECT 'src/' || stem || '.ts' AS file_path, count(*) AS hits, count(*)::DOUBLE AS weight FROM pin GROUP BY stem ORDER BY weight DESC, hits DESC, file_path LIMIT 10")
def feedback_top_files(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.top_files(_pins(spark, sf)).select("file_path", "hits", "weight")


@query(f"WITH {EVENTS}, e AS (SELECT count(*) AS total_events, count(*) FILTER (seed_count = 0) AS zero_hit_events FROM ev), r AS (SELECT count(DISTINCT (conv_id, turn)) AS rewritten_events FROM sig WHERE similarity >= 0.4) SELECT total_events, zero_hit_events, rewritten_events, round(CASE WHEN total_events = 0 THEN 0 ELSE zero_hit_events / total_events END, 6) AS zero_hit_rate, round(CASE WHEN total_events = 0 THEN 0 ELSE rewritten_events / total_events END, 6) AS rewrite_rate FROM e, r")
def feedback_summary(spark: SparkSession, sf: str) -> DataFrame:
    asked = _asked(spark, sf).withColumn("created_at", F.lit(0).cast("long"))
    signals = analytics.rewrite_signals(asked, "conv_id", "turn").select("signal", F.struct("conv_id", "turn").alias("source_event_id"), F.lit(0).cast("long").alias("created_at"))
    return analytics.feedback_summary(asked, signals).select("total_events", "zero_hit_events", "rewritten_events", F.round("zero_hit_rate", 6).alias("zero_hit_rate"), F.round("rewrite_rate", 6).alias("rewrite_rate"))


LEDGER = "k AS (SELECT *, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS n FROM events), led AS (SELECT event_id, 's' || user_id AS session_id, event_type AS bucket, ['opus', 'sonnet', 'haiku', 'gpt-4o', 'gemini-1.5-pro', 'unpriced'][(n % 6 + 1)::INT] AS model, epoch_us(ts) // 1000 AS ts_ms, floor(value * 10)::BIGINT AS tokens_saved FROM k), prices AS (SELECT * FROM (VALUES ('opus', 15000), ('sonnet', 3000), ('haiku', 250), ('gpt-4o', 2500), ('gemini-1.5-pro', 1250)) p(model, rate)), ledger AS (SELECT led.*, tokens_saved * coalesce(rate, 0)::BIGINT AS nano FROM led LEFT JOIN prices USING (model))"


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.with_cost(ledger(spark, sf), "tokens_saved", out="dollars_saved")


@query(f"WITH {LEDGER} SELECT coalesce(sum(tokens_saved), 0)::BIGINT AS tokens_saved, coalesce(sum(nano), 0)::BIGINT / 1e9::DOUBLE AS dollars_saved, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, count(DISTINCT session_id) AS sessions FROM ledger")
def savings_summary(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.savings_summary(_ledger(spark, sf))


def _by_sql(column: str) -> str:
    return f"WITH {LEDGER} SELECT {column}, sum(tokens_saved)::BIGINT AS tokens_saved, sum(nano)::BIGINT / 1e9::DOUBLE AS dollars_saved, count(*) AS queries, CASE WHEN sum(sum(tokens_saved)) OVER () > 0 THEN floor(sum(tokens_saved)::DOUBLE / (sum(sum(tokens_saved)) OVER ())::DOUBLE * 100 + 0.5)::BIGINT ELSE 0 END AS percentage FROM ledger GROUP BY {column}"


@query(_by_sql("bucket"))
def savings_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.savings_by(_ledger(spark, sf), "bucket")


@query(_by_sql("model"))
def savings_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.savings_by(_ledger(spark, sf), "model")


@query(f"WITH {LEDGER}, s AS (SELECT 's' || c_custkey AS session_id, c_custkey * 1000 AS started_at FROM customer) SELECT s.session_id, any_value(started_at) AS started_at, count(l.event_id) AS events, coalesce(sum(tokens_saved), 0)::BIGINT AS tokens_saved FROM s LEFT JOIN ledger l USING (session_id) GROUP BY s.session_id")
def session_list(spark: SparkSession, sf: str) -> DataFrame:
    sessions_ = table(spark, sf, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session_id"), (F.col("c_custkey") * 1000).alias("started_at"))
    return analytics.sessions_with_counts(sessions_, _ledger(spark, sf), None)


_TOKENS = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE ceil(length(text) / CASE WHEN (length(text) - length(translate(text, '{}()[];,.<>', '')))::DOUBLE / length(text) > 0.05 THEN 3.5::DOUBLE ELSE 4.0::DOUBLE END)::BIGINT END"


@query(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.estimated_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT role, sum({_TOKENS})::BIGINT AS tokens, (sum({_TOKENS})::BIGINT * CASE role WHEN 'user' THEN 3000 ELSE 15000 END) / 1e9::DOUBLE AS cost FROM conversations GROUP BY role")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "conversations").groupBy("role").agg(F.sum(fx.estimated_tokens(F.col("text"))).alias("tokens")).withColumn("model", F.lit("sonnet"))
    both = analytics.with_cost(analytics.with_cost(sums, "tokens", "input", out="_in"), "tokens", "output", out="_out")
    return both.select("role", "tokens", F.when(F.col("role") == "user", F.col("_in")).otherwise(F.col("_out")).alias("cost"))


@query(f"WITH {FILES} SELECT language, count(*) AS files, count(DISTINCT hash) AS contents, sum(size)::BIGINT AS bytes FROM files GROUP BY language")
def language_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("hash").alias("contents"), F.sum("size").alias("bytes"))


# Evaluation: each label is a case; what is relevant has the label, with gain 1 + id % 3; ranks are by distance to the probe.
CASES = f"{DISTANCES}, ranked AS (SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM dist QUALIFY rank <= 200), rel AS (SELECT label AS case_id, vec_id AS item, (1 + vec_id % 3)::DOUBLE AS gain, row_number() OVER (PARTITION BY label ORDER BY 1 + vec_id % 3 DESC, vec_id) AS ideal FROM embeddings WHERE label IS NOT NULL), j AS (SELECT rel.*, rank FROM rel LEFT JOIN ranked ON item = vec_id)"
_AT = ", ".join(f"round(count(*) FILTER (rank <= {k}) / count(*), 6) AS recall_{k}, round(coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= {k}), 0) / sum(gain / log2(ideal + 1)) FILTER (ideal <= {k}), 6) AS ndcg_{k}" for k in (10, 50))


@query(f"WITH {CASES} SELECT case_id, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr, {_AT} FROM j GROUP BY case_id")
def eval_recall_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    retrieved, relevant = _cases(spark, sf)
    found = analytics.ranking_metrics(retrieved, relevant, [10, 50], ["case_id"])
    return found.select("case_id", *[F.round(c, 6).alias(c) for c in ("rr", "recall_10", "ndcg_10", "recall_50", "ndcg_50")])


def _cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings")
    near = retrieval.nearest(vectors.select("vec_id", "embedding"), _probe(spark, sf), 200).select(F.col("vec_id").alias("item"), F.col("rank").alias("pos"))
    relevant = vectors.where("label is not null").select(F.col("label").alias("case_id"), F.col("vec_id").alias("item"), (1 + F.col("vec_id") % 3).cast("double").alias("gain"))
    return relevant.select("case_id").distinct().crossJoin(F.broadcast(near)), relevant  # 200 rows


# Tuning: the same cases; the lexical list is by id, descending.
TUNE = f"""{DISTANCES}, params AS (SELECT w AS w_vec, round(1 - w, 6) AS w_lex, k0, m AS top_m FROM (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) a(w), (VALUES (10), (20), (40)) b(k0), (VALUES (40), (60)) c(m)),
    lists AS (SELECT vec_id AS item, row_number() OVER (ORDER BY distance, vec_id) - 1 AS pos, 'v' AS ch FROM dist QUALIFY pos < 100 UNION ALL SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) - 1, 'l' FROM embeddings QUALIFY row_number() OVER (ORDER BY vec_id DESC) <= 100),
    fused AS (SELECT w_vec, w_lex, k0, top_m, item, sum(CASE ch WHEN 'v' THEN w_vec ELSE w_lex END / (k0 + pos)) AS score FROM lists, params GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY w_vec, k0, top_m ORDER BY round(score, 12) DESC, item) AS rank FROM fused QUALIFY rank <= top_m),
    rel AS (SELECT label AS case_id, vec_id AS item FROM embeddings WHERE label IS NOT NULL),
    m AS (SELECT p.w_vec, p.k0, p.top_m, case_id, coalesce(1.0::DOUBLE / min(rank), 0) AS rr, count(*) FILTER (rank <= 10) / count(*) AS r10 FROM rel CROSS JOIN params p LEFT JOIN ranked r ON r.item = rel.item AND r.w_vec = p.w_vec AND r.k0 = p.k0 AND r.top_m = p.top_m GROUP BY ALL)"""


@query(f"WITH {TUNE} SELECT w_vec, k0::INT AS k0, top_m::INT AS top_m, count(*) AS cases, round(avg(rr), 6) AS mrr, round(avg(r10), 6) AS recall_10 FROM m GROUP BY ALL")
def auto_tune_grid(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    near = retrieval.nearest(vectors.select("vec_id", "embedding"), _probe(spark, sf), 100).select(F.col("vec_id").alias("item"), F.col("rank").alias("pos"), F.lit("vector").alias("channel"))
    late = retrieval.ranked(vectors.select(F.col("vec_id").alias("item")), 100, F.col("item").desc()).select("item", F.col("rank").alias("pos"), F.lit("lexical").alias("channel"))
    relevant = vectors.where("label is not null").select(F.col("label").alias("case_id"), F.col("vec_id").alias("item"), F.lit(1.0).alias("gain"))
    lists = relevant.select("case_id").distinct().crossJoin(F.broadcast(near.unionByName(late)))  # 200 rows
    found = analytics.auto_tune(lists, relevant, analytics.grid(spark, **analytics.replay_defaults()), [10])
    return found.select("w_vec", "k0", "top_m", "cases", F.round("mrr", 6).alias("mrr"), F.round("recall_10", 6).alias("recall_10"))


# Impact over the star: supplier depends on nation, nation on region, lineitem's parts on suppliers.
STAR = "e AS (SELECT DISTINCT 'p' || l_partkey AS f, 's' || l_suppkey AS t, 1.0::DOUBLE AS w FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.65::DOUBLE FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.35::DOUBLE FROM nation)"


@query(
    f"""WITH {STAR}, h1 AS (SELECT DISTINCT f AS id, w AS c FROM e WHERE t = 'r0'), h2 AS (SELECT f AS id, max(c * w) AS c FROM h1 JOIN e ON t = id GROUP BY f), h3 AS (SELECT f AS id, max(c * w) AS c FROM h2 JOIN e ON t = id GROUP BY f)
    SELECT 'r0' AS id, 0 AS hop, 1.0::DOUBLE AS score UNION ALL SELECT id, 1, round(c * 0.75, 6) FROM h1 UNION ALL SELECT id, 2, round(c * 0.5625, 6) FROM h2 UNION ALL SELECT id, 3, round(c * 0.421875, 6) FROM h3"""
)
def impact_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.impact(_star(spark, sf), spark.createDataFrame([("r0",)], "id string"), 3, None).select("id", "hop", F.round("score", 6).alias("score"))


def _star(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = table(spark, sf, "lineitem").select(named("p", "l_partkey").alias("from_id"), named("s", "l_suppkey").alias("to_id"), F.lit("high").alias("confidence"))
    suppliers = table(spark, sf, "supplier").select(named("s", "s_suppkey").alias("from_id"), named("n", "s_nationkey").alias("to_id"), F.lit("medium").alias("confidence"))
    nations = table(spark, sf, "nation").select(named("n", "n_nationkey").alias("from_id"), named("r", "n_regionkey").alias("to_id"), F.lit("low").alias("confidence"))
    return parts.unionByName(suppliers).unionByName(nations)


@query("WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 + 1800000 AS end_ms, count(*) AS events FROM s GROUP BY user_id, n")
def session_window_events(spark: SparkSession, sf: str) -> DataFrame:
    found = sessions(table(spark, sf, "events"))
    return found.select("user_id", F.unix_millis("session_start").alias("start_ms"), F.unix_millis("session_end").alias("end_ms"), "events")


@query("SELECT epoch_ms(date_trunc('hour', ts)) AS window_ms, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = windowed_counts(table(spark, sf, "events"))
    return found.select(F.unix_millis("window_start").alias("window_ms"), "event_type", "events", F.round("total", 4).alias("total"))


_ASKED = "SELECT conv_id, turn, coalesce(text, '') || ' lang:' || CASE turn % 3 WHEN 0 THEN 'en' ELSE 'de' END || CASE WHEN turn % 2 = 0 THEN ' path:src' || conv_id % 5 ELSE '' END AS q FROM conversations"


@query(f"WITH q AS ({_ASKED}) SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(q, '(?i)\\b(kind|lang|language|path|name):(\\S+)', 2), lambda v: v), ',') AS field_values, md5(CASE WHEN trim(regexp_replace(regexp_replace(q, '(?i)\\b(kind|lang|language|path|name):(\\S+)', ' ', 'g'), '\\s+', ' ', 'g')) = '' THEN q ELSE trim(regexp_replace(regexp_replace(q, '(?i)\\b(kind|lang|language|path|name):(\\S+)', ' ', 'g'), '\\s+', ' ', 'g')) END) AS natural_md5 FROM q")
def field_filter_parse(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.concat(F.coalesce("text", F.lit("")), F.lit(" lang:"), F.when(F.col("turn") % 3 == 0, "en").otherwise("de"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" path:src"), (F.col("conv_id") % 5).cast("string"))).otherwise(""))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", filters.parsed_query(asked).alias("p"))
    return rows.select("conv_id", "turn", F.array_join(F.concat("p.kind", "p.lang", "p.path", "p.name"), ",").alias("field_values"), F.md5(F.encode("p.natural", "utf-8")).alias("natural_md5"))


@query(f"WITH {FILES} SELECT doc_id, path FROM files WHERE lower(language) IN ('en') AND (contains(lower(path), 'src2') OR contains(lower(path), 'src3'))")
def field_filter_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf).withColumn("breadcrumb", F.col("path"))
    return filters.field_filter(rows, filters.parse_text("text lang:EN path:src2 path:SRC3"), path="path").select("doc_id", "path")


@query(f"WITH {FILES} SELECT doc_id, path FROM files WHERE (regexp_matches(path, '^.*/doc_[^/]*\\.en$') OR regexp_matches(path, '^.*/doc_[^/]*\\.d[^/]$')) AND NOT regexp_matches(path, '^src1/[^/]*$')")
def path_glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where(fx.path_matches(F.col("path"), INCLUDE, EXCLUDE)).select("doc_id", "path")


@query("WITH t AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0) SELECT key FROM t WHERE key NOT IN (SELECT key FROM c WHERE key IS NOT NULL)")
def embedding_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").where("text is not null")
    # entries of documents whose id is divisible by 4 are corrupt: empty, too short, not a number, or null
    bad = F.when(F.col("doc_id") % 16 == 0, F.array().cast("array<float>")).when(F.col("doc_id") % 16 == 4, F.array(F.lit(1.0).cast("float"))).when(F.col("doc_id") % 16 == 8, F.array(F.lit(float("nan")).cast("float"), F.lit(0.5).cast("float")))
    vector = F.when(F.col("doc_id") % 4 == 0, bad).otherwise(F.array(F.lit(0.5).cast("float"), F.col("doc_id").cast("float")))
    cache = texts.where("doc_id % 3 = 0").select(F.md5(F.encode("text", "utf-8")).alias("key"), vector.alias("vector"))
    return embedding_misses(texts.select("text"), cache, width=2).select("key")


@query(
    """WITH RECURSIVE o AS (SELECT source, doc_id, strlen(coalesce(text, ''))::BIGINT AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    b AS (SELECT source, doc_id, k, s AS used, 0 AS batch FROM o WHERE k = 1 UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN b.used + o.s > 50000 THEN o.s ELSE b.used + o.s END, CASE WHEN b.used + o.s > 50000 THEN b.batch + 1 ELSE b.batch END FROM b JOIN o ON o.source = b.source AND o.k = b.k + 1)
    SELECT source, doc_id, batch FROM b"""
)
def greedy_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    return context.greedy_batches(rows, "source", "doc_id", "bytes", 50_000)


@query("WITH h AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?:href|src)=\"([^\"]+)\"', 1)) AS link FROM pages) SELECT page_id, link, count(*) AS n FROM h GROUP BY ALL")
def page_link_edges(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('(?:href|src)="([^"]+)"'), 1)).alias("link"))
    return found.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, round(CASE WHEN p IS NULL OR len(list_distinct(list_concat(p, t))) = 0 THEN 0.0 ELSE len(list_intersect(p, t))::DOUBLE / len(list_distinct(list_concat(p, t))) END, 6) AS similarity FROM (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS t FROM conversations))")
def jaccard_previous_turn(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(fx.word_tokens(F.coalesce("text", F.lit("")))).alias("t"))
    before = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("p", before).select("conv_id", "turn", F.round(F.when(F.col("p").isNull(), 0.0).otherwise(fx.jaccard(F.col("p"), F.col("t"))), 6).alias("similarity"))


@query(f"{CHUNKS} SELECT doc_id, chunk_index, raw_start FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def keyed_chunk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")).join(wanted.distinct(), "doc_id", "left_semi")
    return indexing.file_chunks(chunking.line_chunks(docs, keep=("doc_id",)), wanted, "doc_id").select("doc_id", "chunk_index", "raw_start")


@query(f"{CHUNKS} SELECT count(DISTINCT doc_id) AS files, count(*) AS chunks, coalesce(max(doc_id * 1000), 0) AS last_indexed FROM chunks")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.index_stats(_chunks(spark, sf).withColumn("indexed_at", F.col("doc_id") * 1000), "doc_id")


@query("SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a), 6) AS average FROM events GROUP BY user_id")
def moving_average_by_user(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.moving_average(table(spark, sf, "events"), "user_id", "event_id", "value").withColumn("average", F.round("average", 6))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def commonest_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return reports.first_mode(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query(f"WITH {LEDGER}, s AS (SELECT 's' || c_custkey AS session_id FROM customer) SELECT s.session_id, 99::BIGINT AS ended_at, coalesce(sum(tokens_saved), 0)::BIGINT AS total_tokens_saved, coalesce(sum(nano), 0)::BIGINT / 1e9::DOUBLE AS total_dollars_saved FROM s LEFT JOIN ledger USING (session_id) GROUP BY s.session_id")
def session_end(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session_id"))
    return analytics.ended_sessions(rows, _ledger(spark, sf), 99).select("session_id", "ended_at", "total_tokens_saved", "total_dollars_saved")


TOKENS = "t AS (SELECT o_orderkey AS id, 'u' || o_custkey AS user_id, o_orderstatus <> 'P' AS is_active, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE epoch_us(o_orderdate) // 1000 END AS expires_at, epoch_us(o_orderdate) // 1000 AS last_used_at FROM orders)"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as access tokens: the customer is the user, the date the last use, and the expiry but for urgent ones."""
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"), (F.col("o_orderstatus") != "P").alias("is_active"), F.when(~F.col("o_orderpriority").startswith("1"), at).alias("expires_at"), at.alias("last_used_at")
    )


@query(f"WITH {TOKENS} SELECT id, user_id FROM t WHERE is_active AND (expires_at IS NULL OR expires_at >= 800000000000)")
def valid_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return access.valid_tokens(_tokens(spark, sf), 800_000_000_000).select("id", "user_id")


@query(f"WITH {TOKENS} SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS revoked FROM t")
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return access.token_stats(_tokens(spark, sf))


@query(f"WITH {TOKENS} SELECT user_id, max(last_used_at) AS last_used_at, count(*) AS tokens FROM t WHERE last_used_at IS NOT NULL GROUP BY user_id ORDER BY last_used_at DESC, user_id LIMIT 10")
def recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    return access.recent_activity(_tokens(spark, sf))


@query(f"""{CHUNKS}, parts AS (SELECT doc_id, chunk_index, raw_start, raw_end, chunk_index // 2 AS part FROM chunks), spans AS (SELECT doc_id, part, min(raw_start) AS f, max(raw_end) AS t FROM parts GROUP BY doc_id, part),
    seeds AS (SELECT doc_id, chunk_index, part, 1.0::DOUBLE / (1 + doc_id + chunk_index) AS score FROM parts WHERE chunk_index = doc_id % 3), best AS (SELECT * FROM seeds QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY score DESC, chunk_index) = 1)
    SELECT doc_id, length(substr(text, f + 1, t - f))::INT AS chars, round(score, 6) AS score FROM best JOIN spans USING (doc_id, part) JOIN documents d USING (doc_id) WHERE regexp_matches(substr(text, f + 1, t - f), '\\S') ORDER BY best.score DESC, doc_id, chunk_index LIMIT 20""")
def raw_code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = written(_chunks(spark, sf), "chunks").withColumns({"file_path": F.col("doc_id").cast("string"), "breadcrumb": F.concat(F.lit("part "), F.floor(F.col("chunk_index") / 2).cast("string"))})
    seeds = chunks.where("chunk_index = doc_id % 3").select("file_path", "chunk_index", (1.0 / (1 + F.col("doc_id") + F.col("chunk_index"))).alias("score"), F.lit("vector").alias("source"))
    whole = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    found = reports.raw_blocks(seeds, chunks, whole, 20)
    return found.select(F.col("file_path").cast("long").alias("doc_id"), F.length("text").alias("chars"), F.round("score", 6).alias("score"))


# Registers the queries over source files.
from weftline.plans import catalogue_code, catalogue_edits, catalogue_index, catalogue_source  # noqa: E402, F401
