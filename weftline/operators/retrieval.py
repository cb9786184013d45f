"""Recall, fusion and cut-off of ranked rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import token_overlap
from weftline.plans.lineage import written

# Defaults of the retrieval pipeline and of its BM25 formula.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"symbol_tokens": 6.0, "breadcrumb": 3.0, "body": 1.5, "comments": 0.3}
RRF_K, VECTOR_WEIGHT, LEXICAL_WEIGHT = 20, 0.6, 0.4


def occurrences(text: Column, term: str) -> Column:
    """Occurrences of a lower-case term, overlapping ones too."""
    if any(term[:k] == term[-k:] for k in range(1, len(term))):  # it can overlap itself
        return F.regexp_count(text, F.lit(f"(?=\\Q{term}\\E)"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def bm25(docs: DataFrame, terms: list[str], fields: dict[str, float], every: bool = False) -> DataFrame:
    """Rows that hold a term, with score and matched_all.

    A term is a substring of at least three characters, as in a trigram index, and
    a field's length is its number of trigrams. A shorter term matches nothing, so
    no row then has all terms. The corpus counts are one row of plain numbers, which
    each row is joined with.
    """
    usable = [t.lower() for t in dict.fromkeys(terms) if len(t) >= 3]
    if not usable:
        return docs.withColumns({"score": F.lit(0.0), "matched_all": F.lit(False)}).where(F.lit(False))
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in fields}
    tf = {f"_tf{k}": reduce(lambda a, b: a + b, [F.lit(float(w)) * occurrences(low[c], t) for c, w in fields.items()]) for k, t in enumerate(usable)}
    size = reduce(lambda a, b: a + b, [F.greatest(F.length(low[c]) - 2, F.lit(0)) for c in fields])
    counted = docs.withColumns(tf | {"_size": size})
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_size").alias("_mean"), *[F.count_if(F.col(c) > 0).alias(f"_df{k}") for k, c in enumerate(tf)])
    return bm25_scores(counted, stats, list(tf), len(usable) == len(dict.fromkeys(terms)), every)


def bm25_scores(counted: DataFrame, stats: DataFrame, tf: list[str], all_usable: bool, every: bool) -> DataFrame:
    """Rows with a count of a term, scored; ``stats`` is one row of the number of rows, their mean size and each term's rows."""
    scored = counted.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in tf])).crossJoin(F.broadcast(stats))
    parts = []
    for k, c in enumerate(tf):
        idf = F.log((F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        parts.append(idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("_size") / F.col("_mean"))))
    full = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in tf]) & F.lit(all_usable)
    out = scored.withColumns({"score": reduce(lambda a, b: a + b, parts), "matched_all": full})
    out = out.where("matched_all") if every else out
    return out.drop(*tf, "_size", "_n", "_mean", *[f"_df{k}" for k in range(len(tf))])


def strict_then_relaxed(scored: DataFrame, limit: int, key: str, extra: int = 10) -> DataFrame:
    """Rows with all terms first; if they are fewer than ``limit``, the best others fill up; then by score.

    The relaxed tier takes the best of all rows, as many as are missing and
    ``extra``, so a strict row among them takes a place. The rows that can count, the
    best of each tier, are written, so ``scored`` is computed once.
    """
    best = F.row_number().over(Window.partitionBy("matched_all").orderBy(F.col("score").desc(), key))
    scored = written(scored.withColumn("_best", best).where(F.col("_best") <= limit + extra).drop("_best"), "tiers")
    strict = scored.where("matched_all").orderBy(F.col("score").desc(), key).limit(limit)
    missing = strict.agg((F.lit(limit) - F.count(F.lit(1))).alias("_missing"))
    order = Window.orderBy(F.col("score").desc(), key)
    relaxed = scored.orderBy(F.col("score").desc(), key).limit(limit + extra).withColumn("_k", F.row_number().over(order))
    relaxed = relaxed.crossJoin(F.broadcast(missing)).where((F.col("_missing") > 0) & (F.col("_k") <= F.col("_missing") + extra))
    fill = relaxed.join(strict.select(key), key, "left_anti").withColumn("_r", F.row_number().over(order)).where("_r <= _missing")
    return strict.unionByName(fill.drop("_k", "_r", "_missing")).orderBy(F.col("score").desc(), key)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, d: s + d)


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to the one query vector, with distance (squared), score 1 / (1 + distance) and rank from 0.

    ``query`` has one row, which is broadcast; each task keeps its own k best.
    """
    one = query.select(F.col(vector).alias("_q")).limit(1)
    found = vectors.crossJoin(F.broadcast(one)).withColumn("distance", squared_l2(F.col(vector), F.col("_q"))).drop("_q")
    best = found.orderBy("distance", key).limit(k)
    return best.withColumns({"score": 1 / (1 + F.col("distance")), "rank": F.row_number().over(Window.orderBy("distance", key)) - 1})


def ranked(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows with rank from 0; the limit comes before the window, so the window is small."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def rrf(lists: dict[str, tuple[DataFrame, float]], keys: list[str], k0: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists: keys, score and source (``both`` where several have the row)."""
    parts = [rows.select(*keys, (F.lit(float(w)) / (F.col("rank") + k0)).alias("part"), F.lit(name).alias("source")) for name, (rows, w) in lists.items()]
    fused = reduce(lambda a, b: a.unionByName(b), parts).groupBy(*keys)
    return fused.agg(F.sum("part").alias("score"), F.when(F.count_distinct("source") > 1, "both").otherwise(F.min("source")).alias("source"))


def hybrid(vector: DataFrame, lexical: DataFrame, keys: list[str], k0: int = RRF_K, w_vec: float = VECTOR_WEIGHT, w_lex: float = LEXICAL_WEIGHT) -> DataFrame:
    """Fusion of both ranked lists; where the lexical one is empty, the vector list with its own scores.

    Each list is computed once. Both are limited before they are ranked, so the
    window that asks whether any row is lexical holds those few rows.
    """
    part = lambda rows, name, w: rows.select(*keys, (F.lit(float(w)) / (F.col("rank") + k0)).alias("part"), F.lit(name).alias("source"), F.col("score").alias("own"))
    both = part(vector, "vector", w_vec).unionByName(part(lexical, "lexical", w_lex))
    fused = both.groupBy(*keys).agg(F.sum("part").alias("_fused"), F.max(F.when(F.col("source") == "vector", F.col("own"))).alias("_own"), F.count_distinct("source").alias("_n"), F.min("source").alias("_source"))
    some = F.max((F.col("_n") > 1) | (F.col("_source") == "lexical")).over(Window.partitionBy())
    marked = fused.withColumn("_some", some)
    return marked.select(*keys, F.when(F.col("_some"), F.col("_fused")).otherwise(F.col("_own")).alias("score"), F.when(F.col("_n") > 1, "both").otherwise(F.col("_source")).alias("source"))


def per_group_cap(rows: DataFrame, group: str, cap: int, *order) -> DataFrame:
    """The first ``cap`` rows of each group; a cap of 0 or less changes nothing."""
    if cap <= 0:
        return rows
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def smart_cutoff(rows: DataFrame, *tie: str, ratio: float = 0.5, delta: float = 0.25, floor: float = 0.25, min_k: int = 2, max_k: int = 8) -> DataFrame:
    """Leading rows by score, up to the first one below the threshold.

    The threshold follows the best score; the first ``min_k`` rows only need the
    floor. A best score below the floor leaves one row. Rows are limited to
    ``max_k`` before the windows.
    """
    order = [F.col("score").desc(), *tie]
    top = rows.orderBy(*order).limit(max_k)
    w = Window.orderBy(*order)
    best = F.first("score").over(w)
    need = F.greatest(F.lit(floor), F.least(best * ratio, best - delta))
    k = F.row_number().over(w)
    good = F.when(k <= min_k, F.col("score") >= floor).otherwise(F.col("score") >= need)
    marked = top.withColumns({"_k": k, "_best": best, "_good": good.cast("int")})
    lead = F.min("_good").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_lead", lead).where(F.when(F.col("_best") < floor, F.col("_k") == 1).otherwise(F.col("_lead") == 1)).drop("_k", "_best", "_good", "_lead")


def lexical_fallback(files: DataFrame, chunks: DataFrame, tokens: list[str], per_file: int = 2, total: int = 40) -> DataFrame:
    """Chunks of the found files (path, score), scored by file score and token overlap.

    Files are taken in order of their score, at most ``per_file`` chunks from each,
    those with overlap only, and at most ``total`` in all.
    """
    overlap = token_overlap(F.concat_ws(" ", "breadcrumb", "display_code"), tokens)
    joined = chunks.join(files.select(F.col("path").alias("file_path"), F.col("score").alias("file_score")), "file_path").withColumn("overlap", overlap).where("overlap > 0")
    capped = per_group_cap(joined, "file_path", per_file, F.col("overlap").desc(), "chunk_index")
    first = capped.orderBy(F.col("file_score").desc(), "file_path", F.col("overlap").desc(), "chunk_index").limit(total)
    return first.withColumn("score", F.col("file_score") * (1 + 0.5 * F.col("overlap")))


def rerank(rows: DataFrame, scorer: Column, top: int = 10, *tie: str) -> DataFrame:
    """The ``top`` rows by a score expression, which stands for a cross-encoder."""
    return rows.withColumn("score", scorer).orderBy(F.col("score").desc(), *tie).limit(top)
