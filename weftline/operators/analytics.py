"""Feedback signals, savings ledger and offline evaluation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import file_stem, half_up, jaccard, word_tokens
from weftline.operators.retrieval import RRF_K

# Weights of the signals, least similarity of a rewritten query, prices per million tokens (in, out).
PIN_WEIGHT, REWRITE_WEIGHT, REWRITE_SIMILARITY = 1.0, -0.6, 0.4
PRICES = {
    "opus": (15.0, 75.0), "claude-opus-3": (15.0, 75.0), "sonnet": (3.0, 15.0), "claude-sonnet-3.5": (3.0, 15.0), "haiku": (0.25, 1.25), "claude-haiku-3": (0.25, 1.25),
    "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gpt-4-turbo": (10.0, 30.0), "gpt-4": (30.0, 60.0), "gpt-3.5-turbo": (0.5, 1.5),
    "gemini-2.0-flash": (0.3, 1.2), "gemini-1.5-pro": (1.25, 5.0), "gemini-1.5-flash": (0.075, 0.3),
}


def search_text(query, terms):
    """Query and technical terms as one lower-cased line."""
    joined = F.concat_ws(" ", F.array(F.nullif(query, F.lit(""))), F.filter(terms, lambda t: t != ""))
    return F.trim(F.regexp_replace(F.lower(joined), r"\s+", " "))


def rewrite_signals(events: DataFrame, group: str, order: str, text: str = "text", seeds: str = "seed_count") -> DataFrame:
    """(group, order, weight, similarity) of events whose predecessor found nothing and asked much the same."""
    w = Window.partitionBy(group).orderBy(order)
    tokens = F.array_distinct(word_tokens(F.col(text)))
    seen = events.select(group, order, tokens.alias("_t"), F.lag(tokens).over(w).alias("_p"), F.lag(seeds).over(w).alias("_s"))
    found = seen.where("_s = 0").withColumn("similarity", jaccard(F.col("_p"), F.col("_t"))).where(F.col("similarity") >= REWRITE_SIMILARITY)
    return found.select(group, order, F.lit("no_hit_rewrite").alias("signal"), F.lit(REWRITE_WEIGHT).alias("weight"), F.round("similarity", 4).alias("similarity"))


def pin_signals(events: DataFrame, chunks: DataFrame, event: str = "event_id") -> DataFrame:
    """(event_id, file_path, chunk_index, weight, matched_by): chunks of the previous event that the text names by file stem.

    ``events`` has event_id, previous_id and text; ``chunks`` event_id, file_path and chunk_index.
    """
    named = chunks.dropDuplicates([event, "file_path", "chunk_index"]).withColumn("_stem", file_stem(F.col("file_path"))).where("_stem <> ''").withColumn("_bare", F.translate("_stem", "_-", ""))
    joined = events.select(F.col(event).alias("_now"), F.col("previous_id").alias(event), F.lower("text").alias("_text")).join(named, event)
    token = F.arrays_overlap(word_tokens(F.col("_text")), F.array("_stem", "_bare"))
    found = joined.where(token | F.col("_text").contains(F.col("_stem")) | F.col("_text").contains(F.col("_bare")))
    return found.select(F.col("_now").alias(event), "file_path", "chunk_index", F.lit("path_pin").alias("signal"), F.lit(PIN_WEIGHT).alias("weight"), F.when(token, "token").otherwise("text").alias("matched_by"))


def feedback_summary(events: DataFrame, signals: DataFrame, since_ms: int = 0) -> DataFrame:
    """One row: events, those without hits, events with a pin or rewrite signal, and the rates."""
    e = events.where(F.col("created_at") >= since_ms).agg(F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("seed_count") == 0).alias("zero_hit_events"))
    s = signals.where(F.col("created_at") >= since_ms).agg(
        F.count_distinct(F.when(F.col("signal") == "path_pin", F.col("source_event_id"))).alias("pinned_events"), F.count_distinct(F.when(F.col("signal") == "no_hit_rewrite", F.col("source_event_id"))).alias("rewritten_events")
    )
    rate = lambda part: F.when(F.col("total_events") == 0, F.lit(0.0)).otherwise(F.col(part) / F.col("total_events"))
    return e.crossJoin(F.broadcast(s)).withColumns({"zero_hit_rate": rate("zero_hit_events"), "pin_rate": rate("pinned_events"), "rewrite_rate": rate("rewritten_events")})


def signal_breakdown(signals: DataFrame) -> DataFrame:
    """One row: a map from each signal to its number."""
    counts = signals.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "n")))).alias("breakdown"))


def with_evidence(signals: DataFrame, *columns: str) -> DataFrame:
    """``signals`` with the columns as JSON text in ``evidence``."""
    return signals.withColumn("evidence", F.to_json(F.struct(*columns)))


def record(rows: DataFrame, path: str) -> None:
    """Append events, signals or ledger rows to their table."""
    rows.write.mode("append").parquet(path)


def top_files(signals: DataFrame, limit: int = 10) -> DataFrame:
    got = signals.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count(F.lit(1)).alias("hits"), F.sum("weight").alias("weight"))
    return got.orderBy(F.col("weight").desc(), F.col("hits").desc(), "file_path").limit(limit)


#: Cost is counted in whole billionths of a dollar, so that sums do not depend on the order of adding.
NANO = 1e9


def prices(spark: SparkSession) -> DataFrame:
    """Price list: billionths of a dollar for a token."""
    nano = lambda rate: round(rate * NANO / 1_000_000)
    return spark.createDataFrame([(m, nano(i), nano(o)) for m, (i, o) in PRICES.items()], "model string, input_rate long, output_rate long")


def with_cost(rows: DataFrame, tokens: str, kind: str = "input", model: str = "model", out: str = "cost") -> DataFrame:
    """Dollars of tokens by the model's price, and ``{out}_nano``, the same in whole billionths; 0 for a model without a price.

    The price list has a few rows.
    """
    rate = prices(rows.sparkSession).select(F.col("model").alias("_model"), F.col(f"{kind}_rate").alias("_rate"))
    joined = rows.join(F.broadcast(rate), F.lower(F.trim(model)) == F.col("_model"), "left")
    nano = F.col(tokens) * F.coalesce("_rate", F.lit(0).cast("long"))
    return joined.withColumns({f"{out}_nano": nano, out: nano / NANO}).drop("_model", "_rate")


def dollars(column: str = "dollars_saved") -> Column:
    """Sum of a cost column, exact: by its billionths."""
    return F.coalesce(F.sum(f"{column}_nano"), F.lit(0).cast("long")) / NANO


def savings_summary(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"), dollars().alias("dollars_saved"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.count_distinct("session_id").alias("sessions")
    )


def savings_by(ledger: DataFrame, column: str) -> DataFrame:
    """Sums by a column with the whole-number share of all tokens; the share is taken over the few grouped rows."""
    got = ledger.groupBy(column).agg(F.sum("tokens_saved").alias("tokens_saved"), dollars().alias("dollars_saved"), F.count(F.lit(1)).alias("queries"))
    total = F.sum("tokens_saved").over(Window.partitionBy())
    return got.withColumn("percentage", F.when(total > 0, half_up(F.col("tokens_saved") / total * 100)).otherwise(F.lit(0).cast("long")))


def sessions_with_counts(sessions: DataFrame, ledger: DataFrame, limit: int | None = 50) -> DataFrame:
    """Sessions with their events and sums, those without events too, newest first."""
    sums = ledger.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.sum("tokens_saved").alias("tokens_saved"))
    out = sessions.join(sums, "session_id", "left").withColumns({"events": F.coalesce("events", F.lit(0)), "tokens_saved": F.coalesce("tokens_saved", F.lit(0))})
    return out.orderBy(F.col("started_at").desc(), "session_id").limit(limit) if limit else out


def ended_sessions(sessions: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """``sessions`` with ended_at and the sums of their ledger rows, 0 where there are none."""
    sums = ledger.groupBy("session_id").agg(F.sum("tokens_saved").alias("total_tokens_saved"), dollars().alias("total_dollars_saved"))
    out = sessions.join(sums, "session_id", "left").withColumn("ended_at", F.lit(now_ms).cast("long"))
    return out.withColumns({"total_tokens_saved": F.coalesce("total_tokens_saved", F.lit(0)), "total_dollars_saved": F.coalesce("total_dollars_saved", F.lit(0.0))})


def moving_average(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """(key, average): the exponential moving average of each key's values in order, from the first one on.

    As a weighted sum: a value that k later ones follow has the weight
    alpha * (1 - alpha) ** k, the first value all the weight that is left.
    """
    w = Window.partitionBy(key)
    placed = rows.select(key, F.col(value).cast("double").alias("_v"), (F.row_number().over(w.orderBy(F.col(order).desc())) - 1).alias("_later"), F.count(F.lit(1)).over(w).alias("_n"))
    weight = F.pow(F.lit(1 - alpha), F.col("_later")) * F.when(F.col("_later") == F.col("_n") - 1, 1.0).otherwise(alpha)
    return placed.groupBy(key).agg(F.sum(F.col("_v") * weight).alias("average"))


def index_stats(chunks: DataFrame, file: str = "file_path") -> DataFrame:
    return chunks.agg(F.count_distinct(file).alias("files"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.max("indexed_at"), F.lit(0)).alias("last_indexed"))


def ranking_metrics(retrieved: DataFrame, relevant: DataFrame, ks: list[int], keys: list[str]) -> DataFrame:
    """Per case: rr, and recall and ndcg at each k.

    ``retrieved`` has the keys, item and pos; ``relevant`` the keys, item and gain.
    An item counts at its first place, and places are counted without repeats; only
    gains above 0 count. Cases come from ``relevant``.
    """
    firsts = retrieved.groupBy(*keys, "item").agg(F.min("pos").alias("pos"))
    placed = firsts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "item")))
    good = relevant.groupBy(*keys, "item").agg(F.max("gain").alias("gain")).where("gain > 0").withColumn("ideal", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("gain").desc(), "item")))
    joined = good.join(placed.select(*keys, "item", "rank"), [*keys, "item"], "left")
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))
    parts = [F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"), F.count(F.lit(1)).alias("_n")]
    for k in ks:
        parts += [F.count_if(F.col("rank") <= k).alias(f"_hit{k}"), total(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1)).alias(f"_dcg{k}"), total(F.col("ideal") <= k, F.col("gain") / F.log2(F.col("ideal") + 1)).alias(f"_idcg{k}")]
    got = joined.groupBy(*keys).agg(*parts)
    metrics = {f"recall_{k}": F.col(f"_hit{k}") / F.col("_n") for k in ks} | {f"ndcg_{k}": F.when(F.col(f"_idcg{k}") > 0, F.col(f"_dcg{k}") / F.col(f"_idcg{k}")).otherwise(0.0) for k in ks}
    return got.withColumns(metrics).select(*keys, "rr", *metrics)


def evaluation_summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the cases; zeros where there is none."""
    names = [c for c in metrics.columns if c == "rr" or c.startswith(("recall_", "ndcg_"))]
    return metrics.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("cases"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias("mrr" if c == "rr" else c) for c in names])


def grid(spark: SparkSession, weights: list[float], k0s: list[int], top_ms: list[int]) -> DataFrame:
    """Parameter combinations, of which there are a handful."""
    if not all(0 < w < 1 for w in weights) or not all(k > 0 for k in (*k0s, *top_ms)):
        raise ValueError("weights lie between 0 and 1, the other parameters above 0")
    return spark.createDataFrame([(float(w), round(1 - w, 6), int(k), int(m)) for w, k, m in product(weights, k0s, top_ms)], "w_vec double, w_lex double, k0 int, top_m int")


def auto_tune(lists: DataFrame, relevant: DataFrame, params: DataFrame, ks: list[int], target: str = "mrr", case: str = "case_id") -> DataFrame:
    """Leaderboard of the parameters, replayed over all cases in one job.

    ``lists`` has case, item, pos (from 0) and channel (vector or lexical).
    """
    names = ["w_vec", "w_lex", "k0", "top_m"]
    first = lists.groupBy(case, "channel", "item").agg(F.min("pos").alias("pos"))
    tried = first.crossJoin(F.broadcast(params))
    part = F.when(F.col("channel") == "vector", F.col("w_vec")).otherwise(F.col("w_lex")) / (F.col("k0") + F.col("pos"))
    fused = tried.withColumn("part", part).groupBy(*names, case, "item").agg(F.sum("part").alias("score"))
    ranked = fused.withColumn("pos", F.row_number().over(Window.partitionBy(*names, case).orderBy(F.round("score", 12).desc(), "item"))).where(F.col("pos") <= F.col("top_m"))
    wanted = relevant.crossJoin(F.broadcast(params))
    summary = evaluation_summary(ranking_metrics(ranked, wanted, ks, [*names, case]), names)
    return summary.orderBy(F.col(target).desc(), F.col("mrr").desc(), F.col("w_vec").desc(), "k0", "top_m")


def replay_defaults() -> dict:
    return {"weights": [0.5, 0.6, 0.7], "k0s": [10, RRF_K, 40], "top_ms": [40, 60]}
