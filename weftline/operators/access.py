"""Access tokens and the safety of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_tokens(tokens: DataFrame, now_ms: int) -> DataFrame:
    """Active tokens that haven't expired; one without an expiry never does."""
    return tokens.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= now_ms)))


def token_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("revoked"))


def recent_activity(tokens: DataFrame, limit: int = 10) -> DataFrame:
    """Users by their last use."""
    used = tokens.where(F.col("last_used_at").isNotNull()).groupBy("user_id").agg(F.max("last_used_at").alias("last_used_at"), F.count(F.lit(1)).alias("tokens"))
    return used.orderBy(F.col("last_used_at").desc(), "user_id").limit(limit)


def call_safety(tool: Column, path: Column, command: Column, root: Column, system: list[str], private: list[str], dangerous: list[str], config_files: list[str]) -> Column:
    """struct<safe, risk, restriction> of a call: the first rule that applies decides."""
    full = F.when(path.startswith("/") | root.isNull(), path).otherwise(F.concat(root, F.lit("/"), path))
    plain = F.lower(F.regexp_replace(full, r"\\", "/"))
    any_of = lambda col, words, how: F.coalesce(F.greatest(*[how(col, w.lower()) for w in words], F.lit(False)), F.lit(False)) if words else F.lit(False)
    run = F.lower(F.trim(command))
    out = lambda safe, risk, why: F.struct(F.lit(safe).alias("safe"), F.lit(risk).alias("risk"), F.lit(why).alias("restriction"))
    return (
        F.when(path.contains(".."), out(False, "denied", "path_traversal_blocked"))
        .when(root.isNotNull() & (path != "") & ~full.startswith(root), out(False, "denied", "outside_workspace"))
        .when(any_of(plain, system, lambda c, w: c.startswith(w)), out(False, "denied", "system_path_blocked"))
        .when(any_of(plain, private, lambda c, w: c.contains(f"/{w}")), out(False, "denied", "user_sensitive_path_blocked"))
        .when(any_of(run, dangerous, lambda c, w: c.contains(w)), out(False, "denied", "dangerous_command_blocked"))
        .when(tool.isin("edit-file", "delete-file") & F.substring_index(path, "/", -1).isin(config_files), out(True, "warning", "modifying_config_file"))
        .when((tool == "delete-file") & root.isNull(), out(False, "denied", "missing_repo_path"))
        .when(tool == "delete-file", out(True, "warning", "file_deletion"))
        .when(run.startswith("sudo "), out(True, "safe", "sudo_usage"))
        .otherwise(out(True, "safe", ""))
    )
