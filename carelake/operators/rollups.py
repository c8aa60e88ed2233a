"""Counts, statistics and roll-ups; all of them pre-aggregate before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.operators.filters import matching, updated_after, updated_within


def table_stats(df: DataFrame, as_of: Column, column: str = "updated_at") -> DataFrame:
    """Rows, rows updated in one and in seven days, latest update; one scan."""
    return df.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(updated_after(F.col(column), 1, as_of)).alias("updated_today"),
        F.count_if(updated_after(F.col(column), 7, as_of)).alias("updated_this_week"),
        F.max(column).alias("last_updated"))


def row_count(df: DataFrame, conditions: dict | None = None) -> DataFrame:
    return matching(df, conditions or {}).agg(F.count(F.lit(1)).alias("count"))


def dashboard(tables: dict[str, DataFrame], as_of: Column, column: str = "updated_at") -> DataFrame:
    parts = [table_stats(df, as_of, column).select(F.lit(name).alias("source"), "*")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def run_summary(results: DataFrame) -> DataFrame:
    """Per feed group and source, per group, and overall."""
    return results.rollup("feed_group", "source").agg(
        F.sum("processing_ms").alias("processing_ms"), F.sum("page_count").alias("page_count"),
        F.sum("row_count").alias("row_count"), F.bool_and("success").alias("success"),
        F.count(F.lit(1)).alias("runs"))


def outcome_counts(changes: DataFrame, action: str = "action") -> DataFrame:
    """Save counts by outcome, one row."""
    def of(name):
        return F.count_if(F.col(action) == name).alias(f"{name}_count")
    return changes.agg(F.count(F.lit(1)).alias("total_count"), of("saved"), of("updated"),
                       of("skipped"), of("error"))


LOG_SETS = [[], ["recommendation"], ["predicted_disease"], ["region_label"], ["severity_score"]]


def log_rollups(logs: DataFrame, unit: str = "day") -> DataFrame:
    """Log counts by time, and by time with each of four dimensions, in one pass."""
    dims = [d[0] for d in LOG_SETS if d]
    timed = logs.withColumn("period", F.date_trunc(unit, "created_at"))
    return timed.groupingSets([["period", *s] for s in LOG_SETS], "period", *dims).agg(
        F.grouping_id().alias("grouping_key"), F.count(F.lit(1)).alias("log_count"))


def feedback_rate(feedback: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = updated_within(feedback, days, as_of, "created_at")
    return recent.agg(F.count(F.lit(1)).alias("feedback_count"),
                      F.count_if("helpful").alias("helpful_count"),
                      F.avg(F.col("helpful").cast("int")).alias("helpful_rate"))


def session_volume(messages: DataFrame) -> DataFrame:
    """User messages and their total length per session."""
    user = F.col("role") == "user"
    return messages.groupBy("session_id").agg(
        F.count_if(user).alias("user_messages"),
        F.coalesce(F.sum(F.when(user, F.length("content"))), F.lit(0)).alias("user_chars"))
