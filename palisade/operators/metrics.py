"""Aggregates over decisions: totals, block rate, reasons, severities, rates in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(decisions: DataFrame) -> DataFrame:
    """One row: total, allows, blocks, block_rate (0 for no decisions)."""
    totals = decisions.agg(F.count("*").alias("total"), F.count_if(F.col("allow")).alias("allows"), F.count_if(~F.col("allow")).alias("blocks"))
    return totals.withColumn("block_rate", F.col("blocks") / F.greatest(F.lit(1), F.col("total")))


def by_severity(decisions: DataFrame) -> DataFrame:
    """Decisions by severity; those without one count as UNKNOWN."""
    return decisions.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity")).agg(F.count("*").alias("n"))


def top_reasons(decisions: DataFrame, order: str, k: int = 5) -> DataFrame:
    """The k most frequent reasons; of equally frequent ones that which came first by ``order``."""
    counted = decisions.groupBy("reason").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(k)


def decision_counter(decisions: DataFrame) -> DataFrame:
    """Counter by action and category: the severity, else ALLOW or UNKNOWN by action."""
    category = F.coalesce("severity", F.when(F.col("action") == "ALLOW", "ALLOW").otherwise("UNKNOWN"))
    return decisions.groupBy("action", category.alias("category")).agg(F.count("*").alias("n"))


def request_counter(requests: DataFrame, endpoint: str) -> DataFrame:
    """Requests by endpoint."""
    return requests.groupBy(F.col(endpoint).alias("endpoint")).agg(F.count("*").alias("n"))


def term_counters(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms by category, churn by action and category) of two states of the pending table."""
    held = after.groupBy("category").agg(F.count("*").alias("n"))
    key = ["category", "term"]
    added = after.join(before, key, "left_anti").select(F.lit("added").alias("action"), "category")
    expired = before.join(after, key, "left_anti").select(F.lit("expired").alias("action"), "category")
    return held, added.unionByName(expired).groupBy("action", "category").agg(F.count("*").alias("n"))


def rate_per_second(events: DataFrame, time: str, by: list[str | Column], minutes: int = 5) -> DataFrame:
    """Events a second in tumbling windows, by key."""
    windowed = events.groupBy(F.window(time, f"{minutes} minutes").alias("w"), *by).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("window_start"), *[c for c in windowed.columns if c not in ("w", "n")], "n", (F.col("n") / (60.0 * minutes)).alias("per_second"))


def ratio_in_windows(events: DataFrame, time: str, condition: Column, minutes: int = 10, slide: int = 5) -> DataFrame:
    """Share of events for which a condition holds, in sliding windows."""
    windowed = events.groupBy(F.window(time, f"{minutes} minutes", f"{slide} minutes").alias("w")).agg(F.count_if(condition).alias("hits"), F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("window_start"), "hits", "n", (F.col("hits") / F.col("n")).alias("ratio"))
