"""Five-minute operations metrics over outcomes, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The period and the latency percentile.
PERIOD = "5 minutes"
LATENCY_PERCENTILE = 0.9


def latency_columns() -> list[Column]:
    """Average and p90; the exact p90 keeps counts per distinct value, and values are whole milliseconds."""
    return [F.avg("processing_ms").alias("avg_ms"), F.percentile("processing_ms", LATENCY_PERCENTILE).alias("p90_ms")]


def usage_columns() -> list[Column]:
    return [
        F.sum("cost_usd").alias("cost_usd"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    ]


def outcome_columns() -> list[Column]:
    return [F.count("*").alias("invocations"), F.count_if(F.col("degraded")).alias("degraded")]


def per_period(outcomes: DataFrame, columns: list[Column], period: str = PERIOD) -> DataFrame:
    """Tumbling windows over ts; grouped sums combine map-side, so a busy window is no bigger a task."""
    return outcomes.groupBy(F.window("ts", period).alias("w")).agg(*columns).select(
        F.col("w.start").alias("window_start"), "*"
    ).drop("w")


def latency(outcomes: DataFrame, period: str = PERIOD) -> DataFrame:
    return per_period(outcomes.where("status <> 'skipped'"), latency_columns(), period)


def usage(outcomes: DataFrame, period: str = PERIOD) -> DataFrame:
    return per_period(outcomes.where("status <> 'skipped'"), usage_columns(), period)


def outcome_counts(outcomes: DataFrame, period: str = PERIOD) -> DataFrame:
    """Skipped findings are invocations too, and never failures."""
    return per_period(outcomes, outcome_columns(), period)


def ops_metrics(outcomes: DataFrame, period: str = PERIOD) -> DataFrame:
    """All five-minute figures in one grouped pass."""
    triaged = F.col("status") != "skipped"
    rows = outcomes.withColumn("processing_ms", F.when(triaged, F.col("processing_ms")))
    return per_period(rows, [*latency_columns(), *usage_columns(), *outcome_columns()], period)
