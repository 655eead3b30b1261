"""Accuracy against labelled findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def evaluation_rows(labels: DataFrame, outcomes: DataFrame, key: str = "finding_id") -> DataFrame:
    """(name, expected, model, final, match, ms, degraded); a degraded finding never matches.

    labels: name, key, expected_severity. outcomes: key, degraded, final_severity, model_severity,
    processing_ms. The key is the name itself where findings are known by it.
    """
    return judged(labels.join(outcomes, key))


def judged(results: DataFrame) -> DataFrame:
    """The evaluation row of each labelled result."""
    final = F.when(F.col("degraded"), "DEGRADED").otherwise(F.col("final_severity"))
    return results.select(
        "name",
        F.col("expected_severity").alias("expected"),
        F.when(~F.col("degraded"), F.col("model_severity")).alias("model"),
        final.alias("final"),
        (~F.col("degraded") & (F.col("final_severity") == F.col("expected_severity"))).alias("match"),
        F.col("processing_ms").alias("ms"),
        "degraded",
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row: count, matches, accuracy and mean ms cut to a whole number; zeros when empty."""
    zero = F.lit(0.0)
    return rows.agg(F.count("*").alias("count"), F.count_if("match").alias("matches"), F.sum("ms").alias("_ms")).select(
        "count",
        "matches",
        F.coalesce(F.try_divide("matches", "count"), zero).alias("accuracy"),
        F.coalesce(F.try_divide("_ms", "count"), zero).cast("bigint").alias("mean_ms"),
    )
