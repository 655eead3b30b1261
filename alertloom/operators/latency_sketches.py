"""Latency figures that merge: a row per window with a count, a sum and a quantile sketch.

Rows of five minutes merge to hours and days, and parts of one window that were written at different times
merge to the window, without the outcomes. So a late outcome adds a part and rewrites nothing, and batch and
stream share one table. Skipped outcomes and those without a time have no part in it; a window of only such
outcomes has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.claim_ledger import read_if_there
from ..sources.tables import write_batch
from .metrics import LATENCY_PERCENTILE, PERIOD

# Size of a sketch, and the error of its ranks that this stays well within (0.35 % in 99 of 100 cases).
SKETCH_K = 800
RANK_ERROR = 0.01

PARTS = "window_start TIMESTAMP, n BIGINT, sum_ms BIGINT, sketch BINARY"


def _measured(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status <> 'skipped' AND processing_ms IS NOT NULL AND ts IS NOT NULL").select("ts", F.col("processing_ms").cast("bigint").alias("ms"))


def latency_parts(outcomes: DataFrame, period: str = PERIOD) -> DataFrame:
    """(window_start, n, sum_ms, sketch) of outcomes; sketches are built map-side and merged after the shuffle."""
    return (
        _measured(outcomes).groupBy(F.window("ts", period).alias("w"))
        .agg(F.count("ms").alias("n"), F.sum("ms").alias("sum_ms"), F.kll_sketch_agg_bigint("ms", SKETCH_K).alias("sketch"))
        .select(F.col("w.start").alias("window_start"), "n", "sum_ms", "sketch")
    )


def rolled_up(parts: DataFrame, period: str) -> DataFrame:
    """Parts of the same or of longer windows from parts; the period must be a multiple of theirs."""
    return (
        parts.groupBy(F.window("window_start", period).alias("w"))
        .agg(F.sum("n").alias("n"), F.sum("sum_ms").alias("sum_ms"), F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("sketch"))
        .select(F.col("w.start").alias("window_start"), "n", "sum_ms", "sketch")
    )


def latency_figures(parts: DataFrame, percentile: float = LATENCY_PERCENTILE) -> DataFrame:
    """(window_start, n, avg_ms, p90_ms) of parts that hold each window once; the percentile is one of the values."""
    quantile = F.kll_sketch_get_quantile_bigint("sketch", F.lit(percentile))
    return parts.select("window_start", "n", (F.col("sum_ms") / F.col("n")).alias("avg_ms"), quantile.alias("p90_ms"))


def latency_stream(outcomes: DataFrame, path: str, checkpoint: str, period: str = PERIOD):
    """A stream writer of latency parts: each batch adds its own, late ones too, and a replay replaces them.

    No state and no watermark are kept, as parts of a window need not come together.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(latency_parts(batch, period), path, batch_id)

    return outcomes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts written to a folder, none if there is none yet; roll them up before use."""
    return read_if_there(spark, path, PARTS)


def ranks(outcomes: DataFrame, figures: DataFrame, period: str, percentile: float = LATENCY_PERCENTILE, error: float = RANK_ERROR) -> DataFrame:
    """Figures with `p90_near`: whether the percentile's true rank among the outcomes is within the error.

    That is a check, as it reads the outcomes.
    """
    values = _measured(outcomes).select(F.window("ts", period)["start"].alias("window_start"), "ms")
    counted = values.join(figures.select("window_start", "p90_ms"), "window_start").groupBy("window_start").agg(
        F.avg((F.col("ms") < F.col("p90_ms")).cast("int")).alias("below"), F.avg((F.col("ms") <= F.col("p90_ms")).cast("int")).alias("upto")
    )
    near = (F.col("below") <= percentile + error) & (F.col("upto") >= percentile - error)
    return figures.join(counted, "window_start", "left").withColumn("p90_near", F.coalesce(near, F.lit(False))).drop("below", "upto")
