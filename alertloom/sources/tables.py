"""Inventories, responses and the claim ledger as tables, and the written outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from .claim_ledger import read_if_there

# Parts that an hour of one key is written in.
TRAIL_LANES = 4


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.RESPONSES, fmt)


def write_batch(rows: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Write the rows of one batch to a folder of its own; writing it again replaces it, also by no rows."""
    rows.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """The rows that one batch wrote; none if it wrote none."""
    return read_if_there(spark, path, schema + ", batch_id BIGINT").where(F.col("batch_id") == batch_id).drop("batch_id")


def read_claims(spark: SparkSession, path: str, before_batch: int | None = None, now_seconds: Column | None = None) -> DataFrame:
    """(finding_id, expires_at): the last written claim per id; a ledger not yet written is empty.

    A replayed batch passes its own id as before_batch, so that the claims it left behind when it
    failed do not make it skip its own findings. With now_seconds the claims that have run out by
    then are left out in the scan: a later claim on an id runs longer, so none comes back by that.
    """
    written = read_if_there(spark, path, schemas.CLAIMS + ", batch_id BIGINT")
    if before_batch is not None:
        written = written.where(F.col("batch_id") < before_batch)
    if now_seconds is not None:
        written = written.where(F.col("expires_at") > now_seconds)
    last = written.groupBy("finding_id").agg(F.max(F.struct("batch_id", "expires_at")).alias("c"))
    return last.select("finding_id", "c.expires_at")


def write_trail(trail: DataFrame, path: str, mode: str = "append") -> None:
    """The flattened trail in a folder per UTC day, by key and time inside, for scans of few days and keys."""
    dated = trail.withColumn("dt", F.to_date("event_time"))
    # Days are cut by key, and a key's day by hours and lanes, so a busy key is written by many tasks as well.
    lane = F.pmod(F.xxhash64("event_id", "event_time"), F.lit(TRAIL_LANES))
    dated.repartition("dt", "access_key_id", F.hour("event_time"), lane).sortWithinPartitions("dt", "access_key_id", "event_time").write.mode(mode).partitionBy("dt").parquet(path)


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines (finding_id, key, report) in a folder per day; one file per finding would swamp a store."""
    reports.write.mode(mode).partitionBy("dt").json(path)


def write_audit(audit: DataFrame, path: str, mode: str = "append") -> None:
    audit.write.mode(mode).parquet(path)


def write_notifications(notifications: DataFrame, path: str, mode: str = "append") -> None:
    notifications.write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    metrics.write.mode(mode).parquet(path)
