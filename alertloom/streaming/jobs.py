"""Streaming triage, dedup, timelines and operations metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics
from ..operators.durable import reused_places
from ..operators.skew import NULL_PARTS
from ..plans.triage import Context, TriageResult, triage_batch
from ..schemas import CLAIMS, FINDINGS
from ..sources.findings import parse_findings, unwrap
from ..sources.claim_ledger import ClaimLedger, read_if_there
from ..sources.commits import CommitLog
from ..sources.tables import read_batch, read_claims, write_batch

# Fixed value: how long one claim on a finding id holds.
CLAIM_TTL = "7 days"
# Batches whose intermediate tables are kept; a place is written anew after as many.
SCRATCH_RING = 2


def finding_stream(spark: SparkSession, path: str, *, schema: str = FINDINGS, fmt: str = "json", **options) -> DataFrame:
    """Findings as files arrive in a folder; the schema is given, never inferred."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def event_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """(value) raw JSON events as files arrive in a folder, one a line."""
    return spark.readStream.format("text").options(**options).load(path)


def once_per_finding(stream: DataFrame, ttl: str = CLAIM_TTL) -> DataFrame:
    """First arrival of each finding id, repeats within the ttl dropped; state expires with the watermark."""
    return stream.where("finding_id <> ''").withWatermark("ingest_time", ttl).dropDuplicatesWithinWatermark(["finding_id"])


def timeline_stream(findings: DataFrame, trail: DataFrame, *, window_hours: int = 2, lateness: str = "1 hour") -> DataFrame:
    """(finding, event) pairs of two streams, complete once both watermarks have passed the window.

    Findings that meet no event, those without a key included, come out with null event columns. The
    time bounds let Spark drop state of both sides. Findings without a key meet nothing and are spread.
    """
    keyless = ~F.coalesce(F.col("access_key_id") != "", F.lit(False))
    spread = F.when(keyless, F.pmod(F.xxhash64("finding_id"), F.lit(NULL_PARTS)) + 1).otherwise(F.lit(0).cast("long"))
    f = findings.select("finding_id", "access_key_id", "center_time", spread.alias("part")).withWatermark("center_time", lateness)
    t = (
        trail.select(F.col("access_key_id").alias("trail_key"), "event_id", "event_time", "event_name")
        .withColumn("trail_part", F.pmod(F.xxhash64("trail_key"), F.lit(1).cast("long")))
        .withWatermark("event_time", lateness)
        .dropDuplicates(["trail_key", "event_id", "event_time"])
    )
    inside = F.expr(
        f"access_key_id = trail_key AND part = trail_part AND event_time BETWEEN center_time - INTERVAL {window_hours} HOURS "
        f"AND center_time + INTERVAL {window_hours} HOURS"
    )
    return f.join(t, inside, "left_outer").drop("trail_key", "part", "trail_part")


def ops_metrics_stream(outcomes: DataFrame, *, period: str = metrics.PERIOD, lateness: str = "10 minutes") -> DataFrame:
    """Five-minute figures of a stream of outcomes; written as updates, each window stands from its first outcome on."""
    return metrics.ops_metrics(outcomes.withWatermark("ts", lateness), period)


def update_stream(rows: DataFrame, path: str, checkpoint: str):
    """A stream writer of what each batch changed; read_latest gives the rows as they stand."""
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id))


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Of each key the row of the last batch that has one."""
    written = spark.read.parquet(path)
    rest = [c for c in written.columns if c not in (*keys, "batch_id")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return last.select(*keys, "r.*")


def write_result(result: TriageResult, folder: str, batch_id: int) -> None:
    """All tables of one batch. They count once the batch is in the folder's CommitLog."""
    write_batch(result.outcomes, f"{folder}/outcomes", batch_id)
    write_batch(result.reports, f"{folder}/reports", batch_id, "json")
    write_batch(result.audit, f"{folder}/audit", batch_id)
    write_batch(result.notifications, f"{folder}/notifications", batch_id, "json")
    write_batch(result.metrics, f"{folder}/metrics", batch_id)
    write_batch(result.claims, f"{folder}/claims", batch_id)


def triage_stream(
    findings: DataFrame,
    context: Callable[[], Context],
    responses: Callable[[], DataFrame],
    *,
    folder: str,
    checkpoint: str,
    run_ts: Column | None = None,
    documents: str | None = None,
    **options,
):
    """A stream writer that triages each micro-batch against the tables as they stand then.

    `documents` names a column of raw events, in either casing and any envelope, for a stream of
    those (see event_stream); their run time is the batch's.

    `context` and `responses` are called per batch. Every table is partitioned by batch. A batch counts
    once all its tables are written: read them with CommitLog(spark, folder).read(table). One that died
    before that overwrites what it wrote when it is replayed, one that counts is left as it is, so a
    restart neither loses nor repeats a row. Start it with .start(), or add a trigger first.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        triage_one(batch, batch_id, context(), responses(), folder=folder, run_ts=run_ts, documents=documents, writer=checkpoint, **options)

    return findings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def triage_one(
    batch: DataFrame,
    batch_id: int,
    context: Context,
    responses: DataFrame,
    *,
    folder: str,
    run_ts: Column | None = None,
    documents: str | None = None,
    writer: str | None = None,
    **options,
) -> None:
    """Triage one micro-batch and write all its tables; doing it again leaves them as they are.

    `writer` says who numbers the batches; a folder that another one writes to is refused.
    """
    log = _commits(batch.sparkSession, folder, batch_id)
    if log.holds(batch_id, writer):
        return
    # One reading of the clock for all tables of the batch.
    now = F.timestamp_micros(F.lit(int(time.time() * 1_000_000))) if run_ts is None else run_ts
    findings = batch if documents is None else parse_findings(unwrap(batch, documents), run_ts=now)
    now_seconds = F.unix_seconds(now)
    ledger = _ledger(batch.sparkSession, folder, batch_id, now_seconds)
    claims = ledger.claims(before_batch=batch_id, now_seconds=now_seconds)
    with reused_places(f"{folder}/scratch/slot={batch_id % SCRATCH_RING}"):
        result = triage_batch(findings, context, responses, run_ts=now, claims=claims, **options)
        write_result(result, folder, batch_id)
    # The ledger is what the next batch reads, and a batch does not see its own claims when it is run again.
    ledger.add(read_batch(batch.sparkSession, f"{folder}/claims", batch_id, CLAIMS), batch_id)
    log.commit(batch_id, writer)


def _commits(spark: SparkSession, folder: str, batch_id: int) -> CommitLog:
    log = CommitLog(spark, folder)
    if batch_id and log.is_new():
        # A folder of a time before the log: claims were written last, so those batches are whole.
        before = read_if_there(spark, f"{folder}/claims", "batch_id BIGINT").where(F.col("batch_id") < batch_id).distinct()
        log.adopt(r.batch_id for r in before.collect())
    return log


def _ledger(spark: SparkSession, folder: str, batch_id: int, now_seconds: Column) -> ClaimLedger:
    """The folder's ledger, with its older batches merged where that is due."""
    ledger = ClaimLedger(spark, f"{folder}/claim-ledger")
    if batch_id and ledger.is_new():
        # A folder of a time before the ledger, whose claims are in the batches' own table.
        ledger.start(read_claims(spark, f"{folder}/claims", before_batch=batch_id, now_seconds=now_seconds), batch_id - 1, now_seconds)
    ledger.merge_if_due(batch_id, now_seconds)
    return ledger


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """A stream writer that appends each batch once, whatever is replayed."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id))


def drain(writer, idle_batches: bool = True) -> StreamingQuery:
    """Run a writer over everything there is now, and return once it is done.

    A query whose state runs out by the clock (claim_stream) has something to do in every batch, rows or not,
    so it is only done without batches that have no rows.
    """
    conf, name = SparkSession.active().conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(idle_batches).lower())
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
    return query
