"""Severity gate, missing ids and the once-only claim."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .skew import lookup_join

# The gate, the life of a claim and the skip reasons.
SEVERITY_THRESHOLD = 7.0
CLAIM_SECONDS = 7 * 24 * 3600
NO_FINDING_ID = "no_finding_id"
ALREADY_TRIAGED = "already_triaged"

_SALTS = 64
_REPEAT_CHUNK = 100_000


def severity_gate(findings: DataFrame, threshold: float | None = SEVERITY_THRESHOLD) -> DataFrame:
    """Findings at or over the threshold; None lets all pass."""
    return findings if threshold is None else findings.where(F.col("severity") >= threshold)


def has_id() -> Column:
    return F.coalesce(F.col("finding_id") != "", F.lit(False))


def skipped(rows: DataFrame, reason: str | Column) -> DataFrame:
    """Outcome rows of findings that are not triaged."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return rows.select(
        F.nullif("finding_id", F.lit("")).alias("finding_id"),
        F.lit("skipped").alias("status"),
        reason.alias("reason"),
        F.col("ingest_time").alias("ts"),
    )


def active_claims(claims: DataFrame, now_seconds: Column) -> DataFrame:
    """Ids whose claim has not run out."""
    return claims.where(F.col("expires_at") > now_seconds).select("finding_id").distinct()


def unclaimed(findings: DataFrame, claims: DataFrame, now_seconds: Column) -> DataFrame:
    return findings.join(active_claims(claims, now_seconds), "finding_id", "left_anti")


def already_triaged(findings: DataFrame, claims: DataFrame, now_seconds: Column) -> DataFrame:
    return findings.join(active_claims(claims, now_seconds), "finding_id", "left_semi")


def first_arrivals(findings: DataFrame) -> DataFrame:
    """Arrivals marked `is_first` once per finding_id, each with its number of equal `copies`.

    Equal rows are counted map-side first. What is left of a heavy id is ranked inside salts, and
    only the salts' winners meet in one group, so no task holds all arrivals of an id.
    """
    columns = findings.columns
    counted = findings.groupBy(*columns).agg(F.count("*").alias("copies"))
    ties = [c for c in columns if c not in ("finding_id", "ingest_time")]
    in_order = [F.asc_nulls_last("ingest_time"), *ties]
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(_SALTS)))
    in_salt = W.partitionBy("finding_id", "_salt").orderBy(*in_order)
    ranked = salted.withColumn("_in_salt", F.row_number().over(in_salt))
    # Group -1 gathers the winners of the salts; the others stay in groups of their own.
    grouped = ranked.withColumn("_group", F.when(F.col("_in_salt") == 1, F.lit(-1)).otherwise(F.col("_salt")))
    overall = W.partitionBy("finding_id", "_group").orderBy(*in_order)
    first = (F.row_number().over(overall) == 1) & (F.col("_group") == -1)
    return grouped.withColumn("is_first", first).drop("_salt", "_in_salt", "_group")


def repeat_rows(rows: DataFrame, times: str, chunk: int = _REPEAT_CHUNK) -> DataFrame:
    """Each row `times` over; long repeats are cut into chunks that spread over tasks."""
    chunks = F.sequence(F.lit(0), F.expr(f"({times} - 1) div {chunk}"))
    cut = (
        rows.where(F.col(times) > 0)
        .withColumn("_chunk", F.explode(chunks))
        .withColumn("_len", F.least(F.lit(chunk), F.col(times) - F.col("_chunk") * chunk).cast("int"))
    )
    # Rows that fit one chunk stay where they are; only the cut ones are moved.
    whole = cut.where(F.col(times) <= chunk)
    moved = cut.where(F.col(times) > chunk).repartition("finding_id", "_chunk")
    both = whole.unionByName(moved)
    return both.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_len")))).drop("_i", "_len", "_chunk", times)


def claim_batch(
    findings: DataFrame, claims: DataFrame | None, now_seconds: Column, keep: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(findings to triage, skip outcomes): one triage per id with no active claim.

    Every arrival gets exactly one result, as a finding that is sent twice is triaged once and
    skipped once. `keep` writes the marked arrivals once, for both, where both are read.
    """
    named = findings.where(has_id())
    marked = first_arrivals(named)
    if claims is not None:
        taken = active_claims(claims, now_seconds).withColumn("_taken", F.lit(True))
        marked = lookup_join(marked, taken, ["finding_id"], "ingest_time").withColumn(
            "is_first", F.col("is_first") & F.col("_taken").isNull()
        ).drop("_taken")
    if keep is not None:
        marked = keep(marked)
    fresh = marked.where("is_first").drop("is_first", "copies")
    left_over = marked.withColumn("_times", F.col("copies") - F.col("is_first").cast("int"))
    repeats = repeat_rows(left_over.select("finding_id", "ingest_time", "_times"), "_times")
    skips = skipped(findings.where(~has_id()), NO_FINDING_ID).unionByName(skipped(repeats, ALREADY_TRIAGED))
    return fresh, skips


def new_claims(triaged: DataFrame, now_seconds: Column, ttl_seconds: int = CLAIM_SECONDS) -> DataFrame:
    return triaged.select("finding_id", (now_seconds + ttl_seconds).cast("bigint").alias("expires_at"))


def upsert_claims(claims: DataFrame, added: DataFrame, now_seconds: Column) -> DataFrame:
    """Ledger after writing `added`: an added claim replaces the old one, run-out claims are pruned."""
    both = claims.select("finding_id", "expires_at", F.lit(0).alias("_age")).unionByName(
        added.select("finding_id", "expires_at", F.lit(1).alias("_age"))
    )
    latest = both.groupBy("finding_id").agg(F.max(F.struct("_age", "expires_at")).alias("_c"))
    return latest.select("finding_id", "_c.expires_at").where(F.col("expires_at") > now_seconds)
