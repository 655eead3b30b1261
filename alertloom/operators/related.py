"""Other findings of the same principal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from .skew import lookup_join

# Fixed value: summaries kept per finding.
MAX_SUMMARIES = 10


def related_activity(history: DataFrame, *, max_summaries: int = MAX_SUMMARIES) -> DataFrame:
    """(principal_id, total, newest): count of a principal's findings and its newest ones.

    One more summary than asked for is kept, so that a finding can be taken out of its own list.
    Counting combines map-side and the ranking is limited before its shuffle, so a principal with
    most of the history costs a task no more than any other.
    """
    summary = F.struct("center_time", "type", "severity", "title")
    single = (
        history.where((F.col("principal_id") != "") & F.col("finding_id").isNotNull())
        .groupBy("principal_id", "finding_id")
        .agg(F.max(summary).alias("_s"))
        .select("principal_id", "finding_id", "_s.*")
    )
    totals = single.groupBy("principal_id").agg(F.count("*").alias("total"))
    newest_first = W.partitionBy("principal_id").orderBy(F.desc_nulls_last("center_time"), "finding_id")
    listed = (
        single.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") <= max_summaries + 1)
        .groupBy("principal_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("_rank", F.col("finding_id").alias("id"), "type", "severity", "title"))
            ).alias("newest")
        )
    )
    return totals.join(listed, "principal_id")


@dataclass(frozen=True)
class KeptActivity:
    """Related activity that is kept up to date elsewhere, in the shape of related_activity.

    It must hold the findings that are asked about, as they are taken out of their own counts and lists.
    """

    rows: DataFrame


def with_related(
    findings: DataFrame,
    history: DataFrame | KeptActivity | None = None,
    *,
    max_summaries: int = MAX_SUMMARIES,
    plain: DataFrame | None = None,
) -> DataFrame:
    """Findings plus related_count and related_summaries, the finding itself not counted.

    Without a history the findings are each other's history. A finding with no detector or no
    principal gets 0 and an empty list. `plain` is the findings table itself if `findings` already
    has joins in it. With a KeptActivity no history is read.
    """
    base = findings if plain is None else plain
    if isinstance(history, KeptActivity):
        activity = history.rows
    else:
        activity = related_activity(base if history is None else history, max_summaries=max_summaries)
    if history is None or isinstance(history, KeptActivity):
        asking = findings.withColumn("_listed", F.col("finding_id").isNotNull())
    else:
        known = (
            history.where(F.col("principal_id") != "").select("principal_id", "finding_id").distinct().withColumn("_listed", F.lit(True))
        )
        asking = findings.join(known, ["principal_id", "finding_id"], "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    joined = lookup_join(asking, activity, ["principal_id"], "finding_id")
    usable = (F.col("detector_id") != "") & F.col("total").isNotNull()
    others = F.filter("newest", lambda s: ~s["id"].eqNullSafe(F.col("finding_id")))
    summaries = F.transform(
        F.slice(others, 1, max_summaries),
        lambda s: F.struct(s["id"].alias("id"), s["type"].alias("type"), s["severity"].alias("severity"), s["title"].alias("title")),
    )
    empty = F.array().cast("array<struct<id:string,type:string,severity:double,title:string>>")
    return (
        joined.withColumn("related_count", F.when(usable, F.col("total") - F.col("_listed").cast("int")).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("related_summaries", F.when(usable, summaries).otherwise(empty))
        .drop("total", "newest", "_listed")
    )
