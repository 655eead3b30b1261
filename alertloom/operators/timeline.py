"""Audit-log activity around each finding.

A finding wants the newest `max_events` events of its access key inside its window. Joining on
the key with a time condition would build every (finding, event) pair of a busy key first. Here
events are numbered per key in time order instead, the finding learns the number of the last
event it may see, and it then meets only the run of events that holds the numbers before it: at
most twice `max_events` candidates per finding, whatever the key holds.

Numbers come from three levels, so no task sorts a whole key: rank inside a one-second slot, and
running totals over the slots of a day and over the days. Of the events with one time only the
newest `max_events` can ever be taken, which bounds a slot.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.trail_table import TrailTable, by_hour, with_minutes
from .durable import written_once
from .skew import lookup_join

# Half-width of the window and the cap on events per finding.
WINDOW_HOURS = 2
MAX_EVENTS = 200

# A trail partitioned by event date names the partition column so.
DATE_PARTITION = "dt"

EVENT_FIELDS = (
    "event_time", "event_id", "event_name", "event_source", "username", "source_ip", "user_agent",
    "aws_region", "error_code", "error_message", "request_parameters",
)
# What a timeline depends on.
WINDOW = ("access_key_id", "center_time")


def _hours(n: float) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {n * 3600})")


def _windows(findings: DataFrame, hours: float) -> DataFrame:
    """(access_key_id, center_time, earliest, latest), each once: findings that share key and time share a timeline."""
    named = findings.where((F.col("access_key_id") != "") & F.col("center_time").isNotNull())
    return named.select(
        "access_key_id",
        "center_time",
        (F.col("center_time") - _hours(hours)).alias("earliest"),
        (F.col("center_time") + _hours(hours)).alias("latest"),
    ).distinct()


def _spans_of(windows: DataFrame, seconds: int) -> DataFrame:
    """(access_key_id, _span) that windows touch, each once."""
    first, last = (F.expr(f"unix_seconds({c}) div {seconds}") for c in ("earliest", "latest"))
    return windows.select("access_key_id", F.explode(F.sequence(first, last)).alias("_span")).distinct()


def relevant_trail(windows: DataFrame, trail: DataFrame, hours: float) -> DataFrame:
    """Trail rows in a (key, span of time) that some window touches, and of a dated trail only those days.

    A span is as long as a window, so a window touches two or three. Both filters are semi-joins; days
    are few, as they are bounded by the calendar, and prune the partitions of the scan.
    """
    if DATE_PARTITION in trail.columns:
        # A day to either side, as the writer's days need not be UTC days.
        around = F.sequence(F.date_sub(F.to_date("earliest"), 1), F.date_add(F.to_date("latest"), 1))
        days = windows.select(F.explode(around).alias(DATE_PARTITION)).distinct()
        trail = trail.join(F.broadcast(days), DATE_PARTITION, "left_semi")
    seconds = max(math.ceil(hours * 7200), 1)
    spans = _spans_of(windows, seconds)
    spanned = trail.where(F.col("access_key_id").isNotNull()).withColumn("_span", F.expr(f"unix_seconds(event_time) div {seconds}"))
    return spanned.join(spans, ["access_key_id", "_span"], "left_semi").drop("_span")


def _named() -> Column:
    return F.col("event_id").isNotNull()


def _event_key() -> Column:
    """What copies of an event share: its id, or the time of one without."""
    return F.coalesce(F.col("event_id"), F.unix_micros("event_time").cast("string"))


def _single_copies(events: DataFrame) -> DataFrame:
    """One row per event of a key: (access_key_id, named, event_key, event); the newest copy stands."""
    keyed = events.select("access_key_id", _named().alias("named"), _event_key().alias("event_key"), F.struct(*EVENT_FIELDS).alias("event"))
    return keyed.groupBy("access_key_id", "named", "event_key").agg(F.max("event").alias("event"))


def _numbered(windows: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """Events and windows in one order per key: named and unnamed events are numbered apart, windows learn the last of each.

    A number is a rank inside a one-second slot, plus totals of the slots before it in its day, plus
    totals of the days before, so no task orders a whole key.
    """
    marks = events.groupBy("access_key_id", _named().alias("named"), _event_key().alias("event_key")).agg(F.max("event_time").alias("moment"))
    same_time = W.partitionBy("access_key_id", "named", "moment").orderBy(F.desc("event_key"))
    marks = marks.withColumn("_newer", F.row_number().over(same_time)).where(F.col("_newer") <= n)
    no_time, no_key = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    both = marks.select(
        "access_key_id", "moment", "named", "event_key", F.lit(1).alias("is_event"), no_time.alias("center_time"), no_time.alias("earliest")
    ).unionByName(
        windows.select(
            "access_key_id", F.col("latest").alias("moment"), F.lit(False).alias("named"), no_key.alias("event_key"), F.lit(0).alias("is_event"),
            "center_time", "earliest",
        )
    )
    both = both.select(
        "*",
        F.unix_seconds("moment").alias("slot"),
        F.to_date("moment").alias("day"),
        F.when(F.col("named"), F.col("is_event")).otherwise(0).alias("one_named"),
        F.when(F.col("named"), 0).otherwise(F.col("is_event")).alias("one_unnamed"),
    )
    # A window's mark follows the events of the same time, so its ranks count them.
    in_slot = W.partitionBy("access_key_id", "day", "slot").orderBy("moment", F.desc("is_event"), "event_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    kinds = ("named", "unnamed")
    ranked = both.select("*", *[F.sum(f"one_{k}").over(in_slot).alias(f"rank_{k}") for k in kinds])
    totals = both.groupBy("access_key_id", "day", "slot").agg(*[F.sum(f"one_{k}").alias(f"n_{k}") for k in kinds])
    in_day = W.partitionBy("access_key_id", "day").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = totals.select("access_key_id", "day", "slot", *[F.coalesce(F.sum(f"n_{k}").over(in_day), F.lit(0)).alias(f"day_{k}") for k in kinds])
    days = totals.groupBy("access_key_id", "day").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])
    earlier = W.partitionBy("access_key_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select("access_key_id", "day", *[F.coalesce(F.sum(f"n_{k}").over(earlier), F.lit(0)).alias(f"before_{k}") for k in kinds])
    placed = ranked.join(slots, ["access_key_id", "day", "slot"]).join(days, ["access_key_id", "day"])
    named, unnamed = (F.col(f"rank_{k}") + F.col(f"day_{k}") + F.col(f"before_{k}") for k in kinds)
    return placed.select(
        "access_key_id", "named", "event_key", "moment", "center_time", "earliest", "is_event", named.alias("number"), unnamed.alias("number_unnamed")
    )


def _chosen(numbered: DataFrame, n: int) -> DataFrame:
    """(access_key_id, center_time, named, event_key, moment): the newest n named events of each window and its newest unnamed one.

    Run r holds the numbers of two neighbouring groups of n, so one run covers any n in a row and a
    window meets at most 2 n events. An unnamed event is in a run of its own, below zero.
    """
    group = F.expr(f"(number - 1) div {n}")
    of_event = F.when(F.col("named"), F.array(group, group + 1)).otherwise(F.array(-F.col("number_unnamed")))
    placed = numbered.where("is_event = 1").select(
        "access_key_id", F.explode(of_event).alias("run"), F.when(F.col("named"), F.col("number")).otherwise(F.col("number_unnamed")).alias("_at"),
        "named", "event_key", "moment",
    )
    of_window = F.array(
        F.struct(group.alias("run"), F.col("number").alias("_last")), F.struct((-F.col("number_unnamed")).alias("run"), F.col("number_unnamed").alias("_last"))
    )
    asking = numbered.where("is_event = 0").select("access_key_id", "center_time", "earliest", F.inline(of_window)).where("_last > 0")
    met = asking.join(placed, ["access_key_id", "run"])
    return met.where((F.col("_at") > F.col("_last") - n) & (F.col("_at") <= F.col("_last")) & (F.col("moment") >= F.col("earliest"))).select(
        "access_key_id", "center_time", "named", "event_key", "moment"
    )


def timelines(
    findings: DataFrame, trail: DataFrame | TrailTable, *, window_hours: float = WINDOW_HOURS, max_events: int = MAX_EVENTS
) -> DataFrame:
    """(access_key_id, center_time, events) for each key and time the findings name, oldest first.

    Events without an id count as one event per window, the newest. Which events a window takes is
    settled on keys and times alone; of the other fields only those of taken events are moved. A trail
    that is laid out by key is read in the minutes its index names, and nowhere else.
    """
    windows = _windows(findings, window_hours)
    if isinstance(trail, TrailTable):
        windows = written_once(windows, "timeline-windows")
        chosen, wide = _from_table(windows, trail, max_events)
    else:
        # Read twice below, so written once: it is narrow, and the numbering is the costly part.
        numbered = written_once(_numbered(windows, relevant_trail(windows, trail, window_hours), max_events), "numbered-trail")
        chosen, wide = _chosen(numbered, max_events), relevant_trail(windows, trail, window_hours)
    event = ["access_key_id", "named", "event_key"]
    keyed = wide.withColumn("named", _named()).withColumn("event_key", _event_key()).join(chosen.select(*event).distinct(), event, "left_semi")
    delivered = chosen.select(*WINDOW, "named", "event_key").join(_single_copies(keyed), event)
    listed = delivered.groupBy(*WINDOW).agg(F.sort_array(F.collect_list("event")).alias("events"))
    newest = F.slice("events", F.greatest(F.size("events") - max_events + 1, F.lit(1)), max_events)
    return listed.select(*WINDOW, newest.alias("events"))


def _from_table(windows: DataFrame, table: TrailTable, n: int) -> tuple[DataFrame, DataFrame]:
    """(the events each window takes, the trail rows among which they are) of a trail laid out by key.

    The index counts an event in each minute it has a copy in. A window that copies left short of n events,
    though it has minutes that were not opened, is asked once more with all its minutes.
    """
    probed = written_once(table.probed(windows, n), "probed-minutes")
    wanted = by_hour(probed.where("asked"))
    numbered = written_once(_numbered(windows, table.near(windows, wanted), n), "numbered-trail")
    chosen = written_once(_chosen(numbered, n), "chosen-events")
    taken = chosen.groupBy(*WINDOW).agg(F.count_if("named").alias("n_taken"))
    cut = with_minutes(windows).join(probed.where("NOT asked").select("access_key_id", "first", "last").distinct(), ["access_key_id", "first", "last"], "left_semi")
    short = cut.join(taken, list(WINDOW), "left").where(F.coalesce("n_taken", F.lit(0)) < n).select("access_key_id", "first", "last", *WINDOW[1:], "earliest", "latest")
    short = written_once(short, "short-windows")
    if not short.isEmpty():
        wanted = by_hour(probed.join(short.select("access_key_id", "first", "last").distinct(), ["access_key_id", "first", "last"], "left_semi").unionByName(probed.where("asked")))
        again = _chosen(_numbered(short.drop("first", "last"), table.near(windows, wanted), n), n)
        chosen = written_once(chosen.join(short, list(WINDOW), "left_anti").unionByName(again), "chosen-events")
    return chosen, table.around(windows, wanted, chosen.select("access_key_id", "moment"))


def with_timeline(
    findings: DataFrame, trail: DataFrame | TrailTable, *, plain: DataFrame | None = None, shape: Mapping[str, Column] | None = None, **options
) -> DataFrame:
    """Findings plus `events`; findings without a key or activity get an empty list.

    `plain` is the findings table itself if `findings` already has joins in it. `shape` names lists, or
    JSON texts of lists, to make of `events`, once a timeline and before findings meet it.
    """
    base = findings if plain is None else plain
    found = timelines(base, trail, **options)
    if shape is not None:
        found = found.withColumns(dict(shape))
    joined = lookup_join(findings, found, WINDOW, "finding_id")
    made = [f for f in found.schema if f.name not in WINDOW]
    empty = {f.name: F.lit("[]") if f.dataType.typeName() == "string" else F.array().cast(f.dataType) for f in made}
    return joined.withColumns({name: F.coalesce(name, none) for name, none in empty.items()})


def distinct_events(trail: DataFrame) -> DataFrame:
    """The trail with one row per key and event id; copies combine map-side, the newest stands."""
    return _single_copies(trail).select("access_key_id", "event.*")


def event_pairs(timeline: DataFrame) -> DataFrame:
    """One row per finding and event, with a null event for findings that have none."""
    return timeline.select("finding_id", F.explode_outer("events").alias("e")).select("finding_id", "e.*")
