"""Streams that keep state of their own: capped timelines and claims that run out.

State lives in RocksDB, so it is bounded by disk and not by memory, and is checkpointed with the query.
"""

from __future__ import annotations

import bisect
import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import gate
from ..operators.skew import NULL_PARTS
from ..operators.timeline import MAX_EVENTS, WINDOW_HOURS
from ..sources.tables import write_batch

# Lanes that a key's events are dealt to by a hash of the event, so that a busy key is in several tasks.
LANES = 4
# Groups that the keys' lanes of one span are dealt to; every call on state costs a group as much as a key would.
GROUPS = 256


def keep_state_on_disk(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(micros: int) -> int:
    """Milliseconds, rounded up."""
    return -(-micros // 1_000)


# ---- timelines


def _joined(rows: list[str]) -> str:
    return f"[{','.join(rows)}]"


def _held(state) -> Iterator[list]:
    for entry in state.get():
        yield from json.loads(entry[0])


class _Newest(StatefulProcessor):
    """Of one span of time and some keys' lanes: the events, and the findings that want the newest of them.

    A finding asks each span and lane its window touches. When time has passed the end of its window, each
    answers with its newest events inside, at most as many as the timeline may have; of those without any
    only the finding's first says so. Time that has passed the span by two windows lets go of everything.
    """

    def __init__(self, window_seconds: int, most: int):
        self.window, self.most = window_seconds * 500_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Of each batch one entry, a JSON list of its rows as they came: the values are only looked at once they are asked for.
        self.events = handle.getListState("events", "rows STRING")
        self.findings = handle.getListState("findings", "rows STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events, findings, first = [], [], None
        for row in rows:
            if row.event is not None:
                events.append(row.event)
            elif row.finding is not None:
                findings.append(row.finding)
                first = row.micros if first is None else min(first, row.micros)
        if events:
            self.events.appendValue((_joined(events),))
        if findings:
            self.findings.appendValue((_joined(findings),))
            # The timer of the first that waits is enough: it sets the next one.
            self.handle.registerTimer(_millis(first + self.window))
        elif events:
            self.handle.registerTimer(self._passed(key) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that time has passed, as another group may have no timer for it but this one: a finding's parts come out together.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        asking, waiting = [], []
        for finding in _held(self.findings):
            finding[2] = int(finding[2])
            (asking if _millis(finding[2] + self.window) <= now else waiting).append(finding)
        if asking:
            yield from self._answers(asking)
        if now > self._passed(key):
            self.events.clear()
            self.findings.clear()
            return
        if asking and waiting:
            self.findings.put([(json.dumps(waiting),)])
        elif asking:
            self.findings.clear()
        self.handle.registerTimer(_millis(min(f[2] for f in waiting) + self.window) if waiting else self._passed(key) + 1)

    def _answers(self, asking: list[list]) -> Iterator[Row]:
        by_key: dict[str, list[tuple]] = {f[0]: [] for f in asking}
        for access_key_id, micros, event_id, name in _held(self.events):
            if access_key_id in by_key:
                by_key[access_key_id].append((int(micros), event_id, name))
        for events in by_key.values():
            events.sort(key=lambda e: (e[0], e[1] or ""))
        for access_key_id, finding_id, center, is_first in asking:
            events, seen, taken = by_key[access_key_id], set(), []
            for at in range(bisect.bisect_right(events, center + self.window, key=lambda e: e[0]) - 1, -1, -1):
                event = events[at]
                if len(taken) == self.most or event[0] < center - self.window:
                    break
                if event[1] not in seen:
                    seen.add(event[1])
                    taken.append(event)
            if taken or is_first == "true":
                yield Row(finding_id=finding_id, access_key_id=access_key_id, center=center, events=taken)

    def _passed(self, key) -> int:
        """When no finding can want the span's events any more."""
        return (key[0] + 2) * 2 * self.window // 1_000

    def close(self) -> None:
        pass


def newest_parts(
    findings: DataFrame, trail: DataFrame, *, ticks: DataFrame | None = None, window_hours: float = WINDOW_HOURS, max_events: int = MAX_EVENTS,
    lateness: str = "1 hour", lanes: int = LANES, groups: int = GROUPS,
) -> DataFrame:
    """(finding_id, access_key_id, center_time, events): of each finding the newest events of each span and lane that has some.

    All parts of a finding come out in one micro-batch, the first after both streams' watermarks have passed
    the end of its window; one without events has one part, an empty one. `ticks` is a stream of (moment) that
    says how far time has come where the streams are silent. Findings and events later than the lateness are
    dropped, as everywhere in Spark. State is held for `groups` of lanes a span: more of them are smaller and
    read less of other keys, fewer are faster.
    """
    keep_state_on_disk(findings.sparkSession)
    seconds = max(int(window_hours * 7_200), 1)
    named = F.coalesce(F.col("access_key_id") != "", F.lit(False))
    first, last = (F.floor(F.unix_seconds(F.expr(f"center_time {sign} make_dt_interval(0, 0, 0, {window_hours * 3_600})")) / seconds) for sign in "-+")

    def group(lane: Column) -> Column:
        return F.pmod(F.xxhash64("access_key_id", lane), F.lit(groups)).cast("int")

    # A finding without a key meets no event, and one part is enough to say so; those are spread.
    spans = F.when(named, F.sequence(first, last)).otherwise(F.array(first))
    of_lanes = F.array_distinct(F.array(*[group(F.lit(lane)) for lane in range(lanes)]))
    asked = F.when(named, of_lanes).otherwise(F.array(F.pmod(F.xxhash64("finding_id"), F.lit(groups)).cast("int")))
    none = F.lit(None).cast("string")

    def watched(rows: DataFrame, moment: str, text: dict[str, Column]) -> DataFrame:
        shaped = rows.select("span", "lanes", F.col(moment).alias("moment"), F.unix_micros(moment).alias("micros"), *[text.get(c, none).alias(c) for c in ("event", "finding")])
        if ticks is not None:
            told = ticks.select(F.lit(0).cast("long").alias("span"), F.lit(0).alias("lanes"), "moment", F.lit(0).cast("long").alias("micros"), none.alias("event"), none.alias("finding"))
            shaped = shaped.unionByName(told)
        return shaped.withWatermark("moment", lateness)

    of_findings = findings.where("center_time IS NOT NULL").select("*", F.posexplode(spans).alias("_nth_span", "span")).select("*", F.posexplode(asked).alias("_nth_lanes", "lanes"))
    is_first = F.col("_nth_span") + F.col("_nth_lanes") == 0
    finding = F.to_json(F.array(F.when(named, F.col("access_key_id")).otherwise(""), "finding_id", F.unix_micros("center_time").cast("string"), is_first.cast("string")))
    event_key = F.coalesce(F.col("event_id"), F.unix_micros("event_time").cast("string"))
    of_events = trail.where(named & F.col("event_time").isNotNull()).withColumns(
        {"span": F.floor(F.unix_seconds("event_time") / seconds), "lanes": group(F.pmod(F.xxhash64(event_key), F.lit(lanes)).cast("int"))}
    )
    event = F.to_json(F.array("access_key_id", F.unix_micros("event_time").cast("string"), "event_id", "event_name"))
    parts = watched(of_findings, "center_time", {"finding": finding}).unionByName(watched(of_events, "event_time", {"event": event})).groupBy("span", "lanes").transformWithState(
        _Newest(seconds, max_events), "finding_id STRING, access_key_id STRING, center BIGINT, events ARRAY<STRUCT<micros: BIGINT, event_id: STRING, event_name: STRING>>", "append", "EventTime"
    )
    events = F.transform("events", lambda e: F.struct(F.timestamp_micros(e["micros"]).alias("event_time"), e["event_id"].alias("event_id"), e["event_name"].alias("event_name")))
    return parts.select("finding_id", "access_key_id", F.timestamp_micros("center").alias("center_time"), events.alias("events"))


def merged_parts(parts: DataFrame, max_events: int = MAX_EVENTS) -> DataFrame:
    """One row per finding, key and time of newest_parts: the newest events of all parts, an id once, oldest first."""
    finding = ["finding_id", "access_key_id", "center_time"]
    single = parts.select(*finding, F.explode_outer("events").alias("e")).groupBy(*finding, F.col("e.event_id").alias("event_id")).agg(F.max("e").alias("e"))
    listed = single.groupBy(*finding).agg(F.sort_array(F.collect_list("e")).alias("events"))
    newest = F.slice("events", F.greatest(F.size("events") - max_events + 1, F.lit(1)), max_events)
    return listed.select("finding_id", F.nullif("access_key_id", F.lit("")).alias("access_key_id"), "center_time", newest.alias("events"))


def timeline_list_stream(findings: DataFrame, trail: DataFrame, path: str, checkpoint: str, *, max_events: int = MAX_EVENTS, **options):
    """A stream writer of each finding's capped timeline, an empty list included, once it is complete.

    Repeated rows of a finding at one time are one. A batch that is replayed replaces what it wrote.
    """
    parts = newest_parts(findings, trail, max_events=max_events, **options)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(merged_parts(batch, max_events), path, batch_id)

    return parts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


# ---- claims


class _Claim(StatefulProcessor):
    """Of one finding id: when it was last claimed, forgotten after the time to live."""

    def __init__(self, ttl_seconds: int, columns: list[str]):
        self.ttl_seconds, self.columns = ttl_seconds, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claimed = handle.getValueState("claimed", "ingest_time TIMESTAMP", ttlDurationMs=self.ttl_seconds * 1_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[1] >= 0:
            yield from (self._out(row, "skipped", gate.NO_FINDING_ID) for row in rows)
            return
        first, taken = None, self.claimed.exists()
        for row in rows:
            # Only the earliest so far is held, however many there are.
            if first is None and not taken:
                first = row
            elif not taken and self._order(row) < self._order(first):
                first, row = row, first
                yield self._out(row, "skipped", gate.ALREADY_TRIAGED)
            else:
                yield self._out(row, "skipped", gate.ALREADY_TRIAGED)
        if first is not None:
            self.claimed.update((first.ingest_time,))
            yield self._out(first, "claimed", None)

    @staticmethod
    def _order(row: Row) -> tuple:
        return row.ingest_time is None, row.ingest_time or dt.datetime.min

    def _out(self, row: Row, status: str, reason: str | None) -> Row:
        return Row(**{c: row[c] for c in self.columns}, status=status, reason=reason)

    def close(self) -> None:
        pass


def claim_stream(findings: DataFrame, ttl_seconds: int = gate.CLAIM_SECONDS) -> DataFrame:
    """Every arrival with `status` claimed or skipped, and why: an id is claimed once until its claim has run out.

    The time to live counts by the clock from the claim on, and repeats do not lengthen it. Of the arrivals of a
    micro-batch the earliest claims. Arrivals without an id are skipped, and spread over tasks.
    """
    keep_state_on_disk(findings.sparkSession)
    part = F.when(gate.has_id(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*findings.columns), F.lit(NULL_PARTS)).cast("int"))
    keyed = findings.withColumns({"claim_key": F.coalesce("finding_id", F.lit("")), "claim_part": part})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema.fields)
    return keyed.groupBy("claim_key", "claim_part").transformWithState(
        _Claim(ttl_seconds, findings.columns), f"{fields}, status STRING, reason STRING", "append", "ProcessingTime"
    )
