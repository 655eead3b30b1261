"""Related activity of principals, kept up to date by a stream of findings.

Of each principal the state holds its findings by id, how many there are and the newest few. A batch meets
only the state of the principals and ids that are in it; what stands is read from the state itself, a row
per principal and lane, so neither the history nor the batches so far are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.related import MAX_SUMMARIES
from .state import keep_state_on_disk

# Times are held in microseconds, which are the same on both sides of a worker.
_SUMMARY = "moment BIGINT, type STRING, severity DOUBLE, title STRING"
# Lanes that a principal's findings are dealt to by a hash of their ids, so that a busy one is in several tasks.
LANES = 8


def _order(summary: tuple) -> tuple:
    """As Spark orders structs: nulls first, NaN last."""
    return tuple((v is not None, v != v, v if v == v else 0.0) if v is not None else (False,) for v in summary)


def _newest(listed: dict[str, tuple], most: int) -> dict[str, tuple]:
    """The newest findings, those without a time last, ties by id."""
    by_id = sorted(listed.items())
    by_id.sort(key=lambda e: (e[1][0] is None, -(e[1][0] or 0)))
    return dict(by_id[:most])


class _Activity(StatefulProcessor):
    """Of one principal and lane: the newest of its findings, their number and, once they are more than that, all by id."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "finding_id STRING", _SUMMARY)
        self.standing = handle.getValueState("standing", f"total BIGINT, newest ARRAY<STRUCT<finding_id: STRING, {_SUMMARY}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, listed = self.standing.get() or (0, [])
        newest = {e[0]: tuple(e[1:]) for e in listed}
        # A list of all findings is all there is to know of them; each call on the map is a message to the JVM and back.
        is_whole = total <= self.most
        for row in rows:
            summary = (row.moment, row.type, row.severity, row.title)
            held = newest.get(row.finding_id) if is_whole else self.known.getValue((row.finding_id,))
            if held is not None and _order(tuple(held)) >= _order(summary):
                continue
            # A finding's summary only ever gets newer, so what left the list cannot be wanted again.
            total += held is None
            newest[row.finding_id] = summary
            if not is_whole:
                self.known.updateValue((row.finding_id,), summary)
            elif total > self.most:
                is_whole = False
                for finding_id, listed_summary in newest.items():
                    self.known.updateValue((finding_id,), listed_summary)
            if len(newest) > 4 * self.most:
                newest = _newest(newest, self.most)
        newest = _newest(newest, self.most)
        self.standing.update((total, [(i, *s) for i, s in newest.items()]))
        yield Row(principal_id=key[0], lane=key[1], total=total)

    def close(self) -> None:
        pass


def activity_stream(findings: DataFrame, checkpoint: str, *, max_summaries: int = MAX_SUMMARIES, lanes: int = LANES):
    """A stream writer that keeps the activity of all findings it meets in its checkpoint; read_activity reads it.

    A finding that comes again counts once, with the greatest of its summaries; findings without an id or a
    principal have no part in it. State grows with the distinct findings, on disk, as no principal's findings
    ever run out.
    """
    keep_state_on_disk(findings.sparkSession)
    rows = findings.where((F.col("principal_id") != "") & F.col("finding_id").isNotNull()).select(
        "principal_id", F.pmod(F.xxhash64("finding_id"), F.lit(lanes)).cast("int").alias("lane"), "finding_id", F.unix_micros("center_time").alias("moment"), "type", "severity", "title"
    )
    # One more than asked for, so that a finding can be taken out of its own list.
    changed = rows.groupBy("principal_id", "lane").transformWithState(
        _Activity(max_summaries + 1), "principal_id STRING, lane INT, total BIGINT", "update", "None"
    )
    return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).format("noop")


def read_activity(spark: SparkSession, checkpoint: str, *, max_summaries: int = MAX_SUMMARIES) -> DataFrame:
    """(principal_id, total, newest) as related_activity gives it, after the last batch that was done."""
    keep_state_on_disk(spark)
    state = spark.read.format("statestore").option("stateVarName", "standing").load(checkpoint)
    # A lane has at most as many entries as a list, so a principal's are few.
    merged = state.groupBy(F.col("key.principal_id").alias("principal_id")).agg(
        F.sum("value.total").alias("total"), F.flatten(F.collect_list("value.newest")).alias("all")
    )
    never = F.lit(2**63 - 1)
    ordered = F.array_sort(
        F.transform(
            "all",
            lambda e: F.struct(
                F.coalesce(-e["moment"], never).alias("_order"), e["finding_id"].alias("id"),
                e["type"].alias("type"), e["severity"].alias("severity"), e["title"].alias("title"),
            ),
        )
    )
    return merged.select("principal_id", "total", F.slice(ordered, 1, max_summaries + 1).alias("newest"))
