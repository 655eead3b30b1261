"""The audit trail as a table laid out by access key and time, with a kept index of how busy each key was.

Rows are bucketed by (access key, hour, lane), sorted by key and time inside a bucket, in a folder per UTC
day, with Parquet bloom filters on the key. A lookup that is dealt by the same three columns meets its
bucket where it lies, so the wide rows are not moved before they are known to matter. An hour of a busy
key has several lanes, by a hash of the event, so it is written and read by as many tasks.

Next to it lies the index: for each key and minute how many events there were, and for each key and hour
how many lanes. It is written with the days it is about and never again. The newest events of a window
are found in it by summing minutes from the window's end, so a run opens only the minutes that hold them,
however long the trail and however busy the key.

A day is written as a whole; writing it again replaces it, so a write that died is simply repeated. The
index of a day goes first: until its rows are there, too, the day is as it was or empty. Rows without a
key or a time belong to no timeline and are left out. An empty table has no events.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..schemas import TRAIL

# Seconds of a span of the layout and of a slot of the index.
SPAN_SECONDS = 3_600
SLOT_SECONDS = 60
# Rows of one key and hour that one task is to write and read.
LANE_ROWS = 1_000_000
BUCKETS = 256

_KEYS = ("access_key_id", "span", "lane")
_INDEX = "access_key_id STRING, span BIGINT, slot BIGINT, n_named BIGINT, n_unnamed BIGINT, lanes INT, dt DATE"
_EVENTS = TRAIL + ", span BIGINT, slot BIGINT, lane INT, dt DATE"
_LAYOUT = "buckets INT, lane_rows BIGINT"


def _part(time: str, seconds: int) -> Column:
    return F.expr(f"unix_seconds({time}) div {seconds}")


def _event() -> Column:
    return F.coalesce(F.col("event_id"), F.unix_micros("event_time").cast("string"))


@dataclass(frozen=True)
class TrailTable:
    """A trail in a folder; make one with create or open."""

    spark: SparkSession
    path: str
    name: str
    buckets: int
    lane_rows: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, buckets: int = BUCKETS, lane_rows: int = LANE_ROWS) -> "TrailTable":
        """A new table in a folder that all executors share. Take about as many buckets as tasks that read it."""
        spark.createDataFrame([(buckets, lane_rows)], _LAYOUT).write.parquet(f"{path}/layout")
        for folder, schema in (("index", _INDEX), ("events", _EVENTS)):
            spark.createDataFrame([], schema).write.partitionBy("dt").parquet(f"{path}/{folder}")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "TrailTable":
        """A table that is there, made known to this session's catalog."""
        layout = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
        name = f"trail_{uuid.uuid4().hex}"
        spark.sql(
            f"""CREATE TABLE {name} ({_EVENTS}) USING parquet
            OPTIONS ('parquet.bloom.filter.enabled#access_key_id' 'true') PARTITIONED BY (dt)
            CLUSTERED BY ({", ".join(_KEYS)}) SORTED BY (access_key_id, event_time) INTO {layout.buckets} BUCKETS LOCATION '{path}/events'"""
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return cls(spark, path, name, layout.buckets, layout.lane_rows)

    def rows(self) -> DataFrame:
        """All events with their span, slot, lane and day."""
        return self.spark.table(self.name)

    def index(self) -> DataFrame:
        """(access_key_id, span, slot, n_named, n_unnamed, lanes, dt) of each key's minutes with events."""
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index")

    def write_days(self, trail: DataFrame) -> None:
        """Write whole days; a day that is there already is replaced."""
        placed = trail.where("access_key_id IS NOT NULL AND event_time IS NOT NULL").select(
            *[F.col(c) for c in self.rows().columns if c not in ("span", "slot", "lane", "dt")],
            _part("event_time", SPAN_SECONDS).alias("span"), _part("event_time", SLOT_SECONDS).alias("slot"), F.to_date("event_time").alias("dt"),
        )
        counted = self._counted(placed)
        counted.select(*[f.name for f in self.index().schema.fields]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(f"{self.path}/index")
        # Hours of several lanes are as many as the days' rows have lanes; Spark sends them out or shuffles by their size.
        days = placed.select("dt").distinct()
        busy = self.index().where("lanes > 1").join(F.broadcast(days), "dt", "left_semi").select("access_key_id", "span", "lanes").distinct()
        lane = F.pmod(F.xxhash64(_event()), F.coalesce("lanes", F.lit(1))).cast("int")
        laned = placed.join(busy, ["access_key_id", "span"], "left").withColumn("lane", lane)
        columns = self.rows().columns
        # One task for each bucket, which it writes in a file a day.
        dealt = laned.select(*columns).repartition(self.buckets, *_KEYS)
        with _days_replaced(self.spark):
            dealt.write.insertInto(self.name, overwrite=True)
        self.spark.catalog.refreshTable(self.name)

    def _counted(self, placed: DataFrame) -> DataFrame:
        """The index of some rows; copies of an event in one minute are one."""
        slot = ["access_key_id", "dt", "span", "slot"]
        events = placed.groupBy(*slot, F.col("event_id").isNotNull().alias("named"), _event().alias("event")).agg(F.count("*").alias("copies"))
        slots = events.groupBy(*slot).agg(F.count_if("named").alias("n_named"), F.count_if(~F.col("named")).alias("n_unnamed"), F.sum("copies").alias("n"))
        # At most 60 minutes an hour.
        n_lanes = F.ceil(F.sum("n").over(W.partitionBy("access_key_id", "dt", "span")) / self.lane_rows).cast("int")
        return slots.withColumn("lanes", n_lanes)

    def probed(self, windows: DataFrame, max_events: int) -> DataFrame:
        """(access_key_id, first, last, span, slot, lanes, asked): the minutes with events that windows reach over.

        `windows` has access_key_id, earliest and latest; those that begin and end in the same minutes, `first`
        and `last`, are one. Asked are the minute of the end and those before until the whole ones among
        them hold max_events events with an id, and the newest with one without.
        """
        probes = with_minutes(windows).select("access_key_id", "first", "last").distinct()
        per_span = SPAN_SECONDS // SLOT_SECONDS
        spans = F.explode(F.sequence(F.expr(f"first div {per_span}"), F.expr(f"last div {per_span}")))
        met = probes.select("*", spans.alias("span")).join(self.index().where(_on(windows)).drop("dt"), ["access_key_id", "span"]).where("slot BETWEEN first AND last")
        # A probe meets at most as many minutes as its window has.
        later = W.partitionBy("access_key_id", "first", "last").orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, -1)
        whole = F.col("slot") < F.col("last")
        named, unnamed = (F.coalesce(F.sum(F.when(whole, F.col(c)).otherwise(0)).over(later), F.lit(0)) for c in ("n_named", "n_unnamed"))
        counted = met.withColumns({"_named": named, "_unnamed": unnamed})
        asked = (F.col("_named") < max_events) | ((F.col("n_unnamed") > 0) & (F.col("_unnamed") < 1))
        return counted.select("access_key_id", "first", "last", "span", "slot", "lanes", asked.alias("asked"))

    def _where(self, windows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows joined to wanted hours (access_key_id, span, lanes, ...) where they lie; the rows are not moved for it."""
        laned = wanted.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")
        return self.rows().where(_on(windows)).join(laned, list(_KEYS))

    def near(self, windows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Trail rows of wanted minutes (access_key_id, span, slots, lanes)."""
        met = self._where(windows, wanted).where("array_contains(slots, slot)")
        return met.select(*[F.col(c) for c in _trail_columns(self.rows())])

    def around(self, windows: DataFrame, wanted: DataFrame, moments: DataFrame) -> DataFrame:
        """Trail rows of each key's hours between the first and the last of the given moments (access_key_id, moment)."""
        spans = moments.groupBy("access_key_id", _part("moment", SPAN_SECONDS).alias("span")).agg(F.min("moment").alias("since"), F.max("moment").alias("until"))
        met = self._where(windows, spans.join(wanted.drop("slots"), ["access_key_id", "span"])).where("event_time BETWEEN since AND until")
        return met.select(*[F.col(c) for c in _trail_columns(self.rows())])


@contextmanager
def _days_replaced(spark: SparkSession) -> Iterator[None]:
    """Inserts replace only the folders they write; a table's insert takes no option of its own for it."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_minutes(windows: DataFrame) -> DataFrame:
    """Windows with the slots of their ends, `first` and `last`."""
    return windows.withColumns({"first": _part("earliest", SLOT_SECONDS), "last": _part("latest", SLOT_SECONDS)})


def by_hour(minutes: DataFrame) -> DataFrame:
    """(access_key_id, span, slots, lanes) of minutes (access_key_id, span, slot, lanes), at most 60 an hour."""
    return minutes.groupBy("access_key_id", "span").agg(F.collect_set("slot").alias("slots"), F.max("lanes").alias("lanes"))


def _on(windows: DataFrame) -> Column:
    """Whether a row's day is one that windows touch. Days are few, as the calendar bounds them, and are looked up
    first: a plain condition prunes folders whatever the plan, a join does so only where Spark expects a gain."""
    touched = windows.select(F.explode(F.sequence(F.to_date("earliest"), F.to_date("latest"))).alias("dt")).distinct()
    return F.col("dt").isin([row.dt for row in touched.collect()])


def _trail_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("span", "slot", "lane", "dt")]
