"""The claim ledger as a base in buckets and a delta per batch, merged when it is read.

Each batch writes its claims to a small folder of its own; writing the same batch again replaces it.
Every few batches the deltas are merged into the base: only buckets that they touch are written anew,
and claims that have run out are left behind. A bucket has two places and is written to the one that
does not count at the time; a row of the manifest, written last, says which places count and up to
which batch, so a merge that dies leaves the ledger as it was. Deltas and manifest rows go round a ring
of folders. So what is stored and read is bounded by the live claims, however many batches there were,
and nothing has to be deleted.

A batch may be replayed until the next one has begun, so a merge takes only batches before the one that
runs. Batch ids grow; gaps are allowed. One job writes at a time. Rows without an id claim nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS = 256
# Batches after which deltas are merged, folders for them, and rows kept of the manifest.
MERGE_EVERY = 8
DELTA_RING = 16
MANIFEST_RING = 4

_DELTA = "finding_id STRING, expires_at BIGINT, batch_id BIGINT, bucket INT, slot INT"
_BASE = "finding_id STRING, expires_at BIGINT, batch_id BIGINT, generation BIGINT, place INT, bucket INT"
_MANIFEST = "generation BIGINT, upto BIGINT, buckets INT, places MAP<INT, INT>"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The named columns of a Parquet table, which is empty where its folder does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*T.StructType.fromDDL(schema).names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _latest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("bucket", "finding_id").agg(F.max(F.struct("batch_id", "expires_at")).alias("c"))
    return last.select("bucket", "finding_id", "c.batch_id", "c.expires_at")


@dataclass(frozen=True)
class ClaimLedger:
    """A ledger in a folder; one that is not yet written is empty."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    merge_every: int = MERGE_EVERY

    def _state(self) -> tuple[int, int, int, dict[int, int]]:
        # The ring bounds the rows, and the buckets what is in one.
        rows = read_if_there(self.spark, f"{self.path}/manifest", _MANIFEST).orderBy(F.desc("generation")).limit(1).collect()
        return (rows[0].generation, rows[0].upto, rows[0].buckets, rows[0].places) if rows else (-1, -1, self.buckets, {})

    def _base(self, places: dict[int, int]) -> DataFrame:
        counts = F.lit(False)
        for place in sorted(set(places.values())):
            counts = counts | ((F.col("place") == place) & F.col("bucket").isin([b for b, p in places.items() if p == place]))
        return read_if_there(self.spark, f"{self.path}/base", _BASE).where(counts)

    def _deltas(self, upto: int, before: int | None = None) -> DataFrame:
        """Claims of the batches after one, and before another; only their folders of the ring are read."""
        rows = read_if_there(self.spark, f"{self.path}/deltas", _DELTA).where(F.col("batch_id") > upto)
        if before is not None:
            slots = {n % DELTA_RING for n in range(max(upto + 1, before - DELTA_RING), before)}
            rows = rows.where(F.col("slot").isin(*slots) & (F.col("batch_id") < before))
        return rows.drop("slot")

    def claims(self, before_batch: int | None = None, now_seconds: Column | None = None) -> DataFrame:
        """(finding_id, expires_at): the last claim of each id, of batches before the given one.

        With now_seconds the claims that have run out are left out in the scan, as a later claim on an
        id runs longer. A batch before one that is merged already cannot be asked for.
        """
        _, upto, _, places = self._state()
        if before_batch is not None and before_batch <= upto:
            raise ValueError(f"batch {before_batch} is merged already, up to {upto}")
        rows = self._base(places).select("bucket", "finding_id", "batch_id", "expires_at").unionByName(self._deltas(upto, before_batch))
        if now_seconds is not None:
            rows = rows.where(F.col("expires_at") > now_seconds)
        return _latest(rows).select("finding_id", "expires_at")

    def add(self, claims: DataFrame, batch_id: int) -> None:
        """Write the claims of a batch; the same batch again replaces them."""
        _, upto, buckets, _ = self._state()
        if not upto < batch_id <= upto + DELTA_RING:
            raise ValueError(f"batch {batch_id} does not follow what is merged, up to {upto}; merge first")
        rows = claims.where(F.col("finding_id").isNotNull()).select(
            "finding_id", F.col("expires_at").cast("bigint").alias("expires_at"), F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.pmod(F.xxhash64("finding_id"), F.lit(buckets)).cast("int").alias("bucket"),
        )
        rows.write.mode("overwrite").parquet(f"{self.path}/deltas/slot={batch_id % DELTA_RING}")

    def is_new(self) -> bool:
        return self._state()[0] < 0 and self._deltas(-1).isEmpty()

    def start(self, claims: DataFrame, upto: int, now_seconds: Column) -> None:
        """Begin a new ledger with the claims that stood after a batch."""
        rows = claims.where(F.col("finding_id").isNotNull()).withColumn("batch_id", F.lit(upto).cast("bigint"))
        self._merge(rows.withColumn("bucket", F.pmod(F.xxhash64("finding_id"), F.lit(self.buckets)).cast("int")), upto, now_seconds)

    def merge_if_due(self, running_batch: int, now_seconds: Column) -> bool:
        """Merge the batches before the one that runs, if there are enough of them."""
        _, upto, _, _ = self._state()
        if running_batch - 1 - upto < self.merge_every:
            return False
        self.merge(running_batch - 1, now_seconds)
        return True

    def merge(self, upto: int, now_seconds: Column) -> None:
        """Bring the deltas up to a batch into the base, run-out claims of touched buckets left behind."""
        self._merge(self._deltas(self._state()[1], upto + 1), upto, now_seconds)

    def _merge(self, deltas: DataFrame, upto: int, now_seconds: Column) -> None:
        generation, _, buckets, places = self._state()
        touched = sorted(r.bucket for r in deltas.select("bucket").distinct().collect())
        held = self._base({b: p for b, p in places.items() if b in touched})
        live = _latest(held.select("bucket", "finding_id", "batch_id", "expires_at").unionByName(deltas)).where(F.col("expires_at") > now_seconds)
        second = [b for b in touched if places.get(b) == 0]
        place = F.when(F.col("bucket").isin(second), 1).otherwise(0)
        rows = live.withColumn("generation", F.lit(generation + 1).cast("bigint")).withColumn("place", place)
        (
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("place", "bucket").parquet(f"{self.path}/base")
        )
        # A touched bucket of which nothing lives leaves an older file in its place, which must not count.
        new = read_if_there(self.spark, f"{self.path}/base", _BASE).where((F.col("generation") == generation + 1) & F.col("bucket").isin(touched))
        written = {r.bucket: r.place for r in new.select("bucket", "place").distinct().collect()}
        places = {b: p for b, p in places.items() if b not in touched} | written
        row = self.spark.createDataFrame([(generation + 1, upto, buckets, places)], _MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/slot={(generation + 1) % MANIFEST_RING}")
