"""Which batches of a folder of tables count.

A batch writes several tables, and they cannot appear at one time. So a row that says that the batch is
whole is written after all of them, and readers take only batches that have one: a batch that died between
two tables is not seen, and once it has been run again it is there once. A batch that counts is never
written again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .claim_ledger import read_if_there

_COMMITS = "batch_id BIGINT, writer STRING"


@dataclass(frozen=True)
class CommitLog:
    """The commits of a folder; one that is not yet written has none."""

    spark: SparkSession
    folder: str

    def batches(self) -> DataFrame:
        """(batch_id, writer) of the batches that count, one row each."""
        return read_if_there(self.spark, f"{self.folder}/commits", _COMMITS)

    def holds(self, batch_id: int, writer: str | None = None) -> bool:
        """Whether a batch counts already. Batches that another writer numbered are an error, as theirs would be lost."""
        # Only the batch's own folder is read, however many there are.
        held = read_if_there(self.spark, f"{self.folder}/commits/batch_id={batch_id}", "writer STRING").collect()
        if held and None not in (writer, held[0].writer) and held[0].writer != writer:
            raise ValueError(f"batch {batch_id} of {self.folder} was written by {held[0].writer}, not by {writer}")
        return bool(held)

    def is_new(self) -> bool:
        return self.batches().isEmpty()

    def commit(self, batch_id: int, writer: str | None = None) -> None:
        row = self.spark.createDataFrame([(writer,)], "writer STRING")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch_id={batch_id}")

    def adopt(self, batch_ids: Iterable[int]) -> None:
        """Let batches count that were written before there was a log."""
        for batch_id in sorted(batch_ids):
            self.commit(batch_id)

    def read(self, table: str, schema: str | None = None, fmt: str = "parquet", *, after_batch: int | None = None) -> DataFrame:
        """A table's rows of the batches that count, `batch_id` with them; of those after one batch if given.

        Without a schema the table must have been written. Files of other batches are pruned by their folders.
        """
        reader = self.spark.read.format(fmt)
        rows = (reader if schema is None else reader.schema(f"{schema}, batch_id BIGINT")).load(f"{self.folder}/{table}")
        rows = rows.withColumn("batch_id", F.col("batch_id").cast("bigint"))
        counting = self.batches().select("batch_id")
        if after_batch is not None:
            rows, counting = (r.where(F.col("batch_id") > after_batch) for r in (rows, counting))
        return rows.join(counting, "batch_id", "left_semi")
