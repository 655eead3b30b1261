"""Cutting lineage in a way that outlives an executor."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own inside the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PLACES: ContextVar[Iterator[str] | None] = ContextVar("places", default=None)


@contextmanager
def reused_places(folder: str) -> Iterator[None]:
    """Inside, the tables of written_once go to numbered places in a folder, over what an earlier run left there.

    So a job that runs again and again keeps the tables of one run and not of all. Rows that read them must
    have been used up before the next run with the same folder.
    """
    token = _PLACES.set(f"{folder}/{n}" for n in itertools.count())
    try:
        yield
    finally:
        _PLACES.reset(token)


def written_once(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to a table of their own in the shared folder and read back from there.

    Unlike a checkpointed RDD the table is columnar: later steps read only the columns and row
    groups they need, and its size is known to the planner.
    """
    spark = rows.sparkSession
    places = _PLACES.get()
    path = new_folder(spark, name) if places is None else f"{next(places)}-{name}"
    rows.write.mode("errorifexists" if places is None else "overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
