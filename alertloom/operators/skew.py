"""Lookups that stay balanced when a few keys, or rows without a key, hold much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Parts that rows without a key are spread over.
NULL_PARTS = 256


def lookup_join(rows: DataFrame, unique: DataFrame, keys: Sequence[str], spread_by: str) -> DataFrame:
    """Left join to a table with one row per key.

    A heavy key is left to Spark: a left join whose two sides are shuffled for it is split where a
    partition turns out large, by the sizes it has by then, at no cost where none does. Rows with a
    null key match nothing; they would all hash to one partition, so they are spread by `spread_by`.
    """
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    part = F.when(no_key, F.pmod(F.xxhash64(spread_by), F.lit(NULL_PARTS)) + 1).otherwise(F.lit(0).cast("long"))
    # Always 0, but not a literal, which would be taken out of the join's keys again.
    none = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long"))
    return rows.withColumn("_part", part).join(unique.withColumn("_part", none), [*keys, "_part"], "left").drop("_part")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over at least as many tasks as the session runs at a time.

    For work that is heavy a row and comes before any shuffle: a file, or a group of rows in it, is read by one task
    whatever is done with its rows. Only the columns that are used are moved, and only the rows that pass the filters.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
