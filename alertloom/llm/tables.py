"""Reading the corpus tables, and columns that must not clash with a caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(column: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(column), F.lit(""))
