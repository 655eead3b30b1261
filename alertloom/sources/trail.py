"""Audit-log lookup records flattened to the trail table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import TRAIL, TRAIL_RAW


def read_trail_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAIL_RAW).json(path)


def read_trail(spark: SparkSession, path: str) -> DataFrame:
    """Flattened trail kept as parquet; key and time predicates reach the scan."""
    return spark.read.schema(TRAIL).parquet(path)


def flatten_trail(raw: DataFrame) -> DataFrame:
    """Trail rows from lookup records; inner JSON that does not parse leaves its fields null."""
    raw = raw.withColumn("_inner", F.try_parse_json("CloudTrailEvent"))
    inner = F.col("_inner")

    def field(path: str) -> Column:
        return F.try_variant_get(inner, f"$.{path}", "string")

    key = F.coalesce(F.col("AccessKeyId"), field("userIdentity.accessKeyId")) if "AccessKeyId" in raw.columns else field("userIdentity.accessKeyId")
    return raw.select(
        key.alias("access_key_id"),
        F.col("EventId").alias("event_id"),
        F.col("EventTime").alias("event_time"),
        F.coalesce(F.nullif("EventName", F.lit("")), field("eventName")).alias("event_name"),
        field("eventSource").alias("event_source"),
        F.coalesce(F.nullif("Username", F.lit("")), field("userIdentity.userName")).alias("username"),
        field("sourceIPAddress").alias("source_ip"),
        field("userAgent").alias("user_agent"),
        field("awsRegion").alias("aws_region"),
        field("errorCode").alias("error_code"),
        field("errorMessage").alias("error_message"),
        F.to_json(F.try_variant_get(inner, "$.requestParameters", "variant")).alias("request_parameters"),
    )
