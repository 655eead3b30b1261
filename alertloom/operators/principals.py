"""Principal profiles and blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import level_name
from ..functions.policy import document_number, managed_policy_number
from .skew import lookup_join

PRINCIPAL = ("kind", "user_name")
# Fixed value: the radius of a principal that cannot be looked up.
UNKNOWN = "UNKNOWN"


def principal_kind(user_type: Column) -> Column:
    """'user' for IAMUser in any case; every other type is looked up as a role."""
    return F.when(F.lower(user_type) == "iamuser", "user").otherwise("role")


def _names(column: str) -> Column:
    """Sorted distinct names; a principal's policies and groups are few by platform quota."""
    return F.array_sort(F.collect_set(column))


def profiles(principals: DataFrame, attached: DataFrame, inline: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per known principal: policy and group names and blast_radius.

    The three sides are stacked and reduced in one grouped pass, so each principal is shuffled once
    and copies combine map-side.
    """
    nothing = F.lit(None).cast("string")
    sides = (
        principals.select(*PRINCIPAL, F.lit(True).alias("known"), nothing.alias("attached"), nothing.alias("inline"), nothing.alias("grp"), F.lit(1).alias("number"))
        .unionByName(
            attached.select(*PRINCIPAL, F.lit(False).alias("known"), F.col("policy_name").alias("attached"), nothing.alias("inline"), nothing.alias("grp"), managed_policy_number(F.col("policy_name")).alias("number"))
        )
        .unionByName(
            inline.select(*PRINCIPAL, F.lit(False).alias("known"), nothing.alias("attached"), F.col("policy_name").alias("inline"), nothing.alias("grp"), document_number(F.col("document")).alias("number"))
        )
        .unionByName(
            groups.select(F.lit("user").alias("kind"), "user_name", F.lit(False).alias("known"), nothing.alias("attached"), nothing.alias("inline"), F.col("group_name").alias("grp"), F.lit(1).alias("number"))
        )
    )
    reduced = sides.where(F.col("user_name") != "").groupBy(*PRINCIPAL).agg(
        F.max("known").alias("known"),
        _names("attached").alias("attached_policies"),
        _names("inline").alias("inline_policies"),
        _names("grp").alias("groups"),
        F.max("number").alias("number"),
    )
    return reduced.where("known").select(
        *PRINCIPAL, "attached_policies", "inline_policies", "groups", level_name(F.col("number")).alias("blast_radius")
    )


def blast_radius(principals: DataFrame, attached: DataFrame, inline: DataFrame) -> DataFrame:
    """(kind, user_name, blast_radius): the highest band over a principal's policies, at least LOW."""
    bands = (
        principals.select(*PRINCIPAL, F.lit(True).alias("known"), F.lit(1).alias("number"))
        .unionByName(attached.select(*PRINCIPAL, F.lit(False).alias("known"), managed_policy_number(F.col("policy_name")).alias("number")))
        .unionByName(inline.select(*PRINCIPAL, F.lit(False).alias("known"), document_number(F.col("document")).alias("number")))
    )
    reduced = bands.groupBy(*PRINCIPAL).agg(F.max("known").alias("known"), F.max("number").alias("number"))
    return reduced.where("known").select(*PRINCIPAL, level_name(F.col("number")).alias("blast_radius"))


def with_profile(findings: DataFrame, profiled: DataFrame) -> DataFrame:
    """Findings plus policy and group lists and blast_radius, UNKNOWN where the principal is not known."""
    packed = profiled.select(*PRINCIPAL, F.struct("attached_policies", "inline_policies", "groups", "blast_radius").alias("_profile"))
    none = F.array().cast("array<string>")
    kind = principal_kind(F.col("user_type"))
    joined = lookup_join(findings.withColumn("kind", kind), packed, PRINCIPAL, "finding_id")
    return (
        joined.withColumn("attached_policies", F.coalesce("_profile.attached_policies", none))
        .withColumn("inline_policies", F.coalesce("_profile.inline_policies", none))
        .withColumn("groups", F.coalesce("_profile.groups", none))
        .withColumn("blast_radius", F.coalesce("_profile.blast_radius", F.lit(UNKNOWN)))
        .drop("_profile", "kind")
    )
