"""Rules stated in prose for the model, as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Threat purpose of a finding type, the stage it stands for, its candidate techniques.
PURPOSES = (
    ("Recon", "discovery", ("T1580", "T1087.004", "T1526")),
    ("Discovery", "discovery", ("T1580", "T1087.004", "T1526")),
    ("UnauthorizedAccess", "credential use", ("T1078.004", "T1552.005", "T1528")),
    ("CredentialAccess", "credential use", ("T1078.004", "T1552.005", "T1528")),
    ("Stealth", "defense evasion", ("T1562.008", "T1562")),
    ("DefenseEvasion", "defense evasion", ("T1562.008", "T1562")),
    ("CryptoCurrency", "impact", ("T1496", "T1485", "T1486")),
    ("Impact", "impact", ("T1496", "T1485", "T1486")),
    ("Exfiltration", "exfiltration", ("T1530", "T1537", "T1567")),
    ("Trojan", "persistence", ("T1098.001", "T1136.003")),
    ("Backdoor", "persistence", ("T1098.001", "T1136.003")),
)

# Ours: API calls that stand for each escalation signal the guidance names in words.
SIGNALS = {
    "secret_access": ("GetSecretValue", "GetParameter", "GetParameters", "Decrypt"),
    "bucket_opened": ("PutBucketPolicy",),
    "logging_disabled": ("StopLogging", "DeleteTrail", "DeleteDetector", "StopConfigurationRecorder"),
    "identity_created": ("CreateAccessKey", "CreateUser", "CreateRole"),
    "instances_launched": ("RunInstances",),
    "snapshot_shared": ("CreateSnapshot", "ModifySnapshotAttribute"),
    "deletion": ("TerminateInstances", "DeleteSnapshot", "DeleteBackup", "DeleteRecoveryPoint"),
}


def purposes(spark: SparkSession) -> DataFrame:
    """(purpose, stage, candidates); eleven rows, so always safe to broadcast."""
    rows = ", ".join(
        f"('{purpose}', '{stage}', array({', '.join(repr(i) for i in ids)}))" for purpose, stage, ids in PURPOSES
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(purpose, stage, candidates)")


def threat_purpose(finding_type: Column) -> Column:
    """What stands before the colon of Purpose:Resource/Family; null without a colon."""
    return F.when(finding_type.contains(":"), F.split_part(finding_type, F.lit(":"), F.lit(1)))


def with_stage(findings: DataFrame) -> DataFrame:
    dimension = F.broadcast(purposes(findings.sparkSession))
    return findings.withColumn("purpose", threat_purpose(F.col("type"))).join(dimension, "purpose", "left")


def timeline_signals(timeline: DataFrame, signals: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(finding_id, one boolean per signal) from the collected events, inside the row."""
    chosen = SIGNALS if signals is None else signals
    names = F.transform("events", lambda e: e["event_name"])
    flags = [F.arrays_overlap(names, F.array(*[F.lit(call) for call in calls])) for calls in chosen.values()]
    return timeline.select("finding_id", *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in zip(chosen, flags)])
