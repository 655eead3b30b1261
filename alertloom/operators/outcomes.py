"""Final severity, outcome rows and everything written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages, text
from ..functions.bands import rescore

# Prices per token in USD.
INPUT_PRICE = 5.0 / 1_000_000
OUTPUT_PRICE = 25.0 / 1_000_000


def estimated_cost(input_tokens: Column, output_tokens: Column, input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> Column:
    return F.coalesce(input_tokens, F.lit(0)) * F.lit(input_price) + F.coalesce(output_tokens, F.lit(0)) * F.lit(output_price)


def scored(grounded: DataFrame) -> DataFrame:
    """Adds status, final_severity and the signals it came from to rows that have `degraded`.

    A finding without a brief is scored as if the model had said LOW.
    """
    severity = F.col("bundle.finding.severity")
    blast = F.col("bundle.iam_context.blast_radius")
    related = F.col("bundle.related_findings.count")
    degraded = F.col("degraded")
    model = F.when(degraded, "LOW").otherwise(F.col("brief.severity"))
    return (
        grounded.withColumn("status", F.when(degraded, "degraded").otherwise("analyzed"))
        .withColumn("final_severity", rescore(severity, blast, related, model))
        .withColumn("blast_radius", blast)
        .withColumn("related_count", related)
        .withColumn("action_count", F.when(degraded, 0).otherwise(F.size("brief.recommended_actions")))
    )


def outcome_rows(triaged: DataFrame) -> DataFrame:
    return triaged.select(
        "finding_id", "status", "reason", "final_severity", "blast_radius", "related_count", "action_count",
        "processing_ms", "degraded", "request_id", "input_tokens", "output_tokens",
        estimated_cost(F.col("input_tokens"), F.col("output_tokens")).alias("cost_usd"),
        estimated_cost(F.col("all_input_tokens"), F.col("all_output_tokens")).alias("total_cost_usd"),
        F.col("ingest_time").alias("ts"),
    )


def all_outcomes(triaged: DataFrame, skips: DataFrame) -> DataFrame:
    """Analyzed, degraded and skipped outcomes as one table."""
    return outcome_rows(triaged).unionByName(skips, allowMissingColumns=True)


def report_key(finding_id: Column, run_ts: Column) -> Column:
    return F.concat(F.lit("reports/"), finding_id, F.lit("/"), text.iso_utc(run_ts), F.lit(".json"))


def console_url(region: Column, bucket: Column, key: Column) -> Column:
    return F.concat(
        F.lit("https://"), region, F.lit(".console.aws.amazon.com/s3/object/"), bucket,
        F.lit("?region="), region, F.lit("&prefix="), key,
    )


def report_rows(triaged: DataFrame, run_ts: Column) -> DataFrame:
    """(finding_id, key, dt, report): the whole artifact as JSON, in its analyzed or degraded shape.

    Rows that have their bundle's JSON text as `evidence` give that, others are written out from the bundle.
    """
    usage = F.struct("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    evidence = F.col("evidence") if "evidence" in triaged.columns else F.coalesce(text.flat_json(F.col("bundle")), F.lit("null"))
    finding = F.coalesce(text.flat_json(F.col("bundle.finding")), F.lit("null"))
    analyzed = text.flat_json(F.struct("brief", "final_severity", usage.alias("usage"), "request_id"))
    degraded = text.flat_json(
        F.struct(F.lit(None).cast("string").alias("brief"), F.lit(True).alias("degraded"), "reason", "final_severity")
    )
    rest = F.substr(F.when(F.col("degraded"), degraded).otherwise(analyzed), F.lit(2))
    return triaged.select(
        "finding_id",
        report_key(F.col("finding_id"), run_ts).alias("key"),
        F.to_date(run_ts).alias("dt"),
        F.concat(F.lit('{"finding":'), finding, F.lit(',"enrichment":'), evidence, F.lit(","), rest).alias("report"),
    )


def audit_rows(triaged: DataFrame, run_ts: Column) -> DataFrame:
    """One row per (finding_id, timestamp); reason only for degraded findings."""
    return triaged.select(
        "finding_id",
        text.iso_utc(run_ts).alias("timestamp"),
        "final_severity",
        "blast_radius",
        F.col("action_count").cast("bigint").alias("action_count"),
        "processing_ms",
        "degraded",
        F.nullif("request_id", F.lit("")).alias("request_id"),
        "reason",
    )


def notification_rows(triaged: DataFrame, run_ts: Column, *, region: str, bucket: str, product: str) -> DataFrame:
    """(finding_id, payload): the message to deliver for each finding."""
    url = console_url(F.lit(region), F.lit(bucket), report_key(F.col("finding_id"), run_ts))
    brief = messages.brief_payload(F.col("bundle"), F.col("brief"), F.col("final_severity"), url)
    degraded = messages.degraded_payload(F.col("bundle"), F.coalesce("reason", F.lit("unknown")), product)
    return triaged.select("finding_id", F.when(F.col("degraded"), degraded).otherwise(brief).alias("payload"))


def metric_rows(outcomes: DataFrame, namespace: str = "Triage", dimensions: dict[str, str] | None = None) -> DataFrame:
    """Five named values per triaged finding in long form; skipped findings emit none."""
    values = {
        "ProcessingTimeMs": F.col("processing_ms"),
        "InputTokens": F.coalesce("input_tokens", F.lit(0)),
        "OutputTokens": F.coalesce("output_tokens", F.lit(0)),
        "EstCostUSD": F.col("cost_usd"),
        "Failures": F.col("degraded").cast("int"),
    }
    pairs = [item for name, value in values.items() for item in (F.lit(name), value.cast("double"))]
    named = {str(k): str(v) for k, v in (dimensions or {}).items()}
    labels = F.create_map(*[F.lit(x) for pair in named.items() for x in pair]) if named else F.create_map().cast("map<string,string>")
    return outcomes.where("status <> 'skipped'").select(
        "finding_id", "ts", F.lit(namespace).alias("namespace"), labels.alias("dimensions"), F.stack(F.lit(len(values)), *pairs).alias("metric", "value")
    )


def brief_view(triaged: DataFrame) -> DataFrame:
    """One display row per finding, dropped lists included."""
    return triaged.select(
        "finding_id",
        F.col("bundle.finding.type").alias("type"),
        "status",
        "reason",
        "final_severity",
        F.col("brief.confidence").alias("confidence"),
        "blast_radius",
        "related_count",
        F.size("bundle.cloudtrail_events").alias("event_count"),
        F.col("brief.summary").alias("summary"),
        F.array_join(F.transform("brief.attack_techniques", lambda t: F.concat(t["technique_id"], F.lit("  "), t["name"])), "\n").alias("techniques"),
        messages.numbered(F.col("brief.recommended_actions")).alias("actions"),
        "dropped_techniques",
        "dropped_resources",
        "processing_ms",
        "input_tokens",
        "output_tokens",
        "cache_read_input_tokens",
        "request_id",
    )
