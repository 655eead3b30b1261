"""From model responses to one checked decision per finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import briefs, text

_USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def typed_responses(responses: DataFrame) -> DataFrame:
    """Responses plus the typed brief and the degraded reason of each attempt."""
    # Parsed in a step of its own: the check looks at the parsed brief many times.
    parsed = responses.withColumns({"_typed": briefs.typed(F.col("brief_json")), "_shape": briefs.shape(F.col("brief_json"))})
    typed = parsed.withColumn("brief", briefs.checked(F.col("_typed"), F.col("_shape"))).drop("brief_json", "_typed", "_shape")
    return typed.withColumn("reason", briefs.degraded_reason(F.col("error_type"), F.col("stop_reason"), F.col("brief")))


def resolve_attempts(typed: DataFrame, *, retry: bool = True) -> DataFrame:
    """One row per finding: which of at most two attempts stands, and why none does.

    A second attempt counts only where the first gave a brief whose techniques are all unknown.
    Without retry the first attempt stands whatever its techniques. Tokens, request id and model
    are those of the last attempt made, processing_ms is the sum over the attempts made.
    """
    attempt = F.struct(
        "reason", "brief", *_USAGE, "request_id", "model", "processing_ms", F.col("attempt").alias("attempts")
    )
    per_finding = typed.where("attempt <= 2").groupBy("finding_id").agg(
        F.max(F.when(F.col("attempt") == 1, attempt)).alias("one"),
        F.max(F.when(F.col("attempt") == 2, attempt)).alias("two"),
    )

    def fails(a: str):
        return F.col(f"{a}.reason").isNull() & ~briefs.is_trustworthy(F.col(f"{a}.brief.attack_techniques"))

    goes_on = (fails("one") & F.col("two").isNotNull()) if retry else F.lit(False)
    cost_all = [F.coalesce(F.col("one." + c), F.lit(0)) + F.when(goes_on, F.coalesce(F.col("two." + c), F.lit(0))).otherwise(0) for c in _USAGE[:2]]
    chosen = per_finding.select(
        "finding_id",
        F.when(goes_on, F.col("two")).otherwise(F.col("one")).alias("a"),
        (F.col("one.processing_ms") + F.when(goes_on, F.coalesce("two.processing_ms", F.lit(0))).otherwise(0)).alias("processing_ms"),
        cost_all[0].alias("all_input_tokens"),
        cost_all[1].alias("all_output_tokens"),
    )
    unusable = fails("a") if retry else F.lit(False)
    reason = F.when(F.col("a").isNull(), briefs.NO_RESPONSE).when(unusable, briefs.VALIDATION_FAILED).otherwise(F.col("a.reason"))
    return chosen.withColumn("reason", reason).select(
        "finding_id",
        "reason",
        F.when(F.col("reason").isNull(), F.col("a.brief")).alias("brief"),
        *[F.col("a." + c).alias(c) for c in (*_USAGE, "request_id", "model", "attempts")],
        "processing_ms",
        "all_input_tokens",
        "all_output_tokens",
    )


def ground(decided: DataFrame) -> DataFrame:
    """Brief with unknown techniques and ungrounded resources taken out, both listed as dropped, and `degraded`.

    Needs `brief` and `bundle` in the row, or the bundle's JSON text as `evidence`: the containment test never leaves the row.
    """
    proposed = F.col("brief.attack_techniques")
    named = F.col("brief.affected_resources")
    evidence = F.col("evidence") if "evidence" in decided.columns else text.flat_json(F.col("bundle"))
    # The evidence text is built once per row and only where a brief names resources.
    rows = decided.withColumn("_evidence", F.when(F.size(named) > 0, evidence))
    # Kept and dropped resources are both read off one search of the text.
    rows = rows.withColumn("_grounded", briefs.grounded(named, F.col("_evidence"))).drop("_evidence")
    # Taken from the brief as it came, so that a filter on it does not drag the grounding along.
    rows = rows.withColumn("degraded", F.col("brief").isNull())
    cleaned = (
        F.col("brief")
        .withField("attack_techniques", briefs.kept_techniques(proposed))
        .withField("affected_resources", briefs.kept_resources(named, F.col("_grounded")))
    )
    return (
        rows.withColumn("dropped_techniques", briefs.dropped_techniques(proposed))
        .withColumn("dropped_resources", briefs.dropped_resources(named, F.col("_grounded")))
        .withColumn("valid", briefs.is_trustworthy(proposed))
        .withColumn("brief", F.when(~F.col("degraded"), cleaned))
        .drop("_grounded")
    )


def grounding_matches(resources: DataFrame, evidence: DataFrame) -> DataFrame:
    """The resources with `grounded`, in bulk: an equi-join on the finding with containment as residual."""
    found = resources.join(evidence, "finding_id", "left")
    wanted = text.strip_whitespace(F.col("resource"))
    grounded = F.coalesce((wanted != "") & F.contains(F.col("evidence"), wanted), F.lit(False))
    return found.select(*resources.columns, grounded.alias("grounded"))
