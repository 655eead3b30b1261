"""User-level jobs: enrich, prompt, triage a batch, triage on demand, evaluate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.briefs import NO_RESPONSE
from ..operators import evaluation, gate, outcomes as out
from ..operators.bundles import activity, bundle, bundle_text, calls
from ..operators.durable import written_once
from ..operators.principals import profiles, with_profile
from ..operators.related import MAX_SUMMARIES, KeptActivity, with_related
from ..operators.timeline import MAX_EVENTS, WINDOW_HOURS, with_timeline
from ..operators.validation import ground, resolve_attempts, typed_responses
from ..sources.trail_table import TrailTable


@dataclass(frozen=True)
class Context:
    """The tables findings are read against; history None means the findings themselves."""

    trail: DataFrame | TrailTable
    principals: DataFrame
    attached: DataFrame
    inline: DataFrame
    groups: DataFrame
    history: DataFrame | KeptActivity | None = None


def enrich(
    findings: DataFrame,
    context: Context,
    *,
    plain: DataFrame | None = None,
    carry: Sequence[str] = (),
    window_hours: float = WINDOW_HOURS,
    max_events: int = MAX_EVENTS,
    max_summaries: int = MAX_SUMMARIES,
    as_text: bool = False,
) -> DataFrame:
    """(finding_id, ingest_time, bundle), one row per finding; finding_id must be unique.

    With `as_text` the bundle's JSON text is there too, as `evidence`, and of its events the bundle itself has only
    what a notification names. The text of a timeline is made once, so that nothing takes events apart a finding.

    The narrow lookups come first, so the wide timeline is moved once. `plain` is the findings
    table itself if `findings` already has joins in it, `carry` names its columns to keep.
    """
    base = findings if plain is None else plain
    profiled = profiles(context.principals, context.attached, context.inline, context.groups)
    narrow = with_related(findings, context.history, max_summaries=max_summaries, plain=base)
    narrow = with_profile(narrow, profiled)
    wide = with_timeline(
        narrow,
        context.trail,
        plain=base,
        shape={"events": calls(), "events_json": text.flat_json(activity())} if as_text else {"events": activity()},
        window_hours=window_hours,
        max_events=max_events,
    )
    if not as_text:
        return wide.select("finding_id", "ingest_time", *carry, bundle().alias("bundle"))
    rows = wide.select("finding_id", "ingest_time", *carry, bundle().alias("bundle"), "events_json")
    return rows.withColumn("evidence", bundle_text(F.col("bundle"), F.col("events_json"))).drop("events_json")


def responses_to(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """The responses to some findings, dealt evenly over tasks, as what follows parses them."""
    return responses.join(findings.select("finding_id"), "finding_id", "left_semi").hint("rebalance")


def with_answers(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Findings with the response that stands; one without a response has that as its reason."""
    answered = findings.join(resolved, "finding_id", "left")
    unanswered = F.col("reason").isNull() & F.col("brief").isNull()
    return answered.withColumn("reason", F.when(unanswered, NO_RESPONSE).otherwise(F.col("reason")))


def decide(
    findings: DataFrame,
    context: Context,
    responses: DataFrame,
    *,
    retry: bool = True,
    carry: Sequence[str] = (),
    **enrich_options,
) -> DataFrame:
    """Enriched findings with the response that stands, checked, grounded and scored; `carry` names columns to keep.

    Responses are joined while the findings are narrow, so bundles are not shuffled for it.
    """
    resolved = resolve_attempts(typed_responses(responses), retry=retry)
    carried = [c for c in resolved.columns if c != "finding_id"]
    answered = with_answers(findings, resolved)
    return out.scored(ground(enrich(answered, context, plain=findings, carry=[*carry, *carried], **enrich_options)))


@dataclass(frozen=True)
class TriageResult:
    outcomes: DataFrame
    reports: DataFrame
    audit: DataFrame
    notifications: DataFrame
    metrics: DataFrame
    claims: DataFrame


def triage_batch(
    findings: DataFrame,
    context: Context,
    responses: DataFrame,
    *,
    run_ts: Column,
    claims: DataFrame | None = None,
    severity_threshold: float | None = gate.SEVERITY_THRESHOLD,
    ttl_seconds: int = gate.CLAIM_SECONDS,
    region: str = "us-east-1",
    bucket: str = "triage-reports",
    product: str = "The triage job",
    namespace: str = "Triage",
    dimensions: dict[str, str] | None = None,
    materialize: bool = True,
    **enrich_options,
) -> TriageResult:
    """All outputs of one run over a batch of findings.

    Without a history in the context, related findings are looked for in the whole batch given,
    the findings under the gate included. The marked arrivals feed several joins and the skips, and the
    decided rows six outputs, so each is written once; pass materialize=False where one output is read.
    Responses to other findings than those triaged are left out before they are parsed.
    """
    now_seconds = F.unix_seconds(run_ts)
    history = findings if context.history is None else context.history
    whole = Context(context.trail, context.principals, context.attached, context.inline, context.groups, history)
    gated = gate.severity_gate(findings, severity_threshold)
    keep = partial(written_once, name="claimed-findings") if materialize else None
    fresh, skips = gate.claim_batch(gated, claims, now_seconds, keep)
    if materialize:
        responses = responses_to(fresh, responses)
    decided = decide(fresh, whole, responses, as_text=True, **enrich_options)
    if materialize:
        decided = written_once(decided, "decided-findings")
    outcomes = out.all_outcomes(decided, skips)
    return TriageResult(
        outcomes=outcomes,
        reports=out.report_rows(decided, run_ts),
        audit=out.audit_rows(decided, run_ts),
        notifications=out.notification_rows(decided, run_ts, region=region, bucket=bucket, product=product),
        metrics=out.metric_rows(out.outcome_rows(decided), namespace, dimensions),
        claims=gate.new_claims(decided, now_seconds, ttl_seconds),
    )


def triage_on_demand(findings: DataFrame, context: Context, responses: DataFrame, **enrich_options) -> DataFrame:
    """Display rows for findings asked for by hand: no gate, no claim, no retry, nothing written."""
    return out.brief_view(decide(findings, context, responses, retry=False, **enrich_options))


def evaluate(labeled: DataFrame, context: Context, responses: DataFrame, **enrich_options) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) over labelled findings: name, expected_severity and the findings columns.

    As on demand there is no retry, and a brief with no known technique still counts.
    """
    decided = decide(labeled, context, responses, retry=False, carry=("name", "expected_severity"), **enrich_options)
    # The label is carried along: an id can be missing, or be in two files.
    results = decided.select(
        "name", "expected_severity", "degraded", "final_severity", F.col("brief.severity").alias("model_severity"), "processing_ms"
    )
    rows = evaluation.judged(results)
    return rows, evaluation.evaluation_summary(rows)
