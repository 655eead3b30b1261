"""The registered queries: each operator of the library over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import bands, briefs, messages, policy, techniques, text
from ..operators import bundles as bun, evaluation, gate, latency_sketches as sketches, metrics, outcomes as out, principals as pri, rules
from ..operators.containment import contained
from ..operators.durable import new_folder, written_once
from ..operators.related import KeptActivity, with_related
from ..operators.skew import spread
from ..operators.timeline import distinct_events, event_pairs, with_timeline
from ..operators.validation import grounding_matches, resolve_attempts, typed_responses
from ..sources.claim_ledger import ClaimLedger
from ..sources.commits import CommitLog
from ..sources.findings import center_time as resolved_time, parse_findings, parse_labeled, unwrap
from ..sources.trail import flatten_trail
from ..sources.trail_table import TrailTable
from ..streaming import activity, jobs, state
from . import derived as d
from .triage import Context, decide, enrich, evaluate, triage_batch, triage_on_demand, with_answers

Query = Callable[[SparkSession, str], DataFrame]

# One run time for all queries, so that results repeat.
RUN_TS = "2024-02-01 00:00:00"


# Derived tables whose rows are parsed, each at some cost, before anything shuffles them.
HEAVY = ("documents", "lookups", "parameters", "responses")


def run_ts() -> Column:
    return F.lit(RUN_TS).cast("timestamp")


def _now() -> Column:
    return F.unix_seconds(run_ts())


class Tables:
    """The derived triage tables of one folder, in UTC."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        self._spark, self._folder = spark, folder
        self.source = cache(partial(d.source, spark, folder))

    def __getattr__(self, name: str) -> DataFrame:
        """A derived table by its name in lower case, analysed once."""
        read = self.source if name not in HEAVY else lambda table: spread(self.source(table))
        rows = d.derive(self._spark, getattr(d, name.upper()), read)
        setattr(self, name, rows)
        return rows

    def read(self, name: str) -> DataFrame:
        """A derived table as it comes from its files, for jobs that deal out its rows themselves."""
        return d.derive(self._spark, getattr(d, name.upper()), self.source)

    def context(self, history: DataFrame | None = None) -> Context:
        return Context(self.trail, self.principals, self.attached, self.inline, self.groups, history)

    def timeline(self, **options) -> DataFrame:
        return with_timeline(self.findings, self.trail, **options)

    def profiles(self) -> DataFrame:
        return pri.profiles(self.principals, self.attached, self.inline, self.groups)

    def bundles(self, findings: DataFrame | None = None) -> DataFrame:
        return enrich(self.findings if findings is None else findings, self.context())

    def decided(self) -> DataFrame:
        return decide(self.findings, self.context(), self.responses)

    def resolved(self) -> DataFrame:
        return resolve_attempts(typed_responses(self.responses))

    def light_outcomes(self) -> DataFrame:
        """Outcome rows from the hard signals and responses alone, without timelines."""
        return out.outcome_rows(out.scored(_answered(self)))


def _light(t: Tables) -> DataFrame:
    """Findings with profile and related count in the bundle's shape, for scoring only."""
    findings = t.findings
    rows = pri.with_profile(with_related(findings), t.profiles())
    return rows.select(
        "finding_id",
        "ingest_time",
        F.struct(
            F.struct("severity").alias("finding"),
            F.struct("blast_radius").alias("iam_context"),
            F.struct(F.col("related_count").alias("count")).alias("related_findings"),
        ).alias("bundle"),
    )


def _answered(t: Tables) -> DataFrame:
    """Every finding with what was answered, or the reason that nothing was."""
    return with_answers(_light(t), t.resolved()).withColumn("degraded", F.col("brief").isNull())


def _moment(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _listed(column: str | Column, by: str = ",") -> Column:
    return F.array_join(column, by)


REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    REGISTRY[build.__name__] = partial(_run, build)
    return build


def _run(build: Callable[[Tables], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    return build(Tables(spark, folder))


# ---- enrichment


@query
def trail_interval_join(t: Tables) -> DataFrame:
    pairs = event_pairs(t.timeline())
    return pairs.select("finding_id", "event_id", "event_name", _moment("event_time").alias("event_time"))


@query
def trail_dedup(t: Tables) -> DataFrame:
    return distinct_events(t.trail).select("access_key_id", "event_id", "event_name", "source_ip")


@query
def trail_topk(t: Tables) -> DataFrame:
    return event_pairs(t.timeline(max_events=2)).where("event_id IS NOT NULL").select("finding_id", "event_id")


@query
def timeline_collect(t: Tables) -> DataFrame:
    ids = F.transform("events", lambda e: e["event_id"])
    return t.timeline().select("finding_id", _listed(ids).alias("event_ids"))


@query
def event_count(t: Tables) -> DataFrame:
    return t.timeline().select("finding_id", F.size("events").alias("n_events"))


@query
def distinct_api_calls(t: Tables) -> DataFrame:
    names = text.distinct_in_order(F.transform("events", lambda e: e["event_name"]), messages.API_NAME_LIMIT)
    return t.timeline().select("finding_id", _listed(names).alias("api_calls"))


@query
def distinct_source_ips(t: Tables) -> DataFrame:
    ips = text.distinct_in_order(F.transform("events", lambda e: e["source_ip"]), messages.SOURCE_IP_LIMIT)
    return t.timeline().select("finding_id", _listed(ips).alias("source_ips"))


@query
def related_count(t: Tables) -> DataFrame:
    return with_related(t.findings).select("finding_id", "related_count")


@query
def related_history_count(t: Tables) -> DataFrame:
    """Against a history table that holds only part of the findings."""
    history = t.findings.where("severity >= 4")
    return with_related(t.findings, history).select("finding_id", "related_count")


@query
def related_topk(t: Tables) -> DataFrame:
    ids = F.transform("related_summaries", lambda s: s["id"])
    return with_related(t.findings).select("finding_id", _listed(ids).alias("related_ids"))


@query
def principal_lookup(t: Tables) -> DataFrame:
    rows = pri.with_profile(t.findings, t.profiles())
    return rows.select("finding_id", pri.principal_kind(F.col("user_type")).alias("kind"), "user_name", "blast_radius")


@query
def policy_lists(t: Tables) -> DataFrame:
    lists = ("attached_policies", "inline_policies", "groups")
    return t.profiles().select("kind", "user_name", *[_listed(c).alias(c) for c in lists])


@query
def managed_policy_band(t: Tables) -> DataFrame:
    band = bands.level_name(policy.managed_policy_number(F.col("policy_name")))
    return t.attached.select("kind", "user_name", "policy_name", band.alias("band"))


@query
def policy_document_decode(t: Tables) -> DataFrame:
    found = F.coalesce(policy.statements(policy.decode_document(F.col("document"))), F.array())
    rows = t.inline.select("kind", "user_name", found.alias("s"))
    actions = F.flatten(F.transform("s", lambda s: policy.one_or_many(s, "$.Action")))
    resources = F.flatten(F.transform("s", lambda s: policy.one_or_many(s, "$.Resource")))
    return rows.select(
        "kind", "user_name", F.size("s").alias("n_statements"), _listed(actions).alias("actions"), _listed(resources).alias("resources")
    )


@query
def policy_document_band(t: Tables) -> DataFrame:
    band = bands.level_name(policy.document_number(F.col("document")))
    return t.inline.select("kind", "user_name", "policy_name", band.alias("band"))


@query
def blast_radius(t: Tables) -> DataFrame:
    return pri.blast_radius(t.principals, t.attached, t.inline)


@query
def enrich_bundle(t: Tables) -> DataFrame:
    b = F.col("bundle")
    events = b["cloudtrail_events"]
    return t.bundles().select(
        "finding_id",
        b["finding"]["type"].alias("type"),
        b["finding"]["principal"]["user_name"].alias("user_name"),
        b["finding"]["time"].alias("time"),
        b["iam_context"]["blast_radius"].alias("blast_radius"),
        _listed(b["iam_context"]["attached_policies"]).alias("attached"),
        b["related_findings"]["count"].alias("related_count"),
        F.size(b["related_findings"]["summaries"]).alias("n_summaries"),
        F.size(events).alias("n_events"),
        F.try_element_at(events, F.lit(1))["eventTime"].alias("first_event"),
        F.try_variant_get(F.try_element_at(events, F.lit(1))["requestParameters"], "$.k", "bigint").alias("first_k"),
        b["access_key_id"].alias("access_key_id"),
        b["instance_id"].alias("instance_id"),
    )


# ---- gate and claims


@query
def severity_gate(t: Tables) -> DataFrame:
    return gate.severity_gate(t.findings).select("finding_id", "severity")


@query
def missing_id_skip(t: Tables) -> DataFrame:
    rows = gate.skipped(t.arrivals.where(~gate.has_id()), gate.NO_FINDING_ID)
    return rows.select("finding_id", "status", "reason", _moment("ts").alias("ts"))


@query
def claim_antijoin(t: Tables) -> DataFrame:
    """What becomes of every arrival: one triage per unclaimed id, all others skipped."""
    fresh, skips = gate.claim_batch(t.arrivals, t.claims, _now())
    taken = fresh.select("finding_id", F.lit("triaged").alias("status"), F.lit(None).cast("string").alias("reason"))
    return taken.unionByName(skips.select("finding_id", "status", "reason"))


@query
def already_triaged(t: Tables) -> DataFrame:
    return gate.already_triaged(t.findings, t.claims, _now()).select("finding_id")


@query
def claims_upsert(t: Tables) -> DataFrame:
    added = gate.new_claims(t.findings.where("severity >= 7"), _now())
    return gate.upsert_claims(t.claims, added, _now())


# ---- validation


@query
def degraded_reason(t: Tables) -> DataFrame:
    return typed_responses(t.responses).select("finding_id", "attempt", "reason")


@query
def brief_contract(t: Tables) -> DataFrame:
    return typed_responses(t.responses).select(
        "finding_id",
        "attempt",
        F.col("brief").isNotNull().alias("well_formed"),
        F.col("brief.severity").alias("severity"),
        F.col("brief.confidence").alias("confidence"),
        F.size("brief.attack_techniques").alias("n_techniques"),
    )


@query
def technique_allowlist(t: Tables) -> DataFrame:
    proposed = F.col("brief.attack_techniques")
    kept = F.transform(briefs.kept_techniques(proposed), lambda x: x["technique_id"])
    return typed_responses(t.responses).where("brief IS NOT NULL").select(
        "finding_id", "attempt", _listed(kept).alias("kept"), _listed(briefs.dropped_techniques(proposed)).alias("dropped")
    )


def _each(rows: DataFrame, items: str, name: str) -> DataFrame:
    """One row per item of a list in a checked brief, which holds no null ones.

    For explode Spark filters on the list first, and there it parses the brief once for each time the check names it.
    """
    return rows.select("finding_id", "attempt", F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def _cited(t: Tables) -> DataFrame:
    rows = _each(typed_responses(t.responses), "brief.attack_techniques", "x")
    return rows.select("finding_id", "attempt", "x.technique_id", "x.name")


@query
def technique_semi_anti(t: Tables) -> DataFrame:
    # Counted first and written, so that the responses are parsed once for both sides.
    cited = written_once(_cited(t).groupBy("technique_id").agg(F.count("*").alias("n")), "cited-techniques")
    known = F.broadcast(techniques.techniques(cited.sparkSession))
    kept = cited.join(known, "technique_id", "left_semi").withColumn("side", F.lit("kept"))
    dropped = cited.join(known, "technique_id", "left_anti").withColumn("side", F.lit("dropped"))
    return kept.unionByName(dropped).select("side", "technique_id", "n")


@query
def technique_lookup(t: Tables) -> DataFrame:
    cited = _cited(t)
    known = F.broadcast(techniques.techniques(cited.sparkSession).withColumnRenamed("name", "canonical"))
    return cited.join(known, "technique_id", "left").select(
        "finding_id", "attempt", "technique_id", "name", "canonical", "description", "tactic"
    )


@query
def evidence_text(t: Tables) -> DataFrame:
    rows = t.bundles().select("finding_id", text.flat_json(F.col("bundle")).alias("e"), F.col("bundle.access_key_id").alias("k"))
    return rows.select(
        "finding_id",
        F.contains("e", F.col("finding_id")).alias("names_finding"),
        F.coalesce(F.contains("e", "k"), F.lit(False)).alias("names_key"),
        F.contains("e", F.lit("denied for u")).alias("names_error"),
        F.contains("e", F.lit("AdministratorAccess")).alias("names_admin"),
        F.contains("e", F.lit("bucket-")).alias("names_bucket"),
    )


@query
def resource_grounding(t: Tables) -> DataFrame:
    return t.decided().where("NOT degraded").select(
        "finding_id", _listed("brief.affected_resources", "|").alias("kept"), _listed("dropped_resources", "|").alias("dropped")
    )


@query
def grounding_theta_join(t: Tables) -> DataFrame:
    """Containment in bulk, as an equi-join on the finding with the substring test as residual."""
    evidence = t.bundles().select("finding_id", text.flat_json(F.col("bundle")).alias("evidence"))
    named = _each(typed_responses(t.responses).where("attempt <= 2"), "brief.affected_resources", "resource")
    return grounding_matches(named, evidence)


@query
def validity_flag(t: Tables) -> DataFrame:
    rows = typed_responses(t.responses).where("brief IS NOT NULL")
    return rows.select("finding_id", "attempt", briefs.is_trustworthy(F.col("brief.attack_techniques")).alias("valid"))


@query
def attempt_resolution(t: Tables) -> DataFrame:
    return t.resolved().select(
        "finding_id", "attempts", "reason", "request_id", "processing_ms", "input_tokens", "all_output_tokens", F.col("brief").isNotNull().alias("has_brief")
    )


# ---- scoring


@query
def severity_band(t: Tables) -> DataFrame:
    level = bands.level_name(bands.severity_number(F.col("severity")))
    back = bands.level_number(F.lower(level))
    return t.findings.select("finding_id", level.alias("band"), back.alias("band_number"))


@query
def rescore(t: Tables) -> DataFrame:
    final = bands.rescore(F.col("severity"), F.lit("UNKNOWN"), F.col("related_count"), F.col("model_severity"))
    return t.label_results.select("finding_id", final.alias("final_severity"))


@query
def triage_hard_signals(t: Tables) -> DataFrame:
    """Gated findings scored on severity, blast radius and related findings, next to their activity."""
    findings = t.findings
    gated = gate.severity_gate(findings)
    rows = pri.with_profile(with_related(gated, findings), t.profiles())
    rows = with_timeline(rows, t.trail, plain=gated)
    final = bands.rescore(F.col("severity"), F.col("blast_radius"), F.col("related_count"), F.lit("LOW"))
    return rows.select(
        "finding_id", "severity", "blast_radius", "related_count", F.size("events").alias("n_events"), final.alias("final_severity")
    )


@query
def triage_outcomes(t: Tables) -> DataFrame:
    result = triage_batch(
        t.arrivals, t.context(t.findings), t.read("responses"), run_ts=run_ts(), claims=t.claims
    )
    return result.outcomes.select(
        "finding_id", "status", "reason", "final_severity", "blast_radius", "related_count", "action_count", "processing_ms",
        "request_id", F.round("cost_usd", 6).alias("cost_usd"), F.round("total_cost_usd", 6).alias("total_cost_usd"), _moment("ts").alias("ts"),
    )


# ---- text


def _spiked_documents(t: Tables) -> DataFrame:
    """Documents with characters put in that must be taken out again."""
    spike = F.concat(F.col("text"), F.lit("\u0007\u200b\u202e\u2028 end\t\n"))
    return t.source("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, spike).otherwise(F.col("text")).alias("text"))


@query
def strip_control_chars(t: Tables) -> DataFrame:
    clean = text.strip_control_chars(F.col("text"))
    return _spiked_documents(t).select("doc_id", F.length("text").alias("before"), F.length(clean).alias("after"), F.md5(clean).alias("digest"))


@query
def truncate_field(t: Tables) -> DataFrame:
    cut = text.cap_text(F.col("html"), text.MAX_FIELD)
    return t.source("pages").select("page_id", F.length(cut).alias("n_chars"), F.md5(cut).alias("digest"))


@query
def scrub_nested(t: Tables) -> DataFrame:
    """Scrubs a struct of strings, numbers and a list at once."""
    nested = F.struct(
        F.col("role").alias("role"),
        F.struct(F.concat(F.lit("\u202e"), F.col("text")).alias("body"), F.col("turn").alias("turn")).alias("inner"),
        F.array(F.col("text"), F.lit("\u200bx")).alias("list"),
    ).alias("v")
    rows = t.source("conversations").select("conv_id", "turn", nested)
    kind = rows.schema["v"].dataType
    v = rows.withColumn("v", text.scrub("v", kind))
    return v.select("conv_id", "turn", "v.role", F.md5("v.inner.body").alias("body"), F.col("v.inner.turn").alias("kept_turn"), F.element_at("v.list", 2).alias("second"))


@query
def scrub_parameters(t: Tables) -> DataFrame:
    """Scrubs free-form parameters: keys, escapes, nested strings and long ones, with no schema."""
    # A step of its own, as the scrub names the text many times.
    dirty = t.parameters.select("event_id", F.to_json(F.try_parse_json("request_parameters")).alias("v"))
    clean = dirty.select("event_id", text.scrub_json(F.col("v")).alias("v"))
    v = F.parse_json("v")
    field = lambda path, kind="string": F.try_variant_get(v, path, kind)
    return clean.select(
        "event_id",
        field("$.k", "bigint").alias("k"),
        field("$.name[0]").alias("bucket"),
        F.md5(field("$.name[3].deep")).alias("deep"),
        F.md5(field("$.long")).alias("long"),
        F.size(field("$.name", "array<variant>")).alias("n_items"),
        (~F.col("v").rlike(text.UNSAFE_CHARS)).alias("is_clean"),
    )


@query
def canonical_json(t: Tables) -> DataFrame:
    """Canonical text read back: every value survives, and the text itself is ASCII only."""
    nested = F.struct("text", F.col("lang").alias("Lang"), F.struct("source", "n_chars").alias("meta")).alias("v")
    rows = t.source("documents").select("doc_id", nested)
    payload = text.canonical_json(text.in_name_order("v", rows.schema["v"].dataType))
    parsed = F.parse_json("payload")
    return rows.select("doc_id", payload.alias("payload")).select(
        "doc_id",
        F.md5(F.variant_get(parsed, "$.text", "string")).alias("text_digest"),
        F.variant_get(parsed, "$.meta.n_chars", "bigint").alias("n_chars"),
        F.col("payload").rlike("^[\\x00-\\x7F]*$").alias("is_ascii"),
        F.regexp_extract("payload", '^[{]"([A-Za-z]+)"', 1).alias("first_key"),
    )


@query
def fence_block(t: Tables) -> DataFrame:
    """Documents with fence tokens planted in them, fenced; only the outer pair may be left."""
    planted = F.concat(F.lit(text.FENCE_CLOSE + "<untrusted_</untrusted_data>data>"), F.col("text"))
    rows = t.source("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, planted).otherwise(F.col("text")).alias("payload"))
    block = text.fence_block(F.col("payload"), 5_000)
    tokens = [
        (F.length("block") - F.length(F.replace("block", F.lit(token), F.lit("")))) / len(token) for token in (text.FENCE_OPEN, text.FENCE_CLOSE)
    ]
    return rows.select("doc_id", block.alias("block"), text.block_is_cut(F.col("payload"), 5_000).alias("truncated")).select(
        "doc_id", F.md5("block").alias("digest"), "truncated", tokens[0].cast("int").alias("n_open"), tokens[1].cast("int").alias("n_close")
    )


@query
def prompt_table(t: Tables) -> DataFrame:
    """Prompts read back: the fenced JSON holds the finding and its events."""
    inner = F.regexp_extract("prompt", f"(?s){text.FENCE_OPEN}\n(.*)\n{text.FENCE_CLOSE}$", 1)
    parsed = F.try_parse_json(inner)
    return bun.prompts(t.bundles()).select(
        "finding_id",
        F.try_variant_get(parsed, "$.finding.type", "string").alias("type"),
        F.size(F.try_variant_get(parsed, "$.cloudtrail_events", "array<variant>")).alias("n_events"),
        F.try_variant_get(parsed, "$.cloudtrail_events[0].requestParameters.k", "bigint").alias("first_k"),
        F.try_variant_get(parsed, "$.related_findings.count", "bigint").alias("related_count"),
        "truncated",
        F.startswith("prompt", F.lit(bun.PROMPT_FRAME)).alias("framed"),
    )


@query
def technique_reference(t: Tables) -> DataFrame:
    """Reference lines of the techniques the responses cite, with how often."""
    cited = _cited(t).groupBy("technique_id").agg(F.count("*").alias("n"))
    known = F.broadcast(techniques.techniques(cited.sparkSession))
    line = techniques.reference_line(F.col("technique_id"), F.col("name"), F.col("description"))
    return cited.join(known, "technique_id").select("technique_id", "n", line.alias("line"))


# ---- outputs


@query
def notification_text(t: Tables) -> DataFrame:
    b, brief = F.col("bundle"), F.col("brief")
    fields = messages.brief_fields(
        F.col("final_severity"), brief["confidence"], F.col("blast_radius"), b["finding"]["severity"],
        b["finding"]["principal"]["user_name"], F.col("related_count"),
    )
    url = out.console_url(F.lit("us-east-1"), F.lit("reports"), out.report_key(F.col("finding_id"), run_ts()))
    return t.decided().where("NOT degraded").select(
        "finding_id",
        messages.header_text(F.col("final_severity"), b["finding"]["type"]).alias("header"),
        brief["summary"].alias("summary"),
        _listed(fields, " / ").alias("fields"),
        messages.technique_tags(brief["attack_techniques"]).alias("tags"),
        messages.numbered(brief["recommended_actions"]).alias("actions"),
        messages.context_text(F.col("finding_id"), url).alias("context"),
    )


@query
def degraded_text(t: Tables) -> DataFrame:
    b = F.col("bundle")
    fields = messages.degraded_fields(
        b["finding"]["type"], b["finding"]["severity"], F.col("blast_radius"), F.col("related_count"),
        b["cloudtrail_events"], b["finding"]["principal"]["user_name"],
    )
    return t.decided().where("degraded").select(
        "finding_id",
        messages.degraded_text(F.col("reason"), "The job").alias("lead"),
        _listed(fields, " / ").alias("fields"),
        messages.activity_text(b["cloudtrail_events"]).alias("activity"),
    )


@query
def notification_rows(t: Tables) -> DataFrame:
    rows = out.notification_rows(t.decided(), run_ts(), region="us-east-1", bucket="reports", product="The job")
    blocks = F.from_json("payload", "blocks ARRAY<STRUCT<type: STRING, text: STRUCT<text: STRING>>>")["blocks"]
    return rows.select(
        "finding_id",
        F.size(blocks).alias("n_blocks"),
        F.element_at(blocks, 1)["text"]["text"].alias("header"),
        F.element_at(blocks, -1)["type"].alias("last_type"),
    )


@query
def brief_view(t: Tables) -> DataFrame:
    view = triage_on_demand(t.findings, t.context(), t.responses)
    return view.select(
        "finding_id", "type", "status", "reason", "final_severity", "confidence", "event_count", "summary", "techniques", "actions",
        _listed("dropped_techniques").alias("dropped_techniques"), _listed("dropped_resources", "|").alias("dropped_resources"), "request_id",
    )


@query
def audit_rows(t: Tables) -> DataFrame:
    decided = out.scored(_answered(t))
    return out.audit_rows(decided, run_ts())


@query
def report_rows(t: Tables) -> DataFrame:
    parsed = F.parse_json("report")
    return out.report_rows(t.decided(), run_ts()).select(
        "finding_id",
        "key",
        F.variant_get(parsed, "$.final_severity", "string").alias("final_severity"),
        F.variant_get(parsed, "$.degraded", "boolean").alias("degraded"),
        F.variant_get(parsed, "$.reason", "string").alias("reason"),
        F.variant_get(parsed, "$.brief.severity", "string").alias("model_severity"),
        F.variant_get(parsed, "$.usage.output_tokens", "bigint").alias("output_tokens"),
        F.variant_get(parsed, "$.enrichment.access_key_id", "string").alias("access_key_id"),
    )


@query
def cost_estimate(t: Tables) -> DataFrame:
    cost = out.estimated_cost(F.col("input_tokens"), F.col("output_tokens"))
    return t.responses.select("finding_id", "attempt", F.round(cost, 6).alias("cost_usd"))


@query
def metrics_long(t: Tables) -> DataFrame:
    rows = out.metric_rows(t.light_outcomes(), dimensions={"Stage": "prod"})
    return rows.select("finding_id", "metric", F.round("value", 6).alias("value"), F.element_at("dimensions", "Stage").alias("stage"))


# ---- metrics and evaluation


def _period(rows: DataFrame) -> DataFrame:
    return rows.withColumn("window_start", _moment("window_start"))


@query
def latency_5min(t: Tables) -> DataFrame:
    rows = _period(metrics.latency(t.light_outcomes()))
    return rows.select("window_start", F.round("avg_ms", 6).alias("avg_ms"), F.round("p90_ms", 6).alias("p90_ms"))


@query
def cost_tokens_5min(t: Tables) -> DataFrame:
    return _period(metrics.usage(t.light_outcomes())).withColumn("cost_usd", F.round("cost_usd", 6))


@query
def outcomes_5min(t: Tables) -> DataFrame:
    _, skips = gate.claim_batch(t.arrivals, None, _now())
    return _period(metrics.outcome_counts(t.light_outcomes().unionByName(skips, allowMissingColumns=True)))


def _evaluated(t: Tables) -> DataFrame:
    final = bands.rescore(F.col("severity"), F.lit("UNKNOWN"), F.col("related_count"), F.col("model_severity"))
    return evaluation.evaluation_rows(t.labels, t.label_results.withColumn("final_severity", final))


@query
def eval_rows(t: Tables) -> DataFrame:
    return _evaluated(t)


@query
def eval_summary(t: Tables) -> DataFrame:
    return evaluation.evaluation_summary(_evaluated(t)).withColumn("accuracy", F.round("accuracy", 6))


@query
def evaluate_labeled(t: Tables) -> DataFrame:
    """The evaluation job on findings labelled with their own severity band."""
    labeled = t.findings.withColumn("name", F.concat(F.lit("case-"), "finding_id")).withColumn(
        "expected_severity", bands.level_name(bands.severity_number(F.col("severity")))
    )
    rows, _ = evaluate(labeled, t.context(), t.responses)
    return rows


def _labeled_files(t: Tables) -> DataFrame:
    severity = F.when(F.col("expected_severity") == "HIGH", 8.0).when(F.col("expected_severity") == "MEDIUM", 5.0).otherwise(2.0)
    finding = F.struct(F.col("finding_id").alias("Id"), severity.alias("Severity"), F.lit("Recon:IAMUser/X").alias("Type"))
    return t.labels.select(
        F.concat(F.lit("/cases/"), "name", F.lit(".json")).alias("path"),
        F.to_json(F.struct("expected_severity", finding.alias("finding"))).alias("document"),
    )


@query
def labeled_scan(t: Tables) -> DataFrame:
    rows = parse_labeled(_labeled_files(t), run_ts=run_ts())
    return rows.select("name", "expected_severity", "finding_id", "severity", "type", _moment("center_time").alias("center_time"))


@query
def dimension_check(t: Tables) -> DataFrame:
    """Ids on one side only: cited but not in the dimension, or in it and never cited."""
    cited = _cited(t).select("technique_id").distinct()
    known = techniques.techniques(cited.sparkSession).select("technique_id")
    unknown = cited.exceptAll(known).withColumn("side", F.lit("not in dimension"))
    return unknown.unionByName(known.exceptAll(cited).withColumn("side", F.lit("never cited")))


# ---- ingestion


@query
def finding_envelope(t: Tables) -> DataFrame:
    raw = unwrap(t.documents, "document")
    return raw.select(
        "event_id",
        F.coalesce(F.variant_get("raw", "$.Id", "string"), F.variant_get("raw", "$.id", "string")).alias("id"),
        F.coalesce(F.variant_get("raw", "$.Severity", "double"), F.variant_get("raw", "$.severity", "double")).alias("severity"),
    )


@query
def finding_envelope_every(t: Tables) -> DataFrame:
    raw = unwrap(t.documents, "document")
    return raw.select("event_id", F.variant_get("raw", "$.Id", "string").alias("pascal_id"))


@query
def parse_finding(t: Tables) -> DataFrame:
    rows = parse_findings(unwrap(t.documents, "document"), run_ts=run_ts(), keep=("event_id",))
    return rows.drop("center_time", "ingest_time")


@query
def center_time(t: Tables) -> DataFrame:
    rows = unwrap(t.documents, "document")
    return rows.select("event_id", _moment(resolved_time(F.col("raw"), run_ts())).alias("center_time"))


@query
def trail_flatten(t: Tables) -> DataFrame:
    flat = flatten_trail(t.lookups)
    k = F.try_variant_get(F.try_parse_json("request_parameters"), "$.k", "bigint")
    return flat.select(*[c for c in flat.columns if c not in ("event_time", "request_parameters")], _moment("event_time").alias("event_time"), k.alias("k"))


# ---- streaming: each drains a stream over the given files and reads back what it wrote


def _event_stream(t: Tables) -> DataFrame:
    spark, folder = t._spark, t._folder
    return spark.readStream.schema(t.source("events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _streamed(t: Tables, sql: str) -> DataFrame:
    rows = t._spark.sql(sql, events=_event_stream(t))
    for field in rows.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            rows = rows.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return rows


def _drained(t: Tables, rows: DataFrame, name: str, idle_batches: bool = True) -> DataFrame:
    folder = new_folder(t._spark, name)
    jobs.drain(jobs.append_stream(rows, f"{folder}/rows", f"{folder}/state"), idle_batches)
    return t._spark.read.parquet(f"{folder}/rows").select(*rows.columns)


@query
def stream_dedup(t: Tables) -> DataFrame:
    rows = jobs.once_per_finding(_streamed(t, d.ARRIVALS))
    return _drained(t, rows.select("finding_id"), "stream-dedup")


@query
def claim_ledger(t: Tables) -> DataFrame:
    """Claims of ten batches through a ledger that merges every third; some ids are claimed again and again."""
    ledger = ClaimLedger(t._spark, new_folder(t._spark, "claim-ledger"), buckets=8, merge_every=3)
    number = F.substring("finding_id", 3, 20).cast("bigint")
    for batch in range(10):
        ledger.merge_if_due(batch, _now())
        again = t.findings.where(F.pmod(F.lit(batch), F.pmod(number, F.lit(10)) + 1) == 0)
        ledger.add(t.claims if batch == 0 else again.select("finding_id", F.lit(1_600_000_000 + batch * 20_000_000).alias("expires_at")), batch)
    return ledger.claims(now_seconds=_now())


@query
def stream_triage(t: Tables) -> DataFrame:
    folder = new_folder(t._spark, "stream-triage")
    writer = jobs.triage_stream(
        _streamed(t, d.ARRIVALS), lambda: t.context(t.findings), lambda: t.read("responses"),
        folder=folder, checkpoint=f"{folder}/state", run_ts=run_ts(),
    )
    jobs.drain(writer)
    return CommitLog(t._spark, folder).read("outcomes").select("finding_id", "status", "reason", "final_severity", "related_count", "processing_ms")


@query
def stream_interval_join(t: Tables) -> DataFrame:
    pairs = jobs.timeline_stream(_streamed(t, d.FINDINGS), _streamed(t, d.TRAIL))
    # What met nothing comes out when time has passed it, and the files end before that for the last ones.
    return _drained(t, pairs, "stream-pairs").where("event_time IS NOT NULL").select("finding_id", "event_id")


@query
def stream_metrics(t: Tables) -> DataFrame:
    done = F.col("event_id") % 11 != 0
    outcome = F.when(~done, "skipped").when(F.col("event_id") % 13 < 5, "degraded").otherwise("analyzed")
    rows = _event_stream(t).where("event_type = 'error'").select(
        F.col("ts").cast("timestamp").alias("ts"),
        outcome.alias("status"),
        F.when(done, 7000 + (F.col("event_id") * 37) % 9000).alias("processing_ms"),
        F.when(done, F.col("event_id") % 13 < 5).alias("degraded"),
        F.when(done, 800 + F.col("event_id") % 400).alias("input_tokens"),
        F.when(done, 1200 + F.col("event_id") % 700).alias("output_tokens"),
    )
    rows = rows.withColumn("cost_usd", out.estimated_cost(F.col("input_tokens"), F.col("output_tokens")))
    folder = new_folder(t._spark, "stream-metrics")
    jobs.drain(jobs.update_stream(jobs.ops_metrics_stream(rows), f"{folder}/rows", f"{folder}/state"))
    standing = jobs.read_latest(t._spark, f"{folder}/rows", ["window_start"])
    return _period(standing).select(
        "window_start", F.round("avg_ms", 6).alias("avg_ms"), F.round("p90_ms", 6).alias("p90_ms"), F.round("cost_usd", 6).alias("cost_usd"),
        "input_tokens", "output_tokens", "invocations", "degraded",
    )


@query
def stream_audit(t: Tables) -> DataFrame:
    """The audit of a streamed triage of which one batch is run again."""
    folder = new_folder(t._spark, "stream-audit")
    context = t.context(t.findings)
    jobs.drain(
        jobs.triage_stream(
            _streamed(t, d.ARRIVALS), lambda: context, lambda: t.read("responses"), folder=folder, checkpoint=f"{folder}/state", run_ts=run_ts()
        )
    )
    jobs.triage_one(t.arrivals, 0, context, t.read("responses"), folder=folder, run_ts=run_ts())
    return CommitLog(t._spark, folder).read("audit").drop("batch_id")


@query
def stream_raw_findings(t: Tables) -> DataFrame:
    """Raw events of a stream, triaged without a gate as they come; ids are those the events carry."""
    folder = new_folder(t._spark, "stream-raw")
    jobs.drain(
        jobs.triage_stream(
            _streamed(t, d.DOCUMENTS), lambda: t.context(t.findings), lambda: t.read("responses"),
            folder=folder, checkpoint=f"{folder}/state", run_ts=run_ts(), documents="document", severity_threshold=None,
        )
    )
    return CommitLog(t._spark, folder).read("outcomes").select("finding_id", "status", "blast_radius")


# ---- rules


@query
def threat_purpose(t: Tables) -> DataFrame:
    return rules.with_stage(t.findings).select("finding_id", "purpose", "stage", _listed("candidates").alias("candidates"))


@query
def timeline_signals(t: Tables) -> DataFrame:
    return rules.timeline_signals(t.timeline())


# ---- the trail laid out by key


def _trail_table(t: Tables) -> TrailTable:
    """The trail in a table of its own, the days up to the middle first and the rest as they come later."""
    table = TrailTable.create(t._spark, new_folder(t._spark, "trail-table"), buckets=int(t._spark.conf.get("spark.sql.shuffle.partitions")))
    middle = t.trail.agg(F.to_date(F.timestamp_seconds(F.avg(F.unix_seconds("event_time")))).alias("d")).first()["d"]
    late = F.to_date("event_time") > F.lit(middle)
    table.write_days(t.trail.where(~late))
    table.write_days(t.trail.where(late))
    return table


@query
def trail_table_timeline(t: Tables) -> DataFrame:
    """The newest twenty events of each finding, from a trail laid out by key and grown by days."""
    rows = with_timeline(t.findings, _trail_table(t), max_events=20)
    return event_pairs(rows).where("event_id IS NOT NULL").select("finding_id", "event_id")


@query
def trail_table_activity(t: Tables) -> DataFrame:
    """What the kept index says of each key and hour: minutes with events, and events in them."""
    index = _trail_table(t).index()
    return index.groupBy("access_key_id", "span").agg(F.count("*").alias("minutes"), F.sum("n_named").alias("n_named"), F.sum("n_unnamed").alias("n_unnamed"))


# ---- streams with state of their own


@query
def stream_timeline(t: Tables) -> DataFrame:
    """Each finding's capped timeline from two streams; a tick at the end says that time has passed the last ones."""
    spark, folder = t._spark, new_folder(t._spark, "stream-timeline")
    moments = t.trail.agg(F.max("event_time").alias("a")).join(t.findings.agg(F.max("center_time").alias("b")))
    ticks = moments.select((F.greatest("a", "b") + F.expr("INTERVAL 30 DAYS")).alias("moment"))
    ticks.where("false").write.parquet(f"{folder}/ticks")

    def run() -> None:
        told = spark.readStream.schema("moment TIMESTAMP").parquet(f"{folder}/ticks")
        found, events = _streamed(t, d.FINDINGS), _streamed(t, d.TRAIL)
        jobs.drain(state.timeline_list_stream(found, events, f"{folder}/rows", f"{folder}/state", ticks=told, lateness="3650 days"))

    run()
    ticks.withColumn("moment", F.col("moment") + F.expr("INTERVAL 3650 DAYS")).write.mode("append").parquet(f"{folder}/ticks")
    run()
    ids = F.transform("events", lambda e: e["event_id"])
    return spark.read.parquet(f"{folder}/rows").select("finding_id", _listed(ids).alias("event_ids"))


@query
def stream_claims(t: Tables) -> DataFrame:
    """What becomes of each streamed arrival; nothing is claimed before."""
    rows = _drained(t, state.claim_stream(_streamed(t, d.ARRIVALS)), "stream-claims", idle_batches=False)
    return rows.select(F.nullif("finding_id", F.lit("")).alias("finding_id"), "status", "reason", _moment("ingest_time").alias("ingest_time"))


@query
def stream_related(t: Tables) -> DataFrame:
    """Related counts and lists from activity that a stream of all findings keeps, the history not read again."""
    state_folder = new_folder(t._spark, "related-state")
    jobs.drain(activity.activity_stream(_streamed(t, d.FINDINGS), state_folder), idle_batches=False)
    rows = with_related(t.findings, KeptActivity(activity.read_activity(t._spark, state_folder)))
    return rows.select("finding_id", "related_count", _listed(F.col("related_summaries")["id"]).alias("related_ids"))


# ---- latencies that merge


def _sketched_hours(outcomes: DataFrame, parts: DataFrame) -> DataFrame:
    figures = sketches.latency_figures(sketches.rolled_up(parts, "1 hour"))
    rows = _period(sketches.ranks(outcomes, figures, "1 hour"))
    return rows.select("window_start", "n", F.round("avg_ms", 6).alias("avg_ms"), "p90_near")


@query
def latency_hours(t: Tables) -> DataFrame:
    """Hours merged from sketches of five minutes, and whether the p90 has the rank it should have."""
    outcomes = t.light_outcomes()
    return _sketched_hours(outcomes, sketches.latency_parts(outcomes))


@query
def stream_latency(t: Tables) -> DataFrame:
    """The same hours from a stream of outcomes and skips whose batches each hold parts of all windows."""
    spark, folder = t._spark, new_folder(t._spark, "stream-latency")
    _, skips = gate.claim_batch(t.arrivals, None, _now())
    given = t.light_outcomes().unionByName(skips, allowMissingColumns=True).select("ts", "status", "processing_ms")
    given.repartition(3).write.parquet(f"{folder}/outcomes")
    outcomes = spark.read.schema(given.schema).parquet(f"{folder}/outcomes")
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/outcomes")
    jobs.drain(sketches.latency_stream(stream, f"{folder}/parts", f"{folder}/state"))
    return _sketched_hours(outcomes, sketches.read_parts(spark, f"{folder}/parts"))


# ---- containment, set against set


@query
def passage_containment(t: Tables) -> DataFrame:
    """Which documents hold which benchmark passages, whole and letter for letter."""
    needles = t.source("benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    found = contained(needles, t.source("documents").select(F.col("doc_id").alias("text_id"), "text"))
    return found.select(F.col("text_id").alias("doc_id"), F.col("needle_id").alias("item_id"))
