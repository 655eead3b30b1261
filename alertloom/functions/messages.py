"""Chat notifications as typed blocks, serialised with to_json."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import distinct_in_order

# Emoji per band, caps and separators of the message layout.
EMOJI = {
    "LOW": ":large_blue_circle:",
    "MEDIUM": ":large_yellow_circle:",
    "HIGH": ":large_orange_circle:",
    "CRITICAL": ":red_circle:",
}
OTHER_EMOJI = ":white_circle:"
HEADER_LIMIT = 150
API_NAME_LIMIT = 10
SOURCE_IP_LIMIT = 5
UNTYPED = "GuardDuty finding"

_BLOCK = """
    STRUCT<type: STRING, text: STRUCT<type: STRING, text: STRING, emoji: BOOLEAN>,
           fields: ARRAY<STRUCT<type: STRING, text: STRING>>,
           elements: ARRAY<STRUCT<type: STRING, text: STRING>>>
"""


def _or_none(value: Column) -> Column:
    """Text of a value as a message shows it: a missing one reads None."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def _filled(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))


def _markdown(text: Column) -> Column:
    return F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))


def _block(kind: str, *, text: Column | None = None, plain: bool = False, fields: Column | None = None, elements: Column | None = None) -> Column:
    body = F.lit(None)
    if text is not None:
        body = F.struct(
            F.lit("plain_text" if plain else "mrkdwn").alias("type"),
            text.alias("text"),
            (F.lit(True) if plain else F.lit(None).cast("boolean")).alias("emoji"),
        )
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"),
        body.alias("text"),
        (none if fields is None else fields).alias("fields"),
        (none if elements is None else elements).alias("elements"),
    ).cast(_BLOCK)


def _payload(*blocks: Column) -> Column:
    """JSON of the blocks that are there; absent parts of a block are left out."""
    present = F.filter(F.array(*blocks), lambda b: b.isNotNull())
    return F.to_json(F.struct(present.alias("blocks")))


def header_text(final_severity: Column, finding_type: Column) -> Column:
    emoji = F.lit(OTHER_EMOJI)
    for level, text in EMOJI.items():
        emoji = F.when(final_severity == level, F.lit(text)).otherwise(emoji)
    full = F.concat(emoji, F.lit(" "), final_severity, F.lit(" — "), _filled(finding_type, UNTYPED))
    return F.substring(full, 1, HEADER_LIMIT)


def technique_tags(techniques: Column) -> Column:
    tags = F.transform(techniques, lambda t: F.concat(F.lit("`"), t["technique_id"], F.lit("` "), t["name"]))
    return F.array_join(tags, "  ")


def numbered(items: Column) -> Column:
    lines = F.transform(items, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a))
    return F.array_join(lines, "\n")


def context_text(finding_id: Column, report_url: Column) -> Column:
    parts = F.array(
        F.concat(F.lit("finding `"), _or_none(finding_id), F.lit("`")),
        F.concat(F.lit("<"), F.nullif(report_url, F.lit("")), F.lit("|full report>")),
    )
    return F.array_join(parts, " · ")


def brief_fields(final_severity: Column, confidence: Column, blast: Column, severity: Column, user_name: Column, related: Column) -> Column:
    return F.array(
        F.concat(F.lit("*Final severity:*\n"), final_severity),
        F.concat(F.lit("*Confidence:*\n"), confidence),
        F.concat(F.lit("*IAM blast radius:*\n"), blast),
        F.concat(F.lit("*GuardDuty severity:*\n"), _or_none(severity)),
        F.concat(F.lit("*Principal:*\n"), _filled(user_name, "unknown")),
        F.concat(F.lit("*Related findings:*\n"), related.cast("string")),
    )


def brief_payload(bundle: Column, brief: Column, final_severity: Column, report_url: Column) -> Column:
    finding = bundle["finding"]
    fields = brief_fields(
        final_severity,
        brief["confidence"],
        bundle["iam_context"]["blast_radius"],
        finding["severity"],
        finding["principal"]["user_name"],
        bundle["related_findings"]["count"],
    )
    tags = _block("section", text=F.concat(F.lit("*MITRE ATT&CK:*\n"), technique_tags(brief["attack_techniques"])))
    actions = _block("section", text=F.concat(F.lit("*Recommended actions:*\n"), numbered(brief["recommended_actions"])))
    return _payload(
        _block("header", text=header_text(final_severity, finding["type"]), plain=True),
        _block("section", text=brief["summary"]),
        _block("section", fields=F.transform(fields, _markdown)),
        F.when(F.size(brief["attack_techniques"]) > 0, tags),
        F.when(F.size(brief["recommended_actions"]) > 0, actions),
        _block("context", elements=F.array(_markdown(context_text(finding["id"], report_url)))),
    )


# Fields of a list of events are taken as lists, so that a reader of written events reads no other field.
def api_names(events: Column) -> Column:
    return distinct_in_order(events["eventName"], API_NAME_LIMIT)


def source_ips(events: Column) -> Column:
    return distinct_in_order(events["sourceIPAddress"], SOURCE_IP_LIMIT)


def activity_text(events: Column) -> Column:
    """Recent calls and addresses, or null where no call has a name."""
    names = api_names(events)
    line = F.concat(
        F.lit("*Recent API calls:* "), F.array_join(names, ", "),
        F.lit("\n*Source IPs:* "), _filled(F.array_join(source_ips(events), ", "), "n/a"),
    )
    return F.when(F.size(names) > 0, line)


def degraded_text(reason: Column, product: str) -> Column:
    return F.concat(
        F.lit(product + " could not produce an AI brief (reason: `"), reason,
        F.lit("`). Raw enriched context below for manual triage."),
    )


def degraded_fields(finding_type: Column, severity: Column, blast: Column, related: Column, events: Column, user_name: Column) -> Column:
    return F.array(
        F.concat(F.lit("*Finding:*\n"), _or_none(finding_type)),
        F.concat(F.lit("*GuardDuty severity:*\n"), _or_none(severity)),
        F.concat(F.lit("*IAM blast radius:*\n"), blast),
        F.concat(F.lit("*Related findings:*\n"), related.cast("string")),
        F.concat(F.lit("*CloudTrail events:*\n"), F.size(events["eventName"]).cast("string")),
        F.concat(F.lit("*Principal:*\n"), _filled(user_name, "unknown")),
    )


def degraded_payload(bundle: Column, reason: Column, product: str) -> Column:
    finding = bundle["finding"]
    events = bundle["cloudtrail_events"]
    fields = degraded_fields(
        finding["type"],
        finding["severity"],
        bundle["iam_context"]["blast_radius"],
        bundle["related_findings"]["count"],
        events,
        finding["principal"]["user_name"],
    )
    activity = activity_text(events)
    return _payload(
        _block("header", text=F.lit(":warning: AI analysis unavailable — manual triage needed"), plain=True),
        _block("section", text=degraded_text(reason, product)),
        _block("section", fields=F.transform(fields, _markdown)),
        F.when(activity.isNotNull(), _block("section", text=activity)),
        _block("context", elements=F.array(_markdown(F.concat(F.lit("finding `"), _or_none(finding["id"]), F.lit("`"))))),
    )
