"""Model responses: contract check, degraded reason, allowlist and grounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import BRIEF
from . import techniques
from .bands import LEVELS
from .text import strip_whitespace

# Reasons a response cannot be used, and the token that marks a failed client.
CLIENT_INIT_ERROR = "client_init_error"
REFUSAL = "refusal"
MAX_TOKENS = "max_tokens"
NO_PARSED_OUTPUT = "no_parsed_output"
VALIDATION_FAILED = "validation_failed"
CONFIDENCES = ("low", "medium", "high")
# Ours: the finding has no response row at all.
NO_RESPONSE = "no_response"

# Exact inferred schema of a well-formed brief; an empty list is inferred as ARRAY<VOID>.
_STRINGS = r"ARRAY<(STRING|VOID)>"
_TECHNIQUES = r"ARRAY<(VOID|OBJECT<name: STRING, rationale: STRING, technique_id: STRING>)>"
_CONTRACT = (
    rf"^OBJECT<affected_resources: {_STRINGS}, attack_techniques: {_TECHNIQUES}, "
    rf"confidence: STRING, recommended_actions: {_STRINGS}, severity: STRING, summary: STRING>$"
)


def typed(brief_json: Column) -> Column:
    """The brief as a struct, whatever is missing left null."""
    return F.from_json(brief_json, BRIEF)


def shape(brief_json: Column) -> Column:
    """Inferred schema of the brief as text."""
    return F.schema_of_variant(F.try_parse_json(brief_json))


def checked(typed: Column, shape: Column) -> Column:
    """The typed brief, or null where it breaks the contract.

    All six fields must be there with the right types and no others. The inferred schema of a
    list hides a null item or a field only some items have, so items are looked at one by one.
    """
    whole_lists = ~(
        F.exists(typed["affected_resources"], lambda r: r.isNull())
        | F.exists(typed["recommended_actions"], lambda a: a.isNull())
        | F.exists(
            typed["attack_techniques"],
            lambda t: t["technique_id"].isNull() | t["name"].isNull() | t["rationale"].isNull(),
        )
    )
    good = (
        shape.rlike(_CONTRACT)
        & typed["severity"].isin(*LEVELS)
        & typed["confidence"].isin(*CONFIDENCES)
        & whole_lists
    )
    return F.when(good, typed)


def degraded_reason(error_type: Column, stop_reason: Column, brief: Column) -> Column:
    """Why an attempt gave no usable brief; null when it gave one."""
    return (
        F.when(error_type == CLIENT_INIT_ERROR, CLIENT_INIT_ERROR)
        .when(error_type.isNotNull(), F.concat(F.lit("api_error:"), error_type))
        .when(stop_reason == REFUSAL, REFUSAL)
        .when(stop_reason == MAX_TOKENS, MAX_TOKENS)
        .when(brief.isNull(), NO_PARSED_OUTPUT)
    )


def kept_techniques(proposed: Column) -> Column:
    return F.filter(proposed, lambda t: techniques.is_known(t["technique_id"]))


def dropped_techniques(proposed: Column) -> Column:
    unknown = F.filter(proposed, lambda t: ~techniques.is_known(t["technique_id"]))
    return F.transform(unknown, lambda t: t["technique_id"])


def is_trustworthy(proposed: Column) -> Column:
    """False only where techniques were proposed and not one of them is known."""
    return (F.size(proposed) == 0) | F.exists(proposed, lambda t: techniques.is_known(t["technique_id"]))


def _grounded(resource: Column, evidence: Column) -> Column:
    wanted = strip_whitespace(resource)
    return (wanted != "") & F.contains(evidence, wanted)


def grounded(resources: Column, evidence: Column) -> Column:
    """Of each resource whether its trimmed text stands literally in the evidence, which is searched once for each."""
    return F.transform(resources, lambda r: _grounded(r, evidence))


def kept_resources(resources: Column, grounded: Column) -> Column:
    """The resources that are grounded, untrimmed."""
    return F.filter(resources, lambda _, i: F.get(grounded, i))


def dropped_resources(resources: Column, grounded: Column) -> Column:
    return F.filter(resources, lambda _, i: ~F.get(grounded, i))
