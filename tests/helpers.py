"""Small tables in the shapes of the jobs, built from literals."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import json

from alertloom import schemas
from alertloom.plans.triage import Context

NOON = dt.datetime(2026, 6, 18, 12, 0)


def at(minutes: float = 0) -> dt.datetime:
    return NOON + dt.timedelta(minutes=minutes)


def _rows(spark, schema, rows, defaults):
    names = [field.strip().split()[0] for field in schema.split(",")]
    return spark.createDataFrame([tuple({**defaults, **row}.get(n) for n in names) for row in rows], schema)


def findings(spark, *rows):
    base = dict(
        type="UnauthorizedAccess:IAMUser/X", severity=8.0, title="t", region="us-east-1", resource_type="AccessKey",
        access_key_id="AK1", principal_id="P1", user_type="Role", user_name="app-role", center_time=at(),
        detector_id="d1", ingest_time=at(5),
    )
    return _rows(spark, schemas.FINDINGS, rows, base)


def trail(spark, *rows):
    base = dict(access_key_id="AK1", event_name="GetObject", event_source="s3.amazonaws.com", username="app-role", source_ip="10.0.0.1", user_agent="cli", aws_region="us-east-1")
    return _rows(spark, schemas.TRAIL, rows, base)


def brief(**changes):
    base = dict(
        summary="Something happened.", severity="HIGH", confidence="high",
        attack_techniques=[dict(technique_id="T1552.005", name="Metadata API", rationale="seen")],
        affected_resources=["AK1"], recommended_actions=["Disable AK1", "Look again"],
    )
    return json.dumps({**base, **changes})


def technique(technique_id, name="n"):
    return dict(technique_id=technique_id, name=name, rationale="r")


def responses(spark, *rows):
    base = dict(
        attempt=1, stop_reason="end_turn", brief_json=brief(), input_tokens=1000, output_tokens=2000,
        cache_read_input_tokens=0, cache_creation_input_tokens=0, request_id="req", model="m", processing_ms=4200,
    )
    return _rows(spark, schemas.RESPONSES, rows, base)


def context(spark, *, events=(), principals=(("role", "app-role"),), attached=(), inline=(), groups=(), history=None):
    return Context(
        trail(spark, *events),
        spark.createDataFrame(list(principals), schemas.PRINCIPALS),
        spark.createDataFrame(list(attached), schemas.ATTACHED_POLICIES),
        spark.createDataFrame(list(inline), schemas.INLINE_POLICIES),
        spark.createDataFrame(list(groups), schemas.GROUP_MEMBERSHIPS),
        history,
    )


def plan_text(rows) -> str:
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        rows.explain("formatted")
    return held.getvalue()
