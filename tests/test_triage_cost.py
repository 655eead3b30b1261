"""What a triage does once for many findings, seen in its plans, and that its texts are those of whole bundles."""

import json

from pyspark.sql import functions as F

from alertloom.functions import text
from alertloom.operators import gate, outcomes as out
from alertloom.operators.durable import written_once
from alertloom.plans.triage import decide, responses_to, triage_batch
from helpers import at, brief, context, findings, plan_text, responses, technique, trail


def now():
    return F.lit("2026-06-19 00:00:00").cast("timestamp")


def _given(spark):
    events = [
        dict(event_id="e1", event_time=at(1), event_name="GetSecretValue", request_parameters='{"b": [1.50, "x\\"y"], "a": null}'),
        dict(event_id="e2", event_time=at(2), event_name='Odd "name" é', source_ip=None, request_parameters="no json"),
        dict(event_id=None, event_time=at(3), event_name=""), dict(event_id="e4", event_time=at(3), access_key_id="AK2", source_ip="10.0.0.9"),
    ]
    found = findings(
        spark, dict(finding_id="a"), dict(finding_id="b", title=None), dict(finding_id="bad", access_key_id="AK2", instance_id="i-1"),
        dict(finding_id="keyless", access_key_id=None), dict(finding_id="timeless", center_time=None), dict(finding_id="nothing", access_key_id="AK3"),
    )
    answers = responses(
        spark, dict(finding_id="a", brief_json=brief(affected_resources=["AK1", " 10.0.0.1 ", "nowhere", 'x\\"y'])), dict(finding_id="bad", stop_reason="refusal"),
        dict(finding_id="b", brief_json=brief(attack_techniques=[technique("T9999")])), dict(finding_id="b", attempt=2), dict(finding_id="nothing", request_id=None),
        dict(finding_id="keyless", brief_json=brief(affected_resources=[])), dict(finding_id="another"), dict(finding_id=None),
    )
    return found, context(spark, events=events, history=found), answers


def test_text_of_a_bundle_is_that_of_the_whole_bundle(spark):
    found, known, answers = _given(spark)
    whole, texts = decide(found, known, answers), decide(found, known, answers, as_text=True)
    assert {r.finding_id: r.t for r in texts.select("finding_id", F.col("evidence").alias("t")).collect()} == {
        r.finding_id: r.t for r in whole.select("finding_id", text.flat_json(F.col("bundle")).alias("t")).collect()
    }
    same = [c for c in whole.columns if c != "bundle"]
    assert sorted(map(str, whole.select(*same).collect())) == sorted(map(str, texts.select(*same).collect()))
    for rows_of in (lambda d: out.report_rows(d, now()), lambda d: out.notification_rows(d, now(), region="r", bucket="b", product="p")):
        assert sorted(map(str, rows_of(whole).collect())) == sorted(map(str, rows_of(texts).collect()))
    reports = {r.finding_id: json.loads(r.report) for r in out.report_rows(texts, now()).collect()}
    assert [e["eventName"] for e in reports["a"]["enrichment"]["cloudtrail_events"]] == ["GetSecretValue", 'Odd "name" é', ""]
    assert reports["a"]["enrichment"]["cloudtrail_events"][0]["requestParameters"] == {"a": None, "b": [1.5, 'x"y']}
    assert {k for k, r in reports.items() if not r["enrichment"]["cloudtrail_events"]} == {"keyless", "timeless", "nothing"}


def test_outputs_take_no_event_apart(spark):
    found, known, answers = _given(spark)
    result = triage_batch(found, known, answers, run_ts=now())
    for rows in (result.reports, result.notifications):
        plan = plan_text(rows)
        assert "userAgent" not in plan and "requestParameters" not in plan and "ReadSchema" in plan


def test_only_responses_to_the_findings_are_parsed(spark):
    found, _, answers = _given(spark)
    assert sorted((r.finding_id, r.attempt) for r in responses_to(found, answers).collect()) == [
        ("a", 1), ("b", 1), ("b", 2), ("bad", 1), ("keyless", 1), ("nothing", 1)
    ]


def test_arrivals_are_marked_once_for_findings_and_skips(spark):
    arrivals = findings(spark, *[dict(finding_id="a", ingest_time=at(i)) for i in (5, 5, 6)], dict(finding_id="b"), dict(finding_id=""))
    fresh, skips = gate.claim_batch(arrivals, None, F.lit(0), lambda rows: written_once(rows, "marked"))
    for rows in (fresh, skips):
        assert "Window" not in plan_text(rows)
    assert sorted((r.finding_id, r.ingest_time) for r in fresh.collect()) == [("a", at(5)), ("b", at(5))]
    assert sorted((r.finding_id or "", r.reason, r.ts) for r in skips.collect()) == [
        ("", "no_finding_id", at(5)), ("a", "already_triaged", at(5)), ("a", "already_triaged", at(6))
    ]
