import json

from pyspark.sql import functions as F

from alertloom.functions import briefs, techniques
from alertloom.operators.bundles import system_prompt
from alertloom.operators.validation import ground, resolve_attempts, typed_responses
from helpers import brief, responses, technique


def test_contract(spark):
    good = json.loads(brief())
    cases = {
        "good": (brief(), True),
        "empty lists": (brief(attack_techniques=[], affected_resources=[], recommended_actions=[]), True),
        "wrong severity": (brief(severity="high"), False),
        "wrong confidence": (brief(confidence="HIGH"), False),
        "extra field": (json.dumps({**good, "notes": "x"}), False),
        "missing field": (json.dumps({k: v for k, v in good.items() if k != "summary"}), False),
        "null field": (brief(summary=None), False),
        "number for text": (brief(summary=5), False),
        "text for list": (brief(affected_resources="AK1"), False),
        "null in list": (brief(affected_resources=["a", None]), False),
        "number in list": (brief(recommended_actions=["a", 1]), False),
        "technique lacks a field": (brief(attack_techniques=[technique("T1078"), {"technique_id": "T1", "name": "n"}]), False),
        "technique has one more": (brief(attack_techniques=[{**technique("T1078"), "x": "y"}]), False),
        "broken": ("{", False),
        "not an object": ("[]", False),
        "nothing": (None, False),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k STRING, v STRING").select("k", briefs.checked(briefs.typed(F.col("v")), briefs.shape(F.col("v"))).alias("b"))
    assert {r.k: r.b is not None for r in rows.collect()} == {k: v[1] for k, v in cases.items()}


def test_reasons(spark):
    got = typed_responses(responses(
        spark,
        dict(finding_id="ok"), dict(finding_id="refusal", stop_reason="refusal"), dict(finding_id="cut", stop_reason="max_tokens"),
        dict(finding_id="api", error_type="APIConnectionError", stop_reason=None, brief_json=None),
        dict(finding_id="init", error_type="client_init_error", stop_reason=None, brief_json=None), dict(finding_id="none", brief_json=None),
    ))
    assert {r.finding_id: r.reason for r in got.collect()} == {
        "ok": None, "refusal": "refusal", "cut": "max_tokens", "api": "api_error:APIConnectionError", "init": "client_init_error", "none": "no_parsed_output",
    }


def test_second_attempt_only_after_unknown_techniques(spark):
    bad = brief(attack_techniques=[technique("T9999"), technique("T0000")])
    two = dict(attempt=2, request_id="req2", input_tokens=10, output_tokens=20, processing_ms=1000)
    rows = responses(
        spark,
        dict(finding_id="good"), {**two, "finding_id": "good", "stop_reason": "refusal"},
        dict(finding_id="retry", brief_json=bad), {**two, "finding_id": "retry"},
        dict(finding_id="twice", brief_json=bad), {**two, "finding_id": "twice", "brief_json": bad},
        dict(finding_id="refused", brief_json=bad), {**two, "finding_id": "refused", "stop_reason": "refusal"},
        dict(finding_id="no retry", stop_reason="refusal"), {**two, "finding_id": "no retry"},
        dict(finding_id="alone", brief_json=bad),
        dict(finding_id="empty", brief_json=brief(attack_techniques=[])),
        {**two, "finding_id": "third", "attempt": 3},
    )
    got = {r.finding_id: (r.reason, r.request_id, r.processing_ms, r.all_input_tokens, r.brief is not None) for r in resolve_attempts(typed_responses(rows)).collect()}
    assert got == {
        "good": (None, "req", 4200, 1000, True), "retry": (None, "req2", 5200, 1010, True), "twice": ("validation_failed", "req2", 5200, 1010, False),
        "refused": ("refusal", "req2", 5200, 1010, False), "no retry": ("refusal", "req", 4200, 1000, False), "alone": ("validation_failed", "req", 4200, 1000, False),
        "empty": (None, "req", 4200, 1000, True),
    }
    once = {r.finding_id: (r.reason, r.brief is not None) for r in resolve_attempts(typed_responses(rows), retry=False).collect()}
    assert once["retry"] == (None, True) and once["twice"] == (None, True) and once["no retry"] == ("refusal", False)


def test_grounding_and_allowlist_keep_order_and_text(spark):
    resources = ["AK1", " role/app ", "s3://made-up", "   ", 'quo"te', "\tAK1\n", "finding"]
    text = brief(attack_techniques=[technique("T9999"), technique("T1552.005"), technique("T1078"), technique("t1078")], affected_resources=resources)
    rows = responses(spark, dict(finding_id="f", brief_json=text))
    evidence = F.struct(F.struct(F.lit("AK1").alias("key"), F.lit('quo"te role/app').alias("note")).alias("finding")).alias("bundle")
    got = ground(typed_responses(rows).withColumn("bundle", evidence)).first()
    assert [t.technique_id for t in got.brief.attack_techniques] == ["T1552.005", "T1078"]
    assert got.dropped_techniques == ["T9999", "t1078"] and got.valid
    assert got.brief.affected_resources == ["AK1", " role/app ", "\tAK1\n", "finding"]
    assert got.dropped_resources == ["s3://made-up", "   ", 'quo"te']


def test_dimension(spark):
    dimension = techniques.techniques(spark)
    rows = dimension.collect()
    assert len(rows) == 53 == len({r.technique_id for r in rows})
    assert all(r.name and r.description and r.tactic for r in rows)
    reference = techniques.reference_text(dimension)
    lines = reference.first().reference.split("\n")
    assert len(lines) == 53 and lines[0] == "- T1078 Valid Accounts — Use of legitimate credentials to access and blend in."
    bare = dimension.limit(1).withColumn("description", F.lit(None).cast("string"))
    assert techniques.reference_text(bare).first().reference == "- T1078 Valid Accounts"
    assert system_prompt(reference).first().system_prompt.endswith(lines[-1])
