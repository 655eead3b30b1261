import json

from pyspark.sql import functions as F

from alertloom.schemas import FINDINGS, TRAIL_RAW
from alertloom.sources.findings import parse_findings, read_findings, read_labeled
from alertloom.sources.tables import read_claims, write_batch, write_trail
from alertloom.sources.trail import flatten_trail
from alertloom.streaming import jobs
from helpers import at, brief, context, findings, responses, trail


def now():
    return F.lit("2026-06-19 00:00:00").cast("timestamp")


PASCAL = {
    "Id": "p1", "Type": "T", "Severity": 8, "Title": "t", "Region": "r",
    "Resource": {"ResourceType": "AccessKey", "AccessKeyDetails": {"AccessKeyId": "AK", "PrincipalId": "P", "UserType": "Role", "UserName": "u"}, "InstanceDetails": {"InstanceId": "i-1"}},
    "Service": {"EventFirstSeen": "2026-06-18T14:00:00Z", "EventLastSeen": "2026-06-18T14:20:00Z", "DetectorId": "d"}, "UpdatedAt": "2026-06-18T15:00:00.000Z",
}
CAMEL = {"id": "c1", "type": "T2", "severity": 5.5, "resource": {"accessKeyDetails": {"accessKeyId": "AK2", "userName": "u2"}}, "service": {}, "updatedAt": "2026-06-18T15:00:00Z"}


def test_envelopes_and_both_casings(spark, tmp_path):
    documents = {"a": PASCAL, "b": {"detail": CAMEL}, "c": {"Findings": [{**PASCAL, "Id": "p2"}, {**PASCAL, "Id": "p3"}]}, "d": {}, "e": {"Id": "", "id": "low", "createdAt": "nonsense"}}
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    raw = read_findings(spark, str(tmp_path))
    got = {r.finding_id: r for r in parse_findings(raw, run_ts=now()).collect()}
    assert set(got) == {"p1", "c1", "p2", "p3", None, "low"}
    p1, c1 = got["p1"], got["c1"]
    assert (p1.severity, p1.access_key_id, p1.principal_id, p1.user_type, p1.user_name, p1.instance_id, p1.detector_id) == (8.0, "AK", "P", "Role", "u", "i-1", "d")
    assert p1.center_time.isoformat() == "2026-06-18T14:20:00"
    assert (c1.type, c1.severity, c1.access_key_id, c1.user_name, c1.title) == ("T2", 5.5, "AK2", "u2", None)
    assert c1.center_time.isoformat() == "2026-06-18T15:00:00"
    assert got["low"].center_time.isoformat() == got[None].center_time.isoformat() == "2026-06-19T00:00:00"
    assert read_findings(spark, str(tmp_path), every=True).count() == 6
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.txt").write_text(json.dumps(PASCAL) + "\n" + json.dumps({"detail": CAMEL}) + "\n")
    assert read_findings(spark, str(tmp_path / "lines"), whole_files=False).count() == 2


def test_flattened_trail(spark):
    inner = {"eventName": "In", "eventSource": "s3", "sourceIPAddress": "1.2.3.4", "requestParameters": {"b": 1, "a": "x"}, "userIdentity": {"userName": "inner", "accessKeyId": "AKIN"}}
    rows = [
        ("AK", "e1", "Out", at(), "outer", json.dumps(inner)), (None, "e2", "", at(), None, json.dumps(inner)),
        ("AK", "e3", None, at(), "", "{broken"), ("AK", "e4", None, at(), None, json.dumps({"userIdentity": None, "eventName": "X"})), ("AK", "e5", "N", at(), None, None),
    ]
    got = {r.event_id: r for r in flatten_trail(spark.createDataFrame(rows, TRAIL_RAW)).collect()}
    assert (got["e1"].event_name, got["e1"].username, json.loads(got["e1"].request_parameters)) == ("Out", "outer", {"a": "x", "b": 1})
    assert (got["e2"].event_name, got["e2"].username, got["e2"].access_key_id) == ("In", "inner", "AKIN")
    assert (got["e3"].event_name, got["e3"].username, got["e3"].source_ip) == (None, None, None)
    assert (got["e4"].event_name, got["e4"].username) == ("X", None)
    assert got["e5"].event_name == "N" and got["e5"].request_parameters is None


def test_labelled_files_in_name_order(spark, tmp_path):
    for name, severity in (("02_b", "LOW"), ("01_a", "HIGH")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"expected_severity": severity, "finding": {**PASCAL, "Id": name}}, indent=1))
    (tmp_path / "notes.txt").write_text("not a finding")
    got = read_labeled(spark, str(tmp_path), run_ts=now()).collect()
    assert [(r.name, r.expected_severity, r.finding_id) for r in got] == [("01_a", "HIGH", "01_a"), ("02_b", "LOW", "02_b")]


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "claims")
    assert read_claims(spark, path).count() == 0
    write_batch(spark.createDataFrame([("a", 1)], "finding_id STRING, expires_at BIGINT"), path, 0)
    for _ in range(2):
        write_batch(spark.createDataFrame([("a", 9), ("b", 2)], "finding_id STRING, expires_at BIGINT"), path, 1)
    assert sorted(map(tuple, read_claims(spark, path).collect())) == [("a", 9), ("b", 2)]
    assert [tuple(r) for r in read_claims(spark, path, before_batch=1).collect()] == [("a", 1)]


def _as_files(rows, path):
    rows.coalesce(1).write.mode("append").json(str(path))


def test_streamed_triage_claims_across_batches_and_restarts(spark, tmp_path):
    folder, inbox = str(tmp_path / "out"), tmp_path / "in"
    ctx = context(spark, events=[dict(event_id="e1", event_time=at())], history=findings(spark, dict(finding_id="a")))
    answers = responses(spark, dict(finding_id="a"), dict(finding_id="b", stop_reason="refusal"))

    def run():
        stream = jobs.finding_stream(spark, str(inbox), schema=FINDINGS)
        jobs.drain(jobs.triage_stream(stream, lambda: ctx, lambda: answers, folder=folder, checkpoint=str(tmp_path / "state"), run_ts=now()))

    _as_files(findings(spark, dict(finding_id="a"), dict(finding_id="a"), dict(finding_id="low", severity=1.0)), inbox)
    run()
    _as_files(findings(spark, dict(finding_id="a", ingest_time=at(60)), dict(finding_id="b")), inbox)
    run()
    got = sorted((r.finding_id, r.status, r.batch_id) for r in spark.read.parquet(folder + "/outcomes").collect())
    assert got == [("a", "analyzed", 0), ("a", "skipped", 0), ("a", "skipped", 1), ("b", "degraded", 1)]
    assert spark.read.parquet(folder + "/audit").count() == 2
    assert spark.read.json(folder + "/reports").count() == 2
    assert {r.finding_id for r in read_claims(spark, folder + "/claims").collect()} == {"a", "b"}


def test_stream_dedup(spark, tmp_path):
    _as_files(findings(spark, dict(finding_id="a"), dict(finding_id="a", ingest_time=at(60)), dict(finding_id="b"), dict(finding_id=None)), tmp_path / "in")
    _as_files(findings(spark, dict(finding_id="a", ingest_time=at(90)), dict(finding_id="c")), tmp_path / "in")
    stream = jobs.once_per_finding(jobs.finding_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger=1))
    jobs.drain(jobs.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    assert sorted(r.finding_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_stream_timeline_gives_unmatched_findings_too(spark, tmp_path):
    found = findings(spark, dict(finding_id="hit"), dict(finding_id="miss", access_key_id="AK9"), dict(finding_id="late", center_time=at(3000)))
    seen = trail(spark, dict(event_id="e1", event_time=at(-60)), dict(event_id="e1", event_time=at(-60)), dict(event_id="far", event_time=at(3000)), dict(event_id="far", access_key_id="AK8", event_time=at(3000)))
    _as_files(found, tmp_path / "f")
    _as_files(seen, tmp_path / "t")
    pairs = jobs.timeline_stream(
        spark.readStream.schema(found.schema).json(str(tmp_path / "f")), spark.readStream.schema(seen.schema).json(str(tmp_path / "t"))
    )
    jobs.drain(jobs.append_stream(pairs, str(tmp_path / "out"), str(tmp_path / "state")))
    got = sorted((r.finding_id, r.event_id or "-") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("hit", "e1"), ("late", "far"), ("miss", "-")]


def test_a_busy_key_is_written_by_many_tasks(spark, tmp_path):
    rows = trail(spark, *(dict(event_id=f"e{i}", event_time=at(i % 9)) for i in range(200)), dict(event_id=None, access_key_id=None, event_time=None))
    # So few rows would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_trail(rows, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = spark.read.parquet(str(tmp_path / "t"))
    files = got.where("access_key_id = 'AK1'").groupBy("_metadata.file_name").count().collect()
    assert got.count() == 201 and len(files) > 1 and max(f["count"] for f in files) < 180
