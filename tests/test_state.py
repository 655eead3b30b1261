import random
import time

from pyspark.sql import functions as F

from alertloom.streaming import jobs, state
from helpers import at, findings, trail
from test_timeline import _brute


def _as_files(rows, path):
    rows.coalesce(1).write.mode("append").parquet(str(path))


def _timelines(spark, tmp_path, found, events, batches=1, **options):
    """Lists of every finding: the batches one after the other, then a tick long after all of them."""
    f, t = findings(spark, *found), trail(spark, *events)
    ticks = spark.createDataFrame([(at(60 * 24 * 30),)], "moment TIMESTAMP")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
        writer = state.timeline_list_stream(read("f", f.schema), read("t", t.schema), out, checkpoint, ticks=read("ticks", ticks.schema), **options)
        jobs.drain(writer)

    (tmp_path / "ticks").mkdir()
    for k in range(batches):
        _as_files(f.where(F.pmod(F.xxhash64("finding_id"), F.lit(batches)) == k), tmp_path / "f")
        _as_files(t.where(F.pmod(F.xxhash64("event_id", "event_time"), F.lit(batches)) == k), tmp_path / "t")
        run()
    _as_files(ticks, tmp_path / "ticks")
    run()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len({r.finding_id for r in rows}) == len(found)
    return {r.finding_id: [(e.event_time, e.event_id or "") for e in r.events] for r in rows}


def test_capped_lists_equal_one_lookup_per_finding(spark, tmp_path):
    rng = random.Random(5)
    # One key has nine in ten of the rows.
    key = lambda: "AK0" if rng.random() < 0.9 else rng.choice(["AK1", "AK2"])
    events = [dict(event_id=f"e{i}", access_key_id=key(), event_time=at(rng.uniform(-400, 400))) for i in range(300)]
    events += rng.sample(events, 30) + [dict(event_id=None, access_key_id="AK0", event_time=at(rng.uniform(-300, 300))) for _ in range(6)]
    found = [dict(finding_id=f"f{i}", access_key_id=rng.choice([key(), key(), "AK9", None, ""]), center_time=at(rng.uniform(-300, 300))) for i in range(30)]
    got = _timelines(spark, tmp_path, found, events, batches=2, max_events=7, lateness="2 days")
    assert {k: sorted(v) for k, v in got.items() if v} == _brute(found, events, 2, 7)
    assert [] in got.values() and all(v == sorted(v) for v in got.values())


def test_time_that_has_passed_lets_go_of_state(spark, tmp_path):
    found = [dict(finding_id="a", access_key_id="AK1", center_time=at())]
    got = _timelines(spark, tmp_path, found, [dict(event_id="e", access_key_id="AK1", event_time=at(1))], max_events=3)
    assert got == {"a": [(at(1), "e")]}
    left = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "events").option("flattenCollectionTypes", True).load()
    assert left.count() == 0


def test_keys_share_groups_of_state_and_keep_their_own_lists(spark, tmp_path):
    rng = random.Random(6)
    events = [dict(event_id=f"e{i % 90}", access_key_id=f"AK{i % 30}", event_time=at(rng.uniform(-200, 200))) for i in range(200)]
    found = [dict(finding_id=f"f{i}", access_key_id=f"AK{i % 40}", center_time=at(rng.uniform(-200, 200))) for i in range(60)]
    _as_files(findings(spark, *found), tmp_path / "f0"), _as_files(trail(spark, *events), tmp_path / "t0")
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    # Before time has passed, the state of all keys and lanes is in as many groups a span.
    jobs.drain(state.timeline_list_stream(read("f0"), read("t0"), str(tmp_path / "out0"), str(tmp_path / "state0"), groups=3))
    held = spark.read.format("statestore").option("path", str(tmp_path / "state0")).option("stateVarName", "findings").option("flattenCollectionTypes", True).load()
    assert held.groupBy("key.span").agg(F.count_distinct("key.lanes").alias("n")).where("n > 3").isEmpty() and not held.isEmpty()
    got = _timelines(spark, tmp_path, found, events, batches=2, max_events=4, lateness="2 days", groups=3)
    assert {k: sorted(v) for k, v in got.items() if v} == _brute(found, events, 2, 4)


def _claims(spark, tmp_path, ttl_seconds):
    schema = findings(spark).schema
    stream = state.claim_stream(jobs.finding_stream(spark, str(tmp_path / "in"), fmt="parquet", maxFilesPerTrigger=1), ttl_seconds)
    jobs.drain(jobs.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")), idle_batches=False)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert set(schema.names) < set(rows.columns)
    return rows


def test_every_arrival_comes_out_claimed_or_skipped(spark, tmp_path):
    _as_files(findings(spark, dict(finding_id="a", ingest_time=at(9)), dict(finding_id="a", ingest_time=at(3)), dict(finding_id="b"), dict(finding_id=None), dict(finding_id="")), tmp_path / "in")
    assert _claims(spark, tmp_path, 3_600).count() == 5
    _as_files(findings(spark, dict(finding_id="a", ingest_time=at(1)), dict(finding_id="c", ingest_time=None), dict(finding_id="c", ingest_time=at(2))), tmp_path / "in")
    rows = _claims(spark, tmp_path, 3_600)
    got = sorted((r.finding_id or "", r.ingest_time, r.status, r.reason) for r in rows.collect() if r.ingest_time)
    assert got == [
        ("", at(5), "skipped", "no_finding_id"), ("", at(5), "skipped", "no_finding_id"), ("a", at(1), "skipped", "already_triaged"), ("a", at(3), "claimed", None),
        ("a", at(9), "skipped", "already_triaged"), ("b", at(5), "claimed", None), ("c", at(2), "claimed", None),
    ]
    assert [(r.finding_id, r.status) for r in rows.where("ingest_time IS NULL").collect()] == [("c", "skipped")]


def test_a_claim_is_free_again_after_its_time(spark, tmp_path):
    for _ in range(2):
        _as_files(findings(spark, dict(finding_id="a")), tmp_path / "in")
        rows = _claims(spark, tmp_path, 2)
        time.sleep(4)
    assert [r.status for r in rows.collect()] == ["claimed", "claimed"]
