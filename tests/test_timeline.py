import datetime as dt
import random

from pyspark.sql import functions as F

from alertloom.operators.timeline import _windows, distinct_events, relevant_trail, with_timeline
from helpers import at, findings, plan_text, trail


def _ids(rows):
    return {r["finding_id"]: [e["event_id"] for e in r["events"]] for r in rows.collect()}


def _brute(found, events, hours, n):
    """What one lookup per finding returns: newest first, an id once, cut at n, then oldest first."""
    result = {}
    for f in found:
        if not f["access_key_id"]:
            continue
        inside = [
            e for e in events
            if e["access_key_id"] == f["access_key_id"] and abs((e["event_time"] - f["center_time"]).total_seconds()) <= hours * 3600
        ]
        inside.sort(key=lambda e: (e["event_time"], e["event_id"] or ""), reverse=True)
        seen, kept = set(), []
        for e in inside:
            if e["event_id"] not in seen:
                seen.add(e["event_id"])
                kept.append(e)
        kept = kept[:n]
        if kept:
            result[f["finding_id"]] = sorted((e["event_time"], e["event_id"] or "") for e in kept)
    return result


def _same_as_brute(spark, found, events, hours=2, n=5, **options):
    rows = with_timeline(findings(spark, *found), trail(spark, *events), window_hours=hours, max_events=n, **options).collect()
    got = {r["finding_id"]: [(e["event_time"], e["event_id"] or "") for e in r["events"]] for r in rows if r["events"]}
    assert {k: sorted(v) for k, v in got.items()} == _brute(found, events, hours, n)
    for moments in got.values():
        assert [m[0] for m in moments] == sorted(m[0] for m in moments)


def test_no_key_and_no_activity_give_an_empty_timeline(spark):
    found = findings(spark, dict(finding_id="a", access_key_id=None), dict(finding_id="b", access_key_id=""), dict(finding_id="c", access_key_id="AK9"))
    rows = with_timeline(found, trail(spark, dict(event_id="e1", event_time=at()))).collect()
    assert {r["finding_id"]: r["events"] for r in rows} == {"a": [], "b": [], "c": []}


def test_copies_are_dropped_and_events_sorted(spark):
    events = [dict(event_id="e2", event_time=at(2)), dict(event_id="e1", event_time=at(1)), dict(event_id="e2", event_time=at(2))]
    assert _ids(with_timeline(findings(spark, dict(finding_id="a")), trail(spark, *events))) == {"a": ["e1", "e2"]}
    assert distinct_events(trail(spark, *events)).count() == 2


def test_cap_keeps_the_newest(spark):
    events = [dict(event_id=f"e{i}", event_time=at(i)) for i in range(10)]
    assert _ids(with_timeline(findings(spark, dict(finding_id="a")), trail(spark, *events), max_events=3)) == {"a": ["e7", "e8", "e9"]}


def test_both_ends_of_the_window_are_inside(spark):
    events = [dict(event_id="lo", event_time=at(-120)), dict(event_id="hi", event_time=at(120)), dict(event_id="out", event_time=at(120.001))]
    assert _ids(with_timeline(findings(spark, dict(finding_id="a")), trail(spark, *events))) == {"a": ["lo", "hi"]}


def test_events_without_an_id_count_once_per_finding(spark):
    events = [dict(event_id=None, event_time=at(m)) for m in (-100, 10, 61)] + [dict(event_id="e", event_time=at(5))]
    found = [dict(finding_id="early", access_key_id="AK1", center_time=at(-60)), dict(finding_id="late", access_key_id="AK1", center_time=at(0))]
    rows = {r["finding_id"]: [e["event_time"] for e in r["events"]] for r in with_timeline(findings(spark, *found), trail(spark, *events)).collect()}
    assert rows == {"early": [at(5), at(10)], "late": [at(5), at(61)]}


def test_random_fixture_equals_one_lookup_per_finding(spark):
    rng = random.Random(7)
    events = [
        dict(event_id=f"e{i}", access_key_id=f"AK{rng.randrange(4)}", event_time=at(rng.choice((rng.randrange(-400, 400), rng.uniform(-400, 400)))))
        for i in range(400)
    ]
    events += rng.sample(events, 60)
    events += [dict(event_id=None, access_key_id="AK0", event_time=at(rng.uniform(-300, 300))) for _ in range(9)]
    found = [dict(finding_id=f"f{i}", access_key_id=rng.choice(["AK0", "AK1", "AK2", "AK3", None]), center_time=at(rng.randrange(-300, 300))) for i in range(60)]
    _same_as_brute(spark, found, events)
    _same_as_brute(spark, found, events, n=1)
    _same_as_brute(spark, found, events, hours=0.0002)
    _same_as_brute(spark, found, events, hours=1.00017, n=3)


def test_one_key_with_most_events_in_one_second(spark):
    rng = random.Random(3)
    hot = [dict(event_id=f"h{i:05d}", access_key_id="AK1", event_time=at() + dt.timedelta(microseconds=rng.choice((0, 0, rng.randrange(10**6))))) for i in range(3000)]
    cold = [dict(event_id=f"c{i}", access_key_id=f"AK{2 + i % 5}", event_time=at(i)) for i in range(100)]
    found = [dict(finding_id=f"f{i}", access_key_id=f"AK{1 + i % 3}", center_time=at(-120) + dt.timedelta(microseconds=i * 50_000)) for i in range(40)]
    _same_as_brute(spark, found, hot + cold, n=7)


def test_findings_at_one_time_share_one_timeline(spark):
    events = [dict(event_id=f"e{i}", access_key_id="AK1", event_time=at(i)) for i in range(20)]
    found = [dict(finding_id=f"f{i}", access_key_id="AK1", center_time=at(i // 100)) for i in range(300)]
    _same_as_brute(spark, found, events)


def test_a_window_of_part_of_a_second_loses_nothing(spark):
    events = [dict(event_id=f"e{i}", access_key_id="AK1", event_time=at() + dt.timedelta(milliseconds=100 * i)) for i in range(-20, 21)]
    _same_as_brute(spark, [dict(finding_id="a", access_key_id="AK1", center_time=at())], events, hours=0.0002, n=50)


def test_no_pair_join_and_wide_fields_move_late(spark, tmp_path):
    trail(spark, *[dict(event_id=f"e{i}", event_time=at(i)) for i in range(20)]).write.parquet(str(tmp_path / "trail"))
    plan = plan_text(with_timeline(findings(spark, dict(finding_id="a")), spark.read.parquet(str(tmp_path / "trail"))))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # One exchange to meet the windows that take them, one with each window's list.
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part and "request_parameters" in part]
    assert len(moved) <= 1


def test_days_outside_all_windows_are_not_read(spark, tmp_path):
    rows = trail(spark, *[dict(event_id=f"e{i}", event_time=at(1440 * i)) for i in range(-9, 40)])
    rows.withColumn("dt", F.to_date("event_time")).write.partitionBy("dt").parquet(str(tmp_path / "trail"))
    stored = spark.read.parquet(str(tmp_path / "trail"))
    # A stray finding does not add the days between.
    found = findings(spark, dict(finding_id="a"), dict(finding_id="b", center_time=at(1440 * 30)))
    pruned = relevant_trail(_windows(found, 2), stored, 2)
    assert "dynamicpruning" in plan_text(pruned)
    assert sorted(r.event_id for r in pruned.collect()) == ["e0", "e30"]


def test_the_last_ids_of_equal_times_are_taken(spark):
    same = [dict(event_id=f"e{i:03d}", event_time=at()) for i in range(500)]
    rows = with_timeline(findings(spark, dict(finding_id="a")), trail(spark, *same), max_events=4)
    assert _ids(rows) == {"a": ["e496", "e497", "e498", "e499"]}
