import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from alertloom.operators.timeline import _windows, with_timeline
from alertloom.sources.trail_table import TrailTable, by_hour
from helpers import at, findings, plan_text, trail
from test_timeline import _brute


def _made(spark, path, events, **layout):
    table = TrailTable.create(spark, str(path), **{"buckets": 8, **layout})
    table.write_days(trail(spark, *events))
    return table


def _same_as_brute(spark, table, found, events, hours=2, n=5):
    rows = with_timeline(findings(spark, *found), table, window_hours=hours, max_events=n).collect()
    got = {r["finding_id"]: sorted((e["event_time"], e["event_id"] or "") for e in r["events"]) for r in rows if r["events"]}
    assert got == _brute(found, events, hours, n)


def _busy(rng, n=600):
    events = [
        dict(event_id=f"e{i}", access_key_id=rng.choice(["AK0", "AK0", "AK0", "AK1", "AK2"]), event_time=at(rng.choice((rng.randrange(-400, 400), rng.uniform(-400, 400)))), request_parameters=f'{{"k":{i}}}')
        for i in range(n)
    ]
    events += rng.sample(events, 60) + [dict(event_id=None, access_key_id="AK0", event_time=at(rng.uniform(-300, 300))) for _ in range(9)]
    return events, [dict(finding_id=f"f{i}", access_key_id=rng.choice(["AK0", "AK1", "AK2", "AK3", None]), center_time=at(rng.uniform(-300, 300))) for i in range(60)]


@pytest.mark.parametrize("lane_rows", [1_000_000, 20])
def test_random_fixture_equals_one_lookup_per_finding(spark, tmp_path, lane_rows):
    events, found = _busy(random.Random(7))
    table = _made(spark, tmp_path / "t", events, lane_rows=lane_rows)
    assert (table.rows().agg(F.max("lane")).first()[0] > 0) == (lane_rows == 20)
    for hours, n in ((2, 5), (0.0002, 5), (1.00017, 200))[:: 1 if lane_rows == 20 else 2]:
        _same_as_brute(spark, table, found, events, hours, n)


def test_equals_the_plain_trail(spark, tmp_path):
    events, found = _busy(random.Random(11))
    plain = with_timeline(findings(spark, *found), trail(spark, *events), max_events=7)
    laid = with_timeline(findings(spark, *found), _made(spark, tmp_path / "t", events, lane_rows=30), max_events=7)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, laid.collect()))


def test_copies_at_other_times_leave_no_window_short(spark, tmp_path):
    """Copies make the index count an event twice, so the newest minutes hold fewer events than it says."""
    events = [dict(event_id=f"e{i}", event_time=at(i)) for i in range(20)]
    events += [dict(event_id=f"e{i}", event_time=at(20 + i + j / 10)) for i in range(10, 14) for j in range(3)]
    table = _made(spark, tmp_path / "t", events)
    found = findings(spark, dict(finding_id="a", center_time=at(20)))
    plain = with_timeline(found, trail(spark, *events), max_events=6).first()
    assert [e["event_id"] for e in plain["events"]] == ["e18", "e19", "e10", "e11", "e12", "e13"]
    assert with_timeline(found, table, max_events=6).first()["events"] == plain["events"]


def test_a_busy_key_opens_few_minutes(spark, tmp_path):
    events = [dict(event_id=f"e{i}", event_time=at(i / 40)) for i in range(-4_000, 4_000)]
    table = _made(spark, tmp_path / "t", events)
    windows = _windows(findings(spark, dict(finding_id="a"), dict(finding_id="b", center_time=at(0.2))), 1)
    probed = table.probed(windows, 100)
    assert probed.where("asked").select("slot").distinct().count() <= 5 < 60 < probed.select("slot").distinct().count()
    assert table.near(windows, by_hour(probed.where("asked"))).count() <= 5 * 40


def test_rows_lie_still_until_they_matter(spark, tmp_path):
    events, found = _busy(random.Random(3))
    table = _made(spark, tmp_path / "t", events)
    windows = _windows(findings(spark, *found), 2)
    wanted = by_hour(table.probed(windows, 5).where("asked"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for met in (table.near(windows, wanted), table.around(windows, wanted, trail(spark, *events).select("access_key_id", F.col("event_time").alias("moment")))):
            plan = plan_text(met)
            assert not [part for part in plan.split("\n\n") if ") Exchange" in part and "request_parameters" in part]
            scan = next(part for part in plan.split("\n\n") if ") Scan parquet" in part and "request_parameters" in part)
            assert "Bucketed: true" in scan and re.search(r"PartitionFilters: \[[^]]*dt#", scan) and "SortMergeJoin" in plan
        late = plan_text(with_timeline(findings(spark, *found), table, max_events=5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # Behind the join that drops what no window takes, rows meet their windows, once, and then leave as lists.
    assert len([part for part in late.split("\n\n") if ") Exchange" in part and "request_parameters" in part]) <= 1


def test_a_busy_day_is_written_by_many_tasks(spark, tmp_path):
    events = [dict(event_id=f"e{i}", event_time=at(i / 100)) for i in range(2_000)]
    table = _made(spark, tmp_path / "t", events, buckets=16, lane_rows=100)
    files = {r[0]: r[1] for r in table.rows().groupBy(F.input_file_name()).count().collect()}
    assert len(files) >= 8 and max(files.values()) < 600


def test_grown_trails_read_and_write_only_new_days(spark, tmp_path):
    day = 24 * 60
    old = [dict(event_id=f"o{i}", event_time=at(i)) for i in range(0, day, 60)]
    new = [dict(event_id=f"n{i}", event_time=at(3 * day + i)) for i in range(0, 300, 10)]
    table = _made(spark, tmp_path / "t", old)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    table.write_days(trail(spark, *new))
    again = TrailTable.open(spark, str(tmp_path / "t"))  # as a later session does
    assert before.items() <= {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}.items()
    found = [dict(finding_id="old", access_key_id="AK1", center_time=at(30)), dict(finding_id="new", access_key_id="AK1", center_time=at(3 * day + 60))]
    for t in (table, again):
        _same_as_brute(spark, t, found, [{"access_key_id": "AK1", **e} for e in old + new])
    # A run over the new days opens nothing of the old ones.
    for file in before:
        if "/dt=" in file:
            with open(file, "wb") as out:
                out.write(b"not parquet")
    _same_as_brute(spark, again, found[1:], [{"access_key_id": "AK1", **e} for e in new])


def test_a_day_written_again_is_replaced(spark, tmp_path):
    events = [dict(event_id=f"e{i}", event_time=at(i)) for i in range(9)]
    table = _made(spark, tmp_path / "t", events)
    table.write_days(trail(spark, *events, dict(event_id="late", event_time=at(4.5))))
    assert table.rows().count() == 10 and table.index().agg(F.sum("n_named")).first()[0] == 10


def test_odd_trails(spark, tmp_path):
    table = TrailTable.create(spark, str(tmp_path / "t"), buckets=4)
    found = findings(spark, dict(finding_id="a"), dict(finding_id="b", access_key_id=None))
    assert [r.events for r in with_timeline(found, table).collect()] == [[], []]
    odd = trail(spark, dict(event_id="e", event_time=None), dict(event_id="e2", access_key_id=None, event_time=at()), dict(event_id="e3", event_time=at()), dict(event_id="e3", event_time=at()))
    table.write_days(odd.withColumn("note", F.lit("x")).withColumn("span", F.lit(1)))
    assert table.rows().count() == 2
    assert {r.finding_id: [e.event_id for e in r.events] for r in with_timeline(found, table).collect()} == {"a": ["e3"], "b": []}
    assert isinstance(table.rows().first().dt, dt.date)
