"""Figures and lists that are kept by merging: latency sketches and related activity."""

import random

from pyspark.sql import functions as F

from alertloom.operators import latency_sketches as sketches
from alertloom.operators.related import KeptActivity, with_related
from alertloom.sources.tables import write_batch
from alertloom.streaming import activity, jobs
from helpers import at, findings

OUTCOMES = "ts TIMESTAMP, status STRING, processing_ms BIGINT"


def test_merged_sketches_have_the_exact_rank(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "parts")
    # Most outcomes are in one window and half have one value; two batches bring late parts of all windows.
    rows = [(at(rng.choice([1, 1, 1, 8, 70, 200])), "analyzed", rng.choice([700, int(rng.lognormvariate(8, 1))])) for _ in range(30_000)]
    rows += [(at(3), "skipped", 10**9), (at(3), "analyzed", None), (None, "analyzed", 5), (at(600), "skipped", None)]
    outcomes = spark.createDataFrame(rows, OUTCOMES)
    assert sketches.read_parts(spark, path).collect() == []
    for k in range(3):
        part = sketches.latency_parts(outcomes.where(F.pmod(F.hash("ts", "processing_ms"), F.lit(3)) == k))
        for _ in range(2 if k == 1 else 1):
            write_batch(part, path, k)
    write_batch(sketches.latency_parts(outcomes.limit(0)), path, 3)
    fine, held = {}, [(t, v) for t, s, v in rows if t and s != "skipped" and v is not None]
    for period, cut in (("5 minutes", dict(minute=True)), ("1 hour", {}), ("1 day", {})):
        exact = {}
        for moment, value in held:
            start = moment.replace(minute=moment.minute // 5 * 5 if cut else 0, second=0, microsecond=0)
            exact.setdefault(start.replace(hour=0) if period == "1 day" else start, []).append(value)
        # Days are merged from hours, hours from five minutes.
        parts = fine = sketches.rolled_up(fine or sketches.read_parts(spark, path), period)
        figures = sketches.latency_figures(parts)
        got = {r.window_start: r for r in sketches.ranks(outcomes, figures, period).collect()}
        assert set(got) == set(exact)
        for start, values in exact.items():
            row, n = got[start], len(values)
            assert row.n == n and abs(row.avg_ms - sum(values) / n) < 1e-6 and row.p90_ms in values and row.p90_near
            assert sum(v < row.p90_ms for v in values) <= (0.9 + sketches.RANK_ERROR) * n
            assert sum(v <= row.p90_ms for v in values) >= (0.9 - sketches.RANK_ERROR) * n
    wrong = figures.withColumn("p90_ms", F.lit(1).cast("long"))
    assert not any(r.p90_near for r in sketches.ranks(outcomes, wrong, "1 day").collect())


def _related(rows):
    return sorted((r.finding_id, str(r.principal_id), str(r.detector_id), r.related_count, repr(r.related_summaries)) for r in rows.collect())


def test_kept_activity_equals_the_whole_history(spark, tmp_path):
    rng, inbox, checkpoint = random.Random(4), tmp_path / "in", str(tmp_path / "state")
    # One principal has most findings; some come again, newer, older or with another title, some have no time.
    made = [
        dict(
            finding_id=f"f{rng.randint(0, 60)}", principal_id=rng.choice(["hot", "hot", "hot", "p1", "p2", "", None]), title=f"t{rng.randint(0, 9)}",
            center_time=rng.choice([at(rng.randint(0, 40)), at(rng.randint(0, 40)), None]), severity=rng.choice([1.0, 8.5, None, float("nan")]), detector_id=None if k % 9 == 0 else "d1",
        )
        for k in range(150)
    ] + [dict(finding_id=None, principal_id="hot"), dict(finding_id="", principal_id="p2")]
    seen = []
    for k in range(3):
        batch = findings(spark, *made[k::3])
        batch.coalesce(1).write.mode("append").parquet(str(inbox))
        seen += made[k::3]
        stream = spark.readStream.schema(batch.schema).parquet(str(inbox))
        jobs.drain(activity.activity_stream(stream, checkpoint, max_summaries=4, lanes=3), idle_batches=False)
        if k:
            asked, history = batch.where("finding_id IS NOT NULL"), findings(spark, *seen)
            kept = KeptActivity(activity.read_activity(spark, checkpoint, max_summaries=4))
            got, want = (_related(with_related(asked, h, max_summaries=4)) for h in (kept, history))
            assert got == want and max(v[4].count("Row(") for v in got) == 4


def test_few_findings_are_held_in_their_list_alone(spark, tmp_path):
    def held(name):
        return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state"))

    batches = [[("few", k) for k in range(3)] + [("many", k) for k in range(5)], [("few", 1), ("many", 9), ("many", 2)]]
    for batch in batches:
        findings(spark, *[dict(finding_id=f"{p}{k}", principal_id=p, center_time=at(k)) for p, k in batch]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(findings(spark).schema).parquet(str(tmp_path / "in"))
        jobs.drain(activity.activity_stream(stream, str(tmp_path / "state"), max_summaries=4, lanes=1), idle_batches=False)
    assert {r.p: r.n for r in held("standing").selectExpr("key.principal_id AS p", "value.total AS n").collect()} == {"few": 3, "many": 6}
    assert {r.p for r in held("known").selectExpr("key.principal_id AS p").collect()} == {"many"}
