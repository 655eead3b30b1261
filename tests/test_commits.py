"""Batches of several tables that count as a whole or not at all."""

import pytest
from pyspark.sql import functions as F

from alertloom.operators import durable
from alertloom.schemas import CLAIMS
from alertloom.sources.commits import CommitLog
from alertloom.sources.tables import write_batch
from alertloom.streaming import jobs
from helpers import at, context, findings, responses

TABLES = (("outcomes", "parquet"), ("reports", "json"), ("audit", "parquet"), ("notifications", "json"), ("metrics", "parquet"), ("claims", "parquet"))


def _ids(rows):
    return sorted((r.batch_id, r.finding_id) for r in rows.collect())


def test_a_batch_killed_between_two_tables_is_not_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    log, ctx = CommitLog(spark, folder), context(spark, events=[dict(event_id="e1", event_time=at())])
    answers = responses(spark, *(dict(finding_id=i) for i in "abc"))

    def run(batch_id, *ids):
        jobs.triage_one(findings(spark, *(dict(finding_id=i) for i in ids)), batch_id, ctx, answers, folder=folder, run_ts=F.lit(at(60)))

    run(0, "a")
    for lost in ("audit", "claims", None):
        with monkeypatch.context() as m:
            real = write_batch

            def dies(rows, path, *rest):
                if lost and path.endswith(lost):
                    raise RuntimeError("lost")
                real(rows, path, *rest)

            m.setattr(jobs, "write_batch", dies)
            if lost is None:
                m.setattr(CommitLog, "commit", lambda *_a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                run(1, "a", "b", "b", "c")
        for table, fmt in TABLES:
            assert {r.batch_id for r in log.read(table, fmt=fmt).collect()} == {0}, (lost, table)
    # What the dead batch left is there, and the replay replaces it, by fewer rows too.
    assert spark.read.parquet(f"{folder}/outcomes").where("batch_id = 1").count() == 4
    run(1, "a", "b")
    want = [(0, "a"), (1, "a"), (1, "b")]
    assert _ids(log.read("outcomes")) == want and _ids(log.read("audit")) == [(0, "a"), (1, "b")] == _ids(log.read("claims", CLAIMS))
    assert [r.status for r in log.read("outcomes", after_batch=0).orderBy("finding_id").collect()] == ["skipped", "analyzed"]
    # A batch that counts is left as it is.
    run(1, "b", "c")
    assert _ids(log.read("outcomes")) == want


def test_batches_leave_no_tables_behind(spark, tmp_path, monkeypatch):
    folder, made = tmp_path / "out", []
    monkeypatch.setattr(durable, "new_folder", lambda _s, name: made.append(name) or str(tmp_path / name))
    ctx = context(spark, events=[dict(event_id="e1", event_time=at())])
    kept = []
    for k in range(5):
        batch = findings(spark, dict(finding_id=f"f{k}"), dict(finding_id="f0"))
        jobs.triage_one(batch, k, ctx, responses(spark, dict(finding_id=f"f{k}")), folder=str(folder), run_ts=F.lit(at(60)))
        kept.append(sorted(str(p.relative_to(folder)) for p in (folder / "scratch").glob("*/*")))
    assert made == [] and kept[1] == kept[2] == kept[4] and len(kept[4]) == 2 * len(kept[0])
    assert _ids(CommitLog(spark, str(folder)).read("audit")) == [(k, f"f{k}") for k in range(5)]


def test_writers_and_folders_from_before_the_log(spark, tmp_path):
    folder = str(tmp_path / "out")
    log, ctx, answers = CommitLog(spark, folder), context(spark), responses(spark, dict(finding_id="b"))
    assert log.is_new() and not log.holds(3) and log.batches().collect() == []
    for batch in (0, 1):
        write_batch(spark.createDataFrame([(f"old{batch}", 10**10)], CLAIMS), f"{folder}/claims", batch)
    one = findings(spark, dict(finding_id="b"), dict(finding_id="old1"))
    for _ in range(2):
        jobs.triage_one(one, 2, ctx, answers, folder=folder, run_ts=F.lit(at(60)), writer="w1")
    assert _ids(log.read("claims", CLAIMS)) == [(0, "old0"), (1, "old1"), (2, "b")]
    # Another checkpoint counts its batches from 0 again, and would lose those.
    with pytest.raises(ValueError, match="w1"):
        jobs.triage_one(one, 2, ctx, answers, folder=folder, run_ts=F.lit(at(60)), writer="w2")
