"""The claim ledger against an upsert of the whole, over many batches, replays and merges that die."""

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import gate
from alertloom.schemas import CLAIMS
from alertloom.sources.claim_ledger import DELTA_RING, MANIFEST_RING, ClaimLedger
from alertloom.sources.tables import write_batch
from alertloom.streaming import jobs
from helpers import at, context, findings, responses


def _rows(found):
    return sorted(map(tuple, found.collect()))


def test_fifty_batches_equal_upserts_and_reads_stay_bounded(spark, tmp_path):
    rng = random.Random(2)
    ledger = ClaimLedger(spark, str(tmp_path / "l"), buckets=3, merge_every=8)
    want, files = {}, []
    for batch in range(50):
        clock = batch * 10
        ledger.merge_if_due(batch, F.lit(clock))
        # A third of the rows are of one id; batches without rows leave no gap.
        ids = {rng.choice(["hot", f"f{rng.randint(0, 60)}"]) for _ in range(0 if batch % 9 == 4 else 6)}
        added = [(i, clock + 100) for i in sorted(ids)] + [(None, 5)]
        for _ in range(2 if batch % 16 == 8 else 1):
            ledger.add(spark.createDataFrame(added, CLAIMS).coalesce(1), batch)
        want |= {i: e for i, e in added if i}
        if batch % 7 == 0 or batch == 49:
            live = sorted((i, e) for i, e in want.items() if e > clock)
            assert _rows(ledger.claims(now_seconds=F.lit(clock))) == live
            before = {**want}
            files.append(len(ledger.claims().inputFiles()))
    assert max(files) <= 2 * 3 + DELTA_RING and files[-1] == files[-2] and before == want
    assert len(list((tmp_path / "l" / "deltas").glob("slot=*"))) <= DELTA_RING
    assert len(list((tmp_path / "l" / "manifest").glob("slot=*"))) <= MANIFEST_RING


def test_it_is_the_upsert_of_the_gate(spark, tmp_path):
    claims = spark.createDataFrame([("old", 50), ("kept", 150), ("both", 300)], CLAIMS)
    added = spark.createDataFrame([("both", 400), ("new", 250)], CLAIMS)
    ledger = ClaimLedger(spark, str(tmp_path / "l"), buckets=2)
    assert ledger.is_new() and _rows(ledger.claims()) == []
    ledger.start(claims, 4, F.lit(0))
    ledger.add(added, 7)
    want = _rows(gate.upsert_claims(claims, added, F.lit(100)))
    assert _rows(ledger.claims(now_seconds=F.lit(100))) == want and not ledger.is_new()
    ledger.merge(7, F.lit(100))
    assert _rows(ledger.claims()) == want
    # All that a bucket held can run out; the older file in its place does not come back.
    for batch in (8, 9):
        ledger.add(spark.createDataFrame([(i, 500) for i in ("old", "kept", "both", "new")], CLAIMS), batch)
        ledger.merge(batch, F.lit(1_000))
        assert _rows(ledger.claims()) == []


def test_replays_and_a_merge_that_dies(spark, tmp_path, monkeypatch):
    ledger = ClaimLedger(spark, str(tmp_path / "l"), buckets=2, merge_every=2)
    first, second = (spark.createDataFrame(r, CLAIMS) for r in ([("a", 10), ("b", 10)], [("a", 20)]))
    ledger.add(first, 0)
    ledger.add(second, 1)
    assert _rows(ledger.claims(before_batch=1)) == [("a", 10), ("b", 10)]

    def no_manifest(*_a, **_k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", no_manifest)
        with pytest.raises(RuntimeError):
            ledger.merge(1, F.lit(0))
    assert _rows(ledger.claims()) == [("a", 20), ("b", 10)] and _rows(ledger.claims(before_batch=1)) == [("a", 10), ("b", 10)]
    assert ledger.merge_if_due(2, F.lit(0)) and not ledger.merge_if_due(3, F.lit(0))
    assert _rows(ledger.claims(before_batch=2)) == [("a", 20), ("b", 10)]
    with pytest.raises(ValueError):
        ledger.claims(before_batch=1)
    with pytest.raises(ValueError):
        ledger.add(first, 1)


def test_the_stream_reads_its_ledger_and_takes_over_older_claims(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ClaimLedger.__init__, "__defaults__", (4, 2))
    folder = str(tmp_path / "out")
    ctx = context(spark, events=[dict(event_id="e1", event_time=at())])
    # A folder from before the ledger: two batches in the claims table alone.
    write_batch(spark.createDataFrame([("a", 10**10)], CLAIMS), f"{folder}/claims", 0)
    write_batch(spark.createDataFrame([("b", 1)], CLAIMS), f"{folder}/claims", 1)
    answers = responses(spark, *(dict(finding_id=i) for i in "abcd"))
    batches = [["a", "b"], ["b", "c"], [], ["c", "d", "d"], ["a", "d"]]
    for k, ids in enumerate(batches, 2):
        batch = findings(spark, *(dict(finding_id=i) for i in ids)) if ids else findings(spark, dict(finding_id="x")).limit(0)
        for _ in range(2 if k == 5 else 1):
            jobs.triage_one(batch, k, ctx, answers, folder=folder, run_ts=F.lit(at(60)))
    got = sorted((r.batch_id, r.finding_id, r.status) for r in spark.read.parquet(f"{folder}/outcomes").collect())
    assert got == [
        (2, "a", "skipped"), (2, "b", "analyzed"), (3, "b", "skipped"), (3, "c", "analyzed"),
        (5, "c", "skipped"), (5, "d", "analyzed"), (5, "d", "skipped"), (6, "a", "skipped"), (6, "d", "skipped"),
    ]
    assert [i for i, _ in _rows(ClaimLedger(spark, f"{folder}/claim-ledger").claims())] == ["a", "b", "c", "d"]
