import datetime as dt

from pyspark.sql import functions as F

from alertloom.operators.validation import typed_responses
from alertloom.plans.queries import REGISTRY, Tables, _each
from helpers import brief, plan_text, responses, technique


def _folder(spark, tmp_path, n=400):
    """A folder whose events are one file of one row group."""
    moment = F.lit(dt.datetime(2026, 6, 18)) + F.make_dt_interval(mins=F.col("id"))
    events = spark.range(n).select(
        F.col("id").alias("event_id"), moment.cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("error").alias("event_type"),
        F.lit(1.5).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_rows_that_are_parsed_are_dealt_to_all_tasks(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    for name in ("parameters", "responses", "documents", "lookups"):
        assert getattr(Tables(spark, folder), name).select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    rows = REGISTRY["scrub_parameters"](spark, folder)
    assert rows.withColumn("p", F.spark_partition_id()).agg(F.count_distinct("p"), F.count("*")).first() == (8, 400)
    assert rows.where("NOT is_clean OR k <> event_id").isEmpty()


def test_items_of_briefs_are_listed_without_a_filter_that_parses(spark):
    given = responses(
        spark, dict(finding_id="a"), dict(finding_id="b", brief_json=brief(attack_techniques=[])), dict(finding_id="c", brief_json="no brief"),
        dict(finding_id="d", brief_json=brief(attack_techniques=[technique("T1"), technique("T2")])),
    )
    rows = _each(typed_responses(given), "brief.attack_techniques", "x")
    assert sorted((r.finding_id, r.x.technique_id) for r in rows.collect()) == [("a", "T1552.005"), ("d", "T1"), ("d", "T2")]
    conditions = [line for line in plan_text(rows).splitlines() if line.startswith("Condition")]
    assert conditions and not any("from_json" in line for line in conditions)


def test_semi_and_anti_join_count_each_technique(spark, tmp_path):
    got = {(r.side, r.technique_id) for r in REGISTRY["technique_semi_anti"](spark, _folder(spark, tmp_path)).collect()}
    assert got == {("kept", "T1078.004"), ("kept", "T1552.005"), ("dropped", "T9999"), ("dropped", "T0000")}
