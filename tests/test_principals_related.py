import json

from pyspark.sql import functions as F

from alertloom import schemas
from alertloom.functions import bands, policy
from alertloom.operators.principals import blast_radius, profiles, with_profile
from alertloom.operators.related import with_related
from alertloom.operators.skew import lookup_join
from helpers import at, context, findings, plan_text


def _allow(action, resource="*", effect="Allow"):
    statement = dict(Effect=effect, Action=action)
    return statement if resource is None else dict(statement, Resource=resource)


def _doc(*statements):
    return json.dumps({"Version": "2012-10-17", "Statement": statements[0] if len(statements) == 1 else list(statements)})


def test_document_bands(spark):
    cases = [
        (_doc(_allow("*")), 4),
        (_doc(_allow(["s3:Get*", "*"], ["arn:a", "*"])), 4),
        (_doc(_allow("s3:*")), 3),
        (_doc(_allow("s3:*", "arn:a")), 1),
        (_doc(_allow("s3:Get*")), 1),
        (_doc(_allow("SecretsManager:GetSecretValue", "arn:x")), 3),
        (_doc(_allow("iam:PassRole", None)), 3),
        (_doc(_allow("*", None)), 1),
        (_doc(_allow("*", effect="Deny")), 1),
        (_doc(_allow("s3:GetObject", "arn:b"), _allow("*")), 4),
        ("%7B%22Statement%22%3A%7B%22Effect%22%3A%22Allow%22%2C%22Action%22%3A%22%2A%22%2C%22Resource%22%3A%22%2A%22%7D%7D", 4),
        ('{"Statement":{"Effect":"Allow","Action":"*","Resource":"*","Note":"100% +"}}', 4),
        ('{"Statement":{"Effect":"Deny","Effect":"Allow","Action":"*","Resource":"*"}}', 4),
        ("{broken", 1), ("[]", 1), ("{}", 1), (None, 1),
    ]
    rows = spark.createDataFrame(cases, "document STRING, expected INT").select("document", "expected", policy.document_number(F.col("document")).alias("got"))
    assert [(r.document, r.got) for r in rows.collect()] == cases


def test_managed_names(spark):
    cases = [
        ("AdministratorAccess", 4), ("AdministratorAccess-Amplify", 3), ("IAMFullAccess", 3), ("AmazonS3FullAccess", 3), ("PowerUserAccess", 3),
        ("SecretsManagerReadWrite", 3), ("AWSKeyManagementServicePowerUser", 3), ("AmazonS3ReadOnlyAccess", 2), ("SecurityAudit", 2),
        ("ViewOnlyAccess", 2), ("AmazonSSMManagedInstanceCore", 1), ("administratoraccess", 1),
    ]
    rows = spark.createDataFrame(cases, "name STRING, n INT").select("name", policy.managed_policy_number(F.col("name")).alias("n"))
    assert [tuple(r) for r in rows.collect()] == cases


def test_profiles_of_users_roles_and_unknown_principals(spark):
    ctx = context(
        spark,
        principals=[("role", "admin"), ("role", "wild"), ("user", "alice"), ("role", "scoped")],
        attached=[("role", "admin", "AdministratorAccess"), ("user", "alice", "AmazonS3ReadOnlyAccess"), ("user", "alice", "AmazonS3ReadOnlyAccess")],
        inline=[("role", "wild", "w", _doc(_allow("*"))), ("role", "scoped", "s", _doc(_allow("s3:GetObject", "arn:b")))],
        groups=[("alice", "devs"), ("scoped", "not a user")],
    )
    profiled = profiles(ctx.principals, ctx.attached, ctx.inline, ctx.groups)
    found = findings(
        spark,
        dict(finding_id="1", user_name="admin"), dict(finding_id="2", user_name="wild", user_type="Root"),
        dict(finding_id="3", user_name="alice", user_type="iamUSER"), dict(finding_id="4", user_name="scoped"),
        dict(finding_id="5", user_name="ghost"), dict(finding_id="6", user_name=None), dict(finding_id="7", user_name="alice", user_type=None),
    )
    got = {r.finding_id: (r.blast_radius, r.attached_policies, r.groups) for r in with_profile(found, profiled).collect()}
    assert got == {
        "1": ("CRITICAL", ["AdministratorAccess"], []), "2": ("CRITICAL", [], []), "3": ("MEDIUM", ["AmazonS3ReadOnlyAccess"], ["devs"]),
        "4": ("LOW", [], []), "5": ("UNKNOWN", [], []), "6": ("UNKNOWN", [], []), "7": ("UNKNOWN", [], []),
    }
    radius = {r.user_name: r.blast_radius for r in blast_radius(ctx.principals, ctx.attached, ctx.inline).collect()}
    assert radius == {"admin": "CRITICAL", "wild": "CRITICAL", "alice": "MEDIUM", "scoped": "LOW"}


def test_related_leaves_itself_out_and_needs_detector_and_principal(spark):
    history = findings(spark, dict(finding_id="cur"), dict(finding_id="other-1"), dict(finding_id="other-2"), dict(finding_id="other-2"), dict(finding_id="else", principal_id="P2"))
    asking = findings(
        spark,
        dict(finding_id="cur"), dict(finding_id="new"), dict(finding_id="no-detector", detector_id=None),
        dict(finding_id="no-principal", principal_id=None), dict(finding_id="lonely", principal_id="P3"),
    )
    got = {r.finding_id: (r.related_count, sorted(s.id for s in r.related_summaries)) for r in with_related(asking, history).collect()}
    assert got == {
        "cur": (2, ["other-1", "other-2"]), "new": (3, ["cur", "other-1", "other-2"]), "no-detector": (0, []), "no-principal": (0, []), "lonely": (0, []),
    }


def test_related_summaries_are_the_newest_and_the_count_is_whole(spark):
    rows = [dict(finding_id=f"f{i:03d}", center_time=at(i)) for i in range(300)]
    related = with_related(findings(spark, *rows), max_summaries=3)
    got = {r.finding_id: (r.related_count, [s.id for s in r.related_summaries]) for r in related.collect()}
    # The top list is cut before its shuffle, so a busy principal sends no more than a few rows per task.
    assert "WindowGroupLimit" in plan_text(related)
    assert got["f299"] == (299, ["f298", "f297", "f296"])
    assert got["f000"] == (299, ["f299", "f298", "f297"])
    assert len(got) == 300


def test_lookup_join_is_whole_with_heavy_and_null_keys(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 != 0, "hot").when(F.col("id") % 20 == 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    unique = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k STRING, v INT")
    plain = sorted(map(tuple, rows.join(unique, "k", "left").select("id", "k", "v").collect()), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(rows, unique, ["k"], "id").select("id", "k", "v")
        found = sorted(map(tuple, joined.collect()), key=str)
        # Rows without a key are dealt out by a part that is a key of the join.
        assert "hashpartitioning(k" in plan_text(joined) and "_part" in plan_text(joined).split("hashpartitioning(", 1)[1][:60]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == plain


def test_rescore_table(spark):
    # The first eight are cases that any implementation must give.
    cases = [
        (8.0, "HIGH", 0, "MEDIUM", "HIGH"), (2.0, "CRITICAL", 0, "LOW", "CRITICAL"), (3.0, "LOW", 0, "LOW", "LOW"), (5.0, "LOW", 2, "LOW", "HIGH"),
        (9.0, "MEDIUM", 5, "HIGH", "CRITICAL"), (3.0, "LOW", 0, "HIGH", "HIGH"), (7.0, "HIGH", 0, "LOW", "HIGH"), (0.0, "unknown", 0, "???", "LOW"),
        (None, "critical", None, None, "CRITICAL"), (7.0, "LOW", 1, "LOW", "HIGH"), (1.0, "LOW", 1, "LOW", "MEDIUM"), (3.0, "CRITICAL", 9, "CRITICAL", "CRITICAL"),
    ]
    rows = spark.createDataFrame(cases, "s DOUBLE, b STRING, r INT, m STRING, expected STRING")
    got = rows.select("expected", bands.rescore(F.col("s"), F.col("b"), F.col("r"), F.col("m")).alias("got")).collect()
    assert [r.got for r in got] == [r.expected for r in got]
