"""Correlation rules: windows, issuances, whitelists, dedup."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from attestry.operators import correlate as C
from attestry.operators import issuance as J
from attestry.operators import scans as S
from attestry.operators.joins import last_before
from attestry.plans.reconcile import Settings, reconcile
from attestry_queries import access
from attestry_queries.fixtures import Inputs

UTC = Settings(zone="UTC")
SF = "/root/testdata/sf0.001"


def obj(i, at, user="a@example.com", name="GetObject", bucket="b", **more):
    return {"ord": i, "eventTime": at, "eventName": name, "eventSource": "s3.amazonaws.com", "reqBucketName": bucket,
            "reqObjectKey": f"k{i}", "principalId": f"AROA:{user}" if user else "AROA", "local_date": "2024-01-10", **more}


def ask(i, at, minutes, user="a@example.com", day="2024-01-10"):
    return {"request_id": str(i), "timestamp": at, "local_date": day, "user_email": user, "jira_issue_id": f"P-{i}",
            "justification": "j", "duration_minutes": minutes}


REQ = "request_id string, timestamp string, local_date string, user_email string, jira_issue_id string, justification string, duration_minutes int"


def run(table, objects, requests, settings=UTC, curated=None, tags=None):
    names = list(dict.fromkeys(k for o in objects for k in o))
    schema = ", ".join(f"{n} {'bigint' if n == 'ord' else 'string'}" for n in names)
    df = reconcile(table(objects, schema), curated, table(requests, REQ), tags, settings)
    return {r.ord: r for r in df.collect()}


def test_window_bounds_are_inclusive(table):
    got = run(table, [obj(1, "2024-01-10 09:59:59"), obj(2, "2024-01-10 10:00:00"), obj(3, "2024-01-10 10:30:00"), obj(4, "2024-01-10 10:30:01")],
              [ask(1, "2024-01-10T10:00:00Z", 30)])
    assert sorted(got) == [1, 4]
    assert {r.type for r in got.values()} == {"ACCESS_OUTSIDE_WINDOW"} and got[1].severity == "MEDIUM"
    assert got[1].matched_request.jira_issue_id == "P-1" and got[1].matched_request.duration_minutes == 30


def test_windows_over_hour_marks(table):
    events = [obj(i, f"2024-01-10 {h:02d}:{m:02d}:00") for i, (h, m) in enumerate([(9, 50), (10, 0), (11, 30), (12, 50), (12, 51)])]
    got = run(table, events, [ask(1, "2024-01-10T09:50:00Z", 180)])
    assert sorted(got) == [4]


def test_null_duration_covers_its_second(table):
    got = run(table, [obj(1, "2024-01-10 10:00:00"), obj(2, "2024-01-10 10:00:01")], [ask(1, "2024-01-10T10:00:00Z", None)])
    assert sorted(got) == [2]


def test_day_scope_and_carry_over(table):
    events = [obj(1, "2024-01-10 23:55:00"), obj(2, "2024-01-11 00:20:00")]
    asked = [ask(1, "2024-01-10T23:50:00Z", 60)]
    got = run(table, events, asked)
    assert sorted(got) == [2] and got[2].type == "UNAUTHORIZED_ACCESS" and got[2].severity == "HIGH"
    assert run(table, events, asked, replace(UTC, carry_over=True)) == {}


def test_unreadable_times(table):
    events = [obj(1, "garbage"), obj(2, "garbage", user="b@example.com"), obj(3, "2024-01-10T10:00:00")]
    got = run(table, events, [ask(1, "2024-01-10T10:00:00Z", 30)])
    assert sorted(got) == [2] and got[2].type == "UNAUTHORIZED_ACCESS"
    # a request without a readable time still counts as a request
    got = run(table, [obj(1, "2024-01-10 10:00:00")], [ask(1, "soon", 30)])
    assert got[1].type == "ACCESS_OUTSIDE_WINDOW"


def test_latest_request_is_shown(table):
    got = run(table, [obj(1, "2024-01-10 20:00:00")],
              [ask(1, "2024-01-10T08:00:00Z", 15), ask(3, "2024-01-10T12:00:00Z", 15), ask(2, "2024-01-10T12:00:00Z", 15)])
    assert got[1].matched_request.jira_issue_id == "P-2"


def test_dedup_ignores_key_and_unknown_actor(table):
    events = [obj(3, "2024-01-10 10:00:00", user=None), obj(1, "2024-01-10 10:00:00", user=None, userAgent="first"),
              obj(2, "2024-01-10 10:00:00", user=None, name="PutObject")]
    got = run(table, events, [])
    assert sorted(got) == [1, 2] and got[1].evidence.user_agent == "first" and got[1].user_id is None


def test_chat_name_matches_no_email(table):
    got = run(table, [obj(1, "2024-01-10 10:00:00")], [ask(1, "2024-01-10T10:00:00Z", 30, user="a")])
    assert got[1].type == "UNAUTHORIZED_ACCESS"


def test_whitelists(table):
    events = [
        obj(1, "2024-01-10 10:00:01", user=None, sourceIpAddress="athena.amazonaws.com"),
        obj(2, "2024-01-10 10:00:02", user=None, sourceIpAddress="glue.amazonaws.com"),
        obj(3, "2024-01-10 10:00:03", user="k8s-irsa-Job"),
        obj(4, "2024-01-10 10:00:04", user=None, sessionIssuerUserName="App-prod"),
        obj(5, "2024-01-10 10:00:05", user=None, userName=" Bot ", userIdentityType="IAMUser"),
        obj(6, "2024-01-10 10:00:06", user=None, userAgent=" Config.amazonaws.com"),
        obj(7, "2024-01-10 10:00:07", user="a@example.com"),
    ]
    actors = {"AWS_SERVICE": ["athena.amazonaws.com", "config.amazonaws.com"], "SERVICE_PRINCIPAL": ["k8s-irsa-job", "app-prod"],
              "SERVICE_ACCOUNT": ["bot"], "HUMAN": ["a@example.com"], "UNKNOWN": ["aroa"]}
    assert sorted(run(table, events, [], replace(UTC, actors=actors))) == [2, 7]


CUR = "ord bigint, local_date string, eventTime string, eventName string, db_username string, database string, auth_display_name string, lease_id string, path string, sourceIpAddress string, userAgent string"


def cur(i, at, name, user, **more):
    return {"ord": i, "local_date": at[:10], "eventTime": at, "eventName": name, "db_username": user, **more}


def sessions(table):
    return table([
        cur(1, "2024-01-10 08:00:00", "VaultCredsIssued", "V-U1", auth_display_name="oidc-first@example.com", lease_id="l1"),
        cur(2, "2024-01-10 12:00:00", "VaultCredsIssued", "v-u1 ", auth_display_name="v-oidc-second@example.com"),
        cur(3, "2024-01-10 07:00:00", "DbSessionConnect", "v-u1", database="d"),
        cur(4, "2024-01-10 13:00:00", "DbSessionDisconnect", "v-u1", database="d", lease_id="own"),
        cur(5, "2024-01-12 13:00:00", "DbSessionConnect", "v-u1", database="d"),
    ], CUR)


@pytest.mark.parametrize("mode, want", [
    ("earliest", {3: ("first@example.com", "l1"), 4: ("first@example.com", "own"), 5: (None, None)}),
    ("latest", {3: ("second@example.com", None), 4: ("second@example.com", "own"), 5: (None, None)}),
    ("asof", {3: (None, None), 4: ("second@example.com", "own"), 5: ("second@example.com", None)}),
])
def test_issuance_modes(table, mode, want):
    got = {r.ord: (r.human_id, r.lease_id) for r in J.enrich_sessions(sessions(table), mode).where("eventName <> 'VaultCredsIssued'").collect()}
    assert got == want


def test_issuances_are_no_violations_and_db_users_pass(table):
    got = run(table, [obj(9, "2024-01-10 10:00:00")], [], UTC, sessions(table))
    assert sorted(got) == [3, 4, 5, 9] and got[3].user_id == "first@example.com" and got[3].resource_arn == "db:d"
    assert got[3].resource_details.db_name == "d" and got[3].evidence.db_username == "v-u1"
    assert sorted(run(table, [obj(9, "2024-01-10 10:00:00")], [], replace(UTC, db_users=["v-u1"]), sessions(table))) == [9]


def test_asof_against_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", None]), rnd.randrange(0, 40000)) for i in range(400)]
    facts = [(i, rnd.choice(["hot", "b"]), rnd.randrange(0, 40000), f"p{i}") for i in range(60)]
    left = spark.createDataFrame(rows, "ord bigint, k string, s bigint").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame(facts, "ord bigint, k string, s bigint, p string").withColumn("t", F.timestamp_seconds("s"))
    got = {r.ord: r.p for r in last_before(left, right, "k", "t", ["p"], ["ord"]).collect()}
    want = {}
    for o, k, s in rows:
        earlier = [(fs, fo, p) for fo, fk, fs, p in facts if fk == k and fs <= s]
        want[o] = max(earlier)[2] if earlier else None
    assert got == want


def test_scan_predicates(spark):
    df = spark.createDataFrame([("b_1", "a_x/1"), ("b_1", "abx/1"), ("b2", "z"), ("b3", None)], "reqBucketName string, reqObjectKey string")
    test = S.monitored_object(["arn:aws:s3:::b2/ignored"], ["b_1/a_x", " ", 'b3 '])
    assert df.where(test).count() == 4
    assert df.where(S.monitored_object([], ["b_1/a%y"])).count() == 0
    assert S.monitored_object() is None and S.source_actor_filter({}) is None


def test_minimum_slice_counts(spark):
    """Object events only, no owner tags, no whitelists: the agreed answer at sf0.001."""
    t = Inputs(spark, SF)
    plain = t["fx_events"].where("event_source is not null").select(
        F.col("event_id").alias("ord"), "local_date", F.col("event_time").alias("eventTime"), F.col("event_name").alias("eventName"),
        F.lit("s3.amazonaws.com").alias("eventSource"), F.col("req_bucket").alias("reqBucketName"), F.col("req_key").alias("reqObjectKey"),
        F.col("principal_id").alias("principalId"), F.col("identity_type").alias("userIdentityType"), F.col("source_ip").alias("sourceIpAddress"))
    df = reconcile(plain, None, access.requests(t), None, UTC)
    got = {(r.type, r.human): r.n for r in df.groupBy("type", (F.col("actor_type") == "HUMAN").alias("human")).agg(F.count("*").alias("n")).collect()}
    assert got == {("ACCESS_OUTSIDE_WINDOW", True): 44, ("UNAUTHORIZED_ACCESS", True): 153, ("UNAUTHORIZED_ACCESS", False): 197}


def test_row_order_does_not_matter(spark):
    t = Inputs(spark, SF)
    base = {tuple(r) for r in access.flat_violations(access.violations(t)).collect()}
    shuffled = reconcile(access.named_objects(t).repartition(7).orderBy(F.rand(3)), access.curated(t).orderBy(F.rand(4)),
                         access.requests(t).orderBy(F.rand(5)), t["fx_owner_tags"], access.SETTINGS)
    assert {tuple(r) for r in access.flat_violations(shuffled).collect()} == base


def test_days_together_equal_days_alone(spark):
    t = Inputs(spark, SF)
    objects, curated, requests, tags = access.named_objects(t).cache(), access.curated(t).cache(), access.requests(t).cache(), t["fx_owner_tags"].cache()
    whole = {tuple(r) for r in access.flat_violations(access.violations(t)).where("local_date in ('2024-01-02','2024-01-03')").collect()}
    alone = set()
    for day in ("2024-01-02", "2024-01-03"):
        one = reconcile(*[d.where(F.col("local_date") == day) for d in (objects, curated, requests)], tags, access.SETTINGS)
        alone |= {tuple(r) for r in access.flat_violations(one).collect()}
    assert alone == whole


def test_plans(spark):
    t = Inputs(spark, SF)
    df = access.flat_violations(access.violations(t))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scan = S.scan_object_events(access.raw_objects(t), "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("ord")
    assert "PushedFilters" in scan._jdf.queryExecution().executedPlan().toString()


def test_identifiers(table):
    rows = C.requests_by_identifier(table([{"request_id": "1", "user_id": "U1 ", "user_email": "u1", "user_name": ""}]))
    assert [r.ident for r in rows.collect()] == ["u1"]
