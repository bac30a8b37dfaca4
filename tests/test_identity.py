"""Identities, times and small text functions against hand-written cases."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from attestry.functions import config, hashing, identity, resources, text, times
from attestry.operators import correlate as C


def conformed(table, rows):
    return C.conform(table([{"ord": i, **r} for i, r in enumerate(rows)]), "UTC").orderBy("ord")


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_derived_identifier(table):
    df = conformed(table, [
        {"user_email": "User@Example.com "},
        {"sessionIssuerUserName": "user@example.com"},
        {"principalId": "service-account"},
        {"principalId": "AROAX:Some.One@example.com"},
        {"principalId": "AROAX:k8s-job"},
        {"principalId": "a:b:C"},
        {"user_email": "no email", "principalId": "x"},
        {"eventName": "none"},
    ])
    assert values(df, identity.raw_identifier()) == [
        "user@example.com", "user@example.com", "service-account", "some.one@example.com", "k8s-job", "c", "x", None]


def test_nested_identity(spark):
    rows = [(1, ("a@example.com", None, None, None)), (2, (None, None, "arn:aws:sts::1:assumed-role/R/b@example.com", None)),
            (3, ("plain", None, None, None)), (4, (None, "AROA:sess", None, None))]
    df = spark.createDataFrame(rows, "ord bigint, userIdentity struct<userName string, principalId string, arn string, type string>")
    df = C.conform(df, "UTC").orderBy("ord").withColumns({"raw_user_id": identity.raw_identifier(), "owner_email": F.lit(None).cast("string")})
    assert values(df, "raw_user_id") == ["a@example.com", "b@example.com", "plain", "sess"]
    assert values(df, identity.resolved_email()) == ["a@example.com", "b@example.com", None, None]


def test_actor_types(table):
    df = conformed(table, [
        {"sourceIpAddress": "s3.amazonaws.com"}, {"userAgent": "athena.amazonaws.com"},
        {"principalId": "AROA:k8s-irsa-x"}, {"principalId": "k8s-irsa-x"}, {"sessionIssuerUserName": "app-prod"},
        {"userIdentityType": "IAMUser"}, {"principalId": "AROA:K8S-IRSA-x"}, {},
    ])
    assert values(df, identity.actor_type()) == [
        "AWS_SERVICE", "AWS_SERVICE", "SERVICE_PRINCIPAL", "UNKNOWN", "SERVICE_PRINCIPAL", "SERVICE_ACCOUNT", "UNKNOWN", "UNKNOWN"]
    assert set(values(df, identity.actor_type(F.lit("a@b.co")))) == {"HUMAN"}


def test_login_prefix_and_owner_tags(table):
    df = table([{"s": "v-oidc-user3@example.com"}, {"s": "oidc-a@b.co"}, {"s": "oidc-oidc-a@b.co"}, {"s": "none"}])
    assert values(df, identity.strip_login_prefix("s")) == ["user3@example.com", "a@b.co", "oidc-a@b.co", "none"]
    events = conformed(table, [
        {"userIdentityArn": "arn:aws:iam::1:user/jdoe"}, {"userIdentityArn": "arn:aws:iam::1:user/nobody"},
        {"userIdentityArn": "arn:aws:sts::1:user/jdoe"}, {"userIdentityArn": ""}, {"auth_display_name": "v-oidc-foo@bar.com"}])
    tags = table([{"user_name": "jdoe", "tag_key": "owner", "tag_value": "User2@example.com"},
                  {"user_name": "nobody", "tag_key": "owner", "tag_value": "a team"}])
    got = C.resolve_actors(events, tags).orderBy("ord")
    assert values(got, "user_id") == ["user2@example.com", None, None, None, "foo@bar.com"]


def test_resources(table):
    df = conformed(table, [
        {"eventSource": "s3.amazonaws.com", "resourceArn": "arn:aws:s3:::test-bucket/test-key", "eventName": "GetObject"},
        {"eventSource": "s3.amazonaws.com", "reqBucketName": " b ", "reqObjectKey": ""},
        {"eventName": "DbSessionConnect", "database": "d1"},
        {"eventName": "DbSessionConnect", "resourceArn": "db:d2"},
        {"eventSource": "s3.amazonaws.com"},
    ])
    assert values(df, resources.resource_arn()) == ["arn:aws:s3:::test-bucket", "arn:aws:s3:::b", None, "db:d2", None]
    assert values(df, resources.resource_arn(databases=["arn:one"]))[2:4] == ["arn:one", "arn:one"]
    assert values(df, resources.resource_arn({"d2": "arn:two"}))[3] == "arn:two"
    d = [r[0].asDict() for r in df.select(resources.resource_details()).collect()]
    assert d[0] == {"db_name": None, "s3_bucket": "test-bucket", "s3_key": "test-key", "operation": "GetObject"}
    assert d[1]["s3_bucket"] == "b" and d[1]["s3_key"] is None
    assert d[3]["db_name"] == "d2"


def test_parse_time(table):
    df = table([{"s": s} for s in (
        "2025-09-08 14:02:34.000", "2025-09-08T14:02:34.5Z", "2025-09-08T14:02:34", "2025-09-08T14:02:34+00:00", "", "x", " 2025-09-08 14:02:34 ")])
    base = int(dt.datetime(2025, 9, 8, 14, 2, 34, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert values(df, F.unix_millis(times.parse_time("s"))) == [base, base + 500, None, None, None, None, base]


def test_normalize_time(table):
    later = F.lit("2030-01-01 00:00:00").cast("timestamp")
    cases = {
        "2024-01-01T00:00:00.123Z": "2024-01-01T00:00:00Z", "2024-01-01T05:00:00+02:00": "2024-01-01T05:00:00Z",
        "2024-01-01 05:00:00.25": "2024-01-01T05:00:00Z", "2024-01-01": "2024-01-01T00:00:00Z", "nope": "2030-01-01T00:00:00Z", "": "2030-01-01T00:00:00Z"}
    df = table([{"s": s} for s in cases])
    assert values(df, times.normalize_time("s", later)) == list(cases.values())
    moved = values(df, times.normalize_time("s", later, apply_offset=True))
    assert moved[1] == "2024-01-01T03:00:00Z"


def test_windows_and_rendering(spark):
    now = dt.datetime(2024, 3, 31, 12, 0, tzinfo=dt.timezone.utc)
    lo, hi = times.reconciliation_window(dt.datetime(2024, 4, 1, 12, tzinfo=dt.timezone.utc))
    assert (hi - lo).total_seconds() == pytest.approx(23 * 3600, abs=1)  # the clock change day
    assert times.reconciliation_window(now, period="today")[0] == dt.datetime(2024, 3, 30, 23, tzinfo=dt.timezone.utc)
    assert times.reconciliation_window(now, start="2024-01-01T00:00:00Z", end="2024-01-02T00:00:00Z")[0].day == 1
    assert times.scan_literals(lo, hi)[1] == "2024-03-31 21:59:59"
    row = spark.sql("select timestamp'2024-07-01 10:00:00' ts, '2024-01-01T01:00:00+01:00' a, 'x' b")
    assert row.select(times.local_iso("ts", "Europe/Berlin")).first()[0] == "2024-07-01T12:00:00+02:00"
    assert row.select(times.title_range("a", "a")).first()[0] == "2024-01-01T01:00 - 2024-01-01T01:00"
    assert row.select(times.title_range("a", "b")).first()[0] == "2024-01-01T01:00:00+01:00"


def test_pseudonym_matches_uuid5(table):
    words = ["a", "oidc-user@example.com", "Söhne", "", None]
    got = values(table([{"i": i, "s": w} for i, w in enumerate(words)]).orderBy("i"), hashing.pseudonym("s"))
    assert got == [f"uuid5:{uuid.uuid5(uuid.NAMESPACE_OID, w).hex}" if w else w for w in words]


def test_file_names(table):
    df = table([{"s": s} for s in ("My Report (1).pdf", "dir/.hidden", "Größe_1 .tar.gz", "plain")])
    assert values(df, text.safe_filename(text.file_stem("s"))) == ["my-report--1-", "-hidden", "größe_1-.tar".replace(".", "-"), "plain"]
    assert values(df, text.file_suffix("s")) == [".pdf", "", ".gz", ""]


def test_config(spark, table):
    assert config.actor_whitelist('{"A": [" X "], "B": 3}') == {"A": ["x"]}
    for bad in (lambda: config.actor_whitelist("[]"), lambda: config.user_whitelist("{}")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="invalid flag"):
        table([{"s": "maybe"}]).select(config.flag("s")).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        table([{"s": "15,x"}]).select(config.allowed_minutes("s")).collect()
    assert values(table([{"s": "60,15,,15"}]), config.allowed_minutes("s")) == [[15, 60]]
    assert values(table([{"s": '[" A ","b"]'}]), config.whitelist_entries("s")) == [["a", "b"]]


def test_body_limit(spark):
    df = spark.sql("select repeat('x', 32000) a, repeat('x', 33000) b")
    a, b = df.select(text.clip_body("a"), text.clip_body("b")).first()
    assert len(a) == 32000 and a == "x" * 32000
    assert len(b) <= 32000 and b.startswith("x" * 31800) and "truncated" in b
