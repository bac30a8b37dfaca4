"""Log parsing, deliveries and request capture."""

import base64
import gzip
import json

from pyspark.sql import functions as F

from attestry.operators import logs as L
from attestry.operators import requests as Q
from attestry.sources import deliveries as D
from attestry.sources import sinks

def later():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


def parsed(table, messages):
    df = table([{"ord": i, "message": m} for i, m in enumerate(messages)]).withColumn("ingest_ts", later())
    return {r.ord: r for r in L.parse_lines(df).collect()}


def test_db_lines(table):
    got = parsed(table, [
        "2025-08-29 07:45:01 UTC:10.0.0.1(45986):u@d:[3464]:LOG:  connection authorized: user=u database=d SSL",
        '2025-08-29 07:45:01 UTC:10.0.0.1(45986):u2@d2:[3464]:LOG:  connection authenticated: identity="CN=x" (pg_hba.conf:1) method=cert',
        "2025-08-29 07:45:01 UTC:::[1]:LOG:  disconnection: session time: 1:02:03 user=u database=d host=x",
        "2025-08-29 07:45:01 UTC:::[1]:LOG:  disconnection: session time: 0:00:03.5 user=u database=d",
        "connection authorized: user=u database=d",
        "connection authenticated: identity=x method=md5",
        "hello", "",
    ])
    assert sorted(got) == [0, 1, 2, 4]
    assert (got[0].type, got[0].db_username, got[0].database, got[0].eventTime) == ("DbSessionConnect", "u", "d", "2025-08-29T07:45:01Z")
    assert (got[1].db_username, got[1].database, got[1].auth_identity, got[1].auth_method) == ("u2", "d2", "CN=x", "cert")
    assert (got[2].session_duration_seconds, got[2].computed_connect_time) == (3723, "2025-08-29T06:42:58Z")
    assert got[4].eventTime == "2030-01-01T00:00:00Z"


def cred(path="database/creds/prod-ro", **more):
    return json.dumps({"request": {"path": path, "remote_address": "1.2.3.4", "headers": {"user-agent": ["cli"]}}, "auth": {"display_name": "oidc-a@b.co"}, **more})


def test_credential_lines(table):
    got = parsed(table, [
        cred(time="2024-01-01T00:00:00Z", response={"data": {"username": "v-a"}, "secret": {"lease_id": "l"}, "lease_duration": 60}, request_id="r"),
        cred(), cred(response={}), cred(path="database/creds/dev-ro"), cred(response={"data": {}}), cred(path="other"), "{broken",
        cred(response={"data": {"user": "v-b"}}, **{"@timestamp": "t2"}),
    ])
    assert sorted(got) == [0, 1, 2, 7]
    a = got[0]
    assert (a.type, a.username, a.lease_id, a.lease_ttl_s, a.request_id, a.remote_address, a.user_agent) == ("VaultCredsIssued", "v-a", "l", "60", "r", "1.2.3.4", "cli")
    assert got[1].type == got[2].type == "VaultCredsRequest" and got[1].username is None and len(got[1].request_id) == 64
    assert got[7].username == "v-b" and got[7].eventTime == "t2"


def test_dedup_and_sink_records(table, spark):
    line = "2025-08-29 07:45:01 UTC::u@d:[1]:LOG:  connection authorized: user=u database={}"
    df = table([{"ord": i, "delivery": i // 2, "message": m} for i, m in enumerate([line.format("d"), line.format("d"), line.format("e"), line.format("d")])])
    df = df.withColumn("ingest_ts", later())
    assert sorted(r.ord for r in L.ingest(df).collect()) == [0, 2]
    assert sorted(r.ord for r in L.ingest(df, scope=["delivery"]).collect()) == [0, 2, 3]
    assert sorted(r.ord for r in L.ingest(df, " e ").collect()) == [2]
    rec = L.sink_records(L.ingest(df, "d"), "arn:aws:x:r:42:channel/c").first()
    assert rec.eventData.recipientAccountId == "42" and rec.eventData.userIdentity.principalId == "u"
    assert rec.eventData.additionalEventData["database"] == "d" and "path" not in rec.eventData.additionalEventData
    assert L.sink_records(L.ingest(df, "d"), "arn:aws:x:r").first().eventData.recipientAccountId is None
    chunks = sinks.with_chunks(spark.range(0, 1001, 1, 3).toDF("n")).groupBy("chunk").count().collect()
    assert max(c["count"] for c in chunks) <= 100 and sum(c["count"] for c in chunks) == 1001


def test_deliveries(table):
    body = {"logGroup": "g", "logEvents": [{"id": "1", "timestamp": 5, "message": "a"}, {"id": "2", "timestamp": 6}]}
    pack = lambda b: base64.b64encode(b).decode()
    raw = json.dumps(body).encode()
    df = table([{"n": 1, "data": pack(gzip.compress(raw))}, {"n": 2, "data": pack(raw)}, {"n": 3, "data": ""}, {"n": 4}], "n bigint, data string")
    got = D.decode_deliveries(df).orderBy("n", "line_no").collect()
    assert [(r.n, r.message) for r in got] == [(1, "a"), (1, ""), (2, "a"), (2, "")]


def test_result_rows_last_cell_wins(spark):
    df = spark.createDataFrame([(1, [[{"a": "1"}, {"b": "2"}, {"a": "3"}], [{"b": "4"}]])], "page int, rows array<array<map<string,string>>>")
    got = D.flatten_result_rows(df, ["a", "b"]).orderBy("row_no").collect()
    assert [(r.a, r.b) for r in got] == [("3", "2"), (None, "4")]


def test_submissions(table):
    rows = [
        {"body": "user_id=U1&user_name=n&text=PROJ-999+need+prod+access%3B30"},
        {"body": base64.b64encode(b"text=&text=PROJ-1+x%3B15%3B2&text=later").decode(), "is_base64": True},
        {"body": "%%%", "is_base64": True}, {"body": None}, {"body": "text=PROJ-1%20why;+60+"}, {"body": "text=bad%zz;30"},
    ]
    df = table([{"n": i, "is_base64": False, **r} for i, r in enumerate(rows)], "n bigint, body string, is_base64 boolean")
    got = {r.n: r for r in Q.validate(Q.parse_command(Q.parse_submissions(df)), [15, 30, 60]).collect()}
    assert (got[0].user_id, got[0].jira_issue_id, got[0].justification, got[0].duration_minutes, got[0].error) == ("U1", "PROJ-999", "need prod access", 30, None)
    assert got[1].text == "PROJ-1 x;15;2" and got[1].error.startswith("Invalid Jira ID")
    assert got[2].user_id == "unknown" and got[3].text == ""
    assert (got[4].jira_issue_id, got[4].duration_minutes, got[4].error) == ("PROJ-1", 60, None)
    assert got[5].text == "bad%zz;30"


def test_dialog(table):
    value = lambda v: {"value": v}
    view = {"type": "view_submission", "user": {"id": "U", "name": "n"}, "view": {"callback_id": "access_request", "state": {"values": {
        "jira": {"jira_key": value("ENG-1\n")}, "just": {"justification": value(None)}, "duration": {"duration_select": {"selected_option": value("999")}}}}}}
    from urllib.parse import urlencode
    df = table([{"body": urlencode({"payload": json.dumps(view)}), "is_base64": False}, {"body": "payload=%7B%7D", "is_base64": False}])
    got = Q.validate(Q.parse_dialog(df), [15, 30], every_error=True).collect()
    assert len(got) == 1 and got[0].user_name == "n"
    assert got[0].errors == ["Justification required", "Duration must be one of: [15, 30]"]


def test_request_rows(table):
    df = table([{"received_epoch": 1704063600, "user_id": "U", "user_name": "n", "jira_issue_id": "A1-1", "justification": "j", "duration_minutes": 30}])
    r = Q.request_rows(df, "Europe/Berlin", 1).first()
    assert (r.timestamp, r.local_date, r.expiry_timestamp, r.user_email) == ("2023-12-31T23:00:00Z", "2024-01-01", "2023-12-31T23:30:00Z", "n")
    assert r.ttl == 1704063600 + 365 * 86400


def test_replay(table):
    df = table([{"received_epoch": 1000, "sent_epoch": s} for s in (700, 699, 1300, 1301)])
    assert sorted(r.sent_epoch for r in Q.fresh(df).collect()) == [700, 1300]


def test_observed_counts(table):
    from pyspark.sql import Observation

    df = table([{"ord": 1, "message": "connection authorized: user=u database=d"}, {"ord": 2, "message": "x"}]).withColumn("ingest_ts", later())
    df = L.with_credential_event(L.with_db_event(df, "ingest_ts"), "ingest_ts")
    seen = Observation("ingest")
    L.ingest_counters(df, seen).collect()
    assert seen.get == {"parsed_messages": 2, "emitted_events": 1}
