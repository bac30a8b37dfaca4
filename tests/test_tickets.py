"""Report groups and ticket texts at their limits."""

import base64
import json

from pyspark.sql import functions as F

from attestry.operators import report as R
from attestry.operators import tickets as K
from attestry.sources import sinks

PERIOD = {"start": "2024-01-01T00:00:00+00:00", "end": "2024-01-02T00:00:00+00:00", "start_local": "2024-01-01T01:00:00+01:00", "end_local": "2024-01-02T01:00:00+01:00"}
SCHEMA = """ord bigint, src_rank int, local_date string, type string, severity string, user_id string, actor_type string, resource_arn string,
event_time string, event_name string, description string, resource_details struct<db_name string, s3_bucket string, s3_key string, operation string>,
evidence struct<user_email string, principal_id string, session_issuer string, iam_user string, user_identity_type string, user_identity_arn string, db_username string,
db_auth_method string, db_auth_identity string, vault_auth_name string, vault_lease_id string, s3_request_id string, s3_error_code string, s3_error_message string,
source_ip string, user_agent string, aws_region string, access_key_id string, event_id string, recipient_account_id string>,
matched_request struct<jira_issue_id string, justification string, request_timestamp string, duration_minutes int>"""


def violation(i, user="a@example.com", actor="HUMAN", arn="arn:aws:s3:::b", request=None, kind=None, details=(None, "b", "k", "GetObject")):
    kind = kind or ("ACCESS_OUTSIDE_WINDOW" if request else "UNAUTHORIZED_ACCESS")
    return (i, 0, "2024-01-01", kind, "HIGH", user, actor, arn, f"2024-01-01 10:{i // 60:02d}:{i % 60:02d}", "GetObject", f"d{i}",
            details, (user,) + (None,) * 19, request)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def make(spark, rows, **kw):
    got = K.tickets(frame(spark, rows), PERIOD, "run", "SEC", "Task", ["audit", "violation"], **kw).collect()
    return {r.assignee: r for r in got}


def content(ticket):
    return json.loads(base64.b64decode(ticket.attachments[0].content))


def test_table_limit(spark):
    rows = [violation(i) for i in range(25)] + [violation(100 + i, "b@example.com") for i in range(20)]
    got = make(spark, rows)
    a, b = got["a@example.com"].description, got["b@example.com"].description
    assert a.count("**<Provide your justification here>**") == 20 and "5 additional violations" in a
    assert b.count("**<Provide your justification here>**") == 20 and "additional violations" not in b
    assert a.index("10:00 ") and "| 2024-01-01 10:00 | GetObject | arn:aws:s3:::b | Bucket: b, Key: k, Operation: GetObject |" in a
    full = content(got["a@example.com"])
    assert full["violations_count"] == 25 and [v["description"] for v in full["violations"]][:2] == ["d24", "d23"]
    assert got["a@example.com"].attachments[0].filename == "violations_a_at_example.com.json"
    assert got["a@example.com"].summary == "Customer data access violation - a@example.com - 2024-01-01T01:00 - 2024-01-02T01:00"
    assert list(got["a@example.com"].labels) == ["audit", "violation"]


def test_requests_once_and_long_bodies(spark):
    rows = [violation(i, request=("P-1", "j" * 40, f"t{i % 3}", 15)) for i in range(6)]
    rows += [violation(100 + i, "long@example.com", request=(f"P-{i}", "j" * 200, f"t{i}", 15)) for i in range(400)]
    got = make(spark, rows)
    short, long = got["a@example.com"].description, got["long@example.com"].description
    assert short.count("#### Request ") == 3 and "#### Request 1:\n**Jira Issue ID:** P-1" in short
    assert "Request Timestamp:** t2" in short.split("#### Request 2")[0]
    assert len(long) <= 32000 and long.endswith("Full details available in attachment.**")


def test_oversize_attachment_becomes_summary(spark):
    rows = [violation(i) for i in range(30)] + [violation(50, "b@example.com")]
    got = make(spark, rows, limit=4000)
    brief = content(got["a@example.com"])
    assert brief["violations_count"] == 30 and len(brief["violation_summary"]) == 10 and "too large" in brief["message"]
    assert brief["violation_summary"][0]["description"] == "d29"
    assert len(content(got["b@example.com"])["violations"]) == 1


def test_attachment_at_exact_limit(spark):
    rows = [violation(i) for i in range(3)]
    size = len(base64.b64decode(make(spark, rows)["a@example.com"].attachments[0].content))
    assert "violations" in content(make(spark, rows, limit=size)["a@example.com"])
    assert "violation_summary" in content(make(spark, rows, limit=size - 1)["a@example.com"])


def test_non_human_ticket_and_counts(spark):
    rows = [violation(1, None, "AWS_SERVICE"), violation(2, None, "UNKNOWN", "db:x", details=("x", None, None, None)), violation(3, None, "HUMAN"),
            violation(4, "a@example.com", arn="arn:aws:rds:r", kind="ACCESS_OUTSIDE_WINDOW"), violation(5, None, "UNKNOWN", "arn:other")]
    df = frame(spark, rows)
    t = make(spark, rows)[None]
    assert "* **Total Count:** 4" in t.description and "* **AWS_SERVICE:** 1" in t.description and t.attachments[0].filename == "non_human_violations.json"
    assert content(t)["by_category"] == {"SERVICE_PRINCIPAL": 0, "AWS_SERVICE": 1, "UNKNOWN": 2, "SERVICE_ACCOUNT": 0}
    r = R.non_human(df).first()
    assert r.total_count == 4 and r.aws_service + r.unknown + r.service_principal + r.service_account == 3
    assert R.by_category(df).first().asDict() == {"s3_unauthorized_access": 2, "s3_outside_window": 0, "db_unauthorized_access": 1, "db_outside_window": 1}
    assert K.tickets(df.where("false"), PERIOD, "run", "SEC", "Task", ["audit"]).count() == 0


def test_group_order_and_texts(spark):
    rows = [violation(i, u) for i, u in enumerate(["c@x.co", "b@x.co", "a@x.co", "c@x.co", "b@x.co"])]
    assert [(r.user_email, r.violations_count) for r in R.human_groups(frame(spark, rows)).collect()] == [("b@x.co", 2), ("c@x.co", 2), ("a@x.co", 1)]
    df = frame(spark, [violation(1, details=(None, None, None, None)), violation(2, details=("d", None, None, None)), violation(3, details=(None, "b", "N/A", None))])
    assert [r[0] for r in df.orderBy("ord").select(K.resource_text()).collect()] == ["N/A", "DB Name: d", "Bucket: b"]
    text = frame(spark, [violation(1, request=("P", None, "t", 5))]).select(K.violation_text("ord")).first()[0]
    assert text.startswith("#### Violation 1:\n* **Type:** ACCESS_OUTSIDE_WINDOW\n* **Severity:** HIGH")
    assert "\n\n##### Matched Request:\n* **Jira Issue ID:** P\n* **Justification:** None\n" in text
    assert "\n\n##### Evidence:\n* **User Email:** a@example.com" in text and "Session Issuer" not in text


def test_report_lines_and_formats(spark, tmp_path):
    df = frame(spark, [violation(1), violation(2, None, "UNKNOWN")])
    header = R.report_header(df, PERIOD, {"generated_at": "g", "execution_duration_seconds": "1.23456"})
    lines = R.report_lines(df, header).collect()
    assert sorted(r.section for r in lines) == ["header", "human", "non_human"]
    head = json.loads(next(r.json for r in lines if r.section == "header"))
    assert head["report_metadata"]["execution_duration_seconds"] == 1.235 and head["non_human_violations"]["total_count"] == 1
    for fmt in ("json", "csv", "xml"):
        sinks.write_report(df, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).option("header", True).option("rowTag", "violation").load(str(tmp_path / fmt))
        assert back.count() == 2
    log = json.loads(K.ticket_log(K.tickets(df, PERIOD, "run", "SEC", "Task", ["audit"]), PERIOD, {"generated_at": "g"}).where("record like '%Non-Human%'").first().record)
    assert log["attachments_count"] == 1 and log["time_period"]["start"] == PERIOD["start"]
