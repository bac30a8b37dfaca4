"""Registered queries: report counts and tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import report as R
from attestry.operators import tickets as K
from attestry.plans.nightly import stored
from attestry_queries import access as A
from attestry_queries.fixtures import Inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}
PERIOD = {"start": "2024-01-01T00:00:00+00:00", "end": "2024-01-30T23:59:59+00:00",
          "start_local": "2024-01-01T01:00:00+01:00", "end_local": "2024-01-31T00:59:59+01:00"}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


@query("a1_human_groups", f"WITH {A.MATCHED} SELECT email AS user_email, count(*) AS violations_count FROM violations WHERE email IS NOT NULL GROUP BY email")
def a1(t):
    return R.human_groups(A.violations(t))


@query("a2_non_human", f"""WITH {A.MATCHED} SELECT local_date, count(*) AS total_count, count(*) FILTER (actor_type = 'SERVICE_PRINCIPAL') AS service_principal,
  count(*) FILTER (actor_type = 'AWS_SERVICE') AS aws_service, count(*) FILTER (actor_type = 'UNKNOWN') AS unknown,
  count(*) FILTER (actor_type = 'SERVICE_ACCOUNT') AS service_account FROM violations WHERE email IS NULL GROUP BY local_date""")
def a2(t):
    return R.non_human(A.violations(t), ["local_date"])


@query("a3_categories", f"""WITH {A.MATCHED} SELECT local_date,
  count(*) FILTER (resource_arn LIKE 'arn:aws:s3:::%' AND type = 'UNAUTHORIZED_ACCESS') AS s3_unauthorized_access,
  count(*) FILTER (resource_arn LIKE 'arn:aws:s3:::%' AND type = 'ACCESS_OUTSIDE_WINDOW') AS s3_outside_window,
  count(*) FILTER ((resource_arn LIKE 'arn:aws:rds:%' OR resource_arn LIKE 'db:%') AND type = 'UNAUTHORIZED_ACCESS') AS db_unauthorized_access,
  count(*) FILTER ((resource_arn LIKE 'arn:aws:rds:%' OR resource_arn LIKE 'db:%') AND type = 'ACCESS_OUTSIDE_WINDOW') AS db_outside_window
FROM violations GROUP BY local_date""")
def a3(t):
    return R.by_category(A.violations(t), ["local_date"])


@query("a4_actor_types", f"""WITH {A.MATCHED} SELECT count(*) FILTER (actor_type = 'HUMAN') AS human_actors,
  count(*) FILTER (actor_type = 'SERVICE_PRINCIPAL') AS service_principals, count(*) FILTER (actor_type = 'SERVICE_ACCOUNT') AS service_accounts,
  count(*) FILTER (actor_type = 'AWS_SERVICE') AS aws_services, count(*) FILTER (actor_type = 'UNKNOWN') AS unknown_actors FROM violations""")
def a4(t):
    return R.by_actor_type(A.violations(t))


@query("a5_summary", f"""WITH {A.MATCHED} SELECT (SELECT count(*) FROM fx_audit) + (SELECT count(*) FROM fx_issuances) AS events_processed,
  (SELECT count(*) FROM fx_requests) AS access_requests_found, (SELECT count(*) FROM violations) AS total_violations_found""")
def a5(t):
    return R.summary(A.S.union_sources(A.named_objects(t), A.curated(t)), A.requests(t), A.violations(t))


@query("s18_report_header", f"""WITH {A.MATCHED} SELECT local_date, count(*) AS total_violations_found,
  count(*) FILTER (resource_arn LIKE 'arn:aws:s3:::%' AND type = 'UNAUTHORIZED_ACCESS') AS s3_unauthorized_access,
  count(*) FILTER (actor_type = 'HUMAN') AS human_actors, count(*) FILTER (email IS NULL) AS non_human_total,
  count(*) FILTER (actor_type = 'AWS_SERVICE') AS aws_service_category, '{PERIOD["start_local"]}' AS start_local
FROM violations GROUP BY local_date""")
def s18(t):
    df = R.report_header(A.violations(t), PERIOD, {"generated_at": "run", "execution_duration_seconds": "0"}, ["local_date"])
    return df.select(
        "local_date", "execution_summary.total_violations_found", "violations_by_category.s3_unauthorized_access",
        "violations_by_actor_type.human_actors", F.col("non_human_violations.total_count").alias("non_human_total"),
        F.col("non_human_violations.by_category")["AWS_SERVICE"].alias("aws_service_category"), "time_period.start_local")


DETAILS_SQL = """CASE WHEN db_name IS NOT NULL THEN concat('DB Name: ', db_name)
  ELSE concat('Bucket: ', req_bucket, ', Key: ', req_key, ', Operation: ', event_name) END"""
RANKED = f"""{A.MATCHED}, ranked AS (SELECT *, {DETAILS_SQL} AS details,
  row_number() OVER (PARTITION BY coalesce(email, '') ORDER BY src_rank, event_time DESC, ord) AS rank FROM violations)"""


@query("l3_ticket_rows", f"WITH {RANKED} SELECT coalesce(email, '') AS who, rank, ord FROM ranked WHERE rank <= 20")
def l3(t):
    return K.ticket_rows(K.grouped(A.violations(t)), []).select("who", F.col("rank").cast("bigint").alias("rank"), "ord")


@query("a7_matched_requests", f"""WITH {A.MATCHED} SELECT who, request_key, jira_issue_id, row_number() OVER (PARTITION BY who ORDER BY src_rank, event_time DESC, ord) AS i FROM (
  SELECT email AS who, request_time AS request_key, jira_issue_id, src_rank, event_time, ord,
    row_number() OVER (PARTITION BY email, request_time ORDER BY src_rank, event_time DESC, ord) AS rn
  FROM violations WHERE type = 'ACCESS_OUTSIDE_WINDOW') WHERE rn = 1""")
def a7(t):
    return K.matched_requests(K.grouped(A.violations(t)), []).select(
        "who", "request_key", "matched_request.jira_issue_id", F.col("i").cast("bigint").alias("i"))


@query("f22_resource_text", f"WITH {RANKED} SELECT ord, details FROM ranked")
def f22(t):
    return A.violations(t).select("ord", K.resource_text().alias("details"))


@query("f25_violation_text", f"""WITH {RANKED} SELECT ord, concat('#### Violation ', ord, ':', chr(10), '* **Type:** ', type, chr(10), '* **Severity:** ', severity, chr(10),
 '* **User:** ', coalesce(email, 'None'), chr(10), '* **Actor Type:** ', actor_type, chr(10), '* **Resource:** ', resource_arn, chr(10),
 '* **Event Time:** ', event_time, chr(10), '* **Event Name:** ', event_name, chr(10), '* **Description:** Access to ', resource_arn,
 CASE WHEN type = 'UNAUTHORIZED_ACCESS' THEN ' without approved request' ELSE ' outside approved time window' END, chr(10),
 CASE WHEN jira_issue_id IS NOT NULL THEN concat(chr(10), '##### Matched Request:', chr(10), '* **Jira Issue ID:** ', jira_issue_id, chr(10),
   '* **Justification:** work on ', jira_issue_id, chr(10), '* **Request Timestamp:** ', request_time, chr(10), '* **Duration (minutes):** ', duration_minutes, chr(10)) ELSE '' END,
 chr(10), '##### Resource Details:', chr(10), CASE WHEN db_name IS NOT NULL THEN concat('* **Db Name:** ', db_name)
   ELSE concat('* **S3 Bucket:** ', req_bucket, chr(10), '* **S3 Key:** ', req_key, chr(10), '* **Operation:** ', event_name) END) AS head FROM ranked""")
def f25(t):
    text = F.substring_index(K.violation_text("ord"), "\n\n##### Evidence:", 1)
    return A.violations(t).select("ord", text.alias("head"))


def all_tickets(t, columns=("*",)):
    """Tickets of all violations; queries that read no attachment name the columns that texts need, and only these are stored."""
    return K.tickets(stored(A.violations(t).select(*columns), "violations"), PERIOD, "run", "SEC", "Task", ["audit", "violation"], by=[])


LINE_SQL = """concat(chr(10), '| ', left(event_time, 16), ' | ', event_name, ' | ', resource_arn, ' | ', details, ' | **<Provide your justification here>** |')"""
BODY_SQL = f"""{RANKED},
shown AS (SELECT email, string_agg({LINE_SQL}, '' ORDER BY rank) AS shown_rows FROM ranked WHERE rank <= 20 AND email IS NOT NULL GROUP BY email),
asked AS (SELECT email, string_agg(concat(chr(10), '#### Request ', i, ':', chr(10), '**Jira Issue ID:** ', jira_issue_id, chr(10), '**Justification:** work on ', jira_issue_id, chr(10),
   '**Request Timestamp:** ', request_time, chr(10), '**Duration (minutes):** ', duration_minutes, chr(10)), '' ORDER BY i) AS shown_requests
  FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY src_rank, event_time DESC, ord) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY email, request_time ORDER BY src_rank, event_time DESC, ord) AS rn2 FROM violations WHERE type = 'ACCESS_OUTSIDE_WINDOW') WHERE rn2 = 1) GROUP BY email),
counts AS (SELECT email, count(*) AS n, count(*) FILTER (actor_type='SERVICE_PRINCIPAL') AS sp, count(*) FILTER (actor_type='AWS_SERVICE') AS aws,
  count(*) FILTER (actor_type='UNKNOWN') AS unk, count(*) FILTER (actor_type='SERVICE_ACCOUNT') AS sa FROM violations GROUP BY email),
bodies AS (SELECT c.email, c.n, CASE WHEN c.email IS NOT NULL THEN concat('## Customer Data Access Violation', chr(10), chr(10), '### Report Overview:', chr(10),
  '**Period:** {PERIOD["start_local"]} - {PERIOD["end_local"]}', chr(10), '**User:** ', c.email, chr(10), '**Violations Count:** ', c.n, chr(10), chr(10), '### Action Required', chr(10),
  'Please provide justification for each violation in the table below.', chr(10), 'Update the justification field and save this ticket.', chr(10), chr(10), '### Violations Summary', chr(10), chr(10),
  '| Date | Event | Resource | Resource Details | Justification |', chr(10), '|------|-------|----------|------------------|---------------|', s.shown_rows,
  CASE WHEN c.n > 20 THEN concat(chr(10), chr(10), '**Note:** Table shows first 20 violations. ', c.n - 20, ' additional violations are available in the attached JSON report.', chr(10)) ELSE '' END,
  chr(10), chr(10), '### User Requests', chr(10), coalesce(a.shown_requests, ''), chr(10), '### Note', chr(10), 'Full violation report and evidence are attached to this ticket.')
  ELSE concat('## Customer Data Access Violation - Service or Unknown Actor', chr(10), chr(10), '### Report Overview:', chr(10), '* **Generated At:** run', chr(10),
  '* **Period:** {PERIOD["start"]} - {PERIOD["end"]}', chr(10), '* **Local Period:** {PERIOD["start_local"]} - {PERIOD["end_local"]}', chr(10), chr(10),
  '### Non-Human Violations Summary:', chr(10), '* **Total Count:** ', c.n, chr(10), chr(10), '#### By Category:', chr(10), '* **SERVICE_PRINCIPAL:** ', c.sp, chr(10), '* **AWS_SERVICE:** ', c.aws, chr(10),
  '* **UNKNOWN:** ', c.unk, chr(10), '* **SERVICE_ACCOUNT:** ', c.sa, chr(10), chr(10), '### Note:', chr(10), 'See attached report for detailed violation information.', chr(10)) END AS body
  FROM counts c LEFT JOIN shown s ON c.email = s.email LEFT JOIN asked a ON c.email = a.email)"""


@query("f26_ticket_body", f"""WITH {BODY_SQL} SELECT email AS assignee, CASE WHEN length(body) > 32000 THEN concat(left(body, 31800), chr(10), chr(10), '---', chr(10),
  '**Content truncated due to Jira size limits. Full details available in attachment.**') ELSE body END AS description FROM bodies""")
def f26(t):
    return all_tickets(t, K.TEXT_COLUMNS).select("assignee", "description")


@query("f28_tickets", f"""WITH {BODY_SQL} SELECT email AS assignee, 'SEC' AS project_key, 'Task' AS issue_type,
  CASE WHEN email IS NOT NULL THEN concat('Customer data access violation - ', email, ' - 2024-01-01T01:00 - 2024-01-31T00:59')
    ELSE 'Customer data access violation - service or unknown actor - 2024-01-01T01:00 - 2024-01-31T00:59' END AS summary,
  CASE WHEN email IS NOT NULL THEN concat('violations_', replace(email, '@', '_at_'), '.json') ELSE 'non_human_violations.json' END AS filename,
  'audit,violation' AS labels, n AS counted FROM bodies""")
def f28(t):
    content = F.unbase64(F.col("attachments")[0]["content"]).cast("string")
    count = F.coalesce(F.get_json_object(content, "$.violations_count"), F.get_json_object(content, "$.total_count"))
    return all_tickets(t).select(
        "assignee", "project_key", "issue_type", "summary", F.col("attachments")[0]["filename"].alias("filename"),
        F.array_join("labels", ",").alias("labels"), count.cast("bigint").alias("counted"))


@query("f27_attachment_rows", f"WITH {RANKED} SELECT coalesce(email, '') AS who, ord, rank FROM ranked")
def f27(t):
    rows = K.grouped(stored(A.violations(t).select(*K.LIST_COLUMNS), "violations")).withColumn("json", F.to_json(F.struct("ord")))
    full = K.attachments(rows, K.group_totals(rows, []), [])
    items = F.from_json(F.get_json_object("content", "$.violations"), "array<struct<ord:bigint>>")
    return full.select("who", F.posexplode(items).alias("p", "v")).select(
        "who", "v.ord", (F.col("p") + 1).cast("bigint").alias("rank"))


@query("f29_ticket_log", f"""WITH {BODY_SQL} SELECT email AS assignee, CASE WHEN email IS NOT NULL THEN 'Human Violation Ticket' ELSE 'Non-Human Violation Ticket' END AS ticket_type,
  least(length(body), 31800 + CASE WHEN length(body) > 32000 THEN 90 ELSE 200 END)::BIGINT AS description_length, 1::BIGINT AS attachments_count FROM bodies""")
def f29(t):
    log = K.ticket_log(all_tickets(t, K.TEXT_COLUMNS), PERIOD, {"generated_at": "run"})
    return log.select(
        F.get_json_object("record", "$.assignee").alias("assignee"), F.get_json_object("record", "$.ticket_type").alias("ticket_type"),
        F.get_json_object("record", "$.description_length").cast("bigint").alias("description_length"),
        F.get_json_object("record", "$.attachments_count").cast("bigint").alias("attachments_count"))
