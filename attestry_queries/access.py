"""Registered queries: scans, identities, correlation, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import identity as I
from attestry.functions import resources as R
from attestry.operators import correlate as C
from attestry.operators import issuance as J
from attestry.operators import scans as S
from attestry.operators import whitelist as W
from attestry.plans.reconcile import Settings, access_events, candidates, correlated, reconcile, reconcile_raw
from attestry_queries.fixtures import Inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}

ACTORS = {
    "SERVICE_PRINCIPAL": ["k8s-irsa-loader", "nightly"],
    "AWS_SERVICE": ["athena.amazonaws.com", "config.amazonaws.com"],
    "SERVICE_ACCOUNT": ["u12", "u32"],
}
DB_USERS = ["v-user7", "v-user18"]
DB_ARNS = {"db_0": "arn:aws:rds:eu-central-1:123456789012:db:zero"}
SETTINGS = Settings(zone="UTC", db_arn_map=DB_ARNS, db_users=DB_USERS, actors=ACTORS)
BUCKETS = ["arn:aws:s3:::bucket-1/any", "bucket-2"]
PREFIXES = ["bucket-0/customer/1", "bucket-3 "]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


# --- inputs in the stores' raw shape ----------------------------------------

def raw_objects(t: Inputs) -> DataFrame:
    return t["fx_audit"].where("event_source IS NOT NULL").select(
        "ord", "local_date", F.col("event_time").alias("eventTime"), F.col("event_name").alias("eventName"),
        F.col("event_source").alias("eventSource"), F.col("aws_region").alias("awsRegion"),
        F.col("source_ip").alias("sourceIpAddress"), F.col("user_agent").alias("userAgent"),
        F.struct(
            F.col("identity_type").alias("type"), F.col("principal_id").alias("principalId"),
            F.col("identity_arn").alias("arn"), F.col("user_name").alias("userName"),
            F.struct(F.struct(F.col("issuer").alias("userName")).alias("sessionIssuer")).alias("sessionContext"),
        ).alias("userIdentity"),
        F.col("account_id").alias("recipientAccountId"), F.col("request_no").alias("requestID"),
        F.create_map(F.lit("bucketName"), "req_bucket", F.lit("key"), "req_key").alias("requestParameters"),
    )


def raw_curated(t: Inputs) -> DataFrame:
    sessions = t["fx_audit"].where("event_source IS NULL").select(
        "ord", "local_date", F.col("event_time").alias("eventTime"), F.struct(
            F.col("event_name").alias("eventName"),
            F.create_map(F.lit("db_username"), "db_username", F.lit("database"), "db_name",
                         F.lit("client_addr"), "source_ip").alias("additionalEventData")).alias("eventData"))
    issued = t["fx_issuances"].select(
        F.col("issue_id").alias("ord"), "local_date", F.col("event_time").alias("eventTime"), F.struct(
            F.lit("VaultCredsIssued").alias("eventName"),
            F.create_map(F.lit("username"), "db_username", F.lit("auth_display_name"), "auth_display_name",
                         F.lit("lease_id"), "lease_id", F.lit("path"), F.lit("database/creds/prod-ro"),
                         F.lit("user_agent"), F.concat(F.lit("vault-"), F.col("issue_id").cast("string")),
                         ).alias("additionalEventData")).alias("eventData"))
    return sessions.unionByName(issued)


def objects(t: Inputs) -> DataFrame:
    return S.scan_object_events(raw_objects(t))


def named_objects(t: Inputs) -> DataFrame:
    """Object events that keep the IAM user name, as a wider projection would."""
    return t["fx_audit"].where("event_source IS NOT NULL").select(
        "ord", "local_date", F.col("event_time").alias("eventTime"), F.col("event_name").alias("eventName"),
        F.lit("s3.amazonaws.com").alias("eventSource"), F.col("aws_region").alias("awsRegion"),
        F.col("source_ip").alias("sourceIpAddress"), F.col("user_agent").alias("userAgent"),
        F.col("identity_type").alias("userIdentityType"), F.col("principal_id").alias("principalId"),
        F.col("identity_arn").alias("userIdentityArn"), F.col("issuer").alias("sessionIssuerUserName"),
        F.col("user_name").alias("userName"), F.col("account_id").alias("recipientAccountId"),
        F.col("request_no").alias("requestID"), F.col("req_bucket").alias("reqBucketName"),
        F.col("req_key").alias("reqObjectKey"))


def curated(t: Inputs) -> DataFrame:
    """Curated rows as the scan returns them."""
    return t.sql("""
SELECT ord, local_date, event_time AS eventTime, event_name AS eventName, CAST(NULL AS <str>) AS auth_display_name, db_username,
  db_name AS database, CAST(NULL AS <str>) AS path, CAST(NULL AS <str>) AS lease_id, source_ip AS sourceIpAddress, CAST(NULL AS <str>) AS userAgent
FROM fx_audit WHERE event_source IS NULL
UNION ALL SELECT issue_id, local_date, event_time, 'VaultCredsIssued', auth_display_name, db_username, NULL, 'database/creds/prod-ro', lease_id,
  NULL, concat('vault-', CAST(issue_id AS <str>)) FROM fx_issuances""")


def requests(t: Inputs) -> DataFrame:
    return t["fx_requests"].select(
        F.col("request_id").cast("string").alias("request_id"), F.col("request_time").alias("timestamp"), "local_date",
        F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("user_name"), "user_email",
        "jira_issue_id", F.concat(F.lit("work on "), "jira_issue_id").alias("justification"), "duration_minutes")


def events(t: Inputs, settings: Settings = SETTINGS) -> DataFrame:
    return access_events(named_objects(t), curated(t), settings)


def violations(t: Inputs, settings: Settings = SETTINGS) -> DataFrame:
    return reconcile(named_objects(t), curated(t), requests(t), t["fx_owner_tags"], settings)


# --- scans -------------------------------------------------------------------

@query("s1_object_event_scan", """
SELECT ord, event_time, event_name, event_source, aws_region, source_ip, user_agent, identity_type, principal_id,
  identity_arn, issuer, account_id, request_no, req_bucket, req_key
FROM fx_audit WHERE event_time >= '2024-01-05 00:00:00' AND event_time <= '2024-01-20 23:59:59'
  AND event_source = 's3.amazonaws.com' AND event_name IN ('GetObject','PutObject','DeleteObject','RestoreObject')
  AND (req_bucket IN ('bucket-1','bucket-2') OR (req_bucket = 'bucket-0' AND req_key LIKE 'customer/1%') OR req_bucket = 'bucket-3')
""")
def s1(t):
    df = S.scan_object_events(raw_objects(t), "2024-01-05 00:00:00", "2024-01-20 23:59:59", BUCKETS, PREFIXES)
    names = ["ord", "event_time", "event_name", "event_source", "aws_region", "source_ip", "user_agent",
             "identity_type", "principal_id", "identity_arn", "issuer", "account_id", "request_no", "req_bucket", "req_key"]
    return df.drop("local_date").toDF(*names)


@query("p3_monitored_objects", """
SELECT req_bucket, count(*) AS n FROM fx_audit WHERE event_source IS NOT NULL AND
  (req_bucket IN ('bucket-1') OR (req_bucket = 'bucket-2' AND req_key LIKE 'customer/_.csv%')) GROUP BY req_bucket
""")
def p3(t):
    df = t["fx_audit"].where("event_source IS NOT NULL")
    return df.where(S.monitored_object(["bucket-1"], ["bucket-2/customer/_.csv"], "req_bucket", "req_key")).groupBy(
        "req_bucket").agg(F.count("*").alias("n"))


@query("s2_curated_event_scan", """
SELECT ord, event_time, event_name, NULL AS auth_display_name, db_username, db_name AS db, NULL AS path, NULL AS lease_id, source_ip, NULL AS user_agent
FROM fx_audit WHERE event_source IS NULL
UNION ALL SELECT issue_id, event_time, 'VaultCredsIssued', auth_display_name, db_username, NULL, 'database/creds/prod-ro', lease_id, NULL, concat('vault-', issue_id)
FROM fx_issuances
""")
def s2(t):
    return S.scan_curated_events(raw_curated(t)).drop("local_date").toDF(
        "ord", "event_time", "event_name", "auth_display_name", "db_username", "db", "path", "lease_id", "source_ip", "user_agent")


@query("u1_union_sources", """
SELECT 0 AS src_rank, event_name, count(*) AS n, count(req_bucket) AS with_bucket, CAST(0 AS BIGINT) AS with_db FROM fx_audit
WHERE event_source IS NOT NULL GROUP BY event_name
UNION ALL SELECT 1, event_name, count(*), 0, count(db_name) FROM fx_audit WHERE event_source IS NULL GROUP BY event_name
UNION ALL SELECT 1, 'VaultCredsIssued', count(*), 0, 0 FROM fx_issuances
""")
def u1(t):
    return S.union_sources(objects(t), curated(t)).groupBy("src_rank", F.col("eventName").alias("event_name")).agg(
        F.count("*").alias("n"), F.count("reqBucketName").alias("with_bucket"), F.count("database").alias("with_db"))


@query("s5_requests_for_day", """
SELECT request_id, request_time, user_email, jira_issue_id FROM fx_requests
WHERE local_date = '2024-01-10' AND request_time BETWEEN '2024-01-10 06:00:00' AND '2024-01-10 23:59:59'
""")
def s5(t):
    df = S.requests_for_day(requests(t), "2024-01-10", "2024-01-10 06:00:00", "2024-01-10 23:59:59")
    return df.select(F.col("request_id").cast("bigint").alias("request_id"), F.col("timestamp").alias("request_time"),
                     "user_email", "jira_issue_id")


@query("s6_requests_for_range", """
SELECT request_id, request_time, user_email, jira_issue_id FROM fx_requests
WHERE request_time BETWEEN '2024-01-10 06:00:00' AND '2024-01-17 23:59:59'
""")
def s6(t):
    df = S.requests_for_range(requests(t), "2024-01-10 06:00:00", "2024-01-17 23:59:59")
    return df.select(F.col("request_id").cast("bigint").alias("request_id"), F.col("timestamp").alias("request_time"),
                     "user_email", "jira_issue_id")


@query("s20_ingest_selectors", """
SELECT ord, event_name, req_bucket, req_key FROM fx_audit
WHERE event_source IS NOT NULL AND concat('arn:aws:s3:::', req_bucket, '/', req_key) LIKE 'arn:aws:s3:::bucket-1/customer/%' AND event_name = 'GetObject'
""")
def s20(t):
    raw = t["fx_audit"].withColumns({
        "eventName": F.col("event_name"),
        "eventCategory": F.when(F.col("event_source").isNotNull(), "Data").otherwise("Management"),
        "resourceType": F.lit("AWS::S3::Object"),
        "resourceArn": F.concat(F.lit("arn:aws:s3:::"), "req_bucket", F.lit("/"), "req_key")})
    return S.selected_for_ingest(raw, ["AWS::S3::Object"], ["arn:aws:s3:::bucket-1/customer/"], ["GetObject"]).select(
        "ord", "event_name", "req_bucket", "req_key")


@query("s21_db_log_filter", r"""
SELECT event_id, message FROM fx_log_lines WHERE regexp_matches(message, 'connection authorized|disconnection:|.*@.*:')
""")
def s21(t):
    return S.db_log_lines(t["fx_log_lines"])


@query("s22_credential_log_filter", """
SELECT event_id, message FROM fx_log_lines WHERE contains(message, 'database') AND contains(message, 'creds') AND contains(message, 'prod-')
""")
def s22(t):
    return S.credential_log_lines(t["fx_log_lines"])


# --- whitelists --------------------------------------------------------------

@query("p5_actor_whitelist_source", """
SELECT ord, principal_id, issuer, user_agent FROM fx_audit WHERE event_source IS NOT NULL
  AND (issuer IS NULL OR lower(issuer) NOT IN ('k8s-irsa-loader','nightly'))
  AND (user_name IS NULL OR lower(user_name) NOT IN ('u12','u32'))
  AND (user_agent IS NULL OR lower(user_agent) NOT LIKE '%athena.amazonaws.com%')
  AND (user_agent IS NULL OR lower(user_agent) NOT LIKE '%config.amazonaws.com%')
""")
def p5(t):
    return S.scan_object_events(raw_objects(t), whitelist=ACTORS).select(
        "ord", F.col("principalId").alias("principal_id"), F.col("sessionIssuerUserName").alias("issuer"),
        F.col("userAgent").alias("user_agent"))


EMAILLESS_ACTOR = """CASE WHEN coalesce(contains(source_ip, '.amazonaws.com'), false) OR coalesce(contains(user_agent, '.amazonaws.com'), false) THEN 'AWS_SERVICE'
  WHEN regexp_matches(coalesce(CASE WHEN contains(principal_id, ':') THEN substr(principal_id, strpos(principal_id, ':') + 1) END, ''), 'metadata-handler|k8s-irsa-|aws-sdk-java-|role-') THEN 'SERVICE_PRINCIPAL'
  WHEN regexp_matches(coalesce(issuer, ''), 'role-|k8s-irsa-|-prod|-service') THEN 'SERVICE_PRINCIPAL'
  WHEN identity_type = 'IAMUser' THEN 'SERVICE_ACCOUNT' ELSE 'UNKNOWN' END"""
LISTED = """(event_source IS NOT NULL AND CASE emailless_actor
  WHEN 'SERVICE_PRINCIPAL' THEN coalesce(lower(issuer) IN ('k8s-irsa-loader','nightly'), false)
    OR coalesce(lower(substr(principal_id, strpos(principal_id, ':') + 1)) IN ('k8s-irsa-loader','nightly') AND contains(principal_id, ':'), false)
  WHEN 'AWS_SERVICE' THEN coalesce(lower(coalesce(source_ip, CASE WHEN contains(user_agent, '.amazonaws.com') THEN user_agent END)) IN ('athena.amazonaws.com','config.amazonaws.com'), false)
  WHEN 'SERVICE_ACCOUNT' THEN coalesce(lower(user_name) IN ('u12','u32'), false) ELSE false END)"""


@query("p7_actor_whitelist_exact", f"""
SELECT ord, principal_id, emailless_actor FROM (SELECT *, {EMAILLESS_ACTOR} AS emailless_actor FROM fx_audit) WHERE NOT {LISTED}
""")
def p7(t):
    rows = C.conform(S.union_sources(named_objects(t), curated(t).where("eventName <> 'VaultCredsIssued'")), "UTC")
    return W.drop_whitelisted(rows, actors=ACTORS).select(
        "ord", F.col("principalId").alias("principal_id"), I.actor_type().alias("emailless_actor"))


@query("p6_db_user_whitelist", """
SELECT ord, db_username FROM fx_audit WHERE coalesce(lower(trim(CASE WHEN event_source IS NOT NULL THEN db_username ELSE coalesce(db_username, user_name) END)) NOT IN ('v-user7','v-user18'), true)
""")
def p6(t):
    rows = C.conform(S.union_sources(named_objects(t), curated(t).where("eventName <> 'VaultCredsIssued'")), "UTC")
    return W.drop_whitelisted(rows, db_users=DB_USERS).select("ord", "db_username")


# --- issuances ---------------------------------------------------------------

def _issued(keep: str, name: str) -> None:
    order = "event_time ASC, issue_id DESC" if keep == "earliest" else "event_time DESC, issue_id ASC"

    @query(name, f"""
WITH iss AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(db_username)), local_date ORDER BY {order}) AS rn FROM fx_issuances) WHERE rn = 1)
SELECT a.ord, a.db_username, regexp_replace(i.auth_display_name, '^(v-oidc-|oidc-)', '') AS human_id, i.lease_id,
  a.source_ip, CASE WHEN i.issue_id IS NOT NULL THEN concat('vault-', i.issue_id) END AS user_agent, concat('db:', a.db_name) AS resource_arn
FROM fx_audit a LEFT JOIN iss i ON lower(trim(a.db_username)) = lower(trim(i.db_username)) AND a.local_date = i.local_date
WHERE a.event_source IS NULL
""")
    def run(t):
        return _session_columns(J.enrich_sessions(curated(t), keep))


def _session_columns(df):
    return df.where("eventName <> 'VaultCredsIssued'").select(
        "ord", "db_username", "human_id", "lease_id", F.col("sourceIpAddress").alias("source_ip"),
        F.col("userAgent").alias("user_agent"), F.col("resourceArn").alias("resource_arn"))


_issued("earliest", "j1_issuance_earliest")
_issued("latest", "j1_issuance_latest")


@query("w5_issuance_asof", """
SELECT ord, db_username, regexp_replace(auth_display_name, '^(v-oidc-|oidc-)', '') AS human_id, lease_id, source_ip,
  CASE WHEN issue_id IS NOT NULL THEN concat('vault-', issue_id) END AS user_agent, concat('db:', db_name) AS resource_arn
FROM (SELECT a.ord, a.db_username, a.source_ip, a.db_name, i.auth_display_name, i.lease_id, i.issue_id,
    row_number() OVER (PARTITION BY a.ord ORDER BY i.event_time DESC, i.issue_id DESC) AS rn
  FROM fx_audit a LEFT JOIN fx_issuances i ON a.db_username = i.db_username AND i.event_time <= a.event_time
  WHERE a.event_source IS NULL) WHERE rn = 1
""")
def w5(t):
    return _session_columns(J.enrich_sessions(curated(t), "asof"))


@query("a6_issuance_per_user", """
SELECT user_key, local_date, ord, iss_lease FROM (SELECT lower(trim(db_username)) AS user_key, local_date, issue_id AS ord, lease_id AS iss_lease,
  row_number() OVER (PARTITION BY lower(trim(db_username)), local_date ORDER BY event_time, issue_id DESC) AS rn FROM fx_issuances) WHERE rn = 1
""")
def a6(t):
    return J.issuance_per_user(curated(t)).select("user_key", "local_date", "ord", "iss_lease")


# --- identities and resources -------------------------------------------------

ISSUED = """iss AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_username, local_date ORDER BY event_time, issue_id DESC) AS rn FROM fx_issuances) WHERE rn = 1)"""
RESOLVED = f"""{ISSUED}, tagged AS (SELECT user_name, regexp_extract(lower(tag_value), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') AS owner_email FROM fx_owner_tags WHERE tag_key = 'owner'),
resolved AS (SELECT a.*, i.auth_display_name, i.lease_id, i.issue_id, concat('db:', a.db_name) AS synthetic_arn,
  CASE WHEN i.issue_id IS NOT NULL THEN replace(i.auth_display_name, 'oidc-', '')
    WHEN contains(a.principal_id, '@') THEN lower(substr(a.principal_id, strpos(a.principal_id, ':') + 1))
    ELSE g.owner_email END AS email,
  {EMAILLESS_ACTOR} AS emailless_actor,
  CASE WHEN a.event_source IS NOT NULL THEN concat('arn:aws:s3:::', a.req_bucket)
    WHEN a.db_name = 'db_0' THEN 'arn:aws:rds:eu-central-1:123456789012:db:zero' ELSE concat('db:', a.db_name) END AS resource_arn
FROM fx_audit a LEFT JOIN iss i ON a.db_username = i.db_username AND a.local_date = i.local_date
  LEFT JOIN tagged g ON a.identity_arn = concat('arn:aws:iam::123456789012:user/', g.user_name))"""


def _resolved_events(t):
    return C.resolve_actors(events(t).where("eventName <> 'VaultCredsIssued'"), t["fx_owner_tags"])


@query("f10_email_extraction", r"""
SELECT doc_id, nullif(regexp_extract(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'), '') AS email FROM documents
""")
def f10(t):
    return t["documents"].select("doc_id", I.login_email("text").alias("email"))


ORACLES["f10_email_extraction"] = oracle(r"""
SELECT doc_id, nullif(regexp_extract(regexp_replace(lower(text), '^(v-oidc-|oidc-)', ''), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'), '') AS email FROM documents
""")


@query("f12_identifier", f"""
WITH {ISSUED}
SELECT a.ord, CASE WHEN i.issue_id IS NOT NULL THEN replace(i.auth_display_name, 'oidc-', '')
  WHEN contains(principal_id, ':') THEN lower(substr(principal_id, strpos(principal_id, ':') + 1))
  ELSE lower(principal_id) END AS identifier
FROM fx_audit a LEFT JOIN iss i ON a.db_username = i.db_username AND a.local_date = i.local_date
""")
def f12(t):
    return events(t).where("eventName <> 'VaultCredsIssued'").select("ord", I.raw_identifier().alias("identifier"))


@query("f14_resolve_email", f"WITH {RESOLVED} SELECT ord, email FROM resolved")
def f14(t):
    return _resolved_events(t).select("ord", F.col("user_id").alias("email"))


@query("f15_actor_type", f"""
WITH {RESOLVED} SELECT ord, emailless_actor, CASE WHEN email IS NOT NULL THEN 'HUMAN' ELSE emailless_actor END AS actor_type FROM resolved
""")
def f15(t):
    return _resolved_events(t).select("ord", I.actor_type().alias("emailless_actor"), "actor_type")


@query("j7_owner_tag", f"""
WITH {RESOLVED} SELECT ord, identity_arn, email FROM resolved WHERE identity_arn IS NOT NULL
""")
def j7(t):
    rows = C.conform(named_objects(t).where("userIdentityArn IS NOT NULL"), "UTC")
    return C.resolve_actors(rows, t["fx_owner_tags"]).select(
        "ord", F.col("userIdentityArn").alias("identity_arn"), F.col("user_id").alias("email"))


@query("j8_resource_arn", f"""
WITH {RESOLVED} SELECT ord, resource_arn, db_name, req_bucket AS s3_bucket, req_key AS s3_key,
  CASE WHEN event_source IS NOT NULL THEN event_name END AS operation FROM resolved
""")
def j8(t):
    rows = C.access_candidates(events(t), DB_ARNS).withColumn("d", R.resource_details())
    return rows.select("ord", "resource_arn", "d.*")


@query("f17_evidence", f"""
WITH {RESOLVED} SELECT ord, email AS user_email, principal_id, issuer AS session_issuer, user_name AS iam_user, identity_type AS user_identity_type,
  identity_arn AS user_identity_arn, db_username, auth_display_name_out AS vault_auth_name, lease_id AS vault_lease_id, request_no AS s3_request_id,
  source_ip, agent AS user_agent, aws_region, account_id AS recipient_account_id
FROM (SELECT *, NULL AS auth_display_name_out, CASE WHEN issue_id IS NOT NULL THEN concat('vault-', issue_id) ELSE user_agent END AS agent FROM resolved)
""")
def f17(t):
    return _resolved_events(t).withColumn("e", R.evidence()).select("ord", "e.*").drop(
        "db_auth_method", "db_auth_identity", "s3_error_code", "s3_error_message", "access_key_id", "event_id")


# --- correlation ---------------------------------------------------------------

@query("j2_identity_explode", """
SELECT request_id, ident FROM (SELECT CAST(request_id AS VARCHAR) AS request_id, lower(user_email) AS ident FROM fx_requests
UNION SELECT CAST(request_id AS VARCHAR), lower(jira_issue_id) FROM fx_requests)
""")
def j2(t):
    named = requests(t).withColumns({"user_id": F.upper("user_email"), "user_name": F.concat(F.lit(" "), "jira_issue_id")})
    return C.requests_by_identifier(named).select("request_id", "ident")


MATCHED = f"""{RESOLVED}, cand AS (SELECT * FROM resolved WHERE NOT {LISTED}
    AND coalesce(lower(coalesce(db_username, user_name)) NOT IN ('v-user7','v-user18'), true)),
matched AS (SELECT c.ord, count(q.request_id) AS requests,
  coalesce(bool_or(CAST(c.event_time AS TIMESTAMP) BETWEEN CAST(q.request_time AS TIMESTAMP)
    AND CAST(q.request_time AS TIMESTAMP) + to_minutes(CAST(q.duration_minutes AS INTEGER))), false) AS covered
  FROM cand c LEFT JOIN fx_requests q ON c.email = q.user_email AND c.local_date = q.local_date GROUP BY c.ord),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_email, local_date ORDER BY request_time DESC, CAST(request_id AS VARCHAR)) AS rn FROM fx_requests) WHERE rn = 1),
judged AS (SELECT c.*, m.requests, m.covered, n.jira_issue_id, n.request_time, n.duration_minutes,
  CASE WHEN email IS NOT NULL THEN 'HUMAN' ELSE emailless_actor END AS actor_type,
  CASE WHEN m.requests = 0 THEN 'UNAUTHORIZED_ACCESS' ELSE 'ACCESS_OUTSIDE_WINDOW' END AS type,
  CASE WHEN m.requests = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN event_source IS NULL THEN 1 ELSE 0 END AS src_rank
  FROM cand c JOIN matched m ON c.ord = m.ord LEFT JOIN newest n ON c.email = n.user_email AND c.local_date = n.local_date),
violations AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_date, type, email, resource_arn, event_time, event_name ORDER BY src_rank, ord) AS rn
  FROM judged WHERE NOT covered) WHERE rn = 1)"""


def _matched(t, settings=SETTINGS):
    return correlated(events(t, settings), requests(t), t["fx_owner_tags"], settings)


@query("j3_window_containment", f"WITH {MATCHED} SELECT ord, requests > 0 AS has_request, covered FROM matched")
def j3(t):
    return _matched(t).select("ord", F.col("matched_request").isNotNull().alias("has_request"), "covered")


@query("j3_carry_over", f"""
WITH {RESOLVED}, cand AS (SELECT * FROM resolved WHERE NOT {LISTED}
    AND coalesce(lower(coalesce(db_username, user_name)) NOT IN ('v-user7','v-user18'), true))
SELECT c.ord, count(q.request_id) > 0 AS has_request,
  coalesce(bool_or(CAST(c.event_time AS TIMESTAMP) BETWEEN CAST(q.request_time AS TIMESTAMP)
    AND CAST(q.request_time AS TIMESTAMP) + to_minutes(CAST(q.duration_minutes AS INTEGER))), false) AS covered
FROM cand c LEFT JOIN fx_requests q ON c.email = q.user_email GROUP BY c.ord
""")
def j3_carry(t):
    from dataclasses import replace

    return _matched(t, replace(SETTINGS, carry_over=True)).select(
        "ord", F.col("matched_request").isNotNull().alias("has_request"), "covered")


@query("j4_unapproved", f"WITH {MATCHED} SELECT ord, type, severity FROM judged WHERE NOT covered")
def j4(t):
    return C.unapproved(_matched(t)).select("ord", "type", "severity")


@query("j5_no_request", f"WITH {MATCHED} SELECT ord, email AS user_id, actor_type FROM judged WHERE requests = 0")
def j5(t):
    return C.unapproved(_matched(t)).where("type = 'UNAUTHORIZED_ACCESS'").select("ord", "user_id", "actor_type")


#: Islands of the windows of a person: a window that begins after all earlier ones have ended begins a span.
DISJOINT = """WITH w AS (SELECT user_email AS ident, local_date, CAST(request_time AS TIMESTAMP) AS lo,
  CAST(request_time AS TIMESTAMP) + to_minutes(CAST({minutes} AS INTEGER)) AS hi FROM fx_requests),
r AS (SELECT *, max(hi) OVER (PARTITION BY ident ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, count(*) FILTER (reach IS NULL OR lo > reach) OVER (PARTITION BY ident ORDER BY lo, hi) AS island FROM r)
SELECT ident, strftime(min(lo), '%Y-%m-%d %H:%M:%S') AS opens, strftime(max(hi), '%Y-%m-%d %H:%M:%S') AS closes FROM i GROUP BY ident, island"""


@query("j3_disjoint_windows", DISJOINT.format(minutes="duration_minutes * 1000"))
def j3_disjoint(t):
    """Windows of up to weeks, so that many of a person overlap."""
    known = C.requests_by_identifier(requests(t).withColumn("duration_minutes", F.col("duration_minutes") * 1000))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return C.access_spans(known, ["ident"], None).select("ident", stamp("lo").alias("opens"), stamp("hi").alias("closes"))


#: Some requests without end, as after a slip of the keyboard.
ENDLESS = "CASE WHEN CAST(request_id AS BIGINT) % 5 = 0 THEN 2000000000 ELSE duration_minutes END"


@query("j3_endless_windows", f"""
WITH {RESOLVED}, cand AS (SELECT * FROM resolved WHERE NOT {LISTED}
    AND coalesce(lower(coalesce(db_username, user_name)) NOT IN ('v-user7','v-user18'), true))
SELECT c.ord, coalesce(bool_or(CAST(c.event_time AS TIMESTAMP) BETWEEN CAST(q.request_time AS TIMESTAMP)
    AND CAST(q.request_time AS TIMESTAMP) + to_minutes(CAST({ENDLESS} AS INTEGER))), false) AS covered
FROM cand c LEFT JOIN fx_requests q ON c.email = q.user_email GROUP BY c.ord
""")
def j3_endless(t):
    asked = requests(t).withColumn("duration_minutes", F.expr(ENDLESS))
    rows = candidates(events(t), t["fx_owner_tags"], SETTINGS)
    return C.with_coverage(rows, asked, "UTC", carry_over=True).select("ord", "covered")


@query("j6_latest_request", """
SELECT user_email AS ident, local_date, jira_issue_id, request_time AS request_timestamp, CAST(duration_minutes AS INTEGER) AS duration_minutes
FROM (SELECT *, row_number() OVER (PARTITION BY user_email, local_date ORDER BY request_time DESC, CAST(request_id AS VARCHAR)) AS rn FROM fx_requests) WHERE rn = 1
""")
def j6(t):
    df = C.latest_request(C.requests_by_identifier(requests(t)), ["ident", "local_date"])
    return df.select("ident", "local_date", "matched_request.*").drop("justification")


VIOLATION_SQL = """SELECT ord, local_date, type, severity, email AS user_id, actor_type, resource_arn, event_time, event_name,
  CASE WHEN type = 'UNAUTHORIZED_ACCESS' THEN concat('Access to ', resource_arn, ' without approved request')
    ELSE concat('Access to ', resource_arn, ' outside approved time window') END AS description,
  db_name, req_bucket AS s3_bucket, req_key AS s3_key, lease_id AS vault_lease_id, source_ip,
  jira_issue_id, request_time AS request_timestamp, CAST(duration_minutes AS INTEGER) AS duration_minutes FROM violations"""


def flat_violations(df):
    return df.select(
        "ord", "local_date", "type", "severity", "user_id", "actor_type", "resource_arn", "event_time", "event_name",
        "description", "resource_details.db_name", "resource_details.s3_bucket", "resource_details.s3_key",
        "evidence.vault_lease_id", "evidence.source_ip", "matched_request.jira_issue_id",
        "matched_request.request_timestamp", "matched_request.duration_minutes")


@query("reconcile_violations", f"WITH {MATCHED} {VIOLATION_SQL}")
def flagship(t):
    return flat_violations(violations(t))


# Raw stores have no event number: which of the events that agree in the key stays is left open, so the key is compared.
# The object scan leaves out the IAM user name, as the declared projection does.
BARE = f"fx_bare AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS user_name) FROM fx_audit), {MATCHED.replace('fx_audit', 'fx_bare')}"


@query("reconcile_raw_tables", f"""WITH {BARE} SELECT DISTINCT local_date, type, severity, email AS user_id, resource_arn, event_time, event_name,
  jira_issue_id, request_time AS request_timestamp, CAST(duration_minutes AS INTEGER) AS duration_minutes FROM violations""")
def from_raw(t):
    found = reconcile_raw(raw_objects(t).drop("ord", "local_date"), raw_curated(t).drop("ord", "local_date"), requests(t), t["fx_owner_tags"], SETTINGS)
    return found.select("local_date", "type", "severity", "user_id", "resource_arn", "event_time", "event_name",
                        "matched_request.jira_issue_id", "matched_request.request_timestamp", "matched_request.duration_minutes")


@query("w1_keep_first", f"""
WITH {MATCHED} SELECT local_date, type, resource_arn, count(*) AS kept, sum(ord)::BIGINT AS ord_sum FROM violations GROUP BY ALL
""")
def w1(t):
    return C.unapproved(C.keep_first_violation(_matched(t).where("not covered"))).groupBy("local_date", "type", "resource_arn").agg(
        F.count("*").alias("kept"), F.sum("ord").alias("ord_sum"))
