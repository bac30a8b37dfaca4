"""Registered queries: log ingest and request capture."""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import json

import pyarrow as pa
from pyspark.sql import functions as F

from attestry.functions import config, hashing, text, times
from attestry.operators import logs as L
from attestry.operators import requests as Q
from attestry.operators.scans import retained
from attestry.sources import deliveries as D
from attestry_queries.fixtures import Inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}
ARN = "arn:aws:cloudtrail:eu-central-1:123456789012:channel/audit"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


def lines(t: Inputs):
    """Log lines with their arrival time."""
    return t.sql("SELECT event_id AS ord, message, CAST('2024-02-01 00:00:00' AS TIMESTAMP) AS ingest_ts FROM fx_log_lines")


# --- F1-F3: times in mixed spellings, composed from every event ----------------

STAMPS = """SELECT event_id, CASE event_id % 8
  WHEN 0 THEN CAST(date_trunc('second', ts) AS <str>) WHEN 1 THEN concat(replace(CAST(date_trunc('second', ts) AS <str>), ' ', 'T'), 'Z')
  WHEN 2 THEN concat(CAST(date_trunc('second', ts) AS <str>), '.250') WHEN 3 THEN concat(replace(CAST(date_trunc('second', ts) AS <str>), ' ', 'T'), '.500Z')
  WHEN 4 THEN replace(CAST(date_trunc('second', ts) AS <str>), ' ', 'T') WHEN 5 THEN concat(CAST(date_trunc('second', ts) AS <str>), '+02:00')
  WHEN 6 THEN '' ELSE concat('at ', CAST(user_id AS <str>)) END AS stamp,
  CAST(date_trunc('second', ts) AS <str>) AS wall, event_id % 8 AS form FROM events"""


@query("f1_parse_time", f"""SELECT event_id, CASE WHEN form IN (0, 1, 2) THEN epoch_ms(CAST(wall AS TIMESTAMP)) WHEN form = 3 THEN epoch_ms(CAST(wall AS TIMESTAMP)) + 500 END AS epoch_millis
FROM ({STAMPS})""")
def f1(t):
    return t.sql(STAMPS).select("event_id", F.unix_millis(times.parse_time("stamp")).alias("epoch_millis"))


def _f2(name: str, apply_offset: bool) -> None:
    moved = "strftime(CAST(wall AS TIMESTAMP) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ')" if apply_offset else "iso"

    @query(name, f"""SELECT event_id, CASE WHEN form = 5 THEN {moved} WHEN form < 5 THEN iso ELSE '2024-02-01T00:00:00Z' END AS normalized
FROM (SELECT *, concat(replace(wall, ' ', 'T'), 'Z') AS iso FROM ({STAMPS}))""")
    def run(t):
        later = F.lit("2024-02-01 00:00:00").cast("timestamp")
        return t.sql(STAMPS).select("event_id", times.normalize_time("stamp", later, apply_offset).alias("normalized"))


_f2("f2_normalize_time", False)
_f2("f2_normalize_time_offset", True)


@query("f20_local_period", """SELECT event_id, concat(strftime(timezone('Europe/Berlin', timezone('UTC', date_trunc('second', ts))), '%Y-%m-%dT%H:%M:%S'), '+01:00') AS local_text,
  strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m-%d') AS local_date FROM events""")
def f20(t):
    df = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    return df.select("event_id", times.local_iso(F.date_trunc("second", "ts"), "Europe/Berlin").alias("local_text"),
                     times.local_date("ts", "Europe/Berlin").alias("local_date"))


# --- parsing -------------------------------------------------------------------

DB_SQL = r"""SELECT event_id AS ord, CASE WHEN event_type = 'purchase' THEN 'DbSessionConnect' ELSE 'DbSessionDisconnect' END AS type,
  strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS event_time, concat('u', user_id) AS db_username, concat('db_', event_id % 3) AS db,
  CASE WHEN event_type = 'error' THEN (10 + event_id % 50) * 60 + 7 END AS session_duration_seconds,
  CASE WHEN event_type = 'error' THEN strftime(date_trunc('second', ts) - to_seconds(CAST((10 + event_id % 50) * 60 + 7 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS computed_connect_time
FROM events WHERE event_type IN ('purchase', 'error')"""


@query("f4_parse_db_log", f"SELECT ord, type, event_time, db_username, db FROM ({DB_SQL})")
def f4(t):
    df = L.with_db_event(lines(t), "ingest_ts").where("db is not null")
    return df.select("ord", "db.type", F.col("db.eventTime").alias("event_time"), "db.db_username", F.col("db.database").alias("db"))


@query("f5_session_times", f"SELECT ord, session_duration_seconds, computed_connect_time FROM ({DB_SQL}) WHERE type = 'DbSessionDisconnect'")
def f5(t):
    df = L.with_db_event(lines(t), "ingest_ts").where("db.type = 'DbSessionDisconnect'")
    return df.select("ord", "db.session_duration_seconds", "db.computed_connect_time")


CRED_SQL = """SELECT event_id AS ord, 'VaultCredsIssued' AS type, concat(CAST(date_trunc('second', ts) AS VARCHAR), 'Z') AS event_time, 'database/creds/prod-ro' AS path,
  concat('oidc-user', user_id, '@example.com') AS auth_display_name, concat('v-user', user_id) AS username, concat('lease-', event_id) AS lease_id
FROM events WHERE event_type = 'signup' AND event_id % 2 = 0"""


@query("f6_parse_credential_log", CRED_SQL)
def f6(t):
    df = L.with_credential_event(lines(t), "ingest_ts").where("cred is not null")
    return df.select("ord", "cred.type", F.col("cred.eventTime").alias("event_time"), "cred.path", "cred.auth_display_name",
                     "cred.username", "cred.lease_id")


@query("f7_pseudonymise", """SELECT ord, concat('uuid5:', substr(h,1,12), '5', substr(h,14,3), translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab'), substr(h,18,15)) AS pseudonym FROM (
SELECT issue_id AS ord, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(auth_display_name)) AS h FROM fx_issuances)""")
def f7(t):
    return t["fx_issuances"].select(F.col("issue_id").alias("ord"), hashing.pseudonym("auth_display_name").alias("pseudonym"))


INGESTED = f"""WITH parsed AS (SELECT ord, type, event_time, db_username AS who, db AS place, NULL AS username, session_duration_seconds, computed_connect_time, NULL AS lease_id FROM ({DB_SQL}) WHERE db IN ('db_0', 'db_2')
  UNION ALL SELECT ord, type, replace(event_time, ' ', 'T'), username, path, auth_display_name, NULL, NULL, lease_id FROM ({CRED_SQL})),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, event_time, place, who ORDER BY ord) AS rn FROM parsed) WHERE rn = 1)"""


def _ingested(t):
    return L.ingest(lines(t), "db_0, db_2 ,")


@query("p10_database_filter", f"{INGESTED} SELECT ord, type, place FROM parsed")
def p10(t):
    df = L.monitored_databases(L.parse_lines(lines(t)), "db_0, db_2 ,")
    return df.select("ord", "type", F.coalesce("database", "path").alias("place"))


@query("w2_keep_first_event", f"{INGESTED} SELECT ord, type, who FROM kept")
def w2(t):
    return _ingested(t).select("ord", "type", F.col("key_user").alias("who"))


@query("f50_curated_payload", f"""{INGESTED} SELECT event_time, 'audit.prod' AS event_source, type AS event_name,
  CASE WHEN username IS NULL THEN who ELSE username END AS principal, '123456789012' AS account_id,
  CASE WHEN type = 'DbSessionConnect' THEN concat_ws(';', 'database=' || place, 'db_username=' || who, 'eventTime=' || event_time, 'type=' || type)
    WHEN type = 'DbSessionDisconnect' THEN concat_ws(';', 'computed_connect_time=' || computed_connect_time, 'database=' || place, 'db_username=' || who, 'eventTime=' || event_time, 'session_duration_seconds=' || session_duration_seconds, 'type=' || type)
    ELSE concat_ws(';', 'auth_display_name=' || username, 'eventTime=' || replace(event_time, 'T', ' '), 'lease_id=' || lease_id, 'path=' || place, 'response_ts=' || replace(event_time, 'T', ' '), 'type=' || type, 'username=' || who) END AS extra
FROM kept""")
def f50(t):
    df = L.sink_records(_ingested(t), ARN)
    pairs = F.filter(F.transform(F.array_sort(F.map_entries("eventData.additionalEventData")), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                     lambda s: ~F.startswith(s, F.lit("request_id=")))
    return df.select(
        F.col("eventData.eventTime").alias("event_time"), F.col("eventData.eventSource").alias("event_source"),
        F.col("eventData.eventName").alias("event_name"), F.col("eventData.userIdentity.principalId").alias("principal"),
        F.col("eventData.recipientAccountId").alias("account_id"), F.array_join(pairs, ";").alias("extra"))


@query("f9_masked_summary", f"""SELECT ord, concat('emit_event db op=', CASE WHEN type = 'DbSessionConnect' THEN 'connect' ELSE 'disconnect' END,
  ' user=', db_username, ' database=', db, ' ts=', event_time) AS summary FROM ({DB_SQL})
UNION ALL SELECT ord, concat('emit_event vault path=', path, ' username=', username, ' ts=', event_time) FROM ({CRED_SQL})""")
def f9(t):
    return L.emitted_summaries(L.parse_lines(lines(t))).select("ord", "summary")


@query("a11_ingest_counts", """SELECT count(*) AS parsed_messages, count(*) FILTER (event_type IN ('purchase','error') OR (event_type = 'signup' AND event_id % 2 = 0)) AS emitted_events FROM events""")
def a11(t):
    df = L.with_credential_event(L.with_db_event(lines(t), "ingest_ts"), "ingest_ts")
    return df.agg(F.count("*").alias("parsed_messages"),
                  F.count_if(F.col("db").isNotNull() | F.col("cred").isNotNull()).alias("emitted_events"))


#: Deliveries that a task hands on at once.
PACKED_TOGETHER = 256


def pack(t: Inputs):
    """Log lines as gzip+base64 deliveries of at most 100 lines, the shape the collector sends."""
    groups = t["fx_log_lines"].groupBy(F.floor(F.col("event_id") / 100).alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", "message"))).alias("items"))

    def squeeze(batches):
        def data(items):
            body = {"messageType": "DATA_MESSAGE", "logGroup": "g", "logEvents": [
                {"id": str(i["event_id"]), "timestamp": 1704067200000, "message": i["message"]} for i in items]}
            return base64.b64encode(gzip.compress(json.dumps(body).encode())).decode()

        for batch in batches:
            for begun in range(0, batch.num_rows, PACKED_TOGETHER):
                part = batch.slice(begun, PACKED_TOGETHER)
                packed = [data(items.as_py()) for items in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.string())], ["batch", "data"])

    return groups.mapInArrow(squeeze, "batch long, data string")


@query("s7_decode_deliveries", "SELECT event_id // 100 AS batch, event_id % 100 AS line_no, message, 'g' AS log_group FROM fx_log_lines")
def s7(t):
    return D.decode_deliveries(pack(t)).select("batch", F.col("line_no").cast("bigint").alias("line_no"), "message", "log_group")


@query("s4_flatten_result_rows", """SELECT ord // 50 AS page, ord, event_time, event_name FROM fx_audit""")
def s4(t):
    cell = lambda k, c: F.create_map(F.lit(k), F.col(c).cast("string"))
    row = F.array(cell("eventName", "local_date"), cell("ord", "ord"), cell("eventTime", "event_time"), cell("eventName", "event_name"))
    pages = t["fx_audit"].groupBy(F.floor(F.col("ord") / 50).alias("page")).agg(F.collect_list(row).alias("rows"))
    flat = D.flatten_result_rows(pages, ["ord", "eventTime", "eventName"])
    return flat.select("page", F.col("ord").cast("bigint").alias("ord"), F.col("eventTime").alias("event_time"), F.col("eventName").alias("event_name"))


# --- requests --------------------------------------------------------------------

SUBMITTED = """SELECT event_id, user_id, ts, CASE event_id % 6 WHEN 0 THEN concat('ENG-', CAST(event_id AS <str>), ' fix & check;30')
  WHEN 1 THEN concat('ENG-', CAST(event_id AS <str>), ';15') WHEN 2 THEN concat('eng-', CAST(event_id AS <str>), ' why;15')
  WHEN 3 THEN concat('ENG-', CAST(event_id AS <str>), ' why;45') WHEN 4 THEN concat('ENG-', CAST(event_id AS <str>), ' why;soon')
  ELSE concat(' OPS2-', CAST(event_id AS <str>), '  long reason; here;60') END AS command FROM events"""
ALLOWED = [15, 30, 60, 120]


def submissions(t: Inputs):
    df = t.sql(SUBMITTED)
    text = F.replace(F.url_encode("command"), F.lit("%20"), F.lit("+"))
    form = F.concat(F.lit("text="), F.lit("&user_id=U"), F.col("user_id").cast("string"), F.lit("&text="), text, F.lit("&text=second&user_name=n"),
                    F.col("user_id").cast("string"))
    is64 = F.col("event_id") % 2 == 0
    return df.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("received_epoch"), is64.alias("is_base64"),
                     F.when(is64, F.base64(form.cast("binary"))).otherwise(form).alias("body"))


@query("s8_parse_submissions", f"""SELECT event_id, concat('U', user_id) AS user_id, concat('n', user_id) AS user_name, command AS text,
  CASE event_id % 6 WHEN 4 THEN '' WHEN 5 THEN '' WHEN 2 THEN concat('eng-', event_id) ELSE concat('ENG-', event_id) END AS jira_issue_id,
  CASE event_id % 6 WHEN 0 THEN 'fix & check' WHEN 2 THEN 'why' WHEN 3 THEN 'why' ELSE '' END AS justification,
  CASE event_id % 6 WHEN 0 THEN 30 WHEN 1 THEN 15 WHEN 2 THEN 15 WHEN 3 THEN 45 ELSE 0 END AS duration_minutes,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Justification required. Example: ENG-1234 Justification;30'
    WHEN 3 THEN 'Duration must be one of: 15, 30, 60, 120' ELSE 'Invalid Jira ID. Example: ENG-1234 Justification;30' END AS error
FROM ({SUBMITTED})""")
def s8(t):
    return Q.validate(Q.parse_command(Q.parse_submissions(submissions(t))), ALLOWED).drop("received_epoch")


@query("f41_text_commands", """SELECT conv_id, turn, CASE WHEN contains(text, ';') THEN '' ELSE trim(split_part(trim(text, ' ' || chr(9) || chr(10) || chr(13)), ' ', 1)) END AS jira_issue_id,
  0 AS duration_minutes FROM conversations""")
def f41(t):
    return Q.parse_command(t["conversations"].select("conv_id", "turn", "text")).select(
        "conv_id", "turn", "jira_issue_id", "duration_minutes")


@query("p13_dialog_errors", """SELECT event_id, concat_ws('|', CASE WHEN event_id % 5 = 1 THEN 'Invalid Jira key' END,
  CASE WHEN event_id % 7 = 2 THEN 'Justification required' END, CASE WHEN event_id % 3 = 0 THEN 'Duration must be one of: [15, 30, 60, 120]' END) AS errors FROM events""")
def p13(t):
    df = t["events"]
    key = F.when(F.col("event_id") % 5 == 1, "bad key").otherwise(F.concat(F.lit("ENG-"), F.col("event_id").cast("string")))
    why = F.when(F.col("event_id") % 7 == 2, "").otherwise("because")
    minutes = F.when(F.col("event_id") % 3 == 0, "9").otherwise("60")
    payload = F.to_json(F.struct(
        F.lit("view_submission").alias("type"), F.struct(F.col("user_id").cast("string").alias("id")).alias("user"),
        F.struct(F.lit("access_request").alias("callback_id"), F.struct(F.struct(
            F.struct(F.struct(key.alias("value")).alias("jira_key")).alias("jira"),
            F.struct(F.struct(why.alias("value")).alias("justification")).alias("just"),
            F.struct(F.struct(F.struct(minutes.alias("value")).alias("selected_option")).alias("duration_select")).alias("duration"),
        ).alias("values")).alias("state")).alias("view")))
    sent = df.select("event_id", F.lit(False).alias("is_base64"), F.concat(F.lit("payload="), F.url_encode(payload)).alias("body"))
    return Q.validate(Q.parse_dialog(sent), ALLOWED, every_error=True).select("event_id", F.array_join("errors", "|").alias("errors"))


@query("p13_form_errors", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Justification is required' WHEN 1 THEN 'Jira ID is required' WHEN 2 THEN 'Jira ID format invalid'
  WHEN 3 THEN 'Duration is required' WHEN 4 THEN 'Duration must be one of: 15, 30, 60, 120' WHEN 5 THEN 'Duration must be one of: 15, 30, 60, 120' END AS error FROM events""")
def p13_form(t):
    k = F.col("event_id") % 7
    df = t["events"].select(
        "event_id", F.when(k == 0, "  ").otherwise("why").alias("justification"),
        F.when(k == 1, F.lit(None)).when(k == 2, "ENG_1").otherwise("ENG-1").alias("jira_id"),
        F.when(k == 3, "").when(k == 4, "abc").when(k == 5, "31").otherwise(" 30 ").alias("duration"))
    return Q.form_errors(df, ALLOWED).select("event_id", "error")


@query("f40_request_rows", f"""SELECT strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m-%d') AS local_date,
  concat('n', user_id) AS user_email, concat('ENG-', event_id) AS jira_issue_id,
  strftime(date_trunc('second', ts) + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS expiry, (epoch_ms(date_trunc('second', ts)) // 1000 + 2 * 365 * 86400)::BIGINT AS ttl
FROM ({SUBMITTED}) WHERE command LIKE '%fix & check;30'""")
def f40(t):
    good = Q.validate(Q.parse_command(Q.parse_submissions(submissions(t))), ALLOWED).where("error is null")
    return Q.request_rows(good, "Europe/Berlin", 2).select(
        F.col("timestamp").alias("stamp"), "local_date", "user_email", "jira_issue_id", F.col("expiry_timestamp").alias("expiry"), "ttl")


AGED = "SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS age, event_id % 2 = 0 AS ahead FROM events"


@query("p14_replay_age", f"SELECT event_id FROM ({AGED}) WHERE age <= 300")
def p14(t):
    df = t.sql(AGED).select("event_id", F.lit(1704067200).alias("received_epoch"),
                            (F.lit(1704067200) + F.when(F.col("ahead"), F.col("age")).otherwise(-F.col("age"))).alias("sent_epoch"))
    return Q.fresh(df).select("event_id")


@query("p15_retention", "SELECT request_id FROM fx_requests WHERE CAST(request_time AS TIMESTAMP) + INTERVAL 365 DAY > TIMESTAMP '2025-01-10 00:00:00'")
def p15(t):
    df = t["fx_requests"].withColumn("ttl", F.unix_seconds(F.col("request_time").cast("timestamp")) + 365 * 86400)
    return retained(df, 1736467200).select("request_id")


@query("f30_flags", """SELECT event_id, CASE WHEN event_type IN ('view','click') THEN true ELSE false END AS enabled,
  CASE WHEN event_type = 'error' THEN '15,30' ELSE '60' END AS minutes, event_type = 'signup' AS missing FROM events""")
def f30(t):
    df = t["events"].select(
        "event_id", F.when(F.col("event_type") == "view", "YES").when(F.col("event_type") == "click", "1")
        .when(F.col("event_type") == "error", "Off").otherwise("false").alias("setting"),
        F.when(F.col("event_type") == "error", "30,,15, 30").otherwise(" 60").alias("list"),
        F.when(F.col("event_type") == "signup", "CHANGE_ME").otherwise("set").alias("value"))
    return df.select("event_id", config.flag("setting").alias("enabled"),
                     F.array_join(config.allowed_minutes("list"), ",").alias("minutes"), config.unset("value").alias("missing"))



@query("p1_yesterday_window", """SELECT event_id, local_date FROM (SELECT event_id, ts, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m-%d') AS local_date FROM events)
WHERE ts >= TIMESTAMP '2024-01-10 23:00:00' AND ts <= TIMESTAMP '2024-01-11 22:59:59.999999'""")
def p1(t):
    now = dt.datetime(2024, 1, 12, 3, 0, tzinfo=dt.timezone.utc)
    lo, hi = times.reconciliation_window(now, zone="Europe/Berlin")
    df = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    return df.where(F.col("ts").between(lo, hi)).select("event_id", times.local_date("ts", "Europe/Berlin").alias("local_date"))


@query("p2_utc_window", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS utc_date FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11'""")
def p2(t):
    lo, hi = times.reconciliation_window(dt.datetime(2024, 1, 12, 3, 0, tzinfo=dt.timezone.utc), zone="UTC")
    df = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    return df.where(F.col("ts").between(lo, hi)).select("event_id", times.local_date("ts", "UTC").alias("utc_date"))


@query("f8_accounts", "SELECT event_id, nullif(split_part(arn, ':', 5), '') AS account, split_part(arn, '/', -1) AS store FROM (SELECT event_id, concat('arn:aws:x:eu:', CASE WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS VARCHAR) END, ':store/', event_type) AS arn FROM events)")
def f8(t):
    arn = F.concat(F.lit("arn:aws:x:eu:"), F.when(F.col("event_type") == "view", "").otherwise(F.col("user_id").cast("string")), F.lit(":store/"), "event_type")
    return t["events"].select("event_id", hashing.account_of(arn).alias("account"), text.table_id(arn).alias("store"))


@query("f21_title_range", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'soon' ELSE concat(strftime(ts, '%Y-%m-%dT%H:%M'), ' - ', strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M')) END AS title FROM events""")
def f21(t):
    shape = "yyyy-MM-dd'T'HH:mm:ssXXX"
    ts = F.col("ts").cast("timestamp")
    start = F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format(ts, shape))
    return t["events"].select("event_id", times.title_range(start, F.date_format(ts + F.expr("interval 1 day"), shape)).alias("title"))


@query("f31_whitelist_entries", """SELECT user_id, concat('user', user_id) AS entry FROM events GROUP BY user_id UNION ALL SELECT user_id, 'bot' FROM events GROUP BY user_id""")
def f31(t):
    users = t["events"].select("user_id").distinct()
    setting = F.concat(F.lit('[" User'), F.col("user_id").cast("string"), F.lit('", "BOT"]'))
    return users.select("user_id", F.explode(config.whitelist_entries(setting)).alias("entry"))
