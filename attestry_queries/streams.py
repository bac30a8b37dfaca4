"""Registered queries: the streaming jobs, run over the landed tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import correlate as C
from attestry.operators.alarms import Alarm
from attestry.streaming import jobs as J
from attestry.streaming.runner import run_available, run_to_sink, scratch
from attestry_queries import access, ingest
from attestry_queries.fixtures import StreamInputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(StreamInputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


def _run(t, stream, name):
    base = scratch(t.spark, name)
    return run_available(stream, f"{base}/out", f"{base}/state")


def doubled_lines(t):
    """Every line delivered twice, as after a redelivery."""
    return ingest.lines(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))


@query("t1_stream_ingest", f"""{ingest.INGESTED} SELECT event_time, type AS event_name, CASE WHEN username IS NULL THEN who ELSE username END AS principal, '123456789012' AS account_id FROM kept""")
def t1(t):
    events = J.deduplicated_stream(J.parsed_stream(ingest.lines(t), "db_0, db_2 ,"))
    base = scratch(t.spark, "t1")
    run_to_sink(J.sink_stream(events, ingest.ARN), f"{base}/out", f"{base}/state")
    out = t.spark.read.parquet(f"{base}/out")
    return out.select(
        F.col("eventData.eventTime").alias("event_time"), F.col("eventData.eventName").alias("event_name"),
        F.col("eventData.userIdentity.principalId").alias("principal"), F.col("eventData.recipientAccountId").alias("account_id"))


@query("t3_stream_dedup", f"{ingest.INGESTED} SELECT type, event_time, place AS key_place, who AS key_user FROM kept")
def t3(t):
    events = J.deduplicated_stream(J.parsed_stream(doubled_lines(t), "db_0, db_2 ,"), spread="copy")
    return _run(t, events.select("type", F.col("event_time_norm").alias("event_time"), "key_place", "key_user"), "t3")


# Windows newer than the final watermark stay open, so the answer ends there.
@query("t5_stream_alarms", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 300 SECOND, ts) AS o, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY ALL),
b AS (SELECT event_type, o FROM w WHERE v > 0)
SELECT x.event_type, strftime(x.o, '%Y-%m-%d %H:%M:%S') AS run_start FROM b x JOIN b y ON y.event_type = x.event_type AND y.o = x.o + INTERVAL 300 SECOND
WHERE x.o + INTERVAL 600 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def t5(t):
    samples = t["events"].select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("value"))
    found = _run(t, J.alarm_stream(samples, ["event_type"], Alarm("sum", 0)), "t5")
    return found.select("event_type", F.date_format("run_start", "yyyy-MM-dd HH:mm:ss").alias("run_start"))


APPROVED = """SELECT DISTINCT a.ord FROM (SELECT *, lower(substr(principal_id, strpos(principal_id, ':') + 1)) AS email FROM fx_audit WHERE contains(principal_id, '@')) a
JOIN fx_requests q ON a.email = q.user_email AND a.local_date = q.local_date AND CAST(a.event_time AS TIMESTAMP) BETWEEN CAST(q.request_time AS TIMESTAMP)
  AND CAST(q.request_time AS TIMESTAMP) + to_minutes(CAST(q.duration_minutes AS INTEGER))"""


@query("t8_stream_reconcile", APPROVED)
def t8(t):
    events = C.resolve_actors(C.conform(access.named_objects(t), "UTC"))
    joined = J.reconcile_stream(events, access.requests(StreamInputs(t.spark, t.dir)), "UTC")
    return _run(t, joined, "t8").where("covered").select("ord").distinct()


