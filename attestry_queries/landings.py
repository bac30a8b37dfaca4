"""Registered queries: streams over landing folders that are filled in several deliveries, closed and read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import correlate as C
from attestry.operators.alarms import Alarm
from attestry.streaming import jobs as J
from attestry.streaming import stateful as S
from attestry.streaming.runner import run_available, run_counted, scratch
from attestry_queries import access, ingest
from attestry_queries.fixtures import Inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}
#: Later than any event: a row of this time moves the watermark past all others.
CLOSING = "2100-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


class Landing:
    """A folder in the shared place to which deliveries are added, and a stream over it."""

    def __init__(self, t: Inputs, name: str):
        self.spark, self.base = t.spark, scratch(t.spark, name)
        self.folder, self.out, self.state = (f"{self.base}/{x}" for x in ("landed", "out", "state"))

    def add(self, rows: DataFrame) -> "Landing":
        rows.write.mode("append").parquet(self.folder)
        self.schema = rows.schema
        return self

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.folder)


# --- T1, T4: copies and late files ----------------------------------------------

#: Copies arrive later, under a later number and with another lease, so that a wrong survivor shows.
COPY = 10_000_000_000


def delivered(t: Inputs, where: str, copy: bool = False) -> DataFrame:
    lines = t.sql(f"SELECT l.event_id AS ord, l.message, e.ts FROM fx_log_lines l JOIN events e ON e.event_id = l.event_id WHERE {where}")
    arrival = F.lit("2024-02-01 00:00:00").cast("timestamp")
    if copy:
        lines = lines.withColumns({"ord": F.col("ord") + COPY, "message": F.regexp_replace("message", "lease-", "copied-lease-")})
        arrival = arrival + F.expr("interval 1 day")
    return lines.select("ord", "message", arrival.alias("ingest_ts"))


def closing_line(t: Inputs) -> DataFrame:
    text = f"{CLOSING} UTC:10.0.0.1(1):closing@db_0:[1]:LOG:  connection authorized: user=closing database=db_0"
    return t["events"].limit(1).select(F.lit(-1).cast("bigint").alias("ord"), F.lit(text).alias("message"), F.lit("2024-02-01").cast("timestamp").alias("ingest_ts"))


def _copies(landing: Landing) -> DataFrame:
    events = S.first_copies(J.parsed_stream(landing.stream(), "db_0, db_2 ,"), "18 hours")
    return events.select("ord", "type", F.col("key_user").alias("who"), "lease_id", F.col("event_time_norm").alias("event_time"))


FIRST = f"{ingest.INGESTED} SELECT ord, type, who, lease_id, event_time FROM kept"


@query("t1_first_copies", FIRST)
def t1(t):
    landing = Landing(t, "t1-copies").add(delivered(t, "true", copy=True)).add(delivered(t, "true")).add(closing_line(t))
    return run_available(_copies(landing), landing.out, landing.state)


#: The first landing ends here; the second begins twelve hours earlier, and some lines of the last six hours before come only then.
CUT = "date_trunc('day', (SELECT max(ts) FROM events)) - INTERVAL 5 DAY"
EARLY = f"e.ts < {CUT} AND NOT (e.ts >= {CUT} - INTERVAL 6 HOUR AND e.event_id % 2 = 0)"


def two_landings(t: Inputs) -> tuple[DataFrame, list[int]]:
    """The result after both landings, and the rows that each run read."""
    landing = Landing(t, "t4").add(delivered(t, EARLY))
    counts = [run_counted(_copies(landing), landing.out, landing.state)[1]]
    landing.add(delivered(t, f"NOT ({EARLY})")).add(delivered(t, f"e.ts >= {CUT} - INTERVAL 12 HOUR AND ({EARLY})", copy=True))
    counts.append(run_counted(_copies(landing), landing.out, landing.state)[1])
    out, read = run_counted(_copies(landing.add(closing_line(t))), landing.out, landing.state)
    return out, [*counts, read]


@query("t4_two_landings", FIRST)
def t4(t):
    return two_landings(t)[0]


# --- T5, T8: whole results --------------------------------------------------------

@query("t5_whole_alarms", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 300 SECOND, ts) AS o, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY ALL),
b AS (SELECT event_type, o FROM w WHERE v > 0)
SELECT x.event_type, strftime(x.o, '%Y-%m-%d %H:%M:%S') AS run_start FROM b x JOIN b y ON y.event_type = x.event_type AND y.o = x.o + INTERVAL 300 SECOND""")
def t5(t):
    samples = t["events"].select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("value"))
    close = samples.limit(1).select(F.lit(CLOSING).cast("timestamp").alias("ts"), F.lit("closing").alias("event_type"), F.lit(0).cast("bigint").alias("value"))
    landing = Landing(t, "t5").add(samples).add(close)
    found = run_available(J.alarm_stream(landing.stream(), ["event_type"], Alarm("sum", 0)), landing.out, landing.state)
    return found.select("event_type", F.date_format("run_start", "yyyy-MM-dd HH:mm:ss").alias("run_start"))


@query("t8_whole_reconcile", """
SELECT a.ord, coalesce(bool_or(CAST(a.event_time AS TIMESTAMP) BETWEEN CAST(q.request_time AS TIMESTAMP)
  AND CAST(q.request_time AS TIMESTAMP) + to_minutes(CAST(q.duration_minutes AS INTEGER))), false) AS covered
FROM (SELECT *, CASE WHEN contains(principal_id, '@') THEN lower(substr(principal_id, strpos(principal_id, ':') + 1)) END AS email FROM fx_audit WHERE event_source IS NOT NULL) a
LEFT JOIN fx_requests q ON a.email = q.user_email AND a.local_date = q.local_date GROUP BY a.ord""")
def t8(t):
    """Every event comes out, those without a window once the watermark rules one out."""
    objects, asked = access.named_objects(t), access.requests(t)
    events = Landing(t, "t8-events").add(objects).add(objects.limit(1).withColumns({
        "ord": F.lit(-1).cast("bigint"), "eventTime": F.lit(CLOSING), "principalId": F.lit("A:closing@example.com"), "local_date": F.lit(CLOSING[:10])}))
    requests = Landing(t, "t8-requests").add(asked).add(asked.limit(1).withColumns({
        "request_id": F.lit("closing"), "timestamp": F.lit(CLOSING), "local_date": F.lit(CLOSING[:10]), "user_email": F.lit("other@example.com")}))
    joined = J.reconcile_stream(C.resolve_actors(C.conform(events.stream(), "UTC")), requests.stream(), "UTC")
    out = run_available(joined, events.out, events.state)
    return out.where("ord >= 0").groupBy("ord").agg(F.max("covered").alias("covered"))


# --- T7: retention -----------------------------------------------------------------

NOW = "2025-01-10 00:00:00"
EXPIRES = "CAST(request_time AS TIMESTAMP) + INTERVAL 365 DAY"


def retention_landing(t: Inputs) -> Landing:
    """Requests in the order of their time, then a row that moves the watermark to now."""
    stamped = t["fx_requests"].select(
        F.col("request_id").cast("string").alias("request_id"), F.col("request_time").cast("timestamp").alias("event_ts"))
    rows = stamped.withColumn("ttl", F.unix_seconds("event_ts") + 365 * 86400)
    now = F.lit(NOW).cast("timestamp")
    clock = rows.limit(1).select(F.lit("clock").alias("request_id"), now.alias("event_ts"), F.unix_seconds(F.lit(CLOSING).cast("timestamp")).alias("ttl"))
    return Landing(t, "t7").add(rows).add(clock)


@query("t7_request_ttl", f"""SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN {EXPIRES} > TIMESTAMP '{NOW}' THEN 'remembered' ELSE 'forgotten' END AS state FROM fx_requests""")
def t7(t):
    landing = retention_landing(t)
    gone = run_available(S.forgotten_requests(landing.stream()), landing.out, landing.state)
    kept = S.remembered_requests(t.spark, landing.state).where("request_id <> 'clock'")
    return gone.select("request_id", F.lit("forgotten").alias("state")).unionByName(kept.select("request_id", F.lit("remembered").alias("state")))
