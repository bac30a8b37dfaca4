"""Registered queries: alarms, SLA, drift, gates, fingerprints, sensitive text."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import alarms as A
from attestry.operators import governance as G
from attestry_queries.fixtures import Inputs, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


def samples(t: Inputs):
    # Cents, so sums are exact in any order.
    return t["events"].select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("value"))


BUCKETED = "SELECT event_type, time_bucket(INTERVAL 300 SECOND, ts) AS opened, CAST(round(value * 100) AS BIGINT) AS value FROM events"


@query("a14_metric_windows", f"""SELECT event_type, strftime(opened, '%Y-%m-%d %H:%M:%S') AS opened, sum(value)::BIGINT AS total, count(*) AS samples, round(avg(value), 4) AS mean FROM ({BUCKETED}) GROUP BY ALL""")
def a14(t):
    return A.metric_windows(samples(t), ["event_type"]).select(
        "event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("opened"), "total", "samples", F.round("mean", 4).alias("mean"))


def _t5(name: str, seconds: int, periods: int, statistic: str, threshold: float) -> None:
    agg = "sum(value)" if statistic == "sum" else "avg(value)"

    @query(name, f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL {seconds} SECOND, ts) AS o, {agg} AS v FROM (SELECT event_type, ts, CAST(round(value * 100) AS BIGINT) AS value FROM events) GROUP BY ALL),
b AS (SELECT event_type, o FROM w WHERE v > {threshold})
SELECT event_type, strftime(x.o, '%Y-%m-%d %H:%M:%S') AS run_start FROM b x WHERE (SELECT count(*) FROM b y WHERE y.event_type = x.event_type AND y.o >= x.o AND y.o < x.o + INTERVAL {seconds * periods} SECOND) = {periods}""")
    def run(t):
        rule = A.Alarm(statistic, threshold, periods, seconds)
        return A.alarms(samples(t), ["event_type"], rule).select("event_type", F.date_format("run_start", "yyyy-MM-dd HH:mm:ss").alias("run_start"))


_t5("t5_alarms", 300, 2, "sum", 0)
_t5("t5_alarms_capacity", 3600, 3, "sum", 1000)
_t5("t5_alarms_average", 1800, 2, "avg", 800)

SLA = {"1-URGENT": 30, "2-HIGH": 90, "3-MEDIUM": 180}
FINDINGS = """SELECT o_orderkey, o_orderpriority AS severity, CAST(o_orderdate AS TIMESTAMP) AS opened_at, CAST(closed AS TIMESTAMP) AS resolved_at
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS closed FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
SLA_SQL = f"""SELECT o_orderkey, severity, days, CASE WHEN days IS NULL THEN 'no_window' WHEN seen > opened_at + to_days(days) THEN 'violation'
  WHEN seen > opened_at + to_days(days) - INTERVAL 14 DAY THEN 'warning' ELSE 'on_track' END AS tier, strftime(opened_at + to_days(days), '%Y-%m-%d') AS deadline
FROM (SELECT *, CASE severity WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 90 WHEN '3-MEDIUM' THEN 180 END AS days, coalesce(resolved_at, TIMESTAMP '2000-01-01') AS seen FROM ({FINDINGS}))"""


def sla(t):
    return G.sla_status(t.sql(FINDINGS), SLA, 14, "2000-01-01")


@query("f45_sla", f"SELECT o_orderkey, severity, deadline, tier FROM ({SLA_SQL})")
def f45(t):
    return sla(t).select("o_orderkey", "severity", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "tier")


@query("a15_sla_counts", f"SELECT severity, tier, count(*) AS findings FROM ({SLA_SQL}) GROUP BY ALL")
def a15(t):
    return G.sla_counts(sla(t))


@query("f46_publish_prune", """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'publish' WHEN a.o_orderkey IS NULL THEN 'prune' ELSE 'keep' END AS action
FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') a FULL OUTER JOIN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') b ON a.o_orderkey = b.o_orderkey""")
def f46(t):
    return G.publish_actions(t["orders"].where("o_orderstatus <> 'F'"), t["orders"].where("o_orderdate < '1999-01-01'"), "o_orderkey")


@query("j14_drift", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j14(t):
    allowed = t["orders"].where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return G.unexpected(t["customer"].select("c_custkey", "c_name"), allowed, "c_custkey")


CHANGES = """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE split_part(o_orderpriority, '-', 2) END AS risk,
  CASE WHEN o_orderstatus = 'P' THEN 'fix things' ELSE concat('OPS-', CAST(o_orderkey AS <str>), ' fix') END AS title, o_custkey % 3 AS approvals FROM orders"""


@query("f47_change_gate", f"""SELECT o_orderkey, concat_ws('|', CASE WHEN risk IS NULL THEN 'risk label missing' END, CASE WHEN title = 'fix things' THEN 'ticket key missing' END,
  CASE WHEN approvals < CASE WHEN risk = 'URGENT' THEN 2 WHEN risk = 'LOW' THEN 0 ELSE 1 END THEN 'approvals missing' END) AS failed FROM ({CHANGES})""")
def f47(t):
    df = G.change_gate(t.sql(CHANGES), ["URGENT", "HIGH", "MEDIUM", "LOW"], {"URGENT": 2, "LOW": 0})
    return df.select("o_orderkey", F.array_join("failed", "|").alias("failed"))


PRINT = """SELECT {key}, md5(concat_ws(':', count(*), sum(h::HUGEINT), bit_xor(h))) AS fingerprint FROM
(SELECT *, ('0x' || substr(md5(concat_ws(chr(31), event_id::VARCHAR, user_id::VARCHAR, {extra})), 1, 15))::BIGINT AS h FROM (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)) GROUP BY {key}"""


@query("f48_fingerprints", PRINT.format(key="event_type", extra="coalesce(props, chr(0))"))
def f48(t):
    return G.fingerprints(t["events"], ["event_type"], ["event_id", "user_id", "props"])


@query("f48_skip_unchanged", f"""SELECT a.day FROM ({PRINT.format(key="day", extra="event_type")}) a
WHERE NOT EXISTS (SELECT 1 FROM ({PRINT.format(key="day", extra="CASE WHEN user_id = 7 AND event_type = 'error' THEN 'view' ELSE event_type END")}) b WHERE a.day = b.day AND a.fingerprint = b.fingerprint)""")
def f48_skip(t):
    rows = t["events"].withColumn("day", F.col("ts").cast("date").cast("string"))
    before = rows.withColumn("event_type", F.when((F.col("user_id") == 7) & (F.col("event_type") == "error"), "view").otherwise(F.col("event_type")))
    cols = ["event_id", "user_id", "event_type"]
    return G.changed_since(G.fingerprints(rows, ["day"], cols), G.fingerprints(before, ["day"], cols), ["day"]).select("day")


def _sensitive_sql() -> str:
    from attestry import fixed_values as V

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [f"SELECT doc_id, '{name}' AS rule, unnest(regexp_extract_all(text, {quote(p)})) AS hit FROM documents" for name, p, _ in V.SENSITIVE_PATTERNS]
    return f"SELECT doc_id, rule, hit, count(*) AS times FROM ({' UNION ALL '.join(parts)}) WHERE NOT regexp_matches(hit, {quote('|'.join(V.SENSITIVE_ALLOWED))}) GROUP BY ALL"


@query("f49_sensitive_scan", _sensitive_sql())
def f49(t):
    return G.sensitive_hits(t["documents"].select("doc_id", "text")).groupBy("doc_id", "rule", "hit").agg(F.count("*").alias("times"))
