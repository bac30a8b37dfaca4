"""Registered queries: stores that are written, counted, brought up to date and read back; positions in an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.fixed_values import EVIDENCE_COLUMNS
from attestry.operators import controls as C
from attestry.operators import gaps as G
from attestry.operators import governance as V
from attestry.operators import logs as L
from attestry.operators import report as R
from attestry.operators.correlate import conform
from attestry.sources import files, sinks
from attestry.streaming.runner import run_observed, scratch
from attestry_queries import access as A
from attestry_queries import evidence, ingest
from attestry_queries.fixtures import Inputs, StreamInputs, oracle
from attestry_queries.reports import PERIOD

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


# --- S17, A11: counters of the pass that writes ------------------------------------

@query("s17_sink_counts", f"""{ingest.INGESTED} SELECT count(*) FILTER (who <> 'u7') AS accepted, count(*) FILTER (who = 'u7') AS rejected,
  count(*) FILTER (who <> 'u7') AS stored FROM kept""")
def s17(t):
    """A sink that takes no event of one user: what it took and refused, and what the store holds."""
    path = scratch(t.spark, "s17")
    records = L.sink_records(ingest._ingested(t), ingest.ARN)
    counts = sinks.write_counted(records, path, F.col("eventData.userIdentity.principalId") == "u7", tolerate=True)
    stored = t.spark.read.schema(records.schema).parquet(path)
    return stored.agg(F.count("*").alias("stored")).withColumns({k: F.lit(v).cast("bigint") for k, v in counts.items()})


@query("a11_stream_counts", """SELECT count(*) AS parsed_messages, count(*) FILTER (event_type IN ('purchase','error') OR (event_type = 'signup' AND event_id % 2 = 0)) AS emitted_events,
  count(*) AS landed FROM events""")
def a11(t):
    """The counters that a stream observes while its rows pass, next to the rows themselves."""
    base = scratch(t.spark, "a11")
    lines = ingest.lines(StreamInputs(t.spark, t.dir))
    counted = L.ingest_counters(L.with_credential_event(L.with_db_event(lines, "ingest_ts"), "ingest_ts"))
    totals = run_observed(counted.select("ord"), f"{base}/out", f"{base}/state")["ingest"]
    return t.spark.read.parquet(f"{base}/out").agg(F.count("*").alias("landed")).withColumns({k: F.lit(v).cast("bigint") for k, v in totals.items()})


# --- S5: a store partitioned by day --------------------------------------------------

def asked_days(t: Inputs):
    return t.sql("SELECT DISTINCT local_date FROM fx_issuances WHERE issue_id % 40 = 0")


def pruned_requests(t: Inputs):
    """Requests of the days asked for; files of other days are not read."""
    path = scratch(t.spark, "requests")
    rows = A.requests(t)
    sinks.write_requests(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path).join(asked_days(t), "local_date")


@query("s5_pruned_store", "SELECT CAST(request_id AS VARCHAR) AS request_id, local_date, user_email, CAST(duration_minutes AS INTEGER) AS duration_minutes FROM fx_requests WHERE local_date IN (SELECT local_date FROM fx_issuances WHERE issue_id % 40 = 0)")
def s5(t):
    return pruned_requests(t).select("request_id", "local_date", "user_email", "duration_minutes")


# --- F48: only what changed is rewritten ----------------------------------------------

CONTENT = ["event_id", "user_id", "event_type"]


def two_cycles(t: Inputs):
    """Rows of two cycles; in the second some days differ, as one user's errors are views."""
    rows = t["events"].select(*CONTENT, F.col("ts").cast("date").cast("string").alias("day"))
    changed = F.when((F.col("user_id") == 7) & (F.col("event_type") == "error"), "view").otherwise(F.col("event_type"))
    return rows, rows.withColumn("event_type", changed)


@query("f48_incremental", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, user_id, CASE WHEN user_id = 7 AND event_type = 'error' THEN 'view' ELSE event_type END AS event_type FROM events""")
def f48(t):
    store = scratch(t.spark, "f48")
    before, after = two_cycles(t)
    passed = V.rewrite_changed(before, ["day"], CONTENT, store)
    V.rewrite_changed(after, ["day"], CONTENT, store, passed)
    return t.spark.read.schema(before.schema).parquet(store).select("day", *CONTENT)


# --- L1, L2, L5: positions ----------------------------------------------------------------

@query("l1_event_order", """SELECT ord, row_number() OVER (ORDER BY CASE WHEN event_source IS NULL THEN 1 ELSE 0 END, event_time DESC, ord) - 1 AS position FROM (
  SELECT ord, event_source, event_time FROM fx_audit UNION ALL SELECT issue_id, NULL, event_time FROM fx_issuances)""")
def l1(t):
    events = conform(A.S.union_sources(A.named_objects(t), A.curated(t)), "UTC")
    return R.event_order(events.select("ord", "src_rank", "eventTime")).select("ord", "position")


@query("l2_group_order", f"""WITH {A.MATCHED} SELECT user_email, violations_count, row_number() OVER (ORDER BY violations_count DESC, user_email) - 1 AS position
FROM (SELECT email AS user_email, count(*) AS violations_count FROM violations WHERE email IS NOT NULL GROUP BY email)""")
def l2(t):
    return R.ranked_human_groups(A.violations(t))


@query("l5_control_order", """SELECT p_type AS family, external_id AS sort_key, row_number() OVER (PARTITION BY p_type ORDER BY external_id, id) - 1 AS position,
  dense_rank() OVER (ORDER BY p_type) - 1 AS family_no FROM fx_controls""")
def l5(t):
    return C.control_order(C.families(evidence.controls(t), [])).select("family", "sort_key", "position", "family_no")


# --- S18: whole headers -----------------------------------------------------------------------

CATS = {"s3_unauthorized_access": "resource_arn LIKE 'arn:aws:s3:::%' AND type = 'UNAUTHORIZED_ACCESS'", "s3_outside_window": "resource_arn LIKE 'arn:aws:s3:::%' AND type = 'ACCESS_OUTSIDE_WINDOW'",
        "db_unauthorized_access": "resource_arn NOT LIKE 'arn:aws:s3:::%' AND type = 'UNAUTHORIZED_ACCESS'", "db_outside_window": "resource_arn NOT LIKE 'arn:aws:s3:::%' AND type = 'ACCESS_OUTSIDE_WINDOW'"}
ACTORS = {"human_actors": "HUMAN", "service_principals": "SERVICE_PRINCIPAL", "service_accounts": "SERVICE_ACCOUNT", "aws_services": "AWS_SERVICE", "unknown_actors": "UNKNOWN"}
CATEGORIES = ["SERVICE_PRINCIPAL", "AWS_SERVICE", "UNKNOWN", "SERVICE_ACCOUNT"]
HEADER_SQL = ", ".join([f"count(*) FILTER ({c}) AS {n}" for n, c in CATS.items()] + [f"count(*) FILTER (actor_type = '{k}') AS {n}" for n, k in ACTORS.items()]
                       + [f"count(*) FILTER (email IS NULL AND actor_type = '{k}') AS {k.lower()}_category" for k in CATEGORIES])


@query("s18_whole_header", f"""WITH {A.MATCHED}, v AS (SELECT local_date, count(*) AS total_violations_found, count(*) FILTER (email IS NULL) AS non_human_total, {HEADER_SQL} FROM violations GROUP BY local_date),
e AS (SELECT local_date, count(*) AS n FROM (SELECT local_date FROM fx_audit UNION ALL SELECT local_date FROM fx_issuances) GROUP BY local_date),
r AS (SELECT local_date, count(*) AS n FROM fx_requests GROUP BY local_date),
d AS (SELECT local_date FROM e UNION SELECT local_date FROM r UNION SELECT local_date FROM v)
SELECT d.local_date, coalesce(e.n, 0) AS events_processed, coalesce(r.n, 0) AS access_requests_found, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["total_violations_found", "non_human_total", *CATS, *ACTORS, *(f"{k.lower()}_category" for k in CATEGORIES)])},
  '{PERIOD["start"]}' AS start, '{PERIOD["end"]}' AS "end", '{PERIOD["start_local"]}' AS start_local, '{PERIOD["end_local"]}' AS end_local, 'run' AS generated_at, 1.235 AS execution_duration_seconds
FROM d LEFT JOIN e USING (local_date) LEFT JOIN r USING (local_date) LEFT JOIN v USING (local_date)""")
def s18(t):
    run = {"generated_at": "run", "execution_duration_seconds": "1.23456"}
    df = R.report_headers(A.S.union_sources(A.named_objects(t), A.curated(t)), A.requests(t), A.violations(t), PERIOD, run, ["local_date"])
    other = F.col("non_human_violations.by_category")
    return df.select(
        "local_date", "execution_summary.*", "violations_by_category.*", "violations_by_actor_type.*", F.col("non_human_violations.total_count").alias("non_human_total"),
        *(other[k].alias(f"{k.lower()}_category") for k in CATEGORIES), "time_period.*", "report_metadata.*")


# --- A12: totals -----------------------------------------------------------------------------

@query("a12_rollup", f"""WITH {evidence.JUDGED} SELECT family, band, count(*) AS controls, grouping_id(family, band)::INTEGER AS level FROM (
  SELECT family, CASE WHEN final_score IS NULL THEN 'fetch' WHEN final_score >= 8 THEN 'adequate' WHEN final_score >= 4 THEN 'partial' ELSE 'significant' END AS band FROM judged)
GROUP BY ROLLUP (family, band)""")
def a12(t):
    return G.band_totals(evidence.judged(t))


# --- S12, S13, S16: files that are written and read back ------------------------------

@query("s12_index_round_trip", """SELECT 'DOC' || doc_id AS control, coalesce(source, '') AS family, coalesce(text, '') AS link FROM documents""")
def s12(t):
    """An index whose cells hold whole documents, with their quotes and line ends, through its CSV file."""
    path = scratch(t.spark, "s12")
    told = {"control": F.concat(F.lit("DOC"), F.col("doc_id").cast("string")), "family": F.col("source"), "link": F.col("text")}
    sinks.write_index(t["documents"].select(*(told.get(c, F.lit("")).alias(c) for c in EVIDENCE_COLUMNS)), path)
    return files.read_index(t.spark, path).select("control", "family", "link")


@query("s13_families", "SELECT DISTINCT p_type AS family, 'Family \"' || p_type || '\"' AS display_name FROM part")
def s13(t):
    """Display names of families from the JSON object that lists them."""
    path = scratch(t.spark, "s13")
    names = t["part"].select(F.col("p_type").alias("key"), F.concat(F.lit('Family "'), "p_type", F.lit('"')).alias("value")).distinct()
    names.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value"))))).write.mode("overwrite").text(path)
    return files.read_families(t.spark, path)


@query("s16_inventory_files", f"""SELECT c.external_id, c.name, c.p_type AS family, concat('{evidence.APP}/controls/', c.id) AS control_url,
  coalesce(string_agg(concat('Doc ', k.l_suppkey), '; ' ORDER BY k.ord), '') AS document_titles, true AS same_in_csv
FROM fx_controls c LEFT JOIN fx_links k ON k.l_partkey = c.p_partkey GROUP BY ALL""")
def s16(t):
    """The control inventory as JSON lines, and whether its CSV holds the same row."""
    path = scratch(t.spark, "s16")
    inventory = evidence.a9(t)
    sinks.write_inventory(inventory, f"{path}/csv", f"{path}/json")
    told = t.spark.read.schema(inventory.schema).json(f"{path}/json")
    table = t.spark.read.options(**files.CSV).csv(f"{path}/csv").fillna("").withColumn("same_in_csv", F.lit(True))
    joined = told.fillna("").join(table, inventory.columns, "left")
    return joined.select("external_id", "name", "family", "control_url", "document_titles", F.coalesce("same_in_csv", F.lit(False)).alias("same_in_csv"))
