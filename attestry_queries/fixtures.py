"""Views over the driver tables that play the jobs' inputs, in SQL both engines run.

``<str>`` is STRING in Spark and VARCHAR in DuckDB.  Every view covers its whole
table; roles (request or issuance, bucket, actor) follow from row values.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "fx_events": """
SELECT event_id, user_id, event_type,
  CAST(date_trunc('second', ts) AS <str>) AS event_time,
  CAST(CAST(ts AS DATE) AS <str>) AS local_date,
  CASE event_type WHEN 'view' THEN 'GetObject' WHEN 'click' THEN 'PutObject'
    WHEN 'purchase' THEN 'DbSessionConnect' ELSE 'DbSessionDisconnect' END AS event_name,
  CASE WHEN event_type IN ('view','click') THEN 's3.amazonaws.com' END AS event_source,
  CASE WHEN event_type IN ('view','click') THEN concat('bucket-', CAST(event_id % 4 AS <str>)) END AS req_bucket,
  CASE WHEN event_type IN ('view','click') THEN concat('customer/', CAST(event_id % 97 AS <str>), '.csv') END AS req_key,
  CASE WHEN event_type IN ('purchase','error') THEN concat('db_', CAST(event_id % 3 AS <str>)) END AS db_name,
  CASE WHEN event_type IN ('purchase','error') THEN concat('v-user', CAST(user_id AS <str>)) END AS db_username,
  CASE WHEN event_type NOT IN ('view','click') THEN NULL
    WHEN user_id % 10 = 0 THEN concat('AROAX', CAST(user_id AS <str>))
    WHEN user_id % 10 = 1 THEN concat('AROAX', CAST(user_id AS <str>), ':k8s-irsa-job')
    WHEN user_id % 10 = 2 THEN concat('AIDAX', CAST(user_id AS <str>))
    WHEN user_id % 10 = 3 THEN concat('AROAX', CAST(user_id AS <str>), ':session')
    ELSE concat('AROAX', CAST(user_id AS <str>), ':User', CAST(user_id AS <str>), '@example.com') END AS principal_id,
  CASE WHEN event_type NOT IN ('view','click') THEN NULL WHEN user_id % 10 = 2 THEN 'IAMUser' ELSE 'AssumedRole' END AS identity_type,
  CASE WHEN event_type IN ('view','click') AND user_id % 10 = 2 THEN concat('arn:aws:iam::123456789012:user/u', CAST(user_id AS <str>)) END AS identity_arn,
  CASE WHEN event_type IN ('view','click') AND user_id % 10 = 0 THEN 'athena.amazonaws.com' ELSE concat('10.0.0.', CAST(user_id % 250 AS <str>)) END AS source_ip
FROM events WHERE event_type <> 'signup'""",
    "fx_requests": """
SELECT event_id AS request_id, CAST(date_trunc('second', ts) AS <str>) AS request_time,
  CAST(CAST(ts AS DATE) AS <str>) AS local_date,
  concat('user', CAST(user_id AS <str>), '@example.com') AS user_email,
  CASE event_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 30 ELSE 60 END AS duration_minutes,
  concat('PROJ-', CAST(event_id AS <str>)) AS jira_issue_id
FROM events WHERE event_type = 'signup' AND event_id % 4 <> 0""",
    "fx_issuances": """
SELECT event_id AS issue_id, CAST(date_trunc('second', ts) AS <str>) AS event_time,
  CAST(CAST(ts AS DATE) AS <str>) AS local_date,
  concat('v-user', CAST(user_id AS <str>)) AS db_username,
  concat('oidc-user', CAST(user_id AS <str>), '@example.com') AS auth_display_name,
  concat('lease-', CAST(event_id AS <str>)) AS lease_id
FROM events WHERE event_type = 'signup' AND event_id % 4 = 0""",
    "fx_log_lines": """
SELECT event_id, CASE event_type
  WHEN 'purchase' THEN concat(CAST(date_trunc('second', ts) AS <str>), ' UTC:10.0.0.1(45986):u', CAST(user_id AS <str>), '@db_', CAST(event_id % 3 AS <str>), ':[', CAST(event_id AS <str>), ']:LOG:  connection authorized: user=u', CAST(user_id AS <str>), ' database=db_', CAST(event_id % 3 AS <str>))
  WHEN 'error' THEN concat(CAST(date_trunc('second', ts) AS <str>), ' UTC:10.0.0.1(45986):u', CAST(user_id AS <str>), '@db_', CAST(event_id % 3 AS <str>), ':[', CAST(event_id AS <str>), ']:LOG:  disconnection: session time: 0:', CAST(10 + event_id % 50 AS <str>), ':07 user=u', CAST(user_id AS <str>), ' database=db_', CAST(event_id % 3 AS <str>))
  WHEN 'signup' THEN concat('{"time":"', CAST(date_trunc('second', ts) AS <str>), 'Z","request":{"path":"database/creds/', CASE WHEN event_id % 2 = 0 THEN 'prod' ELSE 'dev' END, '-ro"},"auth":{"display_name":"oidc-user', CAST(user_id AS <str>), '@example.com"},"response":{"data":{"username":"v-user', CAST(user_id AS <str>), '"},"secret":{"lease_id":"lease-', CAST(event_id AS <str>), '"}}}')
  ELSE 'this is not a parseable log line' END AS message
FROM events""",
    # Object and session events with agents, issuers and user names added.
    "fx_audit": """
SELECT event_id AS ord, local_date, event_time, event_name, event_source,
  CASE WHEN event_source IS NOT NULL THEN 'eu-central-1' END AS aws_region,
  CASE WHEN event_source IS NULL OR event_id % 13 <> 0 THEN source_ip END AS source_ip,
  CASE WHEN event_source IS NULL THEN NULL WHEN event_id % 13 = 0 AND user_id % 10 = 3 THEN 'Config.amazonaws.com'
    WHEN event_id % 7 = 0 THEN NULL ELSE 'aws-sdk-python' END AS user_agent,
  identity_type, principal_id, identity_arn,
  CASE WHEN event_source IS NULL OR user_id % 10 IN (0, 2) THEN NULL WHEN user_id % 20 = 3 THEN 'Batch-prod'
    WHEN user_id % 10 = 1 THEN 'k8s-irsa-loader' ELSE 'Reader' END AS issuer,
  CASE WHEN event_source IS NOT NULL AND user_id % 10 = 2 THEN concat('U', CAST(user_id AS <str>)) END AS user_name,
  CASE WHEN event_source IS NOT NULL THEN '123456789012' END AS account_id,
  CASE WHEN event_source IS NOT NULL THEN concat('req-', CAST(event_id AS <str>)) END AS request_no,
  req_bucket, req_key, db_username, db_name, user_id
FROM fx_events""",
    "fx_owner_tags": """
SELECT DISTINCT concat('u', CAST(user_id AS <str>)) AS user_name,
  CASE WHEN user_id % 20 = 2 THEN 'owner' ELSE 'team' END AS tag_key,
  concat(' User', CAST(user_id AS <str>), '@Example.com') AS tag_value
FROM events""",
    # Audit controls, documents linked to them, and an evidence index with faults.
    "fx_controls": """
SELECT CAST(p_partkey AS <str>) AS id, concat(p_type, '-', CAST(p_partkey AS <str>)) AS external_id,
  concat(p_type, '-', CAST(p_partkey AS <str>), ' ', p_name) AS name, p_partkey, p_type, p_size
FROM part""",
    "fx_links": """
SELECT l_partkey, l_suppkey, l_partkey * 10000000000 + l_suppkey AS ord, min(l_returnflag) AS flag
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "fx_evidence": """
SELECT k.ord, CASE WHEN k.l_suppkey % 41 = 7 THEN '' ELSE p.p_type END AS family,
  CASE WHEN k.l_suppkey % 10 = 1 AND k.l_partkey % 50 = 3 THEN ''
       WHEN k.l_suppkey % 37 = 5 THEN 'OLD-1' ELSE concat(p.p_type, '-', CAST(p.p_partkey AS <str>)) END AS control,
  CASE WHEN k.flag = 'A' THEN 'local_file' WHEN k.flag = 'N' THEN 'confluence' ELSE 'external_url' END AS source_type,
  CASE WHEN k.flag = 'A' THEN concat('docs/', p.p_type, '/s', CAST(k.l_suppkey AS <str>), '.txt')
       ELSE concat('https://wiki.example.com/', CAST(k.l_suppkey AS <str>)) END AS link,
  CASE WHEN k.l_suppkey % 29 = 3 THEN 'done' WHEN k.flag = 'A' THEN 'ready' ELSE 'needs_manual_fetch' END AS status,
  CASE WHEN k.flag = 'A' THEN 'evidence' ELSE 'none' END AS doc_type
FROM fx_links k JOIN part p ON p.p_partkey = k.l_partkey""",
}
_NEEDS = {n: [v for v in [*VIEWS] if v != n and re.search(rf"\b{v}\b", sql)] for n, sql in VIEWS.items()}


def _ordered(names: list[str]) -> list[str]:
    done: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            add(m)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return done


def oracle(body: str, *extra: str) -> str:
    """DuckDB SQL: ``body`` with the views it names put in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    parts = [f"{n} AS ({VIEWS[n]})" for n in _ordered(used)] + list(extra)
    text = body.strip()
    if parts:
        head = ", ".join(parts)
        text = f"WITH {head}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {head} {text}"
    return text.replace("<str>", "VARCHAR")


class Inputs:
    """Tables and views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # HotSpot compiles no method of more than 8000 bytes; longer ones would be interpreted row by row.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        # Joins whose smaller side has small partitions, as measured at run time, hash it instead of sorting both sides.
        spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):  # as on one machine, in tests
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="attestry-"))
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str) -> DataFrame:
        """Run SQL over the tables and views it names."""
        text = body.replace("<str>", "STRING")
        views = _ordered([n for n in VIEWS if re.search(rf"\b{n}\b", text)])
        scope = " ".join([text, *[VIEWS[v] for v in views]])
        tables = {t: self[t] for t in TABLES if re.search(rf"\b{t}\b", scope)}
        for t, df in tables.items():
            df.createOrReplaceTempView(t)
        if views:
            head = ", ".join(f"{v} AS ({VIEWS[v].replace('<str>', 'STRING')})" for v in views)
            text = f"WITH {head} {text}" if not text.lstrip().upper().startswith("WITH ") else f"WITH {head}, {text.lstrip()[5:]}"
        return self.spark.sql(text)


class StreamInputs(Inputs):
    """The same tables and views read as streams."""

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        # A pattern, because a stream's plain path has to be a folder and this may be one file.
        return self.spark.readStream.schema(schema).parquet(f"{path}*")
