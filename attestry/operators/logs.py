"""Log lines to audit events: parsing, dedup, sink records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.hashing import account_of, pseudonym
from attestry.functions.text import blank_to_null, col, first_filled, mask
from attestry.functions.times import ISO, line_time, normalize_time
from attestry.operators.joins import first_per_key
from attestry.operators.whitelist import monitored_databases

_CREDENTIAL_RECORD = """
path string, time string, `@timestamp` string, timestamp string, request_id string, mount_type string,
mount_accessor string,
request struct<path: string, id: string, remote_address: string, headers: map<string, array<string>>>,
auth struct<display_name: string, entity_id: string, client_token_accessor: string>,
response struct<data: map<string, string>, secret: struct<lease_id: string>, lease_duration: string, ttl: string>
"""
EVENT_FIELDS = [
    "type", "eventTime", "db_username", "database", "auth_method", "auth_identity", "session_duration_seconds",
    "computed_connect_time", "path", "auth_display_name", "entity_id", "client_token_accessor", "username",
    "lease_ttl_s", "request_id", "response_ts", "mount_type", "mount_accessor", "lease_id", "remote_address", "user_agent",
]


def _groups(pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract("message", pattern, i) for i in range(1, n + 1)]


def with_db_event(lines: DataFrame, ingest_ts: Column | str) -> DataFrame:
    """Add ``db`` struct for connect and disconnect lines, null for others.

    The first of three patterns that matches decides: authorized, authenticated
    with a ``:user@database:`` context, disconnection.
    """
    at = line_time("message", ingest_ts)
    user, database = _groups(V.LINE_AUTHORIZED, 2)
    identity, method = _groups(V.LINE_AUTHENTICATED, 2)
    ctx_user, ctx_database = _groups(V.LINE_CONTEXT, 2)
    hours, minutes, seconds, off_user, off_database = _groups(V.LINE_DISCONNECT, 5)
    duration = hours.cast("long") * 3600 + minutes.cast("long") * 60 + seconds.cast("long")
    began = F.date_format(
        F.timestamp_seconds(F.unix_seconds(F.try_to_timestamp(at, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))) - duration), ISO)

    def event(kind: str, user, database, method=None, identity=None, duration=None, began=None) -> Column:
        def text(c):
            return F.lit(None).cast("string") if c is None else c

        return F.struct(
            F.lit(kind).alias("type"), at.alias("eventTime"), user.alias("db_username"), database.alias("database"),
            text(method).alias("auth_method"), text(identity).alias("auth_identity"),
            (F.lit(None).cast("long") if duration is None else duration).alias("session_duration_seconds"),
            text(began).alias("computed_connect_time"))

    found = (
        F.when(col("message").rlike(V.LINE_AUTHORIZED), event(V.DB_CONNECT, user, database))
        .when(col("message").rlike(V.LINE_AUTHENTICATED) & col("message").rlike(V.LINE_CONTEXT),
              event(V.DB_CONNECT, ctx_user, ctx_database, method, identity))
        .when(col("message").rlike(V.LINE_DISCONNECT),
              event(V.DB_DISCONNECT, off_user, off_database, duration=duration, began=began)))
    # All three patterns hold this word; most lines are done after one plain search.
    return lines.withColumn("db", F.when(F.contains("message", F.lit("connection")), found))


def with_credential_event(lines: DataFrame, ingest_ts: Column | str) -> DataFrame:
    """Add ``cred`` struct for production credential requests and issuances.

    A missing request id becomes the hash of the line, so reruns agree.
    """
    # Only lines that can be a JSON object reach the parser.
    text = F.when(F.startswith(F.ltrim("message"), F.lit("{")), col("message"))
    df = lines.withColumn("_rec", F.from_json(text, _CREDENTIAL_RECORD))
    path = first_filled("_rec.request.path", "_rec.path")
    known = col("_rec.response.data").isNotNull() | col("_rec.response.secret").isNotNull()
    # A response without known fields is empty only if its text is.
    empty = col("_rec.response").isNull() | (~known & (F.get_json_object("message", "$.response") == "{}"))
    data = "_rec.response.data"
    username = first_filled(F.try_element_at(data, F.lit("username")), F.try_element_at(data, F.lit("user")))
    at = F.coalesce(first_filled("_rec.time", "_rec.`@timestamp`", "_rec.timestamp"), line_time("message", ingest_ts))
    issued = ~empty

    def only_issued(c: Column | str) -> Column:
        return F.when(issued, col(c))

    record = F.struct(
        F.when(empty, V.CREDS_REQUEST).otherwise(V.CREDS_ISSUED).alias("type"), at.alias("eventTime"),
        path.alias("path"), col("_rec.auth.display_name").alias("auth_display_name"),
        col("_rec.auth.entity_id").alias("entity_id"),
        col("_rec.auth.client_token_accessor").alias("client_token_accessor"),
        only_issued(username).alias("username"),
        # a lease of zero counts as none
        only_issued(first_filled(F.when(col("_rec.response.lease_duration") != "0", col("_rec.response.lease_duration")), "_rec.response.ttl")).alias("lease_ttl_s"),
        F.coalesce(first_filled("_rec.request_id", "_rec.request.id"), F.sha2(col("message").cast("binary"), 256)).alias("request_id"),
        only_issued(at).alias("response_ts"),
        col("_rec.mount_type").alias("mount_type"), col("_rec.mount_accessor").alias("mount_accessor"),
        only_issued("_rec.response.secret.lease_id").alias("lease_id"),
        col("_rec.request.remote_address").alias("remote_address"),
        F.get(F.try_element_at("_rec.request.headers", F.lit("user-agent")), F.lit(0)).alias("user_agent"))
    kept = F.startswith(path, F.lit(V.PROD_CRED_PATH_PREFIX)) & (empty | username.isNotNull())
    return df.withColumn("cred", F.when(kept, record)).drop("_rec")


def parse_lines(lines: DataFrame, ingest_ts: Column | str = "ingest_ts") -> DataFrame:
    """Parse ``message``; each line becomes at most one event, unparseable lines go.

    Keeps the other columns.  ``ingest_ts`` stands in for a time a line lacks.
    """
    df = with_credential_event(with_db_event(lines, ingest_ts), ingest_ts)
    merged = []
    for f in EVENT_FIELDS:
        places = [s for s in ("db", "cred") if f in df.schema[s].dataType.names]
        value = col(f"{places[0]}.{f}") if len(places) == 1 else F.coalesce(*[col(f"{s}.{f}") for s in places])
        merged.append(value.alias(f))
    keep = [c for c in lines.columns if c != "message"]
    event = F.when(col("db").isNotNull() | col("cred").isNotNull(), F.array(F.struct(*merged)))
    # Exploding an array of one or none drops unparsed lines without a filter, which
    # the optimizer would push below the parsing and so run that twice.
    return df.select(*keep, F.inline(event))


def with_dedup_key(events: DataFrame, ingest_ts: Column | str = "ingest_ts") -> DataFrame:
    """Add ``event_time_norm`` and the four-part key of W2."""
    return events.withColumns({
        "event_time_norm": normalize_time("eventTime", ingest_ts),
        "key_place": F.coalesce(first_filled("database", "path"), F.lit("")),
        "key_user": F.coalesce(first_filled("db_username", "username", "auth_display_name", "auth_identity"), F.lit("")),
    })


DEDUP_KEY = ["type", "event_time_norm", "key_place", "key_user"]


def keep_first_event(events: DataFrame, order: str = "ord", scope: list[str] = ()) -> DataFrame:
    """First event per key (W2); ``scope`` limits the comparison, e.g. to one delivery."""
    return first_per_key(events, [*scope, *DEDUP_KEY], [F.asc(order)])


def sink_records(events: DataFrame, channel_arn: str) -> DataFrame:
    """Sink record per event (F50): id, fixed top-level fields and the rest as a map.

    The id is a hash of the dedup key, so a redelivered event keeps its id.
    """
    on_db, on_cred = col("type").isin(V.DB_CONNECT, V.DB_DISCONNECT), col("type").isin(V.CREDS_ISSUED, V.CREDS_REQUEST)
    principal = (
        F.when(on_db, first_filled("db_username", "auth_identity"))
        .when(on_cred, first_filled("auth_display_name", "entity_id"))
    )
    extra = {f: col(f).cast("string") for f in EVENT_FIELDS if f not in V.DROPPED_NETWORK_FIELDS}
    extra["client_token_accessor"] = pseudonym("client_token_accessor")
    pairs = [x for k, c in extra.items() for x in (F.lit(k), c)]
    return events.select(
        F.sha2(F.concat_ws("\x1f", *DEDUP_KEY).cast("binary"), 256).alias("id"),
        F.struct(
            col("event_time_norm").alias("eventTime"), F.lit(V.DEFAULT_EVENT_SOURCE).alias("eventSource"),
            F.coalesce(blank_to_null("type"), F.lit("Unknown")).alias("eventName"),
            F.struct(F.lit("Unknown").alias("type"), F.coalesce(principal, F.lit("unknown")).alias("principalId")).alias("userIdentity"),
            account_of(F.lit(channel_arn)).alias("recipientAccountId"),
            F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("additionalEventData"),
            blank_to_null("user_agent").alias("userAgent"),
        ).alias("eventData"))


def emitted_summaries(events: DataFrame) -> DataFrame:
    """One short line per event with the user masked."""
    user = mask(first_filled("db_username", "auth_identity", "username"))
    op = F.when(F.endswith("type", F.lit("Disconnect")) | ~F.endswith("type", F.lit("Connect")), "disconnect").otherwise("connect")
    text = (
        F.when(col("type").isin(V.DB_CONNECT, V.DB_DISCONNECT),
               F.concat(F.lit("emit_event db op="), op, F.lit(" user="), F.coalesce(user, F.lit("None")), F.lit(" database="),
                        F.coalesce("database", F.lit("None")), F.lit(" ts="), "eventTime"))
        .when(col("type") == V.CREDS_ISSUED,
              F.concat(F.lit("emit_event vault path="), "path", F.lit(" username="), F.coalesce(mask("username"), F.lit("None")), F.lit(" ts="), "eventTime"))
        .when(col("type") == V.CREDS_REQUEST,
              F.concat(F.lit("emit_event vault_request path="), "path", F.lit(" requester="),
                       F.coalesce(mask("auth_display_name"), F.lit("None")), F.lit(" ts="), "eventTime")))
    return events.withColumn("summary", text)


def ingest(lines: DataFrame, databases: str = "", scope: list[str] = (), ingest_ts: Column | str = "ingest_ts") -> DataFrame:
    """Lines to deduplicated events: parse, filter, keep first.  ``lines`` carries ``ord``."""
    parsed = monitored_databases(parse_lines(lines, ingest_ts), databases)
    return keep_first_event(with_dedup_key(parsed, ingest_ts), scope=list(scope))


def ingest_counters(lines: DataFrame, name: str | Observation = "ingest") -> DataFrame:
    """Observe parsed and emitted counts while the rows pass (A11); ``lines`` has ``db`` and ``cred``."""
    emitted = F.count_if(col("db").isNotNull() | col("cred").isNotNull())
    return lines.observe(name, F.count("*").alias("parsed_messages"), emitted.alias("emitted_events"))


