"""Events against access windows: who had one, who did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry import fixed_values as V
from attestry.functions import identity, resources
from attestry.functions.text import blank_to_null, clean, col, filled, first_filled
from attestry.functions.times import day_bounds, local_date, parse_time
from attestry.operators.intervals import interval_union
from attestry.operators.joins import SALTS, first_per_key, salted_left_join, with_columns_or_null
from attestry.operators.whitelist import drop_whitelisted
from attestry.schemas import EVENT_COLUMNS, USER_IDENTITY

HOUR = 3600
#: Seconds; more than any local day has.
LONG_SPAN = 26 * HOUR
REQUEST_FIELDS = ["jira_issue_id", "justification", "request_timestamp", "duration_minutes"]


def conform(events: DataFrame, zone: str = V.DEFAULT_ZONE) -> DataFrame:
    """Event rows with every optional column, ``ord``, ``src_rank``, ``event_ts`` and ``local_date``.

    A parseable time decides the local day; a given ``local_date`` counts only
    for rows whose time cannot be read.
    """
    df = with_columns_or_null(events, EVENT_COLUMNS)
    if "userIdentity" not in df.columns:
        df = df.withColumn("userIdentity", F.lit(None).cast(USER_IDENTITY))
    if not isinstance(df.schema["userIdentity"].dataType, StructType):
        raise TypeError("userIdentity must be a struct")
    if "src_rank" not in df.columns:
        df = df.withColumn("src_rank", F.when(identity.is_object_event(), 0).otherwise(1))
    df = with_columns_or_null(df, ["local_date"]).withColumn("event_ts", parse_time("eventTime"))
    return df.withColumn("local_date", F.coalesce(local_date("event_ts", zone), "local_date"))


def requests_by_identifier(requests: DataFrame) -> DataFrame:
    """One row per request and distinct identifier it is known under."""
    df = with_columns_or_null(requests, ["user_id", "user_email", "user_name"])
    names = F.array(*[F.when(filled(c), clean(c)) for c in ("user_id", "user_email", "user_name")])
    return df.withColumn("ident", F.explode(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))))


def owner_emails(tags: DataFrame) -> DataFrame:
    """(iam_user, owner_email) from ``user_name, tag_key, tag_value[, ordinal]``."""
    df = tags if "ordinal" in tags.columns else tags.withColumn("ordinal", F.lit(0))
    found = df.where("tag_key = 'owner'").select(
        col("user_name").alias("iam_user"), "ordinal", "tag_value",
        identity.find_email(clean("tag_value")).alias("owner_email"),
    ).where("owner_email is not null")
    return first_per_key(found, ["iam_user"], ["ordinal", "tag_value"]).select("iam_user", "owner_email")


def resolve_actors(events: DataFrame, tags: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Add ``raw_user_id``, ``user_id`` (resolved email) and ``actor_type``."""
    # one step each: an expression is repeated wherever its empty text counts as null
    df = events.withColumn("_derived", identity.derived_identifier())
    df = df.withColumn("raw_user_id", identity.raw_identifier("_derived")).drop("_derived")
    if tags is None:
        df = df.withColumn("owner_email", F.lit(None).cast("string"))
    else:
        df = df.withColumn("iam_user", identity.iam_user_name())
        df = salted_left_join(df, owner_emails(tags), ["iam_user"], "ord", salts).drop("iam_user")
    df = df.withColumn("user_id", identity.resolved_email())
    return df.withColumn("actor_type", identity.actor_type("user_id")).drop("owner_email")


def access_candidates(events: DataFrame, db_arn_map: dict[str, str] | None = None, databases: list[str] | None = None,
                      db_users: list[str] = (), actors: dict[str, list[str]] | None = None) -> DataFrame:
    """Conformed events that can be violations: no issuances, a known resource, not whitelisted."""
    df = events.where(F.coalesce(col("eventName") != V.CREDS_ISSUED, F.lit(True)))
    df = df.withColumn("resource_arn", resources.resource_arn(db_arn_map, databases))
    return drop_whitelisted(df.where("resource_arn <> ''"), db_users, actors)


def _windows(requests: DataFrame) -> DataFrame:
    start = parse_time(first_filled("timestamp"))
    return requests.withColumn("win_start", start).withColumn("win_end", _end())


def _end() -> Column:
    return col("win_start") + F.make_dt_interval(mins=F.coalesce(col("duration_minutes").cast("int"), F.lit(0)))


def _hour(ts: Column | str) -> Column:
    return F.floor(col(ts).cast("double") / HOUR).cast("long")


def latest_request(known: DataFrame, keys: list[str]) -> DataFrame:
    """Newest request per key (J6, W4), ties by request id."""
    kept = first_per_key(known, keys, [F.desc("timestamp"), F.asc("request_id")])
    kept = with_columns_or_null(kept, ["justification", "request_timestamp"])
    stamp = first_filled("timestamp", "request_timestamp")
    return kept.select(*keys, F.struct(
        "jira_issue_id", "justification", stamp.alias("request_timestamp"), col("duration_minutes").cast("int").alias("duration_minutes"),
    ).alias("matched_request"))


def access_spans(known: DataFrame, keys: list[str], zone: str | None) -> DataFrame:
    """Disjoint spans (keys, lo, hi) that the access windows of a person cover; with ``zone`` they end with their local day."""
    # Stamps are read in the aggregation: above it they would be copied into every filter that is pushed below.
    minutes = F.max(F.coalesce(col("duration_minutes").cast("int"), F.lit(0))).alias("duration_minutes")
    df = known.groupBy(*keys, "timestamp").agg(F.max(parse_time(first_filled("timestamp"))).alias("win_start"), minutes)
    df = df.withColumn("win_end", _end()).where("win_start is not null")
    if zone:
        first, following = day_bounds("local_date", zone)
        df = df.withColumns({"win_start": F.greatest("win_start", first), "win_end": F.least("win_end", following)})
    return interval_union(df.select(*keys, col("win_start").alias("lo"), col("win_end").alias("hi")), keys, "lo", "hi", daily=bool(zone))


def _long(lo: Column | str = "lo", hi: Column | str = "hi") -> Column:
    return col(hi).cast("double") - col(lo).cast("double") > LONG_SPAN


def hourly_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of at most ``LONG_SPAN`` seconds cut at hours: per (keys, hour) an array of (lo, hi), inclusive.

    A span gives a few pieces at most, and an array holds disjoint pieces of one hour.
    """
    df = spans.where(~_long()).withColumn("hour", F.explode(F.sequence(_hour("lo"), _hour("hi"))))
    opens = F.timestamp_seconds(col("hour") * HOUR)
    pieces = df.select(*keys, "hour", F.greatest("lo", opens).alias("lo"), F.least("hi", F.timestamp_seconds((col("hour") + 1) * HOUR)).alias("hi"))
    return pieces.groupBy(*keys, "hour").agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))


def long_spans(spans: DataFrame) -> DataFrame:
    """Spans of more than ``LONG_SPAN`` seconds, whole: per person an array of (lo, hi).

    They are disjoint and longer than a day, so the array grows with the days that the data spans, never with the requests.
    """
    return spans.where(_long()).groupBy("ident").agg(F.collect_list(F.struct("lo", "hi")).alias("long_windows"))


def with_coverage(events: DataFrame, requests: DataFrame, zone: str = V.DEFAULT_ZONE, carry_over: bool = False, salts: int = SALTS) -> DataFrame:
    """Add ``covered``: the event lies inside an access window of its person.

    Each event looks only at requests of its own local day; ``carry_over=True`` looks at all
    days.  Windows are united first.  The join key holds the hour, so a busy person's events
    spread over the cluster and an event meets one row.  Windows of several days, which only
    ``carry_over`` knows, stay whole and meet the event by its person: a window costs a few
    rows however long it is.
    """
    keys = ["ident"] if carry_over else ["ident", "local_date"]
    spans = access_spans(requests_by_identifier(requests), keys, None if carry_over else zone)
    df = events.withColumns({"ident": blank_to_null("user_id"), "hour": _hour("event_ts")})
    df = salted_left_join(df, hourly_spans(spans, keys), [*keys, "hour"], "ord", salts=1)
    inside = lambda w: col("event_ts").between(w["lo"], w["hi"])
    covered = F.coalesce(F.exists("windows", inside), F.lit(False))
    if carry_over:
        df = salted_left_join(df, long_spans(spans), ["ident"], "ord", salts)
        covered = covered | F.coalesce(F.exists("long_windows", inside), F.lit(False))
    return df.withColumn("covered", covered).drop("ident", "hour", "windows", "long_windows")


def with_request(events: DataFrame, requests: DataFrame, carry_over: bool = False, salts: int = SALTS) -> DataFrame:
    """Add ``matched_request``: the newest request of the person, null without any."""
    keys = ["ident"] if carry_over else ["ident", "local_date"]
    newest = latest_request(requests_by_identifier(requests), keys)
    df = events.withColumn("ident", blank_to_null("user_id"))
    return salted_left_join(df, newest, keys, "ord", salts if carry_over else 1).drop("ident")


def day_lookup(requests: DataFrame, zone: str = V.DEFAULT_ZONE) -> DataFrame:
    """One row per person and local day with requests: ``windows``, a map from each hour to its spans, and ``matched_request``.

    A day has a few hours, and the spans of an hour are disjoint, so a row stays small however often somebody asks.
    """
    keys = ["ident", "local_date"]
    known = requests_by_identifier(requests)
    by_hour = hourly_spans(access_spans(known, keys, zone), keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("hour", "windows"))).alias("windows"))
    return latest_request(known, keys).join(by_hour, keys, "left")


def with_day_lookup(events: DataFrame, requests: DataFrame, zone: str = V.DEFAULT_ZONE) -> DataFrame:
    """Day-scoped ``covered`` and ``matched_request`` by one join: an event looks at the requests of its own local day.

    A task that a busy person's day makes too large is split by adaptive execution.
    """
    df = salted_left_join(events.withColumn("ident", blank_to_null("user_id")), day_lookup(requests, zone), ["ident", "local_date"], "ord", salts=1)
    inside = F.exists(F.try_element_at("windows", _hour("event_ts")), lambda w: col("event_ts").between(w["lo"], w["hi"]))
    return df.withColumn("covered", F.coalesce(inside, F.lit(False))).drop("ident", "windows")


def match_requests(events: DataFrame, requests: DataFrame, zone: str = V.DEFAULT_ZONE, carry_over: bool = False,
                   salts: int = SALTS) -> DataFrame:
    """All events with ``covered`` and ``matched_request``."""
    return with_request(with_coverage(events, requests, zone, carry_over, salts), requests, carry_over, salts)


def unapproved(matched: DataFrame) -> DataFrame:
    """Events outside every window, with ``type`` and ``severity``.

    An unreadable time with a request leaves no trace; without one it is a violation.
    """
    has = col("matched_request").isNotNull()
    return matched.where(~col("covered") & (~has | col("event_ts").isNotNull())).withColumns({
        "type": F.when(has, V.OUTSIDE_WINDOW).otherwise(V.UNAUTHORIZED),
        "severity": F.when(has, V.MEDIUM).otherwise(V.HIGH),
    })


# The type is not in the key: person and day decide it.
VIOLATION_KEY = ["user_id", "eventTime", "resource_arn", "eventName", "local_date"]
VIOLATION_ORDER = ["src_rank", "ord"]


def keep_first_violation(rows: DataFrame) -> DataFrame:
    """One row per violation key within a day; the first in event order stays."""
    return first_per_key(rows, VIOLATION_KEY, VIOLATION_ORDER)


def as_violations(rows: DataFrame) -> DataFrame:
    """Final violation records."""
    arn = col("resource_arn")
    reason = F.when(col("type") == V.UNAUTHORIZED, F.concat(F.lit("Access to "), arn, F.lit(" without approved request"))).otherwise(
        F.concat(F.lit("Access to "), arn, F.lit(" outside approved time window")))
    return rows.select(
        "ord", "src_rank", "local_date", "type", "severity", "user_id", "actor_type", "resource_arn",
        col("eventTime").alias("event_time"), col("eventName").alias("event_name"), reason.alias("description"),
        resources.resource_details().alias("resource_details"), resources.evidence("user_id").alias("evidence"),
        "matched_request",
    )
