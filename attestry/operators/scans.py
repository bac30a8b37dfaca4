"""Event and request scans with their pushed-down predicates."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import col
from attestry.functions.times import local_date, parse_time

#: Bits of an event number below the second.
NUMBER_BITS = 30


def monitored_object(buckets: list[str] = (), prefixes: list[str] = (),
                     bucket: str = "reqBucketName", key: str = "reqObjectKey") -> Column | None:
    """Bucket list or bucket/prefix list, joined by OR (P3, P4); None means no limit.

    A prefix widens the bucket list, and ``_`` and ``%`` in it are wildcards.
    """
    names = [b.split(":::")[-1].split("/")[0] for b in buckets or []]
    tests = [col(bucket).isin([n for n in names if n])] if any(names) else []
    for p in prefixes or []:
        b, _, rest = p.partition("/")
        b, rest = b.strip(), rest.strip()
        if b and "/" not in p:
            tests.append(col(bucket) == b)
        elif b and rest:
            tests.append((col(bucket) == b) & col(key).like(rest + "%"))
    return reduce(lambda a, b: a | b, tests) if tests else None


def source_actor_filter(whitelist: dict[str, list[str]] | None, issuer: str = "sessionIssuerUserName",
                        user: str = "userName", agent: str = "userAgent") -> Column | None:
    """Hide whitelisted actors at the scan (P5); null fields always pass."""
    whitelist = whitelist or {}
    keep = []
    for kind, column in ((V.SERVICE_PRINCIPAL, issuer), (V.SERVICE_ACCOUNT, user)):
        entries = [p for p in whitelist.get(kind, []) if p]
        if entries:
            keep.append(col(column).isNull() | ~F.lower(col(column)).isin(entries))
    for p in whitelist.get(V.AWS_SERVICE, []):
        if p:
            keep.append(col(agent).isNull() | ~F.lower(col(agent)).like(f"%{p}%"))
    return reduce(lambda a, b: a & b, keep) if keep else None


def _between(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Inclusive range over stamps in any accepted spelling, to whole seconds.

    Instants are compared. A coarse bound on the day, which sorts alike in every spelling, reaches the file
    scan. Stamps that can't be read are compared as text.
    """
    at = F.date_trunc("second", parse_time(column))
    if start is not None:
        df = df.where(col(column) >= start[:10]).where(F.coalesce(at >= F.date_trunc("second", parse_time(F.lit(start))), col(column) >= start))
    if end is not None:
        following = (dt.date.fromisoformat(end[:10]) + dt.timedelta(days=1)).isoformat()
        df = df.where(col(column) < following).where(F.coalesce(at <= F.date_trunc("second", parse_time(F.lit(end))), col(column) <= end))
    return df


def scan_object_events(raw: DataFrame, start: str | None = None, end: str | None = None,
                       buckets: list[str] = (), prefixes: list[str] = (),
                       whitelist: dict[str, list[str]] | None = None) -> DataFrame:
    """Object-access events of a period in 14 columns plus any carried ``ord``.

    ``raw`` has nested ``userIdentity`` and ``requestParameters``
    (:data:`attestry.schemas.RAW_OBJECT_EVENT`), stamps in any spelling of :func:`parse_time`.
    """
    df = _between(raw, "eventTime", start, end)
    df = df.where((col("eventSource") == V.OBJECT_SOURCE) & col("eventName").isin(V.OBJECT_EVENTS))
    df = df.select(
        *[c for c in ("ord", "local_date") if c in raw.columns],
        "eventTime", "eventName",
        # Constant after the filter: later steps fold their database branches away.
        F.lit(V.OBJECT_SOURCE).alias("eventSource"),
        "awsRegion", "sourceIpAddress", "userAgent",
        col("userIdentity.type").alias("userIdentityType"),
        col("userIdentity.principalId").alias("principalId"),
        col("userIdentity.arn").alias("userIdentityArn"),
        col("userIdentity.sessionContext.sessionIssuer.userName").alias("sessionIssuerUserName"),
        "recipientAccountId", "requestID",
        F.try_element_at("requestParameters", F.lit("bucketName")).alias("reqBucketName"),
        F.try_element_at("requestParameters", F.lit("key")).alias("reqObjectKey"),
        col("userIdentity.userName").alias("_user"),
    )
    for test in (monitored_object(buckets, prefixes), source_actor_filter(whitelist, user="_user")):
        if test is not None:
            df = df.where(test)
    return df.drop("_user")


def scan_curated_events(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Database and credential events of a period (S2); credential requests are not read."""
    df = _between(raw, "eventTime", start, end).where(col("eventData.eventName").isin(V.CURATED_EVENTS))

    def extra(*keys: str) -> Column:
        return F.coalesce(*[F.try_element_at("eventData.additionalEventData", F.lit(k)) for k in keys])

    return df.select(
        *[c for c in ("ord", "local_date") if c in raw.columns],
        "eventTime",
        col("eventData.eventName").alias("eventName"),
        extra("auth_display_name").alias("auth_display_name"),
        extra("db_username", "username", "user").alias("db_username"),
        extra("database").alias("database"),
        extra("path").alias("path"),
        extra("lease_id").alias("lease_id"),
        extra("remote_address", "client_addr").alias("sourceIpAddress"),
        extra("user_agent").alias("userAgent"),
    )


def with_event_number(events: DataFrame, zone: str = V.DEFAULT_ZONE) -> DataFrame:
    """Add what raw stores lack, where it is absent: ``ord`` and ``local_date`` (null for stamps that can't be read).

    The number follows from the event alone, so any run and any partitioning gives the same one without a sort:
    seconds above, 30 bits of a hash of all columns below. It ascends with time; equal events share it.
    """
    at = parse_time("eventTime")
    below = F.xxhash64(F.to_json(F.struct(*events.columns))).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
    number = F.shiftleft(F.coalesce(F.unix_seconds(at), F.lit(0)), NUMBER_BITS).bitwiseOR(below)
    made = {"ord": number, "local_date": local_date(at, zone)}
    return events.withColumns({name: value for name, value in made.items() if name not in events.columns})


def union_sources(objects: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """Both event sources with object events ranked first."""
    out = objects.withColumn("src_rank", F.lit(0))
    if curated is None:
        return out
    return out.unionByName(curated.withColumn("src_rank", F.lit(1)), allowMissingColumns=True)


def requests_for_day(requests: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Requests of one local day inside the window (S5); prunes the ``local_date`` partition."""
    return _between(requests.where(col("local_date") == day), "timestamp", start, end)


def requests_for_range(requests: DataFrame, start: str, end: str) -> DataFrame:
    """Requests of a period whatever their local day."""
    return _between(requests, "timestamp", start, end)


def selected_for_ingest(raw: DataFrame, resource_types: list[str], arn_prefixes: list[str] = (),
                        event_names: list[str] = ()) -> DataFrame:
    """Ingest selectors (S20): data events of the listed resource types.

    Prefix and name limits apply to object resources only.
    """
    prefix_ok = F.lit(True)
    if arn_prefixes:
        prefix_ok = reduce(lambda a, b: a | b, [F.startswith(col("resourceArn"), F.lit(p)) for p in arn_prefixes])
    name_ok = col("eventName").isin(list(event_names)) if event_names else F.lit(True)
    is_object = col("resourceType") == "AWS::S3::Object"
    return raw.where((col("eventCategory") == "Data") & col("resourceType").isin(resource_types)).where(
        ~is_object | (prefix_ok & name_ok)
    )


def db_log_lines(lines: DataFrame, column: str = "message") -> DataFrame:
    return lines.where(col(column).rlike(V.DB_LOG_FILTER))


def credential_log_lines(lines: DataFrame, column: str = "message") -> DataFrame:
    for term in V.CRED_LOG_TERMS:
        lines = lines.where(F.contains(col(column), F.lit(term)))
    return lines


def retained(requests: DataFrame, now_epoch: int) -> DataFrame:
    """Requests whose retention has not run out."""
    return requests.where(col("ttl") > now_epoch)


