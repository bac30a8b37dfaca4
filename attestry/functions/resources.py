"""Which resource an event touched, and the evidence kept for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.identity import is_object_event
from attestry.functions.text import blank_to_null, col, filled, strip, strip_first_sql, tidy_sql


def synthetic_arn() -> Column:
    """``db:NAME`` where a database is named and no ARN is given."""
    return F.coalesce(blank_to_null("resourceArn"), F.concat(F.lit(V.DB_ARN_PREFIX), blank_to_null("database")))


def _is_db_session() -> Column:
    named = (col("database") != "") | F.startswith(col("resourceArn"), F.lit(V.DB_ARN_PREFIX))
    return strip("eventName").isin(V.DB_CONNECT, V.DB_DISCONNECT) & F.coalesce(named, F.lit(False))


def _db_name() -> Column:
    return F.coalesce(blank_to_null("database"), F.regexp_replace("resourceArn", "^[^:]*:", ""))


def _object_location() -> tuple[Column, Column]:
    """Bucket and key, from a projected ARN when there is one, else from the request."""
    given = filled(strip("resourceArn"))

    # Each part names the ARN once: a text that is repeated in an expression is stripped again each time.
    def part(pattern: str) -> Column:
        return F.get(F.regexp_extract_all(strip("resourceArn"), F.lit(f"^{V.OBJECT_ARN_PREFIX}{pattern}"), F.lit(1)), F.lit(0))

    req_key = F.when(filled(strip("reqBucketName")), F.expr(tidy_sql("reqObjectKey")))
    return (
        F.when(given, part("([^/]+)")).otherwise(F.expr(tidy_sql("reqBucketName"))),
        F.when(given, part(r"[^/]*/((?s:.*))\z")).otherwise(req_key),
    )


def resource_arn(db_arn_map: dict[str, str] | None = None, databases: list[str] | None = None) -> Column:
    """Canonical ARN (F16, J8): bucket level for objects, configured ARN for databases.

    ``db_arn_map`` and ``databases`` are run configuration of a few kilobytes and
    become literals.
    """
    known = F.lit(None).cast("string")
    if db_arn_map:
        pairs = [F.lit(x) for kv in db_arn_map.items() for x in kv]
        known = F.try_element_at(F.create_map(*pairs), _db_name())
    sole = F.lit(databases[0] if databases and len(databases) == 1 else None).cast("string")
    bucket, _ = _object_location()
    object_arn = F.coalesce(F.concat(F.lit(V.OBJECT_ARN_PREFIX), bucket), F.expr(tidy_sql("resourceArn")))
    return (
        F.when(_is_db_session(), F.coalesce(known, sole, col("resourceArn")))
        .when(is_object_event(), object_arn)
        .otherwise(col("resourceArn"))
    )


def resource_details() -> Column:
    bucket, key = _object_location()
    on_db, on_object = _is_db_session(), is_object_event() & ~_is_db_session()
    located = on_object & (filled(strip("resourceArn")) | filled(strip("reqBucketName")))
    return F.struct(
        F.when(on_db, _db_name()).alias("db_name"),
        F.when(on_object, bucket).alias("s3_bucket"),
        F.when(on_object, key).alias("s3_key"),
        F.when(located, col("eventName")).alias("operation"),
    )


def evidence(email: Column | str = "user_id") -> Column:
    """Twenty-field evidence record of an event."""

    def tidy(*names: str) -> Column:
        return F.expr(tidy_sql(*names))

    return F.struct(
        blank_to_null(email).alias("user_email"),
        tidy("principalId").alias("principal_id"),
        tidy("sessionIssuerUserName").alias("session_issuer"),
        tidy("userName").alias("iam_user"),
        tidy("userIdentityType").alias("user_identity_type"),
        tidy("userIdentityArn").alias("user_identity_arn"),
        F.when(~is_object_event(), tidy("db_username", "userName", "user")).alias("db_username"),
        tidy("auth_method").alias("db_auth_method"),
        tidy("auth_identity").alias("db_auth_identity"),
        tidy("auth_display_name").alias("vault_auth_name"),
        tidy("lease_id").alias("vault_lease_id"),
        tidy("requestID").alias("s3_request_id"),
        tidy("errorCode").alias("s3_error_code"),
        tidy("errorMessage").alias("s3_error_message"),
        F.expr(strip_first_sql("sourceIpAddress", "client_addr", "remote_address")).alias("source_ip"),
        F.expr(strip_first_sql("userAgent")).alias("user_agent"),
        tidy("awsRegion").alias("aws_region"),
        tidy("accessKeyId").alias("access_key_id"),
        tidy("eventID").alias("event_id"),
        tidy("recipientAccountId").alias("recipient_account_id"),
    )
