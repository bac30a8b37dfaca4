"""Linking database sessions to the credential issuance behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.identity import strip_login_prefix
from attestry.functions.resources import synthetic_arn
from attestry.functions.text import blank_to_null, clean, col, first_filled
from attestry.functions.times import parse_time
from attestry.operators.joins import first_per_key, last_before, salted_left_join, with_columns_or_null

_NOTES = ["iss_email", "iss_lease", "iss_ip", "iss_agent"]


def _user_key():
    return clean("db_username")


def issuance_notes(curated: DataFrame) -> DataFrame:
    """Issuances as (user_key, local_date, ord, iss_ts, notes)."""
    return curated.where(col("eventName") == V.CREDS_ISSUED).select(
        _user_key().alias("user_key"), "local_date", "ord", "eventTime", parse_time("eventTime").alias("iss_ts"),
        blank_to_null(strip_login_prefix(clean("auth_display_name"))).alias("iss_email"),
        blank_to_null("lease_id").alias("iss_lease"),
        blank_to_null("sourceIpAddress").alias("iss_ip"),
        blank_to_null("userAgent").alias("iss_agent"),
    ).where("user_key <> ''")


def issuance_per_user(curated: DataFrame, keep: str = "earliest") -> DataFrame:
    """One issuance per user and day (A6); ``keep`` is ``earliest`` or ``latest``.

    Rows arrive newest first and later ones overwrite, so the earliest of the day
    stands, even for sessions before it and with its nulls.
    """
    order = [F.asc("eventTime"), F.desc("ord")] if keep == "earliest" else [F.desc("eventTime"), F.asc("ord")]
    return first_per_key(issuance_notes(curated), ["user_key", "local_date"], order)


def enrich_sessions(curated: DataFrame, issuance: str = "earliest", salts: int = 1) -> DataFrame:
    """Attach ``human_id`` and fill missing lease, address and agent on sessions.

    ``curated`` carries ``ord`` and ``local_date``.  ``issuance`` selects
    ``earliest`` (default), ``latest`` or ``asof``: the last issuance at or before
    the session, on any day.
    """
    curated = with_columns_or_null(curated, ["resourceArn"])
    is_session = col("eventName").isin(V.DB_CONNECT, V.DB_DISCONNECT)
    sessions = curated.withColumn("user_key", F.when(is_session, _user_key()))
    if issuance == "asof":
        sessions = sessions.withColumn("iss_ts", parse_time("eventTime"))
        joined = last_before(sessions, issuance_notes(curated), "user_key", "iss_ts", _NOTES, ["ord"]).drop("iss_ts")
    else:
        notes = issuance_per_user(curated, issuance).select("user_key", "local_date", *_NOTES)
        joined = salted_left_join(sessions, notes, ["user_key", "local_date"], "ord", salts)
    return joined.withColumns({
        "human_id": col("iss_email"),
        "lease_id": first_filled("lease_id", "iss_lease"),
        "sourceIpAddress": first_filled("sourceIpAddress", "iss_ip"),
        "userAgent": first_filled("userAgent", "iss_agent"),
        "resourceArn": synthetic_arn(),
    }).drop("user_key", *_NOTES)
