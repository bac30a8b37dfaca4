"""Row whitelists applied after the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.identity import by_actor, is_object_event, session_name
from attestry.functions.text import blank_to_null, clean, col, contains_any


def db_user_listed(users: list[str]) -> Column:
    # the separate user name of an object event belongs to another directory
    name = clean(F.coalesce(blank_to_null("db_username"), F.when(~F.coalesce(is_object_event(), F.lit(False)), blank_to_null("userName"))))
    return F.coalesce(name.isin([u for u in users if u]), F.lit(False))


def object_actor_listed(whitelist: dict[str, list[str]]) -> Column:
    """Object events whose email-less actor is named exactly in its type's list.

    The lists come from one parameter-store value of a few kilobytes, so they are
    literals; ``isin`` turns into a hash-set lookup.
    """
    agent = F.when(contains_any("userAgent", [V.AWS_HOST_MARK]), clean("userAgent"))

    def named(kind: str, *candidates: Column) -> Column:
        entries = [p for p in whitelist.get(kind, []) if p]
        tests = [F.coalesce(c.isin(entries), F.lit(False)) for c in candidates] if entries else [F.lit(False)]
        return reduce(lambda a, b: a | b, tests)

    listed = by_actor(
        aws_service=named(V.AWS_SERVICE, F.coalesce(blank_to_null(clean("sourceIpAddress")), agent)),
        service_principal=named(
            V.SERVICE_PRINCIPAL, F.lower(col("sessionIssuerUserName")), F.lower(session_name("principalId"))
        ),
        service_account=named(V.SERVICE_ACCOUNT, clean("userName")),
        otherwise=F.lit(False),
    )
    return is_object_event() & listed


def drop_whitelisted(events: DataFrame, db_users: list[str] = (), actors: dict[str, list[str]] | None = None) -> DataFrame:
    if db_users:
        events = events.where(~db_user_listed(list(db_users)))
    if actors:
        events = events.where(~object_actor_listed(actors))
    return events


def monitored_databases(parsed: DataFrame, setting: str) -> DataFrame:
    """Keep session events of the listed databases; other event types always pass (P10)."""
    names = [n.strip() for n in setting.split(",") if n.strip()]
    if not names:
        return parsed
    is_session = col("type").isin(V.DB_CONNECT, V.DB_DISCONNECT)
    return parsed.where(~is_session | F.coalesce(col("database").isin(names), F.lit(False)))
