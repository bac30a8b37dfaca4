"""Run-configuration values.

Driver-side helpers take the few kilobytes a parameter store holds; the column
forms validate tables of settings.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.text import col, strip


def flag(c: Column | str) -> Column:
    """True/false from its eight spellings; anything else fails the query."""
    low = F.lower(col(c))
    return (
        F.when(low.isin("true", "1", "yes", "on"), F.lit(True))
        .when(low.isin("false", "0", "no", "off"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("invalid flag: "), F.coalesce(col(c), F.lit("null")))).cast("boolean"))
    )


def actor_whitelist(text: str) -> dict[str, list[str]]:
    """Whitelist JSON to lower-case trimmed entries per actor type."""
    parsed = json.loads(text)
    if not isinstance(parsed, dict):
        raise ValueError("actor whitelist must be an object")
    return {str(k): [str(p).strip().lower() for p in v] for k, v in parsed.items() if isinstance(v, list)}


def user_whitelist(text: str) -> list[str]:
    parsed = json.loads(text)
    if not isinstance(parsed, list):
        raise ValueError("user whitelist must be a list")
    return [str(u).strip().lower() for u in parsed]


def whitelist_entries(c: Column | str) -> Column:
    """Column form of the whitelist list: array of cleaned entries."""
    return F.transform(F.from_json(col(c), "array<string>"), lambda p: F.lower(strip(p)))


def allowed_minutes(c: Column | str) -> Column:
    """Comma list of minutes as an array; a bad item fails the query."""
    items = F.filter(F.split(col(c), ","), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: strip(x).cast("int"))))


def unset(c: Column | str) -> Column:
    """Setting left empty or at its placeholder (Q5)."""
    return F.coalesce(col(c).isin("", "CHANGE_ME"), F.lit(True))
