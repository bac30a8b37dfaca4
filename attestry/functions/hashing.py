"""Pseudonyms, account ids and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import blank_to_null, col


def pseudonym(c: Column | str) -> Column:
    """``uuid5:`` plus the version-5 UUID of the value; empty and null pass through."""
    seed = F.concat(F.unhex(F.lit(V.OID_NAMESPACE_HEX)), F.encode(col(c), "UTF-8"))
    h = F.sha1(seed)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    uuid = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    return F.when(col(c) == "", col(c)).otherwise(F.concat(F.lit("uuid5:"), uuid))


def account_of(arn: Column | str) -> Column:
    """Account field of an ARN (F8)."""
    return blank_to_null(F.split_part(col(arn), F.lit(":"), F.lit(5)))


def row_hash(*cols: Column | str) -> Column:
    """60-bit hash of a row, stable across engines."""
    text = F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
