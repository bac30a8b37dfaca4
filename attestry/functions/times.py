"""Time parsing and rendering.  The session time zone must be UTC."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import blank_to_null, col, strip

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PLAIN = "yyyy-MM-dd HH:mm:ss"


def parse_time(c: Column | str) -> Column:
    """Instant of a stamp in one of the two accepted spellings, else null (F1).

    Accepted: ISO ending in ``Z`` (fraction cut to microseconds) and ``yyyy-MM-dd HH:mm:ss[.f]``
    (fraction dropped), both UTC.  ``T`` without zone and explicit offsets are
    null.  Fields need their full number of digits.
    """
    s = strip(c)
    iso = F.when(
        s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?Z$"),
        F.regexp_replace(F.regexp_replace(s, r"(\.\d{6})\d+", "$1"), r"^(\d{4}-\d{2}-\d{2})Z$", "$1T00:00:00Z").try_cast("timestamp"),
    )
    # The shape is checked first, so the fast cast reads exactly what is allowed.
    usual = F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"), F.concat(col(c), F.lit("Z")).try_cast("timestamp"))
    plain = F.substring_index(s, ".", 1)
    wall = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.concat(plain, F.lit("Z")).try_cast("timestamp"))
    return F.coalesce(usual, F.when(F.endswith(s, F.lit("Z")), iso).otherwise(wall))


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(col(ts), ISO)


def normalize_time(c: Column | str, ingest_ts: Column | str, apply_offset: bool = False) -> Column:
    """Stamp as ``yyyy-MM-ddTHH:mm:ssZ`` (F2); unparseable becomes ``ingest_ts``.

    A wall time with an offset is relabelled ``Z`` unchanged; ``apply_offset``
    converts it instead.
    """
    s = strip(c)
    zulu = F.concat(F.regexp_replace(F.substring_index(s, ".", 1), "Z$", ""), F.lit("Z"))
    shape = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d*)?(Z|[+-]\d{2}:?\d{2})?$"
    wall = F.concat_ws(" ", F.regexp_extract(s, shape, 1), F.regexp_extract(s, shape, 2))
    zone = F.regexp_replace(F.regexp_extract(s, shape, 4), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    if apply_offset:
        suffix = F.when(zone == "", F.lit("Z")).otherwise(zone)
    else:
        suffix = F.lit("Z")
    other = F.when(
        s.rlike(shape),
        F.try_to_timestamp(F.concat(wall, suffix), F.lit("yyyy-MM-dd HH:mm:ssXXX")),
    )
    day = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(s, F.lit(" 00:00:00Z")), F.lit("yyyy-MM-dd HH:mm:ssX")))
    return (
        F.when(F.endswith(s, F.lit("Z")) & F.contains(s, F.lit("T")), zulu)
        .otherwise(F.coalesce(iso_utc(other), iso_utc(day), iso_utc(ingest_ts)))
    )


def line_time(message: Column | str, ingest_ts: Column | str) -> Column:
    """First ``yyyy-MM-dd HH:mm:ss UTC`` in a log line as ISO, else ``ingest_ts``."""
    found = blank_to_null(F.regexp_extract(col(message), V.LINE_TIME, 1))
    return F.coalesce(
        F.concat(F.replace(F.left(found, F.lit(19)), F.lit(" "), F.lit("T")), F.lit("Z")), iso_utc(ingest_ts)
    )


def local_date(ts: Column | str, zone: str = V.DEFAULT_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), zone), "yyyy-MM-dd")


def day_bounds(local_day: Column | str, zone: str) -> tuple[Column, Column]:
    """First instant of a local day and first instant of the next."""
    day = col(local_day)
    midnight = F.when(day.rlike(r"^[1-9]\d{3}-\d{2}-\d{2}\z"), F.concat(day, F.lit(" 00:00:00Z")).try_cast("timestamp")).otherwise(
        F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    following = midnight + F.make_dt_interval(days=F.lit(1))
    return F.to_utc_timestamp(midnight, zone), F.to_utc_timestamp(following, zone)


def local_iso(ts: Column | str, zone: str) -> Column:
    """ISO text of an instant in a zone, with its offset."""
    there = F.from_utc_timestamp(col(ts), zone)
    minutes = ((there.cast("long") - col(ts).cast("long")) / 60).cast("int")
    offset = F.format_string(
        "%s%02d:%02d",
        F.when(minutes < 0, "-").otherwise("+"),
        F.floor(F.abs(minutes) / 60),
        F.abs(minutes) % 60,
    )
    micros = F.date_format(there, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss"), fraction, offset)


def title_range(start_local: Column | str, end_local: Column | str) -> Column:
    """``start - end`` to the minute for a ticket title; raw start if unparseable."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
    s, e = col(start_local), col(end_local)
    ok = s.rlike(shape) & e.rlike(shape)
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.left(s, F.lit(16)), F.lit(" - "), F.left(e, F.lit(16)))).otherwise(
        F.coalesce(s, F.lit("N/A"))
    )


def _instant(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))


def reconciliation_window(
    now: dt.datetime,
    *,
    start: str | None = None,
    end: str | None = None,
    start_iso: str | None = None,
    end_iso: str | None = None,
    period: str = "yesterday",
    zone: str = V.DEFAULT_ZONE,
) -> tuple[dt.datetime, dt.datetime]:
    """Run parameters of one reconciliation (P1); ``zone='UTC'`` gives P2.

    Explicit pairs win, then today so far, then the whole previous local day.
    """
    for lo, hi in ((start, end), (start_iso, end_iso)):
        if lo and hi:
            return _instant(lo), _instant(hi)
    here = now.astimezone(ZoneInfo(zone))
    midnight = dt.datetime.combine(here.date(), dt.time.min, tzinfo=ZoneInfo(zone))
    if period == "today":
        return midnight.astimezone(dt.timezone.utc), now
    before = here.date() - dt.timedelta(days=1)
    first = dt.datetime.combine(before, dt.time.min, tzinfo=ZoneInfo(zone))
    last = dt.datetime.combine(before, dt.time.max, tzinfo=ZoneInfo(zone))
    return first.astimezone(dt.timezone.utc), last.astimezone(dt.timezone.utc)


def scan_literals(start: dt.datetime, end: dt.datetime) -> tuple[str, str]:
    """Scan bounds cut to whole seconds."""
    return start.strftime("%Y-%m-%d %H:%M:%S"), end.strftime("%Y-%m-%d %H:%M:%S")
