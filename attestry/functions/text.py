"""String helpers shared by all jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import fixed_values as V

# What Python's str.strip removes; Spark's trim takes blanks only.
_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


SPACE_SQL = "'" + "".join(f"\\u{ord(ch):04x}" for ch in _SPACE) + "'"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Column names are turned into one SQL expression each; that builds plans several
# times faster than a chain of function calls per name.


def _bare_sql(name: str) -> str:
    """Whether a text starts and ends with a printable ASCII character: it has nothing to strip and is not empty."""
    return f"({name} >= '!' and {name} < '\\u007f' and substring({name}, -1) between '!' and '~')"


def strip_sql(name: str) -> str:
    # btrim looks each edge up in the list of blanks; most texts are spared that.
    return f"case when {_bare_sql(name)} then {name} else btrim({name}, {SPACE_SQL}) end"


def strip(c: Column | str) -> Column:
    return F.expr(strip_sql(c)) if isinstance(c, str) else F.btrim(c, F.lit(_SPACE))


def strip_first_sql(*names: str) -> str:
    """First value that is neither null nor empty, stripped."""
    filled = ", ".join(f"nullif({n}, '')" for n in names)
    return f"case when {_bare_sql(names[0])} then {names[0]} else btrim(coalesce({filled}), {SPACE_SQL}) end"


def tidy_sql(*names: str) -> str:
    """First value that is neither null nor empty, stripped; null if nothing is left."""
    filled = ", ".join(f"nullif({n}, '')" for n in names)
    return f"case when {_bare_sql(names[0])} then {names[0]} else nullif(btrim(coalesce({filled}), {SPACE_SQL}), '') end"


def clean(c: Column | str) -> Column:
    """Stripped and lower-cased."""
    return F.expr(clean_sql(c)) if isinstance(c, str) else F.lower(strip(c))


def clean_sql(name: str) -> str:
    return f"lower({strip_sql(name)})"


def blank_to_null(c: Column | str) -> Column:
    return F.expr(f"nullif({c}, '')") if isinstance(c, str) else F.nullif(c, F.lit(""))


def first_filled(*cols: Column | str) -> Column:
    """First value that is neither null nor empty."""
    if all(isinstance(c, str) for c in cols):
        return F.expr("coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ")")
    return F.coalesce(*[blank_to_null(c) for c in cols])


def filled(c: Column | str) -> Column:
    """True when the value is neither null nor empty (never null)."""
    return F.expr(f"coalesce({c} <> '', false)") if isinstance(c, str) else F.coalesce(c != "", F.lit(False))


def contains_any(c: Column | str, needles: list[str]) -> Column:
    """True when the text holds one of the needles (never null)."""
    found = F.contains(col(c), F.lit(needles[0])) if len(needles) == 1 else col(c).rlike("|".join(re.escape(n) for n in needles))
    return F.coalesce(found, F.lit(False))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group, null when the pattern does not match."""
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, group))


def clip_body(c: Column | str) -> Column:
    """Ticket body limited to what the tracker accepts."""
    return F.when(
        F.length(col(c)) > V.BODY_MAX_CHARS,
        F.concat(F.left(col(c), F.lit(V.BODY_KEPT_CHARS)), F.lit(V.TRUNCATION_NOTICE)),
    ).otherwise(col(c))


def mask(c: Column | str, keep: int = 24) -> Column:
    """Shorten a user name for summaries."""
    return F.when(F.length(col(c)) > keep, F.concat(F.left(col(c), F.lit(keep)), F.lit("..."))).otherwise(col(c))


def safe_filename(c: Column | str) -> Column:
    """Lower-case file-system-safe form of a title (F32)."""
    kept = F.regexp_replace(col(c), r"[^\p{L}\p{N} _-]", "-")
    return F.replace(F.lower(strip(kept)), F.lit(" "), F.lit("-"))


def file_stem(c: Column | str) -> Column:
    """File name without directory and last suffix; a leading dot is no suffix."""
    name = F.substring_index(col(c), "/", -1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def file_suffix(c: Column | str) -> Column:
    name = F.substring_index(col(c), "/", -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def table_id(c: Column | str) -> Column:
    """Last path segment of an identifier."""
    return F.substring_index(col(c), "/", -1)


def fill(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` holes of a fixed text with columns that are never null."""
    names = re.findall(r"\{(\w+)\}", template)
    return F.format_string(re.sub(r"\{\w+\}", "%s", template.replace("%", "%%")), *[col(parts[n]) for n in names])
