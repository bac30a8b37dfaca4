"""Access-request submissions to request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import col, first_filled, strip
from attestry.functions.times import ISO, local_date


def decoded_body(body: str = "body", is_base64: str = "is_base64") -> Column:
    """Plain form body; a broken base64 body counts as empty."""
    plain = F.try_to_binary(col(body), F.lit("base64")).cast("string")
    return F.when(col(is_base64), F.coalesce(plain, F.lit(""))).otherwise(F.coalesce(col(body), F.lit("")))


def _unquote(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def form_field(body: Column | str, name: str, default: str | None = None) -> Column:
    """First non-blank value of a form key, decoded after the split."""
    mine = F.filter(
        F.split(col(body), "&"),
        lambda p: (_unquote(F.substring_index(p, "=", 1)) == name) & p.rlike("(?s)=."),
    )
    value = _unquote(F.regexp_replace(F.get(mine, F.lit(0)), "^[^=]*=", ""))
    return value if default is None else F.coalesce(value, F.lit(default))


def parse_submissions(deliveries: DataFrame) -> DataFrame:
    """Typed or slash-command submissions as ``user_id, user_name, text``."""
    df = deliveries.withColumn("form", decoded_body())
    return df.withColumns({
        "user_id": form_field("form", "user_id", "unknown"),
        "user_name": form_field("form", "user_name", "unknown"),
        "text": form_field("form", "text", ""),
    }).drop("form", "body", "is_base64")


def _whole_number(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))


def parse_command(df: DataFrame) -> DataFrame:
    """``KEY justification;minutes`` to three columns (F41); bad minutes empty all three."""
    has_minutes = F.contains(col("text"), F.lit(";"))
    left = strip(F.substring_index("text", ";", 1))
    minutes = F.when(has_minutes, _whole_number(F.regexp_replace("text", "(?s)^[^;]*;", ""))).otherwise(F.lit(0))
    df = df.withColumns({"_left": left, "_minutes": minutes})
    ok = col("_minutes").isNotNull()
    spaced = F.contains(col("_left"), F.lit(" "))
    return df.withColumns({
        "jira_issue_id": F.when(ok, strip(F.substring_index("_left", " ", 1))).otherwise(""),
        "justification": F.when(ok & spaced, strip(F.regexp_replace("_left", "(?s)^[^ ]* ", ""))).otherwise(""),
        "duration_minutes": F.coalesce("_minutes", F.lit(0)),
    }).drop("_left", "_minutes")


def parse_dialog(deliveries: DataFrame) -> DataFrame:
    """Dialog submissions: JSON in the form's ``payload`` field."""
    names = [c for c in deliveries.columns if c not in ("body", "is_base64")]
    df = deliveries.withColumn("_p", F.from_json(form_field(decoded_body(), "payload"), _DIALOG))
    state = "_p.view.state.values"
    submitted = (col("_p.type") == "view_submission") & (col("_p.view.callback_id") == "access_request")
    row = F.struct(
        first_filled("_p.user.id", F.lit("unknown")).alias("user_id"),
        first_filled("_p.user.username", "_p.user.name", F.lit("unknown")).alias("user_name"),
        F.coalesce(f"{state}.jira.jira_key.value", F.lit("")).alias("jira_issue_id"),
        F.coalesce(f"{state}.just.justification.value", F.lit("")).alias("justification"),
        F.coalesce(_whole_number(col(f"{state}.duration.duration_select.selected_option.value")), F.lit(0)).alias("duration_minutes"))
    # Exploding one or no row keeps the test above the parsing, which so runs once.
    return df.select(*names, F.inline(F.when(submitted, F.array(row))))


_DIALOG = """
type string, user struct<id: string, username: string, name: string>,
view struct<callback_id: string, state: struct<values: struct<
  jira: struct<jira_key: struct<value: string>>,
  just: struct<justification: struct<value: string>>,
  duration: struct<duration_select: struct<selected_option: struct<value: string>>>>>>
"""


def _problems(allowed: list[int], texts: tuple[str, str, str]) -> list[Column]:
    bad_key = ~F.coalesce(col("jira_issue_id").rlike(V.TICKET_KEY), F.lit(False))
    return [F.when(bad_key, texts[0]), F.when(F.coalesce(col("justification"), F.lit("")) == "", texts[1]),
            F.when(~col("duration_minutes").isin(allowed), texts[2])]


def validate(df: DataFrame, allowed: list[int], every_error: bool = False) -> DataFrame:
    """Add ``error`` (first problem, null if none) or ``errors`` (all, for dialogs)."""
    shown = ", ".join(str(m) for m in sorted(allowed))
    if every_error:
        found = _problems(allowed, ("Invalid Jira key", "Justification required", f"Duration must be one of: [{shown}]"))
        return df.withColumn("errors", F.filter(F.array(*found), lambda e: e.isNotNull()))
    hint = "Example: ENG-1234 Justification;30"
    found = _problems(allowed, (f"Invalid Jira ID. {hint}", f"Justification required. {hint}", f"Duration must be one of: {shown}"))
    return df.withColumn("error", F.coalesce(*found))


def form_errors(df: DataFrame, allowed: list[int]) -> DataFrame:
    """First problem of plain fields ``justification, jira_id, duration``."""
    shown = ", ".join(str(m) for m in sorted(allowed))
    why, key, span = (strip(F.coalesce(col(c), F.lit(""))) for c in ("justification", "jira_id", "duration"))
    minutes = _whole_number(span)
    return df.withColumn("error", (
        F.when(why == "", "Justification is required").when(key == "", "Jira ID is required")
        .when(~key.rlike(V.TICKET_KEY), "Jira ID format invalid").when(span == "", "Duration is required")
        .when(~F.coalesce(minutes.isin(allowed), F.lit(False)), f"Duration must be one of: {shown}")))


def fresh(deliveries: DataFrame, received: str = "received_epoch", sent: str = "sent_epoch") -> DataFrame:
    """Drop replays: sent more than five minutes from receipt."""
    return deliveries.where(F.abs(col(received) - col(sent)) <= V.REPLAY_SECONDS)


def request_rows(valid: DataFrame, zone: str, retention_years: int, email: Column | str = "user_name") -> DataFrame:
    """Rows of the request table.

    Typed commands have no email, so the chat user name stands in ``user_email``
    (the default) and the row has no chat user of its own; dialogs pass their
    resolved email and keep id and name.
    """
    dialog = F.lit(not (isinstance(email, str) and email == "user_name"))
    now = F.timestamp_seconds("received_epoch")
    stamp = F.date_format(now, ISO)
    return valid.select(
        F.sha2(F.concat_ws("\x1f", "received_epoch", "user_id", "jira_issue_id", "justification", "duration_minutes").cast("binary"), 256).alias("request_id"),
        stamp.alias("timestamp"), local_date(now, zone).alias("local_date"), F.when(dialog, col("user_id")).alias("user_id"), F.when(dialog, col("user_name")).alias("user_name"),
        col(email).alias("user_email"), "jira_issue_id", "justification", "duration_minutes",
        stamp.alias("request_timestamp"),
        F.date_format(F.timestamp_seconds(col("received_epoch") + col("duration_minutes") * 60), ISO).alias("expiry_timestamp"),
        (col("received_epoch") + retention_years * 365 * 86400).cast("long").alias("ttl"),
    )
