"""Ticket records for people and services.

A ticket text shows at most twenty rows and is cut at a fixed length, and an
attachment has a byte limit, so each group's share is bounded before it is
gathered: rows are ranked first, byte totals decide who gets a full attachment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import clip_body, col, fill, filled
from attestry.functions.times import parse_time, title_range
from attestry.operators.joins import first_per_key, top_per_key
from attestry.operators.report import list_order, person, violation_json


def or_none(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("None"))


def row_date(c: Column | str) -> Column:
    return F.when(
        col(c).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.replace(F.left(col(c), F.lit(16)), F.lit("T"), F.lit(" "))
    ).otherwise(or_none(c))


def resource_text(details: str = "resource_details") -> Column:
    """``DB Name: …, Bucket: …, Key: …, Operation: …`` or ``N/A``."""

    def part(label: str, name: str, when: Column | None = None) -> Column:
        c = col(f"{details}.{name}")
        test = filled(c) if when is None else filled(c) & when
        return F.when(test, F.concat(F.lit(f"{label}: "), c))

    has_bucket = filled(f"{details}.s3_bucket")
    text = F.concat_ws(
        ", ", part("DB Name", "db_name"), part("Bucket", "s3_bucket"),
        part("Key", "s3_key", has_bucket & (col(f"{details}.s3_key") != "N/A")), part("Operation", "operation"),
    )
    return F.when(text == "", "N/A").otherwise(text)


def table_line() -> Column:
    return fill(V.HUMAN_ROW, date=row_date("event_time"), event=or_none("event_name"), resource=or_none("resource_arn"),
                details=resource_text())


def violation_text(index: Column | str) -> Column:
    """One violation as text: bullets, then request, details and evidence that exist."""
    bullets = {"Type": "type", "Severity": "severity", "User": "user_id", "Actor Type": "actor_type",
               "Resource": "resource_arn", "Event Time": "event_time", "Event Name": "event_name",
               "Description": "description"}
    lines = [F.concat(F.lit("#### Violation "), col(index).cast("string"), F.lit(":"))]
    lines += [F.concat(F.lit(f"* **{k}:** "), or_none(c)) for k, c in bullets.items()]
    asked = {"Jira Issue ID": "jira_issue_id", "Justification": "justification",
             "Request Timestamp": "request_timestamp", "Duration (minutes)": "duration_minutes"}
    request = F.concat_ws("\n", F.lit("\n##### Matched Request:"),
                          *[F.concat(F.lit(f"* **{k}:** "), or_none(f"matched_request.{c}")) for k, c in asked.items()])
    lines.append(F.when(col("matched_request").isNotNull(), request))

    def section(title: str, struct: str, names: list[str]) -> Column:
        items = [F.when(col(f"{struct}.{n}").isNotNull(),
                        F.concat(F.lit(f"* **{n.replace('_', ' ').title()}:** "), col(f"{struct}.{n}"))) for n in names]
        # concat_ws skips null lines
        return F.concat_ws("\n", F.lit(f"\n##### {title}:"), *items)

    some_detail = F.coalesce(*[col(f"resource_details.{n}") for n in ("db_name", "s3_bucket", "s3_key", "operation")])
    lines.append(F.when(some_detail.isNotNull(), section("Resource Details", "resource_details",
                                                         ["db_name", "s3_bucket", "s3_key", "operation"])))
    lines.append(F.when(col("evidence").isNotNull(), section("Evidence", "evidence", EVIDENCE_FIELDS)))
    return F.concat_ws("\n", *lines)


EVIDENCE_FIELDS = [
    "user_email", "principal_id", "session_issuer", "iam_user", "user_identity_type", "user_identity_arn",
    "db_username", "db_auth_method", "db_auth_identity", "vault_auth_name", "vault_lease_id", "s3_request_id",
    "s3_error_code", "s3_error_message", "source_ip", "user_agent", "aws_region", "access_key_id", "event_id",
    "recipient_account_id",
]
# No body shows more requests than fit its length limit: the text is cut there, so later ones can't be seen.
_MIN_REQUEST = len(V.HUMAN_REQUEST.format(i=1, jira="", why="", at="", minutes=""))
MAX_SHOWN_REQUESTS = V.BODY_MAX_CHARS // _MIN_REQUEST + 1


#: What groups, list order and summaries read of a violation, and what texts of tickets read; only the full list of an attachment shows more.
LIST_COLUMNS = ["ord", "src_rank", "local_date", "type", "user_id", "actor_type", "resource_arn", "event_time", "description"]
TEXT_COLUMNS = [*LIST_COLUMNS, "event_name", "resource_details", "matched_request"]
#: Attachments write every key, empty ones as null; compact, since the byte limit is on what is sent.
ALL_KEYS = {"ignoreNullFields": "false"}


def grouped(violations: DataFrame) -> DataFrame:
    """Violations with their ticket group ``who``: an email, or empty for services."""
    return violations.withColumn("who", F.coalesce(person(), F.lit("")))


def ticket_rows(rows: DataFrame, by: list[str], n: int = V.TABLE_MAX_ROWS) -> DataFrame:
    """First ``n`` violations of each group in list order (L3, L4)."""
    return top_per_key(rows, [*by, "who"], list_order(), n)


def matched_requests(rows: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """Distinct requests of each group, numbered by first appearance (A7); all of them, or the first ``most``."""
    asked = rows.where(col("matched_request").isNotNull()).select(
        *by, "who", "src_rank", "event_time", "ord", "matched_request",
        F.coalesce(col("matched_request.request_timestamp"), F.lit("N/A")).alias("request_key"))
    once = first_per_key(asked, [*by, "who", "request_key"], list_order())
    if most is not None:
        return top_per_key(once, [*by, "who"], list_order(), most, "i")
    return once.withColumn("i", F.row_number().over(Window.partitionBy(*by, "who").orderBy(*list_order())))


def _joined(ranked: DataFrame, keys: list[str], rank: str, text: Column, name: str, sep: str = "") -> DataFrame:
    # The text is made one step before it is gathered: expressions inside collect_list are interpreted, as is array_sort.
    made = ranked.select(*keys, F.struct(col(rank).alias("k"), text.alias("v")).alias("_line"))
    lines = F.transform(F.sort_array(F.collect_list("_line")), lambda x: x["v"])
    return made.groupBy(*keys).agg(F.array_join(lines, sep).alias(name))


def group_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, JSON bytes and category counts per group."""
    return rows.groupBy(*by, "who").agg(
        F.count("*").alias("violations_count"), F.sum(F.octet_length("json") + 1).alias("json_bytes"),
        *[F.count_if(col("actor_type") == k).alias(k) for k in V.NON_HUMAN_CATEGORIES])


def human_body(period: dict[str, str]) -> Column:
    """Ticket text of a person from count, shown rows and requests."""
    extra = col("violations_count") - V.TABLE_MAX_ROWS
    more = F.when(extra > 0, fill(V.HUMAN_MORE_ROWS, extra=extra)).otherwise("")
    head = fill(V.HUMAN_BODY_HEAD, start_local=F.lit(period["start_local"]), end_local=F.lit(period["end_local"]),
                user=col("who"), count=col("violations_count"))
    return clip_body(F.concat(head, col("shown_rows"), more, F.lit(V.HUMAN_REQUESTS_HEAD),
                              F.coalesce("shown_requests", F.lit("")), F.lit(V.HUMAN_BODY_FOOT)))


def non_human_body(period: dict[str, str], generated_at: str) -> Column:
    """Ticket text for services and unknown actors."""
    counts = F.concat_ws("\n", *[F.concat(F.lit(f"* **{k}:** "), col(k).cast("string")) for k in V.NON_HUMAN_CATEGORIES])
    return clip_body(fill(
        V.NON_HUMAN_BODY, generated=F.lit(generated_at), start=F.lit(period["start"]), end=F.lit(period["end"]),
        start_local=F.lit(period["start_local"]), end_local=F.lit(period["end_local"]),
        total=col("violations_count"), categories=counts))


def _head_json() -> Column:
    """JSON text of an attachment before its list, without the closing brace."""
    human = F.to_json(F.struct(col("who").alias("user_email"), "violations_count"), ALL_KEYS)
    cats = F.struct(*V.NON_HUMAN_CATEGORIES)
    other = F.to_json(F.struct(col("violations_count").alias("total_count"), cats.alias("by_category")), ALL_KEYS)
    text = F.when(col("who") != "", human).otherwise(other)
    return F.left(text, F.length(text) - 1)


def attachments(rows: DataFrame, totals: DataFrame, by: list[str], limit: int = V.ATTACHMENT_MAX_BYTES) -> DataFrame:
    """Attachment text per group: full list within the byte limit, else a ten-row summary.

    The byte totals are known before anything is gathered, so a list that would
    break the limit is never built.  Only groups over the limit are looked up by
    the rows: each has more than ``limit`` bytes of JSON, so they are few however
    many groups there are, and the rows are shuffled once, to be gathered.
    """
    keys = [*by, "who"]
    sized = totals.withColumn("head", _head_json())
    size = col("json_bytes") + F.octet_length("head") + len(',"violations":[') + len("]}") - 1
    sized = sized.withColumn("fits", size <= limit).select(*keys, "head", "fits")
    known = rows.join(F.broadcast(sized.where("not fits").select(*keys, F.lit(True).alias("over"))), keys, "left")
    packed = F.struct("src_rank", F.coalesce(F.negative(F.unix_micros(parse_time("event_time"))), F.lit((1 << 63) - 1)).alias("t"), "ord", "json")
    items = known.where("over is null").select(*keys, packed.alias("_item"))
    full = items.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_item")), lambda x: x["json"]), ",").alias("list"))
    brief = F.to_json(F.struct("type", "event_time", "resource_arn", "description"), ALL_KEYS)
    first_ten = top_per_key(known.where("over"), keys, list_order(), V.SUMMARY_MAX_ROWS)
    short = _joined(first_ten, keys, "rank", brief, "brief_list", ",")
    told = F.to_json(F.struct(F.lit(V.OVERSIZE_MESSAGE).alias("message")))
    told = F.substring(told, F.lit(2), F.length(told))
    content = F.when(col("fits"), F.concat("head", F.lit(',"violations":['), F.coalesce("list", F.lit("")), F.lit("]}"))).otherwise(
        F.concat(col("head"), F.lit(","), F.regexp_replace(told, "}$", ""), F.lit(',"violation_summary":['), col("brief_list"), F.lit("]}")))
    return sized.join(full, keys, "left").join(short, keys, "left").select(*keys, content.alias("content"), "fits")


def tickets(violations: DataFrame, period: dict[str, str], generated_at: str, project: str, issue_type: str,
            labels: list[str], by: list[str] = ("local_date",), limit: int = V.ATTACHMENT_MAX_BYTES) -> DataFrame:
    """One ticket record per person and one for everything else, per run day.

    No violations, no tickets.  Sending is somebody else's job.
    """
    by = list(by)
    keys = [*by, "who"]
    rows = grouped(violations).withColumn("json", F.to_json(violation_json(violations), ALL_KEYS))
    totals = group_totals(rows, by)
    people = rows.where("who <> ''")
    shown = _joined(ticket_rows(people, by), keys, "rank", table_line(), "shown_rows")
    block = fill(V.HUMAN_REQUEST, i=col("i"), jira=or_none("matched_request.jira_issue_id"),
                 why=or_none("matched_request.justification"), at=or_none("matched_request.request_timestamp"),
                 minutes=or_none("matched_request.duration_minutes"))
    asked = _joined(matched_requests(people, by, MAX_SHOWN_REQUESTS), keys, "i", block, "shown_requests")
    files = attachments(rows, totals, by, limit)
    df = totals.join(shown, keys, "left").join(asked, keys, "left").join(files, keys, "left")
    is_person = col("who") != ""
    span = title_range(F.lit(period["start_local"]), F.lit(period["end_local"]))
    return df.select(
        *by,
        F.lit(project).alias("project_key"), F.lit(issue_type).alias("issue_type"),
        F.when(is_person, F.concat(F.lit("Customer data access violation - "), "who", F.lit(" - "), span)).otherwise(
            F.concat(F.lit("Customer data access violation - service or unknown actor - "), span)).alias("summary"),
        F.when(is_person, human_body(period)).otherwise(non_human_body(period, generated_at)).alias("description"),
        F.when(is_person, col("who")).alias("assignee"),
        F.array(*[F.lit(x) for x in labels]).alias("labels"),
        F.array(F.struct(
            F.when(is_person, F.concat(F.lit("violations_"), F.replace("who", F.lit("@"), F.lit("_at_")), F.lit(".json")))
            .otherwise("non_human_violations.json").alias("filename"),
            F.base64(F.encode("content", "UTF-8")).alias("content"))).alias("attachments"),
    )


def ticket_log(records: DataFrame, period: dict[str, str], run: dict[str, str]) -> DataFrame:
    """Ten-key JSON summary of each ticket (F29); attachments are counted by their names, so their content is not made or read for it."""
    told = ["project_key", "issue_type", "summary", "assignee", "labels", "description"]
    # one step before the texts, which name a column twice: only so the planner sees that no content is asked for
    counted = records.select(*told, F.size("attachments.filename").alias("attachments_count"))
    return counted.select(F.to_json(F.struct(
        F.when(col("assignee").isNotNull(), "Human Violation Ticket").otherwise("Non-Human Violation Ticket").alias("ticket_type"),
        "project_key", "issue_type", "summary", "assignee", "labels",
        F.length("description").alias("description_length"), "attachments_count",
        F.struct(*[F.lit(v).alias(k) for k, v in run.items()]).alias("report_metadata"),
        F.struct(*[F.lit(v).alias(k) for k, v in period.items()]).alias("time_period"),
    )).alias("record"))
