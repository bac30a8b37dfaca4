"""Counts and groups over violations.

The long lists stay tables keyed by person; nothing gathers an unbounded group
into one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import col, filled
from attestry.functions.times import parse_time
from attestry.operators.positions import laid_out, positions


def list_order() -> list[Column]:
    """Order of violations in every list: object events first, newest first whatever a stamp's spelling, unreadable ones last (L1)."""
    return [F.asc("src_rank"), F.desc_nulls_last(parse_time("event_time")), F.asc("ord")]


def person() -> Column:
    """Email a violation is grouped under; null for services and unknown actors."""
    return F.when((col("actor_type") == V.HUMAN) & filled("user_id"), col("user_id"))


def _starts(c: str, *prefixes: str) -> Column:
    out = F.startswith(col(c), F.lit(prefixes[0]))
    for p in prefixes[1:]:
        out = out | F.startswith(col(c), F.lit(p))
    return out


def category_counts() -> list[Column]:
    on_object = _starts("resource_arn", V.OBJECT_ARN_PREFIX)
    on_db = _starts("resource_arn", V.RDS_ARN_PREFIX, V.DB_ARN_PREFIX)
    no_request, outside = col("type") == V.UNAUTHORIZED, col("type") == V.OUTSIDE_WINDOW
    return [
        F.count_if(on_object & no_request).alias("s3_unauthorized_access"),
        F.count_if(on_object & outside).alias("s3_outside_window"),
        F.count_if(on_db & no_request).alias("db_unauthorized_access"),
        F.count_if(on_db & outside).alias("db_outside_window"),
    ]


def actor_counts() -> list[Column]:
    names = {
        "human_actors": V.HUMAN, "service_principals": V.SERVICE_PRINCIPAL, "service_accounts": V.SERVICE_ACCOUNT,
        "aws_services": V.AWS_SERVICE, "unknown_actors": V.UNKNOWN,
    }
    return [F.count_if(col("actor_type") == kind).alias(name) for name, kind in names.items()]


def by_category(violations: DataFrame, by: list[str] = ()) -> DataFrame:
    return violations.groupBy(*by).agg(*category_counts())


def by_actor_type(violations: DataFrame, by: list[str] = ()) -> DataFrame:
    return violations.groupBy(*by).agg(*actor_counts())


def human_groups(violations: DataFrame, by: list[str] = ()) -> DataFrame:
    """Violations per person, most first, then by email (A1, L2)."""
    return (
        violations.withColumn("user_email", person()).where("user_email is not null")
        .groupBy(*by, "user_email").agg(F.count("*").alias("violations_count"))
        .orderBy(*by, F.desc("violations_count"), F.asc("user_email"))
    )


def ranked_human_groups(violations: DataFrame, by: list[str] = ()) -> DataFrame:
    """Violations per person with ``position``, from 0: most first, then by email (A1, L2).

    The position is counted over ranges, so it is part of the row however the table is stored or read.
    """
    groups = violations.withColumn("user_email", person()).where("user_email is not null").groupBy(*by, "user_email").agg(F.count("*").alias("violations_count"))
    return positions(laid_out(groups, [*by, F.desc("violations_count"), F.asc("user_email")]), within=list(by))


def event_order(events: DataFrame) -> DataFrame:
    """Events with their ``position`` in the order of the scans (L1): sources one after the other, newest first, ties by ``ord``."""
    return positions(laid_out(events, ["src_rank", F.desc_nulls_last("eventTime"), "ord"]))


def non_human(violations: DataFrame, by: list[str] = ()) -> DataFrame:
    """Total and the four fixed categories of violations without a person (A2).

    A human row without an email counts in the total only.
    """
    rest = violations.where(person().isNull())
    return rest.groupBy(*by).agg(
        F.count("*").alias("total_count"),
        *[F.count_if(col("actor_type") == k).alias(k.lower()) for k in V.NON_HUMAN_CATEGORIES],
    )


def summary(events: DataFrame, requests: DataFrame, violations: DataFrame) -> DataFrame:
    """Events processed, requests found, violations found (A5)."""
    parts = [
        events.agg(F.count("*").alias("n")).select(F.lit("events_processed").alias("what"), "n"),
        requests.agg(F.count("*").alias("n")).select(F.lit("access_requests_found").alias("what"), "n"),
        violations.agg(F.count("*").alias("n")).select(F.lit("total_violations_found").alias("what"), "n"),
    ]
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return joined.agg(*[
        F.sum(F.when(col("what") == w, col("n"))).alias(w)
        for w in ("events_processed", "access_requests_found", "total_violations_found")
    ])


def report_header(violations: DataFrame, period: dict[str, str], run: dict[str, str], by: list[str] = ()) -> DataFrame:
    """Report without its lists, as nested structs: one row, or one per ``by`` key.

    ``period`` holds start, end, start_local, end_local; ``run`` holds
    generated_at and execution_duration_seconds.
    """
    return _header(_counts(violations, by), period, run, by, ["total_violations_found"])


def _counts(violations: DataFrame, by: list[str]) -> DataFrame:
    return violations.groupBy(*by).agg(
        F.count("*").alias("total_violations_found"), *category_counts(), *actor_counts(),
        F.count_if(person().isNull()).alias("non_human_total"),
    )


def report_headers(events: DataFrame, requests: DataFrame, violations: DataFrame, period: dict[str, str], run: dict[str, str], by: list[str]) -> DataFrame:
    """Headers with all three counts of the run (A5, S18): one row per key that has events, requests or violations.

    A day without violations has a header too, with zeros.
    """
    tally = lambda df, e, r: df.select(*by, F.lit(e).alias("events_processed"), F.lit(r).alias("access_requests_found"))
    seen = tally(events, 1, 0).unionByName(tally(requests, 0, 1)).unionByName(tally(violations, 0, 0))
    seen = seen.groupBy(*by).agg(F.sum("events_processed").alias("events_processed"), F.sum("access_requests_found").alias("access_requests_found"))
    counts = _counts(violations, by)
    same = reduce(lambda x, y: x & y, [seen[k].eqNullSafe(counts[k]) for k in by])
    joined = seen.join(counts, same, "left").select(*(seen[c] for c in seen.columns), *(F.coalesce(counts[c], F.lit(0)).alias(c) for c in counts.columns if c not in by))
    return _header(joined, period, run, by, ["events_processed", "access_requests_found", "total_violations_found"])


def _header(counts: DataFrame, period: dict[str, str], run: dict[str, str], by: list[str], summary: list[str]) -> DataFrame:
    cats = ["s3_unauthorized_access", "s3_outside_window", "db_unauthorized_access", "db_outside_window"]
    actors = ["human_actors", "service_principals", "service_accounts", "aws_services", "unknown_actors"]
    kinds = dict(zip(V.NON_HUMAN_CATEGORIES, ["service_principals", "aws_services", "unknown_actors", "service_accounts"]))
    return counts.select(
        *by,
        F.struct(F.lit(run["generated_at"]).alias("generated_at"),
                 F.round(F.lit(float(run["execution_duration_seconds"])), 3).alias("execution_duration_seconds")).alias("report_metadata"),
        F.struct(*[F.lit(period[k]).alias(k) for k in ("start", "end", "start_local", "end_local")]).alias("time_period"),
        F.struct(*summary).alias("execution_summary"),
        F.struct(*cats).alias("violations_by_category"),
        F.struct(*actors).alias("violations_by_actor_type"),
        F.struct(col("non_human_total").alias("total_count"),
                 F.create_map(*[x for k, c in kinds.items() for x in (F.lit(k), col(c))]).alias("by_category"),
                 ).alias("non_human_violations"),
    )


def report_lines(violations: DataFrame, header: DataFrame) -> DataFrame:
    """The whole report as JSON lines: header rows, then every violation under its person."""
    head = header.select(F.lit("header").alias("section"), F.lit(None).cast("string").alias("user_email"),
                         F.to_json(F.struct(*header.columns)).alias("json"))
    body = violations.select(
        F.when(person().isNotNull(), "human").otherwise("non_human").alias("section"), person().alias("user_email"),
        F.to_json(violation_json(violations), {"ignoreNullFields": "false"}).alias("json"))
    return head.unionByName(body)


def violation_json(violations: DataFrame) -> Column:
    keep = [c for c in violations.columns if c not in ("ord", "src_rank", "local_date")]
    return F.struct(*keep)
