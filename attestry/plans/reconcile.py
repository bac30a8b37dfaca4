"""The nightly reconciliation over any number of days."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from attestry import fixed_values as V
from attestry.operators import correlate as C
from attestry.operators.issuance import enrich_sessions
from attestry.operators.joins import SALTS, with_columns_or_null
from attestry.operators.scans import scan_curated_events, scan_object_events, union_sources, with_event_number
from attestry.schemas import EVENT_COLUMNS


@dataclass(frozen=True)
class Settings:
    """Run configuration: a few kilobytes from a parameter store."""

    zone: str = V.DEFAULT_ZONE
    databases: list[str] = field(default_factory=list)
    db_arn_map: dict[str, str] = field(default_factory=dict)
    db_users: list[str] = field(default_factory=list)
    actors: dict[str, list[str]] = field(default_factory=dict)
    issuance: str = "earliest"
    carry_over: bool = False
    salts: int = SALTS


def access_events(objects: DataFrame, curated: DataFrame | None, settings: Settings) -> DataFrame:
    """Both sources as conformed events; sessions know their issuance."""
    return C.conform(_sources(objects, curated, settings), settings.zone)


def _sources(objects: DataFrame, curated: DataFrame | None, settings: Settings) -> DataFrame:
    return union_sources(objects, None if curated is None else enrich_sessions(curated, settings.issuance))


def candidates(events: DataFrame, tags: DataFrame | None, settings: Settings) -> DataFrame:
    """Events that can be violations, with their actor."""
    rows = C.access_candidates(events, settings.db_arn_map, settings.databases, settings.db_users, settings.actors)
    return C.resolve_actors(rows, tags, settings.salts)


def correlated(events: DataFrame, requests: DataFrame, tags: DataFrame | None, settings: Settings) -> DataFrame:
    """Every candidate event with matched request and coverage."""
    rows = candidates(events, tags, settings)
    return C.match_requests(rows, requests, settings.zone, settings.carry_over, settings.salts)


def reconcile_raw(raw_objects: DataFrame, raw_curated: DataFrame | None, requests: DataFrame, tags: DataFrame | None = None,
                  settings: Settings = Settings(), start: str | None = None, end: str | None = None, buckets: list[str] = (),
                  prefixes: list[str] = (), whitelist: dict[str, list[str]] | None = None) -> DataFrame:
    """Violations of a period, from the stores as :mod:`attestry.schemas` declares them: scan, number, reconcile."""
    objects = with_event_number(scan_object_events(raw_objects, start, end, buckets, prefixes, whitelist), settings.zone)
    curated = None if raw_curated is None else with_event_number(scan_curated_events(raw_curated, start, end), settings.zone)
    return reconcile(objects, curated, requests, tags, settings)


def reconcile(objects: DataFrame, curated: DataFrame | None, requests: DataFrame,
              tags: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Deduplicated violations of all days in the input.

    Inputs carry ``ord`` (a stable event number) and, for ``curated``,
    ``local_date``.  Covered events leave first and copies next.  Requests of the
    own day are met once, for both their windows and the newest of them; requests
    of any day (``carry_over``) by their hour first, and the newest is looked up
    for the remaining few.  Person and day are part of what copies agree in, so
    both ways give the same rows.
    """
    known = _sources(objects, curated, settings)
    # Columns that neither source has are null: they stay out of the shuffles and come back at the end.
    have = {c.lower() for c in [*known.columns, *C.VIOLATION_KEY]}
    absent = [c for c in EVENT_COLUMNS if c.lower() not in have]
    rows = candidates(C.conform(known, settings.zone), tags, settings).drop(*absent)
    if settings.carry_over:
        rows = C.with_coverage(rows, requests, settings.zone, True, settings.salts).where("not covered")
        rows = C.unapproved(C.with_request(C.keep_first_violation(rows), requests, True, settings.salts))
    else:
        rows = C.keep_first_violation(C.unapproved(C.with_day_lookup(rows, requests, settings.zone)))
    return C.as_violations(with_columns_or_null(rows, absent))
