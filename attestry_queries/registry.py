"""All registered queries and oracles."""

from __future__ import annotations

from attestry_queries import access, evidence, governance, ingest, landings, reports, stores, streams

MODULES = [access, reports, ingest, evidence, governance, streams, landings, stores]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
