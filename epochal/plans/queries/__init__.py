"""The driver-contract queries of the core, with their SQL."""

from __future__ import annotations

from epochal.plans.queries import ingest, problems, reference

MODULES = [problems, reference, ingest]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
