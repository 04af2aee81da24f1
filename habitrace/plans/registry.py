"""All queries of this library by name, each with the SQL of the same result."""

from __future__ import annotations

from habitrace.plans import clouds, documents, drawings, evidence, fits, frames, fusion, graphs, layout, measures, records, recovered, registration, relations, risk, rooms, routes, scans, spaces, streams, surfaces, texts, tracks
from habitrace.plans.define import QUERIES, SQL, Query

FAMILIES = (risk, measures, fusion, clouds, fits, layout, frames, relations, graphs, scans, texts, streams, records, rooms, tracks, routes, evidence, registration, spaces, surfaces, documents, recovered, drawings)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
