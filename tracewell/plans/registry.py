"""Every query of the trace operators and its SQL, by name."""

from __future__ import annotations

from tracewell.plans import assembly_queries, catalog, dataset_queries, event_queries, gather_queries, label_queries, pick_queries, stage_queries, survey_queries, trend_queries, view_queries

MODULES = (gather_queries, dataset_queries, pick_queries, event_queries, label_queries, trend_queries, stage_queries, survey_queries, assembly_queries, view_queries)


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
