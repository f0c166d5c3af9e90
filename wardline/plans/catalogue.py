"""All registered queries of the core and their SQL."""

from __future__ import annotations

from wardline.plans import corpus_queries, feature_queries, metric_queries, model_queries, session_queries, source_queries  # noqa: F401  (they register)
from wardline.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
