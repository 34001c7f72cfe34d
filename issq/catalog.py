"""The queries of the analytics engine, by operator id, and their SQL."""

from __future__ import annotations

from issq.plans import queries


def flagship(spark, sf_dir):
    return queries.flagship(spark, sf_dir)


def base_queries() -> dict:
    return dict(queries.QUERIES)


def base_oracle_sql() -> dict[str, str]:
    return dict(queries.SQL)
