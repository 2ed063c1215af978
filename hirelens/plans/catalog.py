"""Query registry: each operator of the survey inventory as a Spark query over
the driver tables plus its DuckDB SQL twin (the correctness oracle).

Every query reads the whole driver tables (through the ``jobs`` /
``raw_hits`` derivations of ``hirelens.fixtures``) — no id subsets, no row
caps except where the limit is the feature (top-k reports).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _load_all():
    # Importing the modules fills the registry.
    from hirelens.plans import q_trends, q_distribution, q_filters, q_ingest, q_codes, q_day_state, q_documents, q_gram_index, q_io, q_partial, q_reports, q_stream  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(SQL)
