"""Queries over the driver's tables and fixtures, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, changes, code, codegraph, context, corpus, evaluation, markdown, reports, resolution, search, selectors, snapshots, staleness, sweeps  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
