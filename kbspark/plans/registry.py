"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
_FROM = re.compile(rf"\b(FROM|JOIN) ({TABLES.replace(' ', '|')})\b")


def derived(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    """A relation that Spark derives from the given tables; it is written once, in SQL that both engines read."""
    names = {name for _, name in _FROM.findall(relation)}
    text = _FROM.sub(r"\1 {\2}", relation.replace("{", "{{").replace("}", "}}"))
    return spark.sql(f"SELECT * FROM {text}", **{n: table(spark, sf_dir, n) for n in names})
