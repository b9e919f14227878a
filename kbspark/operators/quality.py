"""Integrity, parity, drift and gate reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parity(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that only one side has, with ``missing`` or ``extra``."""
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(actual.select(*keys).distinct().withColumn("_a", F.lit(1)), list(keys), "full_outer")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra")
    return both.select(*keys, state.alias("state")).filter("state is not null")


def dangling(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def tag_drift(tags: DataFrame) -> DataFrame:
    """Pairs of distinct tags where one starts the other, or that one edit turns into each other.

    Prefix pairs meet on equal prefixes and edit pairs on equal strings with one character left out, so no tag meets all
    others.
    """
    one = tags.select("tag").filter("tag is not null and tag <> ''").distinct()
    starts = one.select(F.col("tag").alias("b"), F.explode(F.transform(F.sequence(F.lit(1), F.length("tag")), lambda n: F.substring(F.col("tag"), F.lit(1), n))).alias("a")).filter("a <> b")
    prefix = starts.join(one.withColumnRenamed("tag", "a"), "a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cut = F.transform(F.sequence(F.lit(1), F.length("tag")), lambda n: F.concat(F.substring(F.col("tag"), F.lit(1), n - 1), F.substring(F.col("tag"), n + 1, F.length("tag"))))
    keyed = one.select("tag", F.explode(F.array_distinct(F.concat(cut, F.array("tag")))).alias("key"))
    near = keyed.alias("x").join(keyed.alias("y"), F.expr("x.key = y.key and x.tag < y.tag")).select(F.col("x.tag").alias("a"), F.col("y.tag").alias("b")).distinct()
    return prefix.union(near.filter(F.levenshtein("a", "b") == 1)).distinct()


def set_revision(rows: DataFrame, key: str, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """An order-free revision of a table, or of each group of it: the hash of its size and of the sums of its rows' hashes.

    Sums are associative, so every task sends one row, however large the table is; unlike with exclusive or, repeated
    rows do not cancel.
    """
    line = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.sha2(value, 256)), 256)
    number = lambda k: F.conv(F.substring("line", 15 * k + 1, 15), 16, 10).cast("long").alias(f"l{k}")
    # Sums of 20 bits fit longs for 2^43 rows and take half the time of sums of decimals.
    bits = lambda k, j: F.sum(F.shiftright(f"l{k}", 20 * j).bitwiseAND(F.lit((1 << 20) - 1))).alias(f"l{k}_{j}")
    numbers = rows.select(*by, line.alias("line")).select(*by, *map(number, range(4)))
    sums = numbers.groupBy(*by).agg(F.count("*").alias("n_rows"), *[bits(k, j) for k in range(4) for j in range(3)])
    joined = lambda k: F.expr(" + ".join(f"l{k}_{j}::decimal(38,0) * {1 << 20 * j}" for j in range(3))).cast("decimal(38,0)")
    whole = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("0")) for c in (F.col("n_rows"), *map(joined, range(4)))])
    return sums.select(*by, F.sha2(whole, 256).alias("revision"), "n_rows")


def evaluate_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """``metrics(metric, value)`` against ``gates(metric, op, bound)``; a metric that is not there fails."""
    value, bound, op = F.col("value"), F.col("bound"), F.col("op")
    passed = F.when(op == "<", value < bound).when(op == "<=", value <= bound).when(op == ">", value > bound).when(op == ">=", value >= bound)
    return gates.join(metrics, "metric", "left").select("metric", "value", F.coalesce(passed, F.lit(False)).alias("passed"))
