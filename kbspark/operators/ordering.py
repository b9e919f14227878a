"""A total order over rows of any number, without a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import staged

_ROWS = (1 << 33) - 1  # the low bits of monotonically_increasing_id are the row's number within its partition


def ranked(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the order of columns that should be unique together.

    Rows are dealt by ranges and sorted within them; a range's rows are numbered on from the counts of the ranges before,
    one row for each range, which is all that is broadcast. The result is a table in the shared folder.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_id").bitwiseAND(_ROWS) + F.col("_offset") + 1
    return rows.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, place).drop("_id", "_part", "_offset")
