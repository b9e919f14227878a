"""As-of joins, and whether pages were up to date with their sources at some time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import staged


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of its key at or before its time; nulls without one.

    The columns of ``right`` but the key must not be among those of ``left``. Both tables are dealt together by ranges of
    key and time, so a key with very many rows spreads over tasks. Within a range the last row so far is a window; what a
    range has not seen of a key is the last row of the ranges before, of which there is one for each key and range. Rows
    with a null key or time match nothing; of rows of ``right`` at one time that with the greatest columns counts.
    """
    kept = [c for c in right.columns if c != key]
    one = right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).groupBy(key, right_ts).agg(F.max(F.struct(*[F.col(c) for c in kept if c != right_ts], F.col(right_ts))).alias("_right"))
    events = one.select(F.col(key).alias("_key"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), "_right", F.lit(None).cast(left.schema).alias("_left"))
    asked = left.select(F.col(key).alias("_key"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(one.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    both = events.unionByName(asked).repartitionByRange("_key", "_ts", "_side").sortWithinPartitions("_key", "_ts", "_side")
    both = staged(both.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    here = Window.partitionBy("_part", "_key").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_right", ignorenulls=True).over(here)).filter("_side = 1")
    pieces = both.groupBy("_key", "_part").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_id"))).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("_key", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carry")).filter("_carry is not null")
    out = near.join(carried, ["_key", "_part"], "left").withColumn("_hit", F.coalesce("_near", "_carry"))
    known = F.col("_key").isNotNull() & F.col("_ts").isNotNull()
    return out.select("_left.*", *[F.when(known, F.col(f"_hit.{c}")).alias(c) for c in kept])


def page_states(asks: DataFrame, log: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each page was current when it was asked for: ``asks`` with ``record_source`` and ``state``.

    ``asks(page, at)``; ``log(page, ts, op, source, src_hash)`` are ingests and deletes, of which the last one up to then
    counts (ingests without a source say nothing); ``sources(source, changed, hash, gone)`` are the versions of sources.
    ``fresh`` if the source then has the hash that was ingested, or, without a recorded hash, has not changed since;
    ``stale`` if not; ``missing_source`` if it was not there or gone; ``no_record`` for pages never ingested or deleted.
    Other columns of ``asks`` are kept.
    """
    said = log.filter("op = 'delete' or source is not null").select("page", F.col("ts").alias("_ingested"), F.col("op").alias("_op"), F.col("source").alias("record_source"), F.col("src_hash").alias("_src_hash"))
    known = as_of_join(asks, said, "page", "at", "_ingested")
    deleted = F.coalesce(F.col("_op") == "delete", F.lit(True))
    known = known.withColumn("record_source", F.when(~deleted, F.col("record_source")))
    versions = sources.select(F.col("source").alias("record_source"), F.col("changed").alias("_changed"), F.col("hash").alias("_hash"), F.col("gone").alias("_gone"))
    j = as_of_join(known, versions, "record_source", "at", "_changed")
    same = F.when(F.col("_src_hash").isNotNull(), F.col("_hash").eqNullSafe(F.col("_src_hash"))).otherwise(F.col("_changed") <= F.col("_ingested"))
    state = F.when(F.col("record_source").isNull(), "no_record").when(F.col("_changed").isNull() | F.coalesce(F.col("_gone"), F.lit(False)), "missing_source").when(same, "fresh").otherwise("stale")
    return j.select(*asks.columns, "record_source", state.alias("state"))
