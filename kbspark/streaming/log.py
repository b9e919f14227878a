"""The ingest log as a stream: last-wins state, idempotent batches and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import Snapshots
from ..sources.versioned import VersionedTable, staged


def last_wins(stream: DataFrame, table: VersionedTable, key: str, seq: str, checkpoint: str) -> StreamingQuery:
    """Keep each key's row with the highest ``seq`` in ``table``; ends when what is there now has been read.

    A micro-batch writes the version of its own number from the version before it, so a batch that is run again after
    a failure replaces its own version and changes nothing else. Rows with a null key or ``seq`` are left out; of equal
    ``seq`` the row that sorts last stays. Each version is written whole, so batches should not be small against the table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col(key).isNotNull() & F.col(seq).isNotNull())
        before = table.read(number - 1)
        both = rows if before is None else before.unionByName(rows)
        order = F.struct(F.col(seq), *[F.col(c) for c in both.columns if c not in (key, seq)])
        newest = both.groupBy(key).agg(F.max(order).alias("_row"))
        table.write(newest.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in both.columns]), number)

    return stream.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def last_wins_buckets(stream: DataFrame, store: Snapshots, name: str, key: str, seq: str, checkpoint: str) -> StreamingQuery:
    """``last_wins`` into a table of ``store``: a micro-batch reads and writes only the buckets that hold its keys.

    The manifest names the batch that it came from, so a batch that is run again after its commit changes nothing. The
    store must have no other writer.
    """

    def merge(batch: DataFrame, number: int) -> None:
        base = store.manifest()
        if base["note"].get("batch", -1) >= number:
            return
        rows = staged(batch.filter(F.col(key).isNotNull() & F.col(seq).isNotNull()))
        before = store.read(base, name)
        both = rows if before is None else rows.unionByName(before.join(rows.select(key).distinct(), key, "left_semi").select(rows.columns))
        order = F.struct(F.col(seq), *[F.col(c) for c in both.columns if c not in (key, seq)])
        newest = both.groupBy(key).agg(F.max(order).alias("_row"))
        newest = newest.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in both.columns])
        store.commit(base, {name: store.replaced(base, name, key, newest)}, note={"batch": number})

    return stream.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def distinct_batches(stream: DataFrame, identity: list[str], ts: str, delay: str) -> DataFrame:
    """One row per identity within ``delay`` of event time: a batch that is sent again is dropped, and old state expires."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(identity)


def lease_sessions(stream: DataFrame, key: str, ts: str, lease: str, delay: str) -> DataFrame:
    """Leases that every event renews; a session is given out once the watermark has passed its end."""
    spans = stream.filter(F.col(key).isNotNull()).withWatermark(ts, delay).groupBy(key, F.session_window(ts, lease).alias("s"))
    return spans.agg(F.count("*").alias("renewals")).select(key, F.col("s.start").alias("opened"), F.col("s.end").alias("expires"), "renewals")


def events_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """New files of a Parquet table as a stream with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
