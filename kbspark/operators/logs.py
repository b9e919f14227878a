"""The ingest log: an append-only event table that is read last-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(log: DataFrame, key: str, seq: str, op: str, delete: str, relevant: list[str]) -> DataFrame:
    """The last relevant event of each key, without the keys whose last one is ``delete``."""
    last = log.filter(F.col(op).isin(relevant)).groupBy(key).agg(F.max_by(F.struct(op, seq), seq).alias("last"))
    return last.filter(F.col(f"last.{op}") != delete).select(key, F.col(f"last.{op}").alias("op"), F.col(f"last.{seq}").alias("seq"))


def upsert(log: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The log without the earlier rows of changed keys, and the changes."""
    return log.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def expired_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Lease sessions: an event renews the lease of its key, a gap over ``gap_seconds`` ends it."""
    spans = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, F.session_window(F.col(ts).cast("timestamp"), f"{gap_seconds} seconds").alias("s"))
    return spans.agg(F.count("*").alias("renewals"), F.min(ts).alias("opened"), F.max(ts).alias("renewed")).drop("s")
