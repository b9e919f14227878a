"""Staleness of pages over time, from events that play the ingest log, the sources' versions and the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import asof
from .registry import derived, query

_S = "CAST({} AS STRING)".format
_LOG = f"(SELECT 'p' || {_S('user_id')} AS page, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'ingest' END AS op, CASE WHEN event_id % 9 <> 0 THEN 's' || {_S('event_id % 11')} END AS source, CASE WHEN event_id % 4 <> 0 THEN 'h' || {_S('event_id % 3')} END AS src_hash FROM events) AS log"
_SOURCES = f"(SELECT 's' || {_S('user_id % 14')} AS source, ts AS changed, 'h' || {_S('event_id % 3')} AS hash, event_type = 'signup' AS gone FROM events) AS sources"
_ASKS = f"(SELECT event_id AS ask, 'p' || {_S('user_id + event_id % 2')} AS page, ts AS at FROM events) AS asks"


@query(f"""WITH said AS (SELECT page, ts AS ingested, op, source, src_hash FROM {_LOG} WHERE op = 'delete' OR source IS NOT NULL), v AS (SELECT * FROM {_SOURCES}),
  k AS (SELECT a.ask, a.page, a.at, CASE WHEN op <> 'delete' THEN source END AS record_source, ingested, src_hash FROM {_ASKS.replace('AS asks', 'AS a')} ASOF LEFT JOIN said ON said.page = a.page AND a.at >= said.ingested)
  SELECT k.ask, k.page, k.at, record_source, CASE WHEN record_source IS NULL THEN 'no_record' WHEN changed IS NULL OR gone THEN 'missing_source' WHEN (src_hash IS NOT NULL AND hash = src_hash) OR (src_hash IS NULL AND changed <= ingested) THEN 'fresh' ELSE 'stale' END AS state
  FROM k ASOF LEFT JOIN v ON v.source = k.record_source AND k.at >= v.changed""")
def page_states_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a page whenever someone asked for it."""
    return asof.page_states(*(derived(spark, sf_dir, r) for r in (_ASKS, _LOG, _SOURCES)))
