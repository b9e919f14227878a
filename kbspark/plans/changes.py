"""Page edits, staging, findings and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutation
from ..sources.versioned import VersionedTable, shared_path
from ..streaming import log
from .corpus import LINKS, _links
from .registry import query, table

# Customers play the pages, the nation a page's revision, suppliers the requests.


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_nationkey").alias("revision"), F.col("c_name").alias("title"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_nationkey").alias("revision"), F.col("s_name").alias("title"))


@query("SELECT p_partkey AS page, CASE WHEN c_custkey IS NULL THEN 'created' ELSE 'exists' END AS status FROM part LEFT JOIN customer ON c_custkey = p_partkey")
def page_insert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.insert_status(_pages(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page")), "page")


@query("""SELECT s_suppkey AS page, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_nationkey = s_nationkey THEN 'updated' ELSE 'conflict' END AS status,
  c_nationkey AS current FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey""")
def page_update_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.update_status(_pages(spark, sf_dir), _requests(spark, sf_dir), "page", "revision")


@query("""SELECT c_custkey AS page, CASE WHEN s_suppkey IS NOT NULL THEN c_nationkey + 1 ELSE c_nationkey END AS revision, coalesce(s_name, c_name) AS title
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey = c_nationkey""")
def page_updates_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"title": F.col("new_title"), "revision": F.col("revision") + 1}
    return mutation.update_pages(_pages(spark, sf_dir), _requests(spark, sf_dir).withColumnRenamed("title", "new_title"), "page", "revision", sets)


@query("""SELECT c_custkey AS page, c_nationkey AS revision, c_name AS title FROM customer
  WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey = c_nationkey)""")
def page_deletes_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.delete_pages(_pages(spark, sf_dir), _requests(spark, sf_dir), "page", "revision")


@query(f"""WITH {LINKS} SELECT page_id, CASE WHEN target LIKE '/%' THEN 'https://moved.example' || target ELSE target END AS target FROM links""")
def page_move_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links follow pages whose relative address became an absolute one."""
    links = _links(spark, sf_dir)
    moves = links.select(F.col("target").alias("old")).filter(F.col("old").startswith("/")).distinct().withColumn("new", F.concat(F.lit("https://moved.example"), "old"))
    return mutation.move_pages(table(spark, sf_dir, "pages").select("url"), links, moves, "url", "target")[1]


@query("""WITH leases AS (SELECT user_id, max(ts) + INTERVAL 3600 SECOND AS lease FROM events GROUP BY user_id)
  SELECT user_id, lease FROM leases WHERE lease < (SELECT max(ts) FROM events) ORDER BY lease, user_id LIMIT 32""")
def staging_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 sessions that one cleanup pass takes."""
    leases = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 3600 SECOND")).alias("lease"))
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    return mutation.expired_staging(leases.join(F.broadcast(now)), "lease", F.col("now"), 32, "user_id").select("user_id", "lease")  # now is one row


@query(f"WITH {LINKS} SELECT page_id, url FROM pages WHERE url IS NOT NULL AND url NOT IN (SELECT target FROM links)")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no link names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").filter("url is not null")
    return pages.join(_links(spark, sf_dir).select(F.col("target").alias("url")).distinct(), "url", "left_anti").select("page_id", "url")


FINDINGS = f"""{LINKS}, findings AS (
  SELECT 'broken' AS kind, page_id AS page, false AS source_known FROM links WHERE target NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)
  UNION ALL SELECT 'orphan', page_id, false FROM pages WHERE url IS NOT NULL AND url NOT IN (SELECT target FROM links)
  UNION ALL SELECT 'missing_source', doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
  UNION ALL SELECT 'stale', doc_id, source IS NOT NULL FROM documents JOIN labels USING (doc_id) WHERE quality = 0)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings as one tall table."""
    pages, links = table(spark, sf_dir, "pages"), _links(spark, sf_dir)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    row = lambda rows, kind, key, known: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("page"), known.alias("source_known"))
    urls = pages.select(F.col("url").alias("target")).distinct()
    out = row(links.join(urls, "target", "left_anti"), "broken", "page_id", F.lit(False))
    out = out.unionByName(row(orphan_pages(spark, sf_dir), "orphan", "page_id", F.lit(False)))
    out = out.unionByName(row(docs.join(labels, "doc_id", "left_anti"), "missing_source", "doc_id", F.lit(False)))
    return out.unionByName(row(docs.join(labels, "doc_id").filter("quality = 0"), "stale", "doc_id", F.col("source").isNotNull()))


@query(f"WITH {FINDINGS} SELECT kind, count(*) AS n_findings, count(DISTINCT page) AS n_pages FROM findings GROUP BY kind")
def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_findings"), F.count_distinct("page").alias("n_pages"))


@query(f"""WITH {FINDINGS} SELECT kind, page, CASE WHEN kind = 'stale' AND source_known THEN 'update' WHEN kind = 'missing_source' THEN 'delete' ELSE 'blocked' END AS route
  FROM findings""")
def remediation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.remediation(_findings(spark, sf_dir)).select("kind", "page", "route")


@query("""SELECT source, lang, count(*) AS n_pages, count(*) FILTER (text IS NULL OR text = '') AS n_empty, sum(length(text))::BIGINT AS n_chars
  FROM documents GROUP BY source, lang""")
def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n_pages"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_empty"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stream_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest log read as a stream into a versioned table."""
    path = shared_path(spark, "last-wins")
    kept = VersionedTable(spark, f"{path}/table")
    # As a pattern: the stream source takes the path of a single file for a partitioned folder.
    events = log.events_stream(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events")).select("user_id", "event_id", "event_type")
    log.last_wins(events, kept, "user_id", "event_id", f"{path}/checkpoint").awaitTermination()
    newest = kept.newest()
    return no_events(spark, sf_dir) if newest is None else newest


def no_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty table, for a stream that had no files."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").filter("false")
