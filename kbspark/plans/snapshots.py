"""Queries over versions of tables: refreshed links, consistent exports, differences by hash trees, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, graph
from ..operators.linkgraph import refresh_domains, refresh_links
from ..sources.snapshots import Snapshots, differing_rows, hash_tree
from ..sources.versioned import shared_path
from ..streaming import log
from .catalog import _FILES, _LINKS_BY_KIND, LINKS, PAGES
from .registry import derived, query, table

# Documents are pages; a page links to pages by multiples of its number. On the second day those of one language have other
# links and anchors, those of two sources are gone, and new pages have come.
_S = "CAST({} AS STRING)".format
_DAY1 = f"(SELECT 'p' || {_S('doc_id')} AS page, sha2(coalesce(text, ''), 256) AS hash FROM documents) AS pages"
_DAY2 = f"(SELECT 'p' || {_S('doc_id')} AS page, sha2(concat('2', coalesce(text, '')), 256) AS hash FROM documents WHERE lang = 'en' AND source <> 'src3' AND source <> 'src7' UNION ALL SELECT 'n' || {_S('doc_id')}, 'new' FROM labels) AS pages"
_LINKS = f"""(SELECT 'p' || {_S('doc_id')} AS source, 'p' || {_S('2 * doc_id')} AS target, CASE WHEN doc_id % 3 = 0 THEN 'a' || {_S('doc_id % 4')} ELSE '' END AS anchor FROM documents
  UNION ALL SELECT 'p' || {_S('doc_id')}, CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE 'p' END || {_S('doc_id + 17')}, '' FROM documents) AS links"""
_LINKS2 = f"""(SELECT 'p' || {_S('doc_id')} AS source, 'p' || {_S('doc_id + 5')} AS target, CASE WHEN doc_id % 2 = 0 THEN 'b0' ELSE '' END AS anchor FROM documents WHERE lang = 'en' AND source <> 'src3' AND source <> 'src7'
  UNION ALL SELECT 'n' || {_S('doc_id')}, 'p' || {_S('doc_id')}, 'a1' FROM labels) AS links"""
_ANCHORS = f"(SELECT 'p' || {_S('doc_id')} AS page, 'a' || {_S('doc_id % 4')} AS anchor FROM documents) AS anchors"
_ANCHORS2 = f"(SELECT 'p' || {_S('doc_id')} AS page, 'b' || {_S('doc_id % 3')} AS anchor FROM documents WHERE lang = 'en' AND source <> 'src3' AND source <> 'src7') AS anchors"
_GONE = f"(SELECT 'p' || {_S('doc_id')} AS page FROM documents WHERE source = 'src3' OR source = 'src7') AS gone"
_duck = lambda relation: relation.replace("sha2(coalesce(text, ''), 256)", "sha256(coalesce(text, ''))").replace("sha2(concat('2', coalesce(text, '')), 256)", "sha256('2' || coalesce(text, ''))")


def _two_days(spark: SparkSession, sf_dir: str) -> Snapshots:
    store = Snapshots(spark, shared_path(spark, "links"))
    nothing = derived(spark, sf_dir, _GONE).filter("false")
    refresh_links(store, *(derived(spark, sf_dir, r) for r in (_DAY1, _LINKS, _ANCHORS)), nothing)
    refresh_links(store, *(derived(spark, sf_dir, r) for r in (_DAY2, _LINKS2, _ANCHORS2, _GONE)))
    return store


_NOW = f"""g AS (SELECT page FROM {_GONE}), d2 AS (SELECT * FROM {_duck(_DAY2)}), pages AS (SELECT * FROM {_duck(_DAY1)} WHERE page NOT IN (FROM g) AND page NOT IN (SELECT page FROM d2) UNION ALL SELECT * FROM d2),
  links AS (SELECT DISTINCT * FROM {_LINKS} WHERE source NOT IN (FROM g) AND source NOT IN (SELECT page FROM d2) UNION SELECT * FROM {_LINKS2}),
  anchors AS (SELECT DISTINCT * FROM {_ANCHORS} WHERE page NOT IN (FROM g) AND page NOT IN (SELECT page FROM d2) UNION SELECT * FROM {_ANCHORS2})"""


@query(f"""WITH {_NOW} SELECT target, source, anchor, CASE WHEN target NOT IN (SELECT page FROM pages) THEN 'broken_page' WHEN anchor <> '' AND (target, anchor) NOT IN (SELECT (page, anchor) FROM anchors) THEN 'broken_anchor' ELSE 'ok' END AS state FROM links""")
def refreshed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with their states after some pages were replaced, added and removed, against all pages resolved at once."""
    store = _two_days(spark, sf_dir)
    return store.read(store.manifest(), "incoming")


@query(f"""SELECT 1 AS version, 'pages' AS name, count(*) AS n_rows FROM {_duck(_DAY1)} UNION ALL SELECT 1, 'links', count(*) FROM (SELECT DISTINCT * FROM {_LINKS}) UNION ALL SELECT 1, 'anchors', count(*) FROM {_ANCHORS} UNION ALL SELECT 1, 'incoming', count(*) FROM (SELECT DISTINCT * FROM {_LINKS})
  UNION ALL SELECT * FROM (WITH {_NOW} SELECT 2, 'pages', count(*) FROM pages UNION ALL SELECT 2, 'links', count(*) FROM links UNION ALL SELECT 2, 'anchors', count(*) FROM anchors UNION ALL SELECT 2, 'incoming', count(*) FROM links)""")
def exported_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all tables as they were together in each version: the first is read after the second was committed."""
    store = _two_days(spark, sf_dir)
    counts = [store.read(store.manifest(v), t).agg(F.lit(v).alias("version"), F.lit(t).alias("name"), F.count("*").alias("n_rows")) for v in (1, 2) for t in ("pages", "links", "anchors", "incoming")]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


_WAS = "(SELECT doc_id, lang, source, length(text) AS n FROM documents) AS was"
_IS = "(SELECT CASE WHEN doc_id % 50 = 49 THEN doc_id + 10000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 31 = 7 THEN 'xx' ELSE lang END AS lang, source, length(text) AS n FROM documents) AS now"


@query(f"SELECT coalesce(w.doc_id, i.doc_id) AS doc_id, CASE WHEN w.doc_id IS NULL THEN 'added' WHEN i.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {_WAS.replace('AS was', 'AS w')} FULL JOIN {_IS.replace('AS now', 'AS i')} ON i.doc_id = w.doc_id WHERE (w.lang, w.source, w.n) IS DISTINCT FROM (i.lang, i.source, i.n) OR w.doc_id IS NULL OR i.doc_id IS NULL")
def tree_row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ between two states of a table, found by descending hash trees."""
    return differing_rows(derived(spark, sf_dir, _WAS), derived(spark, sf_dir, _IS), "doc_id")


@query("""WITH l AS (SELECT ('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT % 256 AS leaf FROM orders), t AS (SELECT unnest([0, 1, 2]) AS level, leaf FROM l) SELECT level::INT AS level, (leaf // CASE level WHEN 0 THEN 256 WHEN 1 THEN 16 ELSE 1 END)::INT AS node, count(*) AS n_rows FROM t GROUP BY ALL""")
def hash_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders each node of a tree of two levels covers."""
    return hash_tree(table(spark, sf_dir, "orders"), "o_orderkey").select("level", "node", "n_rows")


@query("SELECT 'orders' AS name, count(*) AS n_rows, true AS again FROM orders UNION ALL SELECT 'customer', count(*), true FROM customer")
def imported_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a load tells when it is made again."""
    store = Snapshots(spark, shared_path(spark, "import"))
    load = {"orders": ("o_orderkey", table(spark, sf_dir, "orders")), "customer": ("c_custkey", table(spark, sf_dir, "customer"))}
    store.import_once("first", load)
    told = store.import_once("first", load)
    return spark.createDataFrame([(k, told[k], told["already_imported"]) for k in load], "name string, n_rows long, again boolean")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stream_last_wins_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest log as a stream, each batch rewriting only the buckets of its keys."""
    path = shared_path(spark, "last-wins-buckets")
    store = Snapshots(spark, f"{path}/store")
    table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").repartitionByRange(3, "event_id").write.parquet(f"{path}/in")
    stream = log.events_stream(spark, f"{path}/in", table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"))
    log.last_wins_buckets(stream, store, "newest", "user_id", "event_id", f"{path}/checkpoint").awaitTermination()
    return store.read(store.manifest(), "newest")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND ('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT % 16 <> 3 THEN 'new' ELSE 'old' END AS state FROM orders""")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two versions after the newer files of one bucket were spoilt: found by its hash tree, that bucket is as it was before."""
    store = Snapshots(spark, shared_path(spark, "quarantine"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("old").alias("state"))
    base = store.manifest()
    base = store.commit(base, {"orders": store.replaced(base, "orders", "o_orderkey", orders)})
    changed = orders.filter("o_orderkey % 2 = 0").withColumn("state", F.lit("new"))
    base = store.commit(base, {"orders": store.replaced(base, "orders", "o_orderkey", changed)})
    base = store.commit(base, store.sealed(base))
    spoilt = f"{store.path}/data/{base['tables']['orders']['folders']['3']}/_bucket=3"
    orders.filter(F.lit(False)).write.mode("overwrite").parquet(spoilt)
    fixed = store.quarantine(base, store.verify(base))
    return store.read(fixed, "orders")


#: On the second day each page of one domain has one more link, another domain is gone.
_FILES2 = f"(SELECT domain, file, CASE WHEN domain = 'src3' THEN coalesce(markdown, '') || chr(10) || '[n](new.md)' ELSE markdown END AS markdown, k, d FROM {_FILES} WHERE domain <> 'src7') AS files"


@query(f"""WITH f AS (SELECT domain || '/' || replace(file, '.md', '') AS page, domain, k, d FROM {_FILES2}), e AS (SELECT DISTINCT page, domain, domain || '/' || x[1] AS target, x[2] AS anchor FROM (SELECT page, domain, unnest(list_concat({_LINKS_BY_KIND}, CASE WHEN domain = 'src3' THEN [('new', '')] ELSE [] END)) AS x FROM f))
  SELECT domain, count(*) AS n_links, count(*) FILTER (target NOT IN (SELECT page FROM f)) AS n_lost, domain = 'src3' AS rebuilt FROM e GROUP BY domain""")
def refreshed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by domain after the graph was brought up to date, which parsed one domain's pages only."""
    store = Snapshots(spark, shared_path(spark, "domains"))
    refresh_domains(store, derived(spark, sf_dir, _FILES).select("domain", "file", "markdown"))
    now, wrong = refresh_domains(store, derived(spark, sf_dir, _FILES2).select("domain", "file", "markdown"))
    links = store.read(now, "incoming").withColumn("domain", F.substring_index("source", "/", 1))
    counts = links.groupBy("domain").agg(F.count("*").alias("n_links"), F.count_if(F.col("state") == "broken_page").alias("n_lost"))
    return counts.join(wrong.select("domain", F.lit(True).alias("rebuilt")), "domain", "left").withColumn("rebuilt", F.coalesce("rebuilt", F.lit(False)))


_SOME = "(SELECT domain FROM (SELECT DISTINCT source AS domain FROM documents) AS every WHERE domain < 'src5') AS scoped"


@query(f"""WITH RECURSIVE p AS (SELECT page FROM {PAGES} WHERE domain IN (SELECT domain FROM {_SOME})), e AS (SELECT source AS a, target AS b FROM {LINKS} WHERE source IN (FROM p) AND target IN (FROM p) AND source <> target), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT 'p0' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN u ON a = node WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def scoped_neighbour_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within three links of one, over pages of some domains only, read from one version of the graph."""
    scope = derived(spark, sf_dir, _SOME)
    links = catalog.scoped_links(derived(spark, sf_dir, LINKS), derived(spark, sf_dir, PAGES), scope).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    seeds = spark.createDataFrame([("p0", "seed", 1)], "node string, origin string, seed_rank int")
    return graph.capped_traversal(links, seeds, 3, None).select("node", "depth")
