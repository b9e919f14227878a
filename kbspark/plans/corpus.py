"""Text structure, links, logs, incremental indexing and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalise_tag, slugify
from ..operators import chunking, graph, logs, quality
from .registry import query, table

CHUNKS = r"""lines AS (SELECT doc_id, unnest(l) AS section, unnest(range(len(l))) AS ordinal FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents)),
  words AS (SELECT doc_id, ordinal, list_filter(regexp_split_to_array(section, '\s+'), lambda w: w <> '') AS w FROM lines),
  starts AS (SELECT doc_id, ordinal, w, unnest(CASE WHEN len(w) <= 40 THEN [0] ELSE range(0, len(w), 32) END) AS s FROM words WHERE len(w) > 0),
  chunks AS (SELECT doc_id, ordinal::INT AS ordinal, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, s) - 1)::INT AS chunk, left(sha256(array_to_string(w[s + 1:s + 40], ' ')), 16) AS hash FROM starts)"""


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"))


@query(f"WITH {CHUNKS} SELECT hash, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY hash HAVING count(*) > 1")
def repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunk_documents(table(spark, sf_dir, "documents"))
    return c.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).filter("n > 1")


@query("SELECT doc_id, count(*) OVER (PARTITION BY left(sha256(text), 16)) = 1 AS usable FROM documents")
def unique_identity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity that occurs more than once is unusable; counted before the join, so copies pre-aggregate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))
    counts = docs.groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("n"))
    return docs.join(counts, F.col("hash").eqNullSafe(F.col("h"))).select("doc_id", (F.col("n") == 1).alias("usable"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '\s', '-', 'g') AS slug FROM pages")
def heading_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", slugify(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("slug"))


LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query(f"WITH {LINKS} SELECT page_id, target FROM links")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(f"WITH {LINKS} SELECT target, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page FROM links GROUP BY target")
def incoming_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("target").agg(F.count_distinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))


@query(f"WITH {LINKS} SELECT DISTINCT page_id, target FROM links WHERE target NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dangling(_links(spark, sf_dir), table(spark, sf_dir, "pages"), "target", "url").select("page_id", "target").distinct()


EDGES = "edges AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), two AS (SELECT a AS src, b AS dst FROM edges UNION SELECT b, a FROM edges)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


@query(f"WITH {EDGES} SELECT src AS node, count(*) AS neighbours FROM two GROUP BY src")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbour_counts(_edges(spark, sf_dir))


BFS = f"""WITH {EDGES}, d0 AS (SELECT * FROM (VALUES ('s1', 'lexical', 1), ('s2', 'semantic', 1), ('s1', 'semantic', 2)) t(node, origin, seed_rank)),
  l0 AS (SELECT node, 0 AS depth, list_sort(list(DISTINCT origin)) AS origins, min(seed_rank) AS seed_rank FROM d0 GROUP BY node),
  c1 AS (SELECT dst AS node, 1 AS depth, list_sort(list_distinct(flatten(list(origins)))) AS origins, min(seed_rank) AS seed_rank FROM l0 JOIN two ON node = src WHERE dst NOT IN (SELECT node FROM l0) GROUP BY dst),
  l1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (ORDER BY seed_rank, node) <= {{cap}} - (SELECT count(*) FROM l0)),
  c2 AS (SELECT dst AS node, 2 AS depth, list_sort(list_distinct(flatten(list(origins)))) AS origins, min(seed_rank) AS seed_rank FROM l1 JOIN two ON node = src
    WHERE dst NOT IN (SELECT node FROM l0 UNION SELECT node FROM l1) GROUP BY dst),
  l2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (ORDER BY seed_rank, node) <= {{cap}} - (SELECT count(*) FROM l0) - (SELECT count(*) FROM l1))
  SELECT node, depth, array_to_string(origins, ',') AS origins, seed_rank FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s1", "lexical", 1), ("s2", "semantic", 1), ("s1", "semantic", 2)], "node string, origin string, seed_rank int")


@query(BFS.format(cap=40))
def graph_bfs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped_traversal(_edges(spark, sf_dir), _seeds(spark), 2, 40)


@query(BFS.format(cap=1_000_000_000))
def graph_bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped_traversal(_edges(spark, sf_dir), _seeds(spark), 2, None)


@query("""WITH t AS (SELECT DISTINCT p_name AS tag FROM part WHERE p_name <> '')
  SELECT x.tag AS a, y.tag AS b FROM t x JOIN t y ON x.tag < y.tag WHERE starts_with(y.tag, x.tag) OR levenshtein(x.tag, y.tag) = 1""")
def tag_drift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tag_drift(table(spark, sf_dir, "part").select(F.col("p_name").alias("tag")))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[\s_/-]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM part")
def normalized_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalise_tag(F.col("p_type")).alias("tag"))


@query("""SELECT user_id, max_by(event_type, event_id) AS op, max(event_id) AS seq FROM events WHERE event_type IN ('view', 'purchase', 'error')
  GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'""")
def log_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest_by_key(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "error", ["view", "purchase", "error"])


@query("""WITH changes AS (SELECT user_id, event_id, event_type FROM events WHERE event_type = 'signup')
  SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'signup' AND user_id NOT IN (SELECT user_id FROM changes WHERE user_id IS NOT NULL) UNION ALL SELECT * FROM changes""")
def log_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return logs.upsert(log.filter("event_type <> 'signup'"), log.filter("event_type = 'signup'"), "user_id")


@query("""WITH gaps AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  marked AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM gaps)
  SELECT user_id, count(*) AS renewals, min(ts) AS opened, max(ts) AS renewed FROM marked GROUP BY user_id, n""")
def session_lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.expired_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)


VERSIONS = """old AS (SELECT doc_id, left(sha256(text), 16) AS h FROM documents WHERE lang <> 'es'),
  new AS (SELECT doc_id, left(sha256(CASE WHEN lang = 'de' THEN upper(text) ELSE text END), 16) AS h FROM documents WHERE lang <> 'fr')"""


@query(f"""WITH {VERSIONS} SELECT doc_id, CASE WHEN new.h IS NULL THEN 'delete' WHEN old.h IS NULL THEN 'insert' WHEN new.h = old.h THEN 'reuse' ELSE 'update' END AS action
  FROM new FULL JOIN old USING (doc_id)""")
def incremental_index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    new = docs.filter("lang <> 'fr'").withColumn("h", content_hash(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))))
    return chunking.incremental_plan(new, docs.filter("lang <> 'es'").withColumn("h", content_hash(F.col("text"))), "doc_id", "h")


@query(f"WITH {VERSIONS} SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'extra' ELSE 'missing' END AS state FROM new FULL JOIN old USING (doc_id) WHERE new.doc_id IS NULL OR old.doc_id IS NULL")
def parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.parity(docs.filter("lang <> 'es'"), docs.filter("lang <> 'fr'"), ["doc_id"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def integrity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is not among the open ones."""
    return quality.dangling(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("""WITH h AS (SELECT sha256(doc_id || ':' || sha256(coalesce(text, ''))) AS d FROM documents), p AS (SELECT count(*) AS n_rows,
    sum(('0x' || d[1:15])::HUGEINT) AS a, sum(('0x' || d[16:30])::HUGEINT) AS b, sum(('0x' || d[31:45])::HUGEINT) AS c, sum(('0x' || d[46:60])::HUGEINT) AS e FROM h)
  SELECT sha256(concat_ws(':', n_rows, a::HUGEINT, b::HUGEINT, c::HUGEINT, e::HUGEINT)) AS revision, n_rows FROM p""")
def set_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.set_revision(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")))


@query("SELECT event_type, count(*) AS n_rows, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("""SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS n_rows FROM orders
  GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One counter table by kind, by state and in all, from one scan."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("kb_orders")
    return spark.sql("""SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS n_rows FROM kb_orders
      GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")


@query("""SELECT o_orderpriority AS kind, max(l_linenumber) AS last_batch, count(DISTINCT l_linenumber) = max(l_linenumber) AS dense, count(*) AS n_rows
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def batch_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a kind are dense if their numbers have no gap."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.max("l_linenumber").alias("last_batch"), (F.count_distinct("l_linenumber") == F.max("l_linenumber")).alias("dense"), F.count("*").alias("n_rows"))


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS active FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def active_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pointer to each key's newest finished version."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return done.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("active"))


@query("""SELECT r_name, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS readable, array_to_string(coalesce(list_sort(list(DISTINCT n_name) FILTER (c_acctbal > 9000)), []), ',') AS writable
  FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def grants_array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return j.groupBy("r_name").agg(names(F.col("n_name")).alias("readable"), names(F.when(F.col("c_acctbal") > 9000, F.col("n_name"))).alias("writable"))


@query("""SELECT n_name, (SELECT count(*) FROM customer WHERE c_acctbal < 0 AND c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_acctbal < 0 AND s_nationkey = n_nationkey) AS suppliers
  FROM nation WHERE customers + suppliers > 0""")
def domain_scope_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with two kinds of grants, each counted before its outer join; those without either are left out."""
    count = lambda name, key, to: table(spark, sf_dir, name).filter(f"{name[0]}_acctbal < 0").groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(to))
    n = table(spark, sf_dir, "nation").join(count("customer", "c_nationkey", "customers"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return n.select("n_name", zero("customers"), zero("suppliers")).filter("customers + suppliers > 0")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_source' WHEN l.quality = 0 THEN 'stale' ELSE 'fresh' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality").withColumn("known", F.lit(1)), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("known").isNull(), "missing_source").when(F.col("quality") == 0, "stale").otherwise("fresh").alias("state"))
