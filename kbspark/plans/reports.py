"""The lint report of a domain, sections related to others, and the publication of a whole code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint, publication, retrieval
from ..operators import markdown as m
from ..sources.snapshots import Snapshots
from ..sources.versioned import shared_path, staged
from . import markdown as md
from .registry import derived, query, table

_S = "CAST({} AS STRING)".format
#: The pages of the Markdown queries with one more line: a link into one of three domains, of which one cannot be seen, and one to a generated page.
_EXTRA = "'[x](wiki://' || CASE d % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'other' ELSE 'hidden' END || '/d1.md) [i](index.md)'"
LINTED = f"(SELECT slug, markdown || chr(10) || {_EXTRA} AS markdown, k, d FROM {md.PAGES}) AS linted"
_OTHER = f"(SELECT 'other' AS domain, 'q' || {_S('n_nationkey')} AS page, '' AS anchor FROM nation) AS other"
_STATES = f"(SELECT CASE doc_id % 4 WHEN 0 THEN 'guide/d' ELSE 'd' END || {_S('doc_id')} AS page, CASE WHEN quality IS NULL THEN 'missing_source' WHEN quality = 0 THEN 'stale' ELSE 'fresh' END AS state FROM documents LEFT JOIN (SELECT doc_id AS labelled, quality FROM labels) AS known ON labelled = doc_id) AS states"
_HEADS = "CASE k WHEN 0 THEN ['page-' || d, 'overview', 'install', 'outgoing-links'] WHEN 1 THEN ['using-' || d, 'next-step', 'last'] WHEN 2 THEN ['deep', 'empty', 'top'] WHEN 4 THEN ['references'] ELSE [] END"
_TO = "CASE k WHEN 0 THEN [('guide/d' || d + 4, 'next-step'), ('guide/d' || d + 1, ''), ('d1', '')] WHEN 1 THEN [('d' || d + 1, 'top'), ('guide/d' || d + 3, ''), ('d2', 'top')] ELSE [] END"


@query(f"""WITH p AS (SELECT l.*, lang, length(trim(coalesce(text, ''))) AS n, length({_EXTRA}) AS x FROM {LINTED.replace('AS linted', 'AS l')} JOIN documents ON doc_id = d), a AS (SELECT slug AS page, unnest(list_append({_HEADS}, '')) AS anchor FROM p),
  lk AS (SELECT DISTINCT slug, t[1] AS page, t[2] AS anchor FROM (SELECT slug, unnest({_TO}) AS t FROM p)), g AS (SELECT DISTINCT CASE WHEN k = 0 THEN unnest(['first-steps', lang]) END AS tag FROM p WHERE k = 0),
  s AS (SELECT slug, unnest(CASE k WHEN 0 THEN ['unknown_type Guide', 'missing_description'] WHEN 2 THEN ['deep_heading', 'pre_h2_text', 'missing_lead Empty', CASE WHEN 5 + n + 1 + x - CASE WHEN n = 0 THEN 1 ELSE 0 END > 250 THEN 'long_lead Top' END] WHEN 3 THEN ['pre_h2_text']
    WHEN 4 THEN ['unknown_type odd', 'missing_description', 'unknown_status weird', CASE WHEN n + 1 + x > 250 THEN 'long_lead References' END] END) AS f FROM p)
  SELECT 'broken' AS kind, slug AS page, page || CASE anchor WHEN '' THEN '' ELSE '#' || anchor END AS detail FROM lk WHERE (page, anchor) NOT IN (SELECT (page, anchor) FROM a)
  UNION ALL SELECT 'broken', slug, 'other/d1' FROM p WHERE d % 3 = 1 AND k <> 5 UNION ALL SELECT 'reserved_target', slug, 'index' FROM p WHERE k <> 5 UNION ALL SELECT 'unavailable_domain', slug, 'hidden/d1' FROM p WHERE d % 3 = 2 AND k <> 5
  UNION ALL SELECT 'orphan', slug, '' FROM p WHERE slug NOT IN (SELECT page FROM lk WHERE page <> slug) UNION ALL SELECT 'legacy_link', slug, '' FROM p WHERE k = 1
  UNION ALL SELECT 'section', slug, rtrim(f) FROM s WHERE f IS NOT NULL UNION ALL SELECT 'missing_front_matter', slug, '' FROM p WHERE k IN (1, 3, 5)
  UNION ALL SELECT 'tag_drift', NULL, x.tag || ' ' || y.tag FROM g x JOIN g y ON x.tag < y.tag AND (levenshtein(x.tag, y.tag) = 1 OR starts_with(y.tag, x.tag)) UNION ALL SELECT state, page, '' FROM {_STATES} WHERE state <> 'fresh'""")
def wiki_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of finding about a domain's pages in one table."""
    pages = derived(spark, sf_dir, LINTED).select("slug", "markdown")
    anchors = m.heading_anchors(pages).select(F.lit("main").alias("domain"), F.col("slug").alias("page"), "anchor")
    visible = anchors.union(pages.select(F.lit("main"), "slug", F.lit(""))).union(derived(spark, sf_dir, _OTHER))
    out = lint.lint_findings(pages, "main", visible, derived(spark, sf_dir, _STATES))
    return out.withColumn("detail", F.rtrim("detail"))


# Vectors are chunks of sections, three to a section; a few sections have none and fall back on links.
_COS = "round(list_cosine_similarity(r.embedding::DOUBLE[], w.embedding::DOUBLE[]), 4)"
_PAGE_LINKS = f"(SELECT 'g' || {_S('vec_id // 3')} AS source, 'g' || {_S('(vec_id // 3 * 7 + label) % 60')} AS target FROM embeddings) AS page_links"


@query(f"""WITH RECURSIVE r AS (SELECT 'sec' || vec_id // 3 AS section, 'g' || vec_id // 3 AS page, embedding, vec_id FROM embeddings WHERE vec_id % 4 <> 1), t AS (SELECT DISTINCT 'sec' || vec_id // 3 AS target, 'g' || vec_id // 3 AS home, (vec_id // 3) AS n FROM embeddings WHERE (vec_id // 3) % 25 = 0),
  w AS (SELECT target, home, embedding, row_number() OVER (PARTITION BY target ORDER BY embedding) AS i FROM t JOIN r ON r.section = t.target), b AS (SELECT w.target, r.section AS item, max({_COS}) AS score FROM w JOIN r ON r.section <> w.target WHERE i = 1 GROUP BY ALL)
  SELECT target, 'vector' AS source, item, score, row_number() OVER (PARTITION BY target ORDER BY score DESC, item)::INT AS place FROM b QUALIFY place <= 6""")
def related_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections nearest to every 25th one."""
    records, targets, links = _records(spark, sf_dir)
    return retrieval.related(records, targets, links, 6, 2)


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.floor(F.col("vec_id") / 3).cast("string")
    v = table(spark, sf_dir, "embeddings").withColumn("section", F.concat(F.lit("sec"), n)).withColumn("page", F.concat(F.lit("g"), n))
    targets = v.filter(F.floor(F.col("vec_id") / 3) % 25 == 0).select("section")
    links = v.select(F.col("page").alias("source"), F.concat(F.lit("g"), ((F.floor(F.col("vec_id") / 3) * 7 + F.col("label")) % 60).cast("string")).alias("target"))
    return v.filter("vec_id % 4 <> 1").select("section", "page", F.lit("section").alias("kind"), "embedding"), targets, links


@query("""WITH RECURSIVE l AS (SELECT DISTINCT 'g' || vec_id // 3 AS source, 'g' || ((vec_id // 3) * 7 + label) % 60 AS target FROM embeddings), h AS (SELECT DISTINCT 'sec' || vec_id // 3 AS target, 'g' || vec_id // 3 AS home FROM embeddings WHERE vec_id % 4 <> 1 AND (vec_id // 3) % 25 = 0),
  w AS (SELECT h.target, home AS item, 0 AS step FROM h UNION SELECT w.target, l.target, step + 1 FROM w JOIN l ON l.source = item WHERE step < 2), f AS (SELECT target, item, min(step) FILTER (step > 0) AS step FROM w GROUP BY target, item HAVING min(step) FILTER (step > 0) IS NOT NULL)
  SELECT target, 'graph' AS source, item, row_number() OVER (PARTITION BY target ORDER BY step, item)::INT AS place FROM f""")
def related_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without any neighbour to compare with: pages by links instead, here because all records are summaries."""
    records, targets, links = _records(spark, sf_dir)
    return retrieval.related(records.withColumn("kind", F.lit("summary")), targets, links, 6, 2).select("target", "source", "item", "place")


_FILES = f"(SELECT DISTINCT 'f' || {_S('p_partkey % 23')} AS path, 'python' AS language FROM part) AS files"
_SYMBOLS = f"(SELECT 's' || {_S('p_partkey')} AS entity_id, 'f' || {_S('p_partkey % 23')} AS path, 1 + p_size AS start, 1 + p_size + p_partkey % 9 AS stop FROM part) AS symbols"
_RELATIONS = f"(SELECT DISTINCT 's' || {_S('l_partkey')} AS src, 's' || {_S('p_partkey')} AS dst, 'CALLS' AS kind FROM lineitem JOIN part ON p_partkey = l_suppkey) AS relations"


@query(f"""SELECT 1 AS version, 'files' AS name, count(*) AS n_rows, 0 AS n_wrong FROM {_FILES} UNION ALL SELECT 1, 'symbols', count(*), 0 FROM {_SYMBOLS} UNION ALL SELECT 1, 'relations', count(*), 0 FROM {_RELATIONS}
  UNION ALL SELECT 2, 'refused', 0, count(*) FROM {_SYMBOLS} WHERE path = 'f3' UNION ALL SELECT 3, 'relations', count(*), 0 FROM {_RELATIONS} WHERE src <> 's1' AND dst <> 's1' UNION ALL SELECT 3, 'symbols', count(*), 0 FROM {_SYMBOLS} WHERE entity_id <> 's1'""")
def published_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code graph published whole, one refused for symbols whose file is not there, and one without a symbol."""
    store = Snapshots(spark, shared_path(spark, "graph"))
    files, symbols, relations = (staged(derived(spark, sf_dir, r)) for r in (_FILES, _SYMBOLS, _RELATIONS))
    publication.publish_graph(store, files, symbols, relations)
    _, wrong = publication.publish_graph(store, files.filter("path <> 'f3'"), symbols, relations)
    publication.publish_graph(store, files, symbols.filter("entity_id <> 's1'"), relations.filter("src <> 's1' and dst <> 's1'"))
    one, two = store.manifest(1), store.manifest(2)
    row = lambda v, t, man: store.read(man, t).agg(F.lit(v).alias("version"), F.lit(t).alias("name"), F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_wrong"))
    out = row(1, "files", one).union(row(1, "symbols", one)).union(row(1, "relations", one))
    refused = wrong.agg(F.lit(2), F.lit("refused"), F.lit(0).cast("long"), F.count("*"))
    return out.union(refused).union(row(3, "relations", two)).union(row(3, "symbols", two))
