"""Selectors of code by pages, ignore files, snapshot batches and revisions by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import publication, quality
from ..operators import selectors as s
from .registry import derived, query, table

# Customers play the files, in a folder for each nation; orders the symbols, of which some share a name; suppliers the pages.

_CODE = """files AS (SELECT 'src/n' || c_nationkey || '/f' || c_custkey || '.py' AS path FROM customer), symbols AS (SELECT 'm.f' || (o_orderkey % 400) AS qualified_name, 's' || o_orderkey AS entity_id FROM orders),
  sel AS (SELECT s_suppkey AS page, 'symbol' AS kind, 'm.f' || (s_suppkey * 7) AS selector FROM supplier UNION SELECT s_suppkey, 'file', 'src/n' || s_nationkey || '/f' || s_suppkey || '.py' FROM supplier
    UNION SELECT s_suppkey, 'source_glob', 'src/n' || s_nationkey || '/f*' || (s_suppkey % 10) || '.py' FROM supplier UNION SELECT s_suppkey, 'file', CASE s_suppkey % 4 WHEN 0 THEN '../up.py' WHEN 1 THEN 'keys/id_rsa' WHEN 2 THEN 'build/x.py' ELSE 'src/none.py' END FROM supplier),
  judged AS (SELECT *, CASE WHEN kind <> 'symbol' AND selector LIKE '../%' THEN 'unsafe_selector' WHEN selector LIKE '%/id_rsa' THEN 'secret_selector' WHEN selector LIKE 'build/%' THEN 'ignored_selector' END AS verdict FROM sel),
  matched AS (SELECT page, kind, selector, 'symbol' AS target_type, entity_id AS target FROM judged JOIN symbols ON kind = 'symbol' AND qualified_name = selector
    UNION SELECT page, kind, selector, 'file', path FROM judged JOIN files ON kind = 'file' AND path = selector WHERE verdict IS NULL
    UNION SELECT page, kind, selector, 'file', path FROM judged JOIN files ON kind = 'source_glob' AND regexp_full_match(path, replace(replace(selector, '.', '[.]'), '*', '[^/]*'))),
  links AS (SELECT page, target_type, target, min_by(kind, k) AS kind, min_by(selector, k) AS source FROM (SELECT *, (CASE kind WHEN 'symbol' THEN 1 WHEN 'file' THEN 2 ELSE 3 END, selector) AS k FROM matched) GROUP BY ALL)"""


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cat = lambda *parts: F.concat(*[F.lit(p) if p.__class__ is str else p.cast("string") for p in parts])
    files = table(spark, sf_dir, "customer").select(cat("src/n", F.col("c_nationkey"), "/f", F.col("c_custkey"), ".py").alias("path"))
    symbols = table(spark, sf_dir, "orders").select(cat("m.f", F.col("o_orderkey") % 400).alias("qualified_name"), cat("s", F.col("o_orderkey")).alias("entity_id"))
    page, nation, rest = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_suppkey") % 4
    odd = F.when(rest == 0, "../up.py").when(rest == 1, "keys/id_rsa").when(rest == 2, "build/x.py").otherwise("src/none.py")
    named = [("symbol", cat("m.f", page * 7)), ("file", cat("src/n", nation, "/f", page, ".py")), ("source_glob", cat("src/n", nation, "/f*", page % 10, ".py")), ("file", odd)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("selector")) for k, c in named]))
    return table(spark, sf_dir, "supplier").select(page.alias("page"), each.alias("e")).select("page", "e.*"), files, symbols


def _matched(spark: SparkSession, sf_dir: str) -> s.Matched:
    named, files, symbols = _code(spark, sf_dir)
    return s.Matched(s.verdicts(named, ["build/"]).filter("verdict is null"), files, symbols)


@query(f"WITH {_CODE} SELECT * FROM links")
def selector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).links()


@query(f"WITH {_CODE} SELECT page, min_by(kind, k) AS kind, min_by(source, k) AS source, min_by(target, k) AS target FROM (SELECT *, (CASE kind WHEN 'symbol' THEN 1 WHEN 'file' THEN 2 ELSE 3 END, source, target) AS k FROM links) GROUP BY page")
def selector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's most specific link."""
    return _matched(spark, sf_dir).page_links()


@query(f"""WITH {_CODE}, seen AS (SELECT j.page, j.kind, j.selector, count(m.target) AS n FROM judged j LEFT JOIN matched m ON m.page = j.page AND m.kind = j.kind AND m.selector = j.selector WHERE verdict IS NULL GROUP BY ALL)
  SELECT page, verdict AS finding, kind, selector, 0::BIGINT AS n FROM judged WHERE verdict IS NOT NULL
  UNION ALL SELECT page, CASE WHEN n > 1 THEN 'ambiguous_symbol' WHEN kind = 'symbol' THEN 'unknown_symbol' WHEN kind = 'file' THEN 'missing_file' ELSE 'empty_glob' END, kind, selector, n FROM seen WHERE n = 0 OR (kind = 'symbol' AND n > 1)
  UNION ALL SELECT page, 'conflicting_selectors', 'file', target, count(*) FROM matched WHERE target_type = 'file' GROUP BY page, target HAVING count(*) > 1
  UNION ALL SELECT DISTINCT page, 'stale_revision', NULL, NULL, 0 FROM links WHERE page % 5 = 0""")
def selector_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong selectors, and pages whose stored links, here none for every fifth page, are not those that follow now."""
    named, files, symbols = _code(spark, sf_dir)
    return s.findings(named, files, symbols, ["build/"], _matched(spark, sf_dir).links().filter("page % 5 <> 0"), repeats=False)


_C = "CAST(c_custkey AS STRING)"
SOME_FILES = f"""(SELECT CASE c_custkey % 14 WHEN 0 THEN 'build/x' || {_C} || '.py' WHEN 1 THEN 'src/build/x' || {_C} WHEN 2 THEN 'build' WHEN 3 THEN 'a' || {_C} || '.log' WHEN 4 THEN 'x/a' || {_C} || '.log' WHEN 5 THEN 'keep.log' WHEN 6 THEN 'x' || {_C} || '/keep.log' WHEN 7 THEN 'docs/a' || {_C} || '.md'
  WHEN 8 THEN 'x/docs/a' || {_C} WHEN 9 THEN 'docs' WHEN 10 THEN 'tmp/a' || {_C} WHEN 11 THEN 'tmp' WHEN 12 THEN 'build/x' || {_C} || '/keep.log' END AS path FROM customer) AS paths"""


@query(f"""SELECT path, coalesce(CASE WHEN regexp_matches(path, '^tmp/.') THEN true WHEN regexp_matches(path, '^docs(/|$)') THEN true WHEN regexp_matches(path, '(^|/)keep[.]log(/|$)') THEN false WHEN regexp_matches(path, '(^|/)[^/]*[.]log(/|$)') THEN true ELSE regexp_matches(path, '(^|/)build/') END, false) AS ignored FROM {SOME_FILES}""")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ignore file's lines, the last match winning; the SQL asks for the lines from the last to the first."""
    lines = ["# comment", "", "build/", "*.log", "!keep.log", "/docs", "tmp/**"]
    return derived(spark, sf_dir, SOME_FILES).select("path", paths.is_ignored(F.col("path"), lines).alias("ignored"))


_ROW = """SELECT 'customer' AS kind, c_custkey::VARCHAR AS id, to_json({'c_acctbal': c_acctbal, 'c_custkey': c_custkey, 'c_name': c_name}) AS json FROM customer UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, to_json({'s_name': s_name, 's_suppkey': s_suppkey}) FROM supplier"""


@query(f"""WITH RECURSIVE r AS MATERIALIZED (SELECT kind, json, strlen(json) AS n, row_number() OVER (PARTITION BY kind ORDER BY id) AS i FROM ({_ROW})),
  g AS (SELECT kind, i, 0 AS ordinal, 1 AS held, n + 2 AS size FROM r WHERE i = 1
    UNION ALL SELECT r.kind, r.i, CASE WHEN held >= 40 OR size + 1 + n > 2000 THEN ordinal + 1 ELSE ordinal END, CASE WHEN held >= 40 OR size + 1 + n > 2000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 40 OR size + 1 + n > 2000 THEN n + 2 ELSE size + 1 + n END
      FROM g JOIN r ON r.kind = g.kind AND r.i = g.i + 1)
  SELECT kind, ordinal::INT AS ordinal, count(*) AS n_rows, max(size)::BIGINT AS n_bytes, sha256('[' || string_agg(json, ',' ORDER BY i) || ']') AS hash FROM g JOIN r USING (kind, i) GROUP BY kind, ordinal""")
def snapshot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as canonical rows in batches of 40 rows and 2000 bytes at most."""
    customers = table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey", "c_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_name", "s_suppkey")
    rows = publication.canonical_rows(customers, "customer", "c_custkey").union(publication.canonical_rows(suppliers, "supplier", "s_suppkey"))
    return publication.snapshot_batches(rows, 40, 2000).drop("payload")


@query("""WITH h AS (SELECT source, sha256(doc_id || ':' || sha256(coalesce(text, ''))) AS d FROM documents), p AS (SELECT source, count(*) AS n_rows,
    sum(('0x' || d[1:15])::HUGEINT) AS a, sum(('0x' || d[16:30])::HUGEINT) AS b, sum(('0x' || d[31:45])::HUGEINT) AS c, sum(('0x' || d[46:60])::HUGEINT) AS e FROM h GROUP BY source)
  SELECT source, sha256(concat_ws(':', n_rows, a::HUGEINT, b::HUGEINT, c::HUGEINT, e::HUGEINT)) AS revision, n_rows FROM p""")
def domain_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision of each source's documents, by which a stale one is told without reading the others."""
    return quality.set_revision(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")), by=("source",))


_E = "CAST(event_id AS STRING)"
JSONL = f"""(SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN concat('{{"op":"', event_type) WHEN 2 THEN '' WHEN 3 THEN concat('{{"page":"p', {_E}, '"}}') WHEN 4 THEN NULL ELSE concat('{{"op":"', event_type, '","page":"p', {_E}, '","ts":', CAST(user_id AS STRING), '}}') END AS line FROM events) AS log"""


@query("""SELECT event_type AS op, 'p' || event_id AS page, user_id AS ts, '- ' || event_type || ': p' || event_id AS line FROM events WHERE event_id % 7 > 4""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines read with broken ones left out, and the line that each record is shown as."""
    read = derived(spark, sf_dir, JSONL).select(F.from_json("line", "op string, page string, ts long").alias("r")).select("r.*").filter("op is not null and page is not null")
    return read.withColumn("line", F.concat(F.lit("- "), "op", F.lit(": "), "page"))
