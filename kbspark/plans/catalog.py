"""Queries over domains, pages, chunks and code entities: documents are pages of their sources, regions are empty domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, code, extraction
from ..sources.versioned import staged
from . import codegraph, context
from . import markdown as md
from .registry import derived, query, table

_S = "CAST({} AS STRING)".format
DOMAINS = "(SELECT DISTINCT source AS domain FROM documents UNION SELECT r_name FROM region) AS domains"
PAGES = f"(SELECT 'p' || {_S('doc_id')} AS page, source AS domain, coalesce(text, '') AS markdown, doc_id FROM documents) AS pages"
LINKS = f"(SELECT DISTINCT 'p' || {_S('doc_id')} AS source, 'p' || {_S('doc_id + 1 + length(coalesce(text, \"\")) % 9')} AS target FROM documents) AS links".replace('""', "''").replace('coalesce(text, "")', "coalesce(text, '')")
_SCOPED = "(SELECT DISTINCT source AS domain FROM documents WHERE source < 'src5') AS scoped"


@query(f"""SELECT p.domain, p.page, (v.vec_id % 3)::INT AS ordinal, 'h' || v.label AS heading, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings v JOIN {PAGES.replace('AS pages', 'AS p')} ON p.doc_id = v.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE p.domain IN (SELECT domain FROM {_SCOPED})""")
def scoped_chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the pages of some domains, scored against one vector."""
    v = table(spark, sf_dir, "embeddings")
    chunks = v.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("page"), (F.col("vec_id") % 3).cast("int").alias("ordinal"), F.concat(F.lit("h"), F.col("label").cast("string")).alias("heading"), "embedding")
    out = catalog.scoped_chunks(chunks, derived(spark, sf_dir, PAGES), derived(spark, sf_dir, _SCOPED), v.filter("vec_id = 0"))
    return out.withColumn("score", F.round("score", 6))


@query(f"""SELECT a.domain AS source_domain, l.source, b.domain AS target_domain, l.target FROM {LINKS.replace('AS links', 'AS l')} JOIN {PAGES.replace('AS pages', 'AS a')} ON a.page = l.source JOIN {PAGES.replace('AS pages', 'AS b')} ON b.page = l.target
  WHERE a.domain IN (SELECT domain FROM {_SCOPED}) AND b.domain IN (SELECT domain FROM {_SCOPED})""")
def scoped_link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scoped_links(derived(spark, sf_dir, LINKS), derived(spark, sf_dir, PAGES), derived(spark, sf_dir, _SCOPED))


@query(f"SELECT d.domain, p.page FROM {DOMAINS.replace('AS domains', 'AS d')} LEFT JOIN {PAGES.replace('AS pages', 'AS p')} ON p.domain = d.domain")
def domain_page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by domain; a domain without pages has one row."""
    return catalog.domain_pages(derived(spark, sf_dir, DOMAINS), derived(spark, sf_dir, PAGES)).select("domain", "page")


_POINTERS = f"(SELECT 'd' || {_S('c_custkey')} AS domain, CASE WHEN c_custkey % 4 <> 0 THEN 'n' || {_S('c_custkey % 40')} END AS snapshot FROM customer) AS pointers"
_SNAPSHOTS = f"(SELECT 'd' || {_S('o_custkey')} AS domain, 'n' || {_S('o_orderkey % 40')} AS snapshot, 'r' || {_S('max(o_orderkey)')} AS revision, 'm' || {_S('max(o_orderkey) % 3')} AS markdown_revision, max(o_orderkey) % 2 AS generation FROM orders GROUP BY o_custkey, o_orderkey % 40) AS snapshots"
_NOW = f"(SELECT 'd' || {_S('c_custkey')} AS domain, 'm' || {_S('c_custkey % 3')} AS current_revision, c_custkey % 2 AS current_generation FROM customer) AS now"
_CUSTOMERS = f"(SELECT 'd' || {_S('c_custkey')} AS domain FROM customer) AS domains"


@query(f"""SELECT d.domain, CASE WHEN s.revision IS NULL THEN 'missing_snapshot' ELSE 'ready' END AS state, s.revision, s.revision IS NOT NULL AND (s.markdown_revision <> n.current_revision OR s.generation <> n.current_generation) AS links_stale
  FROM {_CUSTOMERS.replace('AS domains', 'AS d')} LEFT JOIN {_POINTERS.replace('AS pointers', 'AS p')} ON p.domain = d.domain LEFT JOIN {_SNAPSHOTS.replace('AS snapshots', 'AS s')} ON s.domain = p.domain AND s.snapshot = p.snapshot JOIN {_NOW.replace('AS now', 'AS n')} ON n.domain = d.domain""")
def code_graph_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.code_states(*(derived(spark, sf_dir, r) for r in (_CUSTOMERS, _POINTERS, _SNAPSHOTS, _NOW)))


_WANTED = f"(SELECT CASE l_linenumber WHEN 1 THEN 's:o' || {_S('l_orderkey')} WHEN 2 THEN 's:p' || {_S('l_partkey')} WHEN 3 THEN 'f:c' || {_S('l_suppkey')} WHEN 4 THEN 'm:c' || {_S('l_suppkey')} ELSE 'gone' END AS entity_id FROM lineitem) AS wanted"


@query(f"WITH {context._GRAPH} SELECT * FROM ent WHERE entity_id IN (SELECT entity_id FROM {_WANTED})")
def entities_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.entity_lookup(context.code_graph(spark, sf_dir)[0], derived(spark, sf_dir, _WANTED))


_ALIASES = f"""(SELECT CASE WHEN l_linenumber < 6 THEN 'IMPORTS' ELSE 'CALLS' END AS relation_type, CASE l_linenumber % 3 WHEN 0 THEN 'm:' || p_brand WHEN 1 THEN 's:p' || {_S('l_partkey')} ELSE 's:gone' END AS dst, 'a' || {_S('l_suppkey')} AS binding,
  CASE WHEN l_quantity > 10 THEN 'explicit_alias' ELSE 'implicit_binding' END AS binding_kind, CASE WHEN l_quantity > 40 THEN 'unresolved' WHEN l_quantity > 30 THEN 'ambiguous' ELSE 'resolved' END AS state FROM lineitem JOIN part ON p_partkey = l_partkey) AS relations"""


@query(f"""WITH {context._GRAPH}, t AS (SELECT DISTINCT binding, ent.entity_id, entity_type, file_id FROM {_ALIASES} JOIN ent ON ent.entity_id = dst WHERE relation_type = 'IMPORTS' AND binding_kind = 'explicit_alias' AND state <> 'unresolved')
  SELECT t.*, n AS alias_target_count, n > 1 AS alias_ambiguous FROM t JOIN (SELECT binding, count(DISTINCT entity_id) AS n FROM t GROUP BY binding) USING (binding)""")
def alias_import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules and symbols that explicit aliases stand for, with their files."""
    return catalog.ambiguous_aliases(catalog.alias_imports(derived(spark, sf_dir, _ALIASES), context.code_graph(spark, sf_dir)[0]))


@query(f"WITH {context._GRAPH} SELECT s.entity_id, f.entity_id AS file, f.module_id FROM ent s JOIN ent f ON f.entity_id = s.file_id AND f.entity_type = 'file' WHERE s.entity_type = 'symbol'")
def symbols_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = staged(context.code_graph(spark, sf_dir)[0])
    files = e.filter("entity_type = 'file'").select(F.col("entity_id").alias("file"), "module_id")
    return e.filter("entity_type = 'symbol'").select("entity_id", F.col("file_id").alias("file")).join(files, "file").select("entity_id", "file", "module_id")


_GRANTS = "(SELECT c_nationkey AS principal, c_mktsegment AS runtime, c_custkey AS domain, c_acctbal > 0 AS can_read FROM customer) AS grants"


@query(f"SELECT principal, runtime, count(*) FILTER (can_read) AS n_domains FROM {_GRANTS} GROUP BY principal, runtime")
def principal_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many domains each principal may read, by runtime."""
    return derived(spark, sf_dir, _GRANTS).groupBy("principal", "runtime").agg(F.count_if("can_read").alias("n_domains"))


_FILES = md.PAGES.replace("AS slug, CASE", "|| '.md' AS file, source AS domain, CASE").replace("AS pages", "AS files")
_LINKS_BY_KIND = "CASE k WHEN 0 THEN [('guide/d' || d + 4, 'next-step'), ('guide/d' || d + 1, ''), ('d1', '')] WHEN 1 THEN [('d' || d + 1, 'top'), ('guide/d' || d + 3, ''), ('d2', 'top')] ELSE [] END"


@query(f"""WITH f AS (SELECT domain || '/' || replace(file, '.md', '') AS page, domain, file, coalesce(markdown, '') AS markdown, k, d FROM {_FILES}), e AS (SELECT DISTINCT page, domain || '/' || x[1] AS target, x[2] AS anchor FROM (SELECT page, domain, unnest({_LINKS_BY_KIND}) AS x FROM f))
  SELECT f.page, f.domain, f.file, sha256(markdown) AS content_hash, sha256(coalesce(string_agg(target || '#' || anchor, chr(10) ORDER BY target || '#' || anchor), '')) AS link_hash FROM f LEFT JOIN e ON e.page = f.page GROUP BY f.page, f.domain, f.file, markdown""")
def domain_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a link graph with the hashes of their texts and links."""
    return catalog.page_snapshot(derived(spark, sf_dir, _FILES).select("domain", "file", "markdown"))[0]


@query(f"""WITH f AS (SELECT domain || '/' || replace(file, '.md', '') AS page, domain, k, d FROM {_FILES}) SELECT DISTINCT page AS source, domain || '/' || x[1] AS target, x[2] AS anchor FROM (SELECT page, domain, unnest({_LINKS_BY_KIND}) AS x FROM f)""")
def domain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_snapshot(derived(spark, sf_dir, _FILES).select("domain", "file", "markdown"))[2].select("source", "target", "anchor")


_LISTING = f"""(SELECT CASE c_custkey % 12 WHEN 0 THEN 'src/build/f' WHEN 1 THEN 'node_modules/f' WHEN 2 THEN 'src/secrets' WHEN 3 THEN '../f' WHEN 4 THEN 'tmp/f' ELSE 'src/n' || {_S('c_nationkey')} || '/f' END || {_S('c_custkey')} || CASE c_custkey % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.ts' ELSE '.py' END AS path,
  c_custkey * 37 % 1000 AS length FROM customer) AS listing"""


@query(f"""SELECT path, length, row_number() OVER (ORDER BY path)::INT AS place FROM (SELECT path, length FROM {_LISTING} WHERE (path LIKE '%.py' OR path LIKE '%.ts') AND path NOT LIKE 'src/build/%' AND path NOT LIKE 'node_modules/%' AND path NOT LIKE 'src/secrets%' AND path NOT LIKE '../%' AND path NOT LIKE 'tmp/%' AND length <= 900 ORDER BY path LIMIT 400)""")
def discovered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 source files of a listing that may be read."""
    return catalog.source_files(derived(spark, sf_dir, _LISTING), ["py", "ts"], max_bytes=900, max_files=400, ignored=["tmp/"])


@query(f"SELECT domain, '# Index' || chr(10) || chr(10) || string_agg('- [' || page || '](' || page || '.md)', chr(10) ORDER BY page) || chr(10) AS markdown FROM {PAGES} GROUP BY domain")
def generated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_pages(derived(spark, sf_dir, PAGES).withColumnRenamed("page", "slug"))


_LOG = f"(SELECT 'd' || {_S('user_id % 7')} AS domain, event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN 'day' || {_S('event_id % 30')} END AS date, event_type AS op, CASE WHEN event_id % 3 <> 0 THEN 'p' || {_S('user_id')} END AS page FROM events) AS log"


@query(f"SELECT domain, '# Log' || chr(10) || chr(10) || string_agg(rtrim('- ' || coalesce(date, '') || ' ' || op || ' ' || coalesce(page, '')), chr(10) ORDER BY seq) || chr(10) AS markdown FROM {_LOG} GROUP BY domain")
def generated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.log_pages(derived(spark, sf_dir, _LOG))


_Q8 = "SELECT vec_id, label, embedding::DOUBLE[] AS e, CASE WHEN m = 0 THEN 1.0 ELSE m / 127 END AS scale FROM (SELECT vec_id, label, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    v, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return v.select(text("p", i % 40).alias("page"), F.lit("section").alias("kind"), text("h", F.col("label")).alias("heading"), i.alias("chunk"), text("body ", i).alias("body"), "embedding")


_SLOT = """'{"kind":"section","heading":"h' || label || '","chunk":' || vec_id || '}'"""


@query(f"SELECT 'p' || vec_id % 40 AS page, {_SLOT} AS slot, left(sha256('body ' || vec_id), 16) AS hash, len(e)::INT AS dim, round(scale, 9) AS scale, array_to_string(list_transform(e, lambda x: least(127, greatest(-127, round_even(x / scale, 0)::INT))), ',') AS q FROM ({_Q8})")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an index: slots, hashes and quantised vectors."""
    out = catalog.chunk_records(_chunks(spark, sf_dir))
    return out.withColumn("scale", F.round("scale", 9)).withColumn("q", F.array_join(F.transform("q", lambda x: x.cast("string")), ","))


@query(f"SELECT 'p' || vec_id % 40 AS page, {_SLOT} AS slot, CASE WHEN label % 5 = 0 THEN 'add' WHEN label % 5 = 1 THEN 'remove' WHEN vec_id % 3 = 0 OR vec_id % 7 = 0 THEN 'replace' ELSE 'keep' END AS action FROM embeddings")
def reused_chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new index keeps of the old one: slots came, went, or changed their text or the size of their vector."""
    chunks, i = _chunks(spark, sf_dir), F.col("chunk")
    label = F.substr(F.col("heading"), F.lit(2)).cast("int") % 5
    shorter = F.when(i % 7 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    old = chunks.filter(label != 0).withColumn("embedding", shorter)
    new = chunks.filter(label != 1).withColumn("body", F.when(i % 3 == 0, "changed").otherwise(F.col("body")))
    return catalog.reused_records(catalog.chunk_records(old), catalog.chunk_records(new))


_ASKS = f"(SELECT 'p' || {_S('doc_id + 3')} AS target, CAST(NULL AS STRING) AS anchor FROM documents) AS asks"


@query(f"""WITH l AS (SELECT a.target, l.source, p.doc_id FROM {_ASKS.replace('AS asks', 'AS a')} LEFT JOIN {LINKS.replace('AS links', 'AS l')} ON l.target = a.target LEFT JOIN {PAGES.replace('AS pages', 'AS p')} ON p.page = l.source)
  SELECT target, NULL::VARCHAR AS anchor, CASE WHEN bool_or(coalesce(doc_id % 10 = 3, false)) THEN 'stale' ELSE 'ok' END AS state, CASE WHEN NOT bool_or(coalesce(doc_id % 10 = 3, false)) THEN coalesce(string_agg(source, ',' ORDER BY source), '') END AS sources FROM l GROUP BY target""")
def verified_incoming_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to each page, unless one of them has changed since it was indexed, as one in ten has."""
    pages = derived(spark, sf_dir, PAGES).select("page", "doc_id", F.sha2("markdown", 256).alias("content_hash"))
    indexed = pages.select("page", F.when(F.col("doc_id") % 10 == 3, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    edges = derived(spark, sf_dir, LINKS).withColumn("anchor", F.lit(""))
    return catalog.verified_incoming(derived(spark, sf_dir, _ASKS), edges, indexed, pages.select("page", "content_hash"))


_REQUESTS = f"(SELECT c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'bound' END AS scope, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS one FROM customer) AS requests"
_BOUND = f"(SELECT o_custkey AS request, 'src' || {_S('o_orderkey % 20')} AS domain FROM orders WHERE o_custkey % 7 <> 1) AS bound"


@query(f"""WITH r AS (SELECT * FROM {_REQUESTS}), b AS (SELECT DISTINCT b.* FROM {_BOUND.replace('AS bound', 'AS b')} JOIN r ON r.request = b.request WHERE one IS NULL AND scope IS DISTINCT FROM 'all')
  SELECT request, one AS domain FROM r WHERE one IS NOT NULL UNION SELECT * FROM b UNION SELECT r.request, d.domain FROM r CROSS JOIN {DOMAINS.replace('AS domains', 'AS d')} WHERE one IS NULL AND request NOT IN (SELECT request FROM b)""")
def request_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that each request reads: named, all, or bound to it."""
    asks = derived(spark, sf_dir, _REQUESTS).select("request", "scope", F.when(F.col("one").isNotNull(), F.array("one")).alias("named"))
    return catalog.scope(asks, derived(spark, sf_dir, DOMAINS), derived(spark, sf_dir, _BOUND))


@query(f"""WITH RECURSIVE {codegraph._MADE}, e AS (SELECT 'declarations' AS what, count(*) AS n FROM symbols UNION ALL SELECT 'calls', count(*) * 5 FROM v UNION ALL SELECT 'calls', count(*) FROM v WHERE packed)
  SELECT what, sum(n)::BIGINT AS expected, sum(n)::BIGINT AS found, sum(n)::BIGINT AS "right", 1.0::DOUBLE AS recall, 0.0::DOUBLE AS false_share FROM e GROUP BY what""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations and call targets that were read from files, against those that the files were made to have."""
    extracted = staged(extraction.extract(codegraph._files(spark, sf_dir)))
    names = extracted.filter("kind in ('class', 'function', 'async_function', 'method')").select(F.lit("declarations").alias("what"), "name", F.lit("").alias("target"))
    calls = extracted.filter("kind = 'CALLS' and target is not null").select(F.lit("calls").alias("what"), "name", "target")
    return catalog.quality(names.union(calls), derived(spark, sf_dir, _TRUTH), "what", ["name", "target"])


_M = f"CASE c_custkey % 10 WHEN 9 THEN 'c' || {_S('c_custkey')} ELSE 'app.n' || {_S('c_custkey % 10')} || '.c' || {_S('c_custkey')} END"
_C = f"{_M} || '.C' || {_S('c_custkey')}"
_READ = "FROM customer WHERE c_custkey % 7 <> 3 AND c_custkey % 11 <> 5"
_TRUTH = "(" + " UNION ALL ".join(
    [f"SELECT 'declarations' AS what, {x} AS name, '' AS target {_READ}" for x in (_C, f"{_C} || '.step'", f"{_C} || '.go'", f"{_M} || '.helper' || {_S('c_custkey')}", f"{_M} || '.aux'")]
    + [f"SELECT 'calls', {a}, {b} {_READ}" for a, b in ((f"{_C} || '.step'", "'json.dumps'"), (f"{_C} || '.go'", f"{_C} || '.step'"), (f"{_C} || '.go'", f"{_M} || '.helper' || {_S('c_custkey')}"), (f"{_M} || '.aux'", _C), (f"{_M} || '.aux'", f"{_C} || '.go'"))]
    + [f"SELECT 'calls', {_C} || '.go', 'app.n' || {_S('(c_custkey + 1) % 10')} || '.main' || {_S('c_custkey % 3')} {_READ} AND c_custkey % 10 <> 9"]
) + ") AS truth"


@query(f"""WITH {codegraph._ENTITIES}, r AS (SELECT entity_id, qualified_name, CASE WHEN entity_id LIKE '%7' THEN 'path' WHEN entity_id LIKE '%3' THEN 'local_exact' ELSE 'canonical_prefix' END AS match FROM e)
  SELECT entity_id, match, row_number() OVER (ORDER BY CASE match WHEN 'local_exact' THEN 2 WHEN 'canonical_prefix' THEN 4 ELSE 9 END, qualified_name, entity_id)::BIGINT AS place FROM r""")
def ordered_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a search in their total order, numbered over all of them."""
    from ..operators.ordering import ranked

    match = F.when(F.col("entity_id").endswith("7"), "path").when(F.col("entity_id").endswith("3"), "local_exact").otherwise("canonical_prefix")
    results = codegraph.entities(spark, sf_dir).select("entity_id", "qualified_name", match.alias("match"))
    return ranked(results, *catalog.result_order(results, code.RANKS)).select("entity_id", "match", "place")
