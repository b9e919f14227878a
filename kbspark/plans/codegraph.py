"""Code-graph queries: extraction, entity search with filters at size, paths, publication, reachability."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import code, extraction, graph, publication, retrieval
from ..sources.versioned import shared_path, staged
from ..streaming import sessions
from .code import RELATIONS
from .registry import derived, query, table

#: A Python file for each customer, in ten folders of which the last is no package, and the packages' own files, which
#: pass names on: main0 from a file beside them, main1 in a circle, main2 along a chain.
_S = "CAST({} AS STRING)".format
_N, _F, _G = _S("c_custkey"), _S("c_custkey % 10"), _S("(c_custkey + 1) % 10")
_M10 = _S("c_custkey + 10")
FILES = f"""(SELECT 'app/n' || {_F} || '/c' || {_N} || '.py' AS path, CASE WHEN c_custkey % 7 = 3 THEN 'x = (' WHEN c_custkey % 11 <> 5 THEN concat_ws(chr(10), 'import json as j', 'from . import c' || {_M10} || ' as near',
    'from ..n' || {_G} || ' import main' || {_S('c_custkey % 3')} || ' as run', 'class C' || {_N} || '(near.C' || {_M10} || '):', '    def step(self): return j.dumps(1)', '    def go(self):', '        self.step()', '        helper' || {_N} || '()',
    '        return run()', 'def helper' || {_N} || '(j): return j.loads(2)', 'async def aux(x: int=1): return C' || {_N} || '().go()') END AS source FROM customer
  UNION ALL SELECT DISTINCT 'app/n' || {_F} || '/__init__.py', concat_ws(chr(10), 'from .c' || {_S('c_custkey % 10 + 20')} || ' import helper' || {_S('c_custkey % 10 + 20')} || ' as main0', 'from ..n' || {_S('(c_custkey % 10 + 1) % 9')} || ' import main1',
    CASE c_custkey % 10 WHEN 8 THEN 'from .c28 import helper28 as main2' ELSE 'from ..n' || {_G} || ' import main2' END) FROM customer WHERE c_custkey % 10 <> 9
  UNION ALL SELECT DISTINCT 'app/__init__.py', 'import os' FROM region) AS files"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FILES)


@query(f"""WITH f AS (SELECT path, string_split(path, '/') AS parts FROM {FILES}), folders AS (SELECT array_to_string(parts[:-2], '/') AS folder FROM f WHERE parts[-1] = '__init__.py'),
  up AS (SELECT path, parts, unnest(range(1, len(parts))) AS n FROM f), broken AS (SELECT path, max(CASE WHEN array_to_string(parts[:n], '/') IN (FROM folders) THEN 0 ELSE n END) AS last FROM up GROUP BY path)
  SELECT path, CASE WHEN last < len(parts) - 1 THEN array_to_string(list_filter(list_transform(parts[last + 1:], lambda x: regexp_replace(x, '\\.py$', '')), lambda x: x <> '__init__'), '.') END AS module FROM f LEFT JOIN broken USING (path)""")
def python_module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.module_names(_files(spark, sf_dir))


#: What the files hold by their making, without reading them: symbols, bindings of modules, references.
_MADE = """c AS (SELECT c_custkey AS n, 'app/n' || c_custkey % 10 || '/c' || c_custkey || '.py' AS path, CASE c_custkey % 10 WHEN 9 THEN 'c' || c_custkey ELSE 'app.n' || c_custkey % 10 || '.c' || c_custkey END AS m, c_custkey % 7 <> 3 AND c_custkey % 11 <> 5 AS valid, c_custkey % 10 <> 9 AS packed FROM customer),
  v AS (SELECT * FROM c WHERE valid), p AS (SELECT DISTINCT c_custkey % 10 AS f FROM customer WHERE c_custkey % 10 <> 9),
  sym AS (SELECT path, 'class' AS kind, m || '.C' || n AS name, 'C' || n AS local, CASE WHEN packed THEN '(near.C' || n + 10 || ')' ELSE '(near.C' || n + 10 || ')' END AS signature, 4 AS start, 9 AS stop FROM v
    UNION ALL SELECT path, 'method', m || '.C' || n || '.step', 'step', '(self)', 5, 5 FROM v UNION ALL SELECT path, 'method', m || '.C' || n || '.go', 'go', '(self)', 6, 9 FROM v
    UNION ALL SELECT path, 'function', m || '.helper' || n, 'helper' || n, '(j)', 10, 10 FROM v UNION ALL SELECT path, 'async_function', m || '.aux', 'aux', '(x: int=1)', 11, 11 FROM v),
  symbols AS (SELECT 'symbol:' || left(sha256(concat_ws(chr(0), 'symbol', path, name, signature)), 32) AS entity_id, kind, path, name AS qualified_name, local AS local_name, signature, 'public' AS visibility, start, stop FROM sym),
  modules AS (SELECT m AS module FROM c WHERE valid OR n % 7 = 3 UNION SELECT 'app.n' || f FROM p UNION SELECT 'app'),
  bind AS (SELECT m || '.j' AS name, 'json' AS target FROM v UNION ALL SELECT 'app.os', 'os' UNION ALL SELECT m || '.near', 'app.n' || n % 10 || '.c' || n + 10 FROM v WHERE packed UNION ALL SELECT m || '.run', 'app.n' || (n + 1) % 10 || '.main' || n % 3 FROM v WHERE packed
    UNION ALL SELECT 'app.n' || f || '.main0', 'app.n' || f || '.c' || f + 20 || '.helper' || f + 20 FROM p UNION ALL SELECT 'app.n' || f || '.main1', 'app.n' || (f + 1) % 9 || '.main1' FROM p
    UNION ALL SELECT 'app.n' || f || '.main2', CASE f WHEN 8 THEN 'app.n8.c28.helper28' ELSE 'app.n' || f + 1 || '.main2' END FROM p),
  chain AS (SELECT name, target AS first, target, 0 AS d FROM bind UNION ALL SELECT c.name, c.first, b.target, d + 1 FROM chain c JOIN bind b ON b.name = c.target WHERE d < 30),
  aliases AS (SELECT name, CASE WHEN max(d) = 30 THEN any_value(first) ELSE max_by(target, d) END AS target, CASE WHEN max(d) = 30 THEN 'cycle' ELSE 'resolved' END AS state FROM chain GROUP BY name)"""


@query(f"WITH RECURSIVE {_MADE} SELECT * FROM symbols")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.symbols(extraction.extract(_files(spark, sf_dir)))


def _aliases(extracted: DataFrame) -> DataFrame:
    return extraction.resolve_aliases(extraction.alias_bindings(extracted, extraction.symbols(extracted)))


@query(f"WITH RECURSIVE {_MADE} SELECT * FROM aliases")
def python_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imported names stand for in the end, through modules that pass them on."""
    return _aliases(staged(extraction.extract(_files(spark, sf_dir))))


@query(f"""WITH RECURSIVE {_MADE}, pack AS (SELECT * FROM v WHERE packed), refs AS (SELECT path, 'IMPORTS' AS kind, m AS name, 'json' AS target, 1 AS start, 'j' AS binding, NULL AS written FROM v
    UNION ALL SELECT path, 'IMPORTS', m, 'app.n' || n % 10 || '.c' || n + 10, 2, 'near', NULL FROM pack UNION ALL SELECT path, 'IMPORTS', m, 'app.n' || (n + 1) % 10 || '.main' || n % 3, 3, 'run', NULL FROM pack
    UNION ALL SELECT path, 'INHERITS', m || '.C' || n, 'app.n' || n % 10 || '.c' || n + 10 || '.C' || n + 10, 4, NULL, NULL FROM pack
    UNION ALL SELECT path, 'CALLS', m || '.C' || n || '.step', 'json.dumps', 5, NULL, NULL FROM v UNION ALL SELECT path, 'CALLS', m || '.C' || n || '.go', m || '.C' || n || '.step', 7, NULL, NULL FROM v
    UNION ALL SELECT path, 'CALLS', m || '.C' || n || '.go', m || '.helper' || n, 8, NULL, NULL FROM v UNION ALL SELECT path, 'CALLS', m || '.C' || n || '.go', CASE WHEN packed THEN 'app.n' || (n + 1) % 10 || '.main' || n % 3 END, 9, NULL, 'run' FROM v
    UNION ALL SELECT path, 'CALLS', m || '.helper' || n, NULL, 10, NULL, 'j.loads' FROM v UNION ALL SELECT path, 'CALLS', m || '.aux', m || '.C' || n || '.go', 11, NULL, NULL FROM v UNION ALL SELECT path, 'CALLS', m || '.aux', m || '.C' || n, 11, NULL, NULL FROM v
    UNION ALL SELECT 'app/n' || f || '/__init__.py', 'IMPORTS', 'app.n' || f, target, 1 + right(bind.name, 1)::INT, CASE WHEN bind.name LIKE '%.main_' THEN right(bind.name, 5) END, NULL FROM p JOIN bind ON bind.name LIKE 'app.n' || f || '.main_' UNION ALL SELECT 'app/__init__.py', 'IMPORTS', 'app', 'os', 1, 'os', NULL),
  ids AS (SELECT 'relation:' || left(sha256(concat_ws(chr(0), 'relation', kind, path, name, coalesce(target, '?' || written), start::VARCHAR, coalesce(binding, ''))), 32) AS ref_id, refs.* FROM refs),
  r AS (SELECT ids.* EXCLUDE (target), CASE WHEN a.name IS NULL THEN ids.target WHEN a.state = 'resolved' THEN a.target END AS target, ids.target AS raw FROM ids LEFT JOIN aliases a ON a.name = ids.target),
  every AS (SELECT ref_id, 1 AS step, entity_id FROM r JOIN symbols ON target = qualified_name
    UNION ALL SELECT * FROM (SELECT ref_id, 2, module FROM r JOIN modules ON target = module OR starts_with(target, module || '.') QUALIFY rank() OVER (PARTITION BY ref_id ORDER BY length(module) DESC) = 1) UNION ALL SELECT ref_id, 3, NULL FROM r),
  first AS (SELECT * FROM every QUALIFY step = min(step) OVER (PARTITION BY ref_id)),
  sub AS (SELECT a.m || '.C' || a.n AS base FROM c a JOIN v b ON b.n = a.n - 10 WHERE a.packed)
  SELECT ref_id, kind AS relation_type, name AS source, raw AS target, start, binding, entity_id, CASE WHEN kind = 'CALLS' AND raw IN (SELECT base || '.step' FROM sub UNION ALL SELECT base || '.go' FROM sub) THEN 'ambiguous' WHEN step = 3 THEN 'unresolved' WHEN count(entity_id) OVER (PARTITION BY ref_id) > 1 THEN 'ambiguous' WHEN step = 2 THEN 'partially_resolved' ELSE 'resolved' END AS state
  FROM first JOIN r USING (ref_id)""")
def python_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with what they resolve to, through names passed on, and whether a subclass may override the target."""
    return resolved_references(staged(extraction.extract(_files(spark, sf_dir))))


def resolved_references(extracted: DataFrame) -> DataFrame:
    """What references resolve to depends on their targets alone: each target is resolved once, as a reference whose id it
    is, and references themselves are only shuffled to be told apart and for the last join."""
    own = extracted.filter(F.col("kind").isin("IMPORTS", "CALLS", "INHERITS")).select(F.col("kind").alias("relation_type"), F.col("name").alias("source"), "target").filter("target is not null")
    targets = staged(own.select(F.col("target").alias("ref_id"), "target").distinct())
    meant = staged(extraction.dealiased(targets, staged(_aliases(extracted))))
    resolved = code.resolve_once(meant, extraction.symbols(extracted).select("qualified_name", "entity_id"), extracted.select("module").distinct())
    calls = own.filter("relation_type = 'CALLS'").select("relation_type", F.lit(None).cast("string").alias("source"), "target").distinct()
    links = calls.unionByName(own.filter("relation_type = 'INHERITS'")).withColumn("ref_id", F.col("target"))
    methods = extracted.filter("kind = 'method'").select("kind", F.col("name").alias("qualified_name"))
    told = resolved.select(F.col("ref_id").alias("target"), "entity_id", F.col("state").alias("_state"))
    uncertain = extraction.overridable_calls(links, methods).select(F.col("ref_id").alias("target"), F.lit(True).alias("_over"))
    told = staged(told.join(uncertain, "target", "left"))
    state = F.when(F.col("_over") & (F.col("relation_type") == "CALLS"), "ambiguous").otherwise(F.coalesce("_state", F.lit("unresolved")))
    return extraction.references(extracted).join(told, "target", "left").select("ref_id", "relation_type", "source", "target", "start", "binding", "entity_id", state.alias("state"))


_ENTITIES = """e AS (SELECT 'symbol:' || o_orderkey AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'typescript' WHEN o_orderkey % 5 = 1 THEN 'javascript' ELSE 'python' END AS language,
    lower(replace(o_orderpriority, ' ', '')) || '/' || (o_custkey % 50) || '.py' AS path, 'pkg' || (o_custkey % 50) || '.load_' || o_orderkey AS qualified_name, 'load_' || o_orderkey AS local_name FROM orders
  UNION ALL SELECT DISTINCT 'file:' || lower(replace(o_orderpriority, ' ', '')) || '/' || (o_custkey % 50) || '.py', 'file', 'python', lower(replace(o_orderpriority, ' ', '')) || '/' || (o_custkey % 50) || '.py', lower(replace(o_orderpriority, ' ', '')) || '/' || (o_custkey % 50) || '.py', (o_custkey % 50) || '.py' FROM orders
  UNION ALL SELECT DISTINCT 'module:pkg' || (o_custkey % 50), 'module', 'python', 'pkg' || (o_custkey % 50), 'pkg' || (o_custkey % 50), 'pkg' || (o_custkey % 50) FROM orders)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, files and modules of a made-up code base with a symbol for each order, in one shape."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("string").alias("n"), F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit(""))).alias("folder"))
    path = F.concat("folder", F.lit("/"), "n", F.lit(".py"))
    number = F.col("o_orderkey").cast("string")
    rest = F.col("o_orderkey") % 5
    language = F.when(rest == 0, "typescript").when(rest == 1, "javascript").otherwise("python")
    symbols = o.select(F.concat(F.lit("symbol:"), number).alias("entity_id"), F.when(F.col("o_orderkey") % 3 == 0, "class").otherwise("function").alias("kind"), language.alias("language"), path.alias("path"), F.concat(F.lit("pkg"), "n", F.lit(".load_"), number).alias("qualified_name"), F.concat(F.lit("load_"), number).alias("local_name"))
    files = o.select(path.alias("path"), F.concat("n", F.lit(".py")).alias("local_name")).distinct()
    modules = o.select(F.concat(F.lit("pkg"), "n").alias("module")).distinct()
    return code.entity_union(files.withColumn("language", F.lit("python")), modules.withColumn("language", F.lit("python")), symbols)


@query(f"""WITH {_ENTITIES}, r AS (SELECT *, CASE WHEN lower(qualified_name) = 'load_77' THEN 1 WHEN lower(local_name) = 'load_77' THEN 2 WHEN starts_with(qualified_name, 'load_77') OR starts_with(local_name, 'load_77') THEN 4
    WHEN list_has_all(string_split_regex(lower(qualified_name || ' ' || local_name), '[^a-z0-9]+'), ['load', '77']) THEN 6 WHEN contains(lower(path), 'load_77') THEN 9 END AS rank FROM e
    WHERE kind IN ('function', 'class') AND language IN ('typescript', 'javascript') AND starts_with(path, '1-urgent/') AND entity_id NOT IN ('symbol:7700'))
  SELECT entity_id, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, qualified_name, entity_id LIMIT 50""")
def code_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of a large code base by kinds, language family, path prefix and excluded ids."""
    excluded = spark.createDataFrame([("symbol:7700",)], "entity_id string")
    found = code.filter_entities(entities(spark, sf_dir), kinds=["function", "class"], family=code.LANGUAGE_FAMILIES["typescript"], path_prefix="1-urgent/", excluded=excluded)
    imports = spark.createDataFrame([], "binding_name string, entity_id string")
    return code.search_entities(found.withColumn("signature", F.lit(None).cast("string")), imports, "load_77", 50).select("entity_id", "rank")


@query(f"WITH {_ENTITIES} SELECT kind, language, count(*) AS n FROM e GROUP BY kind, language")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).groupBy("kind", "language").agg(F.count("*").alias("n"))


SOME_PATHS = """(SELECT CASE c_custkey % 13 WHEN 0 THEN 'src/a' || CAST(c_custkey AS STRING) || '.py' WHEN 1 THEN 'src/x/b' || CAST(c_custkey AS STRING) || '.py' WHEN 2 THEN 'src/x/y/c' || CAST(c_custkey AS STRING) || '.ts' WHEN 3 THEN 'docs/.env' WHEN 4 THEN 'docs/.env.n' || CAST(c_custkey AS STRING)
  WHEN 5 THEN 'keys/n' || CAST(c_custkey AS STRING) || '/id_rsa' WHEN 6 THEN 'a/secrets' || CAST(c_custkey AS STRING) || '.yml' WHEN 7 THEN '../up' || CAST(c_custkey AS STRING) || '.py' WHEN 8 THEN '/abs' || CAST(c_custkey AS STRING) || '.py' WHEN 9 THEN 'a//b' || CAST(c_custkey AS STRING)
  WHEN 10 THEN 'c:/win' || CAST(c_custkey AS STRING) WHEN 11 THEN 'a/./b' || CAST(c_custkey AS STRING) ELSE 'b/key' || CAST(c_custkey AS STRING) || '.PEM' END AS path FROM customer) AS paths"""
GLOBS = "(VALUES ('src/*.py', 'src/[^/]*[.]py'), ('src/**/*.ts', 'src/([^/]+/)*[^/]*[.]ts'), ('**', '([^/]+/)*[^/]+'), ('src/**', 'src(/[^/]+)*'), ('docs/.e?v', 'docs/[.]e[^/]v')) AS globs(pattern, regex)"


@query(f"SELECT path, pattern FROM {SOME_PATHS}, {GLOBS} WHERE regexp_full_match(path, regex)")
def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors against paths; the few patterns are expressions of one scan, not a join."""
    patterns = ["src/*.py", "src/**/*.ts", "**", "src/**", "docs/.e?v"]
    hits = F.array_compact(F.array(*[F.when(paths.glob_matches(F.col("path"), p), F.lit(p)) for p in patterns]))
    return derived(spark, sf_dir, SOME_PATHS).select("path", F.explode(hits).alias("pattern"))


@query(f"""SELECT path, regexp_matches(lower(path), '(^|/)([.]env([.][^/]*)?|[^/]*[.](pem|key)|id_rsa|id_ed25519|credentials[^/]*|secrets[^/]*)$') AS secret,
  NOT (path LIKE '/%' OR path LIKE '%//%' OR path LIKE '%:%' OR regexp_matches(path, '(^|/)[.]{{1,2}}(/|$)')) AS safe FROM {SOME_PATHS}""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SOME_PATHS).select("path", paths.is_secret(F.col("path")).alias("secret"), paths.is_safe(F.col("path")).alias("safe"))


#: Orders are sessions of their customers' domains, line items the batches that they sent.
HEADERS = """(SELECT 's' || CAST(o_orderkey AS STRING) AS session, 'd' || CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS STRING) AS domain, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'r' || CAST((o_custkey + o_orderkey % 2) % 5 AS STRING) END AS base_revision,
  'n' || CAST(o_orderkey AS STRING) AS revision, CAST(1 + o_orderkey % 2 AS INT) AS n_kinds, o_orderpriority = '5-LOW' AS aborted FROM orders) AS headers"""
BATCHES = """(SELECT 's' || CAST(l_orderkey AS STRING) AS session, CASE WHEN l_suppkey % 2 = 0 THEN 'files' ELSE 'symbols' END AS kind, CAST(l_linenumber % 2 AS INT) AS ordinal, CASE WHEN l_quantity > 44 THEN 'x' ELSE 'b' END AS hash, CAST(l_quantity AS BIGINT) AS n_rows FROM lineitem) AS batches"""
ACTIVE = """(SELECT 'd' || CAST(c_custkey AS STRING) AS domain, CASE WHEN c_custkey % 6 <> 0 THEN 'r' || CAST(c_custkey % 5 AS STRING) END AS revision, CAST(c_nationkey AS INT) AS generation FROM customer) AS active"""
_STATES = f"""k AS (SELECT session, kind, count(DISTINCT ordinal) AS n, max(ordinal) AS last, bool_or(bad) AS bad, sum(rows_) AS n_rows FROM (SELECT session, kind, ordinal, count(DISTINCT hash) > 1 AS bad, max(n_rows) AS rows_ FROM {BATCHES} GROUP BY ALL) GROUP BY ALL),
  s AS (SELECT session, count(*) AS kinds, bool_or(n <> last + 1) AS gap, bool_or(bad) AS bad, sum(n_rows) AS n_rows FROM k GROUP BY session),
  states AS (SELECT h.session, h.domain, h.revision, CASE WHEN aborted THEN 'aborted' WHEN coalesce(bad, false) THEN 'batch_conflict' WHEN coalesce(gap, true) OR coalesce(kinds, 0) < n_kinds THEN 'gap' WHEN a.revision IS DISTINCT FROM base_revision THEN 'revision_conflict' ELSE 'ready' END AS state,
    coalesce(n_rows, 0)::BIGINT AS n_rows FROM {HEADERS.replace('AS headers', 'AS h')} LEFT JOIN s ON s.session = h.session LEFT JOIN {ACTIVE.replace('AS active', 'AS a')} ON a.domain = h.domain)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = derived(spark, sf_dir, HEADERS).withColumn("kinds", F.slice(F.array(F.lit("files"), F.lit("symbols")), F.lit(1), F.col("n_kinds")))
    return publication.session_states(headers, derived(spark, sf_dir, BATCHES), derived(spark, sf_dir, ACTIVE))


@query(f"WITH {_STATES} SELECT * FROM states")
def publication_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


@query(f"""WITH {_STATES}, w AS (SELECT domain, min_by(revision, session) AS fresh FROM states WHERE state = 'ready' GROUP BY domain)
  SELECT coalesce(a.domain, w.domain) AS domain, coalesce(fresh, a.revision) AS revision, (coalesce(generation, 0) + (fresh IS NOT NULL)::INT)::INT AS generation FROM {ACTIVE.replace('AS active', 'AS a')} FULL JOIN w ON w.domain = a.domain""")
def publication_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.activate(_sessions(spark, sf_dir), derived(spark, sf_dir, ACTIVE))


_ROWS = """(SELECT 's' || CAST(p_partkey AS STRING) AS entity_id, 'f' || CAST(p_partkey % 23 AS STRING) AS path, CAST(p_size AS INT) AS start, CAST(p_size + p_partkey % 9 - 1 AS INT) AS stop FROM part
  UNION ALL SELECT 's' || CAST(s_suppkey * 3 AS STRING), 'f1', 1, 1 FROM supplier) AS rows"""
_ROW_FILES = "(SELECT 'f' || CAST(s_suppkey * 2 AS STRING) AS path FROM supplier) AS files"
_ROW_ENDS = "(SELECT 's' || CAST(l_partkey AS STRING) AS src, 's' || CAST(l_partkey + l_suppkey AS STRING) AS dst FROM lineitem) AS ends"


@query(f"""SELECT 'span' AS rule, entity_id AS id FROM {_ROWS} WHERE start > stop OR start < 1 UNION ALL SELECT 'file', entity_id FROM {_ROWS} WHERE path NOT IN (SELECT path FROM {_ROW_FILES})
  UNION ALL SELECT 'repeated', entity_id FROM {_ROWS} GROUP BY entity_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'end', id FROM (SELECT src AS id FROM {_ROW_ENDS} UNION ALL SELECT dst FROM {_ROW_ENDS}) WHERE id NOT IN (SELECT entity_id FROM {_ROWS})""")
def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.row_violations(derived(spark, sf_dir, _ROWS), derived(spark, sf_dir, _ROW_FILES), derived(spark, sf_dir, _ROW_ENDS))


#: Events of a user are steps of a session in one of a few domains; a session has the name of the user's hundredth.
_STEPS = """(SELECT 'd' || CAST(user_id % 5 AS STRING) AS domain, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'finalize' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'abort' ELSE 'renew' END ELSE 'batch' END AS op,
  's' || CAST(user_id AS STRING) || '.' || CAST(event_id % 2 AS STRING) AS session, 'o' || CAST(user_id % 3 AS STRING) AS owner, 'r' || CAST(event_id AS STRING) AS revision, CAST(10 * (event_id % 3) AS BIGINT) AS expected,
  'files' AS kind, CAST(user_id % 2 AS INT) AS ordinal, CASE WHEN event_type = 'view' THEN 'a' ELSE 'b' END AS hash, CAST(10 AS BIGINT) AS n_rows FROM events) AS steps"""


@query()
def publication_session_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to a stream of session steps; state machines with timers have no SQL, they are tested step by step."""
    path = shared_path(spark, "sessions")
    derived(spark, sf_dir, _STEPS).write.parquet(f"{path}/steps")
    stream = spark.readStream.schema(sessions.EVENT).parquet(f"{path}/steps")
    told = sessions.publication_sessions(stream, ttl=dt.timedelta(days=2), retention=dt.timedelta(days=1), delay="1 hour")
    return sessions.answers(told, path)


@query(f"""WITH RECURSIVE r AS (SELECT src, dst FROM {RELATIONS}), reach AS (SELECT 'o7' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM reach JOIN r ON src = node WHERE depth < 2)
  SELECT node, min(depth)::INT AS depth FROM reach GROUP BY node""")
def directed_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("o7", "seed", 1)], "node string, origin string, seed_rank int")
    return graph.capped_traversal(derived(spark, sf_dir, RELATIONS), seeds, 2, None, directed=True).select("node", "depth")


@query(f"""WITH r AS (SELECT *, length(src) * 10 + CASE relation_type WHEN 'CALLS' THEN 5 ELSE 20 END AS cost FROM {RELATIONS}), o AS (SELECT *, sum(cost) OVER (ORDER BY relation_type, src, dst ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE src IN ('o1', 'p2') OR dst IN ('o1', 'p2'))
  SELECT src, dst, relation_type, used FROM o WHERE used <= 265""")
def budgeted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations around some nodes in admission order, as far as their sizes fit a budget."""
    cost = F.length("src") * 10 + F.when(F.col("relation_type") == "CALLS", 5).otherwise(20)
    nodes = spark.createDataFrame([("o1",), ("p2",)], "node string")
    return graph.within_budget(derived(spark, sf_dir, RELATIONS).withColumn("cost", cost), nodes, 265)


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), pool AS (SELECT DISTINCT label FROM embeddings WHERE vec_id IN (3, 4, 5))
  SELECT vec_id, label, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, q WHERE label IN (FROM pool) ORDER BY score DESC, vec_id LIMIT 15""")
def sections_of_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sections of the pages that were ranked first: the scan is cut to the pool before it is scored."""
    v = table(spark, sf_dir, "embeddings")
    pool = v.filter("vec_id in (3, 4, 5)").select("label").distinct()
    scored = retrieval.semantic_scores(v.join(pool, "label", "left_semi"), v.filter("vec_id = 0")).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), "vec_id").limit(15).select("vec_id", "label", "score")
