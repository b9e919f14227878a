"""Context queries over a code base made from ``orders``, ``part`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context
from .registry import query, table

#: Each order is a symbol in a file of its customer's group, each part one in a file of its brand; line items are calls.
_GRAPH = """sym AS (SELECT 's:o' || o_orderkey AS entity_id, 'f:c' || (o_custkey % 97) AS file_id FROM orders UNION ALL SELECT 's:p' || p_partkey, 'f:' || p_brand FROM part),
  fil AS (SELECT DISTINCT file_id FROM sym),
  ent AS (SELECT entity_id, 'symbol' AS entity_type, file_id, replace(file_id, 'f:', 'm:') AS module_id FROM sym UNION ALL SELECT file_id, 'file', file_id, replace(file_id, 'f:', 'm:') FROM fil
    UNION ALL SELECT replace(file_id, 'f:', 'm:'), 'module', file_id, replace(file_id, 'f:', 'm:') FROM fil),
  rel AS (SELECT DISTINCT 'c' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS relation_id, 'CALLS' AS relation_type, 's:o' || l_orderkey AS src, CASE WHEN l_linenumber <> 5 THEN 's:p' || l_partkey END AS dst,
      CASE WHEN l_linenumber = 5 THEN 'ext.' || l_suppkey END AS reference, l_linenumber::BIGINT AS start FROM lineitem
    UNION ALL SELECT 'd' || entity_id, 'DECLARES', replace(file_id, 'f:', 'm:'), entity_id, NULL, 0 FROM sym
    UNION ALL SELECT DISTINCT 'i' || (o_custkey % 97) || p_brand, 'IMPORTS', 'm:c' || (o_custkey % 97), 'm:' || p_brand, NULL, 0 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1
    UNION ALL SELECT 'x' || p_partkey, 'INHERITS', 's:p' || p_partkey, CASE p_size % 3 WHEN 0 THEN 's:p' || (p_partkey + 1) ELSE 's:gone' || p_partkey END, NULL, 7 FROM part)"""
_SEEDS = ["s:p7", "f:c5", "s:none", "s:p7", "m:Brand#11"]
_SEED_SQL = "(VALUES ('s:p7', 1), ('f:c5', 2), ('m:c5', 3), ('s:none', 4), ('s:p7', 5), ('m:Brand#11', 6)) AS seeds(entity_id, place)"


def _context_sql(depth: int, max_nodes: int, max_files: int, direction: str, last: str) -> str:
    """Level by level with window sums over all candidate relations, in place of the library's ranges and joins."""
    parts = [_GRAPH, f"a0 AS (SELECT entity_id, entity_type, file_id, 0 AS depth, row_number() OVER (ORDER BY place) AS admitted FROM ent JOIN (SELECT entity_id, min(place) AS place FROM {_SEED_SQL} GROUP BY entity_id) USING (entity_id)), cut0 AS (SELECT 1e18 AS cut)"]
    ok = "(t.entity_type <> 'module' OR relation_type IN ('DECLARES', 'IMPORTS'))"
    for k in range(1, depth + 1):
        out = f"EXISTS (SELECT 1 FROM a{k - 1} t WHERE t.depth = {k - 1} AND t.entity_id = src AND {ok})" if direction != "in" else "false"
        into = f"EXISTS (SELECT 1 FROM a{k - 1} t WHERE t.depth = {k - 1} AND t.entity_id = dst AND t.entity_type <> 'file' AND {ok})" if direction != "out" else "false"
        parts.append(f"""c{k} AS (SELECT *, row_number() OVER (ORDER BY relation_type, src, coalesce(dst, reference, ''), start, relation_id) AS place FROM (SELECT *, CASE WHEN {out} THEN dst ELSE src END AS nb FROM rel WHERE ({out} OR {into}) AND (SELECT cut FROM cut{k - 1}) = 1e18)),
  n{k} AS (SELECT nb, min(place) AS place, any_value(e.entity_type) AS entity_type, any_value(e.file_id) AS file_id FROM c{k} JOIN ent e ON nb = e.entity_id WHERE nb NOT IN (SELECT entity_id FROM a{k - 1}) GROUP BY nb),
  r{k} AS (SELECT *, row_number() OVER (ORDER BY place) + (SELECT count(*) FROM a{k - 1}) AS nth, (place = min(place) OVER (PARTITION BY file_id) AND file_id NOT IN (SELECT file_id FROM a{k - 1}))::INT AS fresh FROM n{k}),
  s{k} AS (SELECT *, sum(fresh) OVER (ORDER BY place) + (SELECT count(DISTINCT file_id) FROM a{k - 1}) AS nth_file FROM r{k}),
  cut{k} AS (SELECT coalesce(min(place), 1e18) AS cut FROM s{k} WHERE nth > {max_nodes} OR nth_file > {max_files}),
  a{k} AS (SELECT * FROM a{k - 1} UNION ALL SELECT nb, entity_type, file_id, {k}, nth FROM s{k} WHERE place < (SELECT cut FROM cut{k})),
  q{k} AS (SELECT relation_id, relation_type, src, dst, reference, {k} AS depth, place FROM c{k} WHERE place < (SELECT cut FROM cut{k}) AND (nb IS NULL OR nb IN (SELECT entity_id FROM ent)))""")
    return "WITH " + ",\n  ".join(parts) + "\n  " + last.format(k=depth, relations=" UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(1, depth + 1)))


def code_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of the made-up code base."""
    orders, part, lines = (table(spark, sf_dir, t) for t in ("orders", "part", "lineitem"))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    group = F.col("o_custkey") % 97
    symbols = orders.select(text("s:o", "o_orderkey").alias("entity_id"), text("f:c", group).alias("file_id")).union(part.select(text("s:p", "p_partkey"), text("f:", "p_brand")))
    module = F.replace("file_id", F.lit("f:"), F.lit("m:"))
    files = symbols.select("file_id").distinct()
    entities = symbols.select("entity_id", F.lit("symbol").alias("entity_type"), "file_id", module.alias("module_id"))
    entities = entities.union(files.select("file_id", F.lit("file"), "file_id", module)).union(files.select(module, F.lit("module"), "file_id", module))
    none = F.lit(None).cast("string")
    fifth = F.col("l_linenumber") == 5
    calls = lines.select(F.concat(F.lit("c"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("relation_id"), F.lit("CALLS").alias("relation_type"), text("s:o", "l_orderkey").alias("src"), F.when(~fifth, text("s:p", "l_partkey")).alias("dst"), F.when(fifth, text("ext.", "l_suppkey")).alias("reference"), F.col("l_linenumber").cast("long").alias("start")).distinct()
    zero = F.lit(0).cast("long")
    declares = symbols.select(text("d", "entity_id"), F.lit("DECLARES"), module, "entity_id", none, zero)
    uses = lines.filter("l_linenumber = 1").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(group.cast("string").alias("g"), "p_brand").distinct()
    imports = uses.select(F.concat(F.lit("i"), "g", "p_brand"), F.lit("IMPORTS"), text("m:c", "g"), text("m:", "p_brand"), none, zero)
    target = F.when(F.col("p_size") % 3 == 0, text("s:p", F.col("p_partkey") + 1)).otherwise(text("s:gone", "p_partkey"))
    inherits = part.select(text("x", "p_partkey"), F.lit("INHERITS"), text("s:p", "p_partkey"), target, none, F.lit(7).cast("long"))
    return entities, calls.union(declares).union(imports).union(inherits)


def _context(spark: SparkSession, sf_dir: str, **budget) -> context.Context:
    seeds = spark.createDataFrame([(s, i) for i, s in enumerate(_SEEDS)], "entity_id string, place long")
    return context.budgeted_context(*code_graph(spark, sf_dir), seeds, **budget)


@query(_context_sql(3, 250, 120, "both", "SELECT * FROM a{k}"))
def context_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities within three steps, as far as the budget of entities goes."""
    return _context(spark, sf_dir, depth=3, max_nodes=250, max_files=120).nodes


@query(_context_sql(3, 5000, 9, "out", "SELECT relation_id, relation_type, src, dst, reference, depth, row_number() OVER (ORDER BY depth, place) AS admitted FROM ({relations}) QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY depth) = 1"))
def context_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations outward, as far as the budget of files goes."""
    return _context(spark, sf_dir, depth=3, max_nodes=5000, max_files=9, direction="out").relations


_LINKS_SQL = "SELECT 'page' || (p_partkey % 13) AS page_id, CASE p_partkey % 4 WHEN 0 THEN 'source_glob' WHEN 1 THEN 'file' ELSE 'symbol' END AS selector_kind, p_type AS source, 'f:' || p_brand AS file_id, CASE WHEN p_partkey % 4 > 1 THEN 's:p' || p_partkey END AS symbol_id FROM part"


@query(_context_sql(1, 300, 20, "in", f"""SELECT page_id, selector_kind, 'documents' AS relation_type, source FROM ({_LINKS_SQL}) WHERE symbol_id IN (SELECT entity_id FROM a{{k}}) OR file_id IN (SELECT file_id FROM a{{k}})
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CASE selector_kind WHEN 'symbol' THEN 0 WHEN 'file' THEN 1 ELSE 2 END, source) = 1"""))
def context_wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages about what a context holds, each by its most specific selector."""
    part = table(spark, sf_dir, "part")
    rest = F.col("p_partkey") % 4
    links = part.select(F.concat(F.lit("page"), (F.col("p_partkey") % 13).cast("string")).alias("page_id"), F.when(rest == 0, "source_glob").when(rest == 1, "file").otherwise("symbol").alias("selector_kind"), F.lit("documents").alias("relation_type"), F.col("p_type").alias("source"), F.concat(F.lit("f:"), "p_brand").alias("file_id"), F.when(rest > 1, F.concat(F.lit("s:p"), F.col("p_partkey").cast("string"))).alias("symbol_id"))
    return context.context_pages(_context(spark, sf_dir, depth=1, max_nodes=300, max_files=20, direction="in"), links)


@query(_context_sql(2, 200, 30, "both", """, src AS (SELECT file_id, 'x' || repeat('y', (100 * length(file_id) + ascii(right(file_id, 1)))::INT) AS source FROM fil), o AS (SELECT file_id, octet_length(encode(source)) AS size, row_number() OVER (ORDER BY min(admitted)) AS nth FROM a{k} JOIN src USING (file_id) GROUP BY file_id, source),
  fold AS (SELECT nth, file_id, CASE WHEN size <= 5000 THEN size ELSE 0 END AS used, size <= 5000 AS fits FROM o WHERE nth = 1 UNION ALL SELECT o.nth, o.file_id, fold.used + CASE WHEN fold.used + size <= 5000 THEN size ELSE 0 END, fold.used + size <= 5000 FROM fold JOIN o ON o.nth = fold.nth + 1)
  SELECT file_id, CASE WHEN fits THEN 'ok' ELSE 'max_source_bytes_exhausted' END AS status, CASE WHEN fits THEN sha256(source) END AS source_sha256 FROM fold JOIN src USING (file_id)""".replace(", src AS", ",\n  src AS")).replace("WITH sym", "WITH RECURSIVE sym").replace("\n  ,\n", ",\n"))
def context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a context's files in order, each if it fits what is left of 5000 bytes."""
    found = _context(spark, sf_dir, depth=2, max_nodes=200, max_files=30)
    files = code_graph(spark, sf_dir)[0].select("file_id").distinct()
    size = (100 * F.length("file_id") + F.ascii(F.substr(F.col("file_id"), F.lit(-1)))).cast("int")
    sources = files.withColumn("source", F.concat(F.lit("x"), F.repeat(F.lit("y"), size))).withColumn("content_hash", F.sha2("source", 256))
    return context.context_sources(found, sources, 5000).select("file_id", "status", F.sha2("source", 256).alias("source_sha256"))
