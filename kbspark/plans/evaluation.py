"""Evaluation queries: cases are sources, hits the documents that a term search ranks in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as e
from .registry import derived, query, table
from .search import HITS, _lexical

TOP = f"top AS (SELECT * FROM ({HITS}) WHERE rank <= 50)"


def _hits(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    hits = _lexical(spark, sf_dir).filter("score > 0").select(F.col("source").alias("case_id"), F.col("doc_id").alias("key"), F.row_number().over(order).alias("rank"))
    return hits.filter(F.col("rank") <= k)


@query(f"""WITH {TOP}, intents AS (SELECT source AS case_id, lang || '-' || (doc_id % 5) AS intent, doc_id AS key FROM documents), met AS (
    SELECT i.case_id, intent, max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS met FROM intents i LEFT JOIN top USING (case_id, key) GROUP BY i.case_id, intent)
  SELECT case_id, avg(met) AS coverage FROM met GROUP BY case_id""")
def intent_coverage_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.concat_ws("-", "lang", (F.col("doc_id") % 5).cast("string")).alias("intent"), F.col("doc_id").alias("key"))
    return e.intent_coverage(_hits(spark, sf_dir), intents, 10)


@query("""SELECT 'lang' AS field, coalesce(lang, 'unknown') AS label, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY source""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.source_mix(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("""SELECT user_id AS case_id, event_type AS stage, round(sum(value), 3) AS ms FROM events GROUP BY ALL UNION ALL SELECT user_id, 'total', round(sum(value), 3) FROM events GROUP BY user_id""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.latency_summary(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query("SELECT event_type AS mode, count(*) AS cases, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def mode_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = e.roll_up(table(spark, sf_dir, "events").withColumnRenamed("event_type", "mode"), "mode", ["value"])
    return rolled.withColumn("value", F.round("value", 6))


_FINDINGS = "SELECT l_linenumber::VARCHAR AS class, CASE WHEN l_discount >= 0.09 THEN 'high' WHEN l_discount >= 0.05 THEN 'medium' ELSE 'low' END AS severity FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3"


@query(f"""WITH f AS ({_FINDINGS}), g AS (SELECT class, count(*) AS n, min(CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS w FROM f GROUP BY class)
  SELECT class, n, ['high', 'medium', 'low'][w] AS severity, row_number() OVER (ORDER BY w, n DESC, class)::INT AS place FROM g""")
def ranked_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linenumber > 3")
    severity = F.when(F.col("l_discount") >= 0.09, "high").when(F.col("l_discount") >= 0.05, "medium").otherwise("low")
    return e.ranked_backlog(line.select(F.col("l_linenumber").cast("string").alias("class"), severity.alias("severity")))


@query(f"""WITH {TOP}, relevant AS (SELECT DISTINCT source AS case_id, doc_id AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1), first AS (SELECT case_id, min(rank) AS first FROM top JOIN relevant USING (case_id, key) GROUP BY case_id)
  SELECT round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 9) AS recall_at_k, round(avg(coalesce(1 / first, 0)), 9) AS mrr_at_k FROM (SELECT DISTINCT case_id FROM relevant) LEFT JOIN first USING (case_id)""")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("key"))
    got = e.hit_rate(_hits(spark, sf_dir), relevant)
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


_STAGES = f"""{TOP}, wanted AS (SELECT source AS case_id, doc_id AS key, left(sha256(coalesce(text, '')), 16) AS hash FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
  chunks AS (SELECT doc_id AS key, left(sha256(coalesce(text, '')), 16) AS hash FROM documents WHERE doc_id % 11 <> 0), idx AS (SELECT key, CASE WHEN key % 13 = 0 THEN 'old' ELSE hash END AS hash FROM chunks WHERE key % 7 <> 0),
  fused AS (SELECT * FROM top WHERE key % 5 <> 0), hydrated AS (SELECT * FROM top WHERE key % 3 <> 0), final AS (SELECT case_id, key, 51 - rank AS rank FROM hydrated)"""
_LOSS = f"""losses AS (SELECT w.case_id, w.key, CASE WHEN c.key IS NULL THEN 'missing_from_chunks' WHEN i.key IS NULL THEN 'missing_from_index' WHEN i.hash <> w.hash THEN 'stale_index_chunk' WHEN t.key IS NULL THEN 'signal_recall_miss'
    WHEN f.key IS NULL THEN 'lost_during_fusion' WHEN f.rank > 20 THEN 'lost_after_fusion_topk' WHEN h.key IS NULL THEN 'hydration_drop' WHEN x.rank > 20 THEN 'rerank_worsened_order' END AS loss FROM wanted w LEFT JOIN chunks c USING (key) LEFT JOIN idx i USING (key)
    LEFT JOIN top t ON t.case_id = w.case_id AND t.key = w.key LEFT JOIN fused f ON f.case_id = w.case_id AND f.key = w.key LEFT JOIN hydrated h ON h.case_id = w.case_id AND h.key = w.key LEFT JOIN final x ON x.case_id = w.case_id AND x.key = w.key)"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("key"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("hash"))
    wanted = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("key")), "key", "left_semi")
    chunks = docs.filter("key % 11 <> 0").select("key", "hash")
    index = chunks.filter("key % 7 <> 0").select("key", F.when(F.col("key") % 13 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    top = _hits(spark, sf_dir)
    hydrated = top.filter("key % 3 <> 0")
    stages = {"chunks": chunks, "index": index, "signals": top, "fused": top.filter("key % 5 <> 0"), "hydrated": hydrated, "final": hydrated.withColumn("rank", 51 - F.col("rank"))}
    return e.classify_losses(wanted, stages, 20)


@query(f"WITH {_STAGES}, {_LOSS} SELECT * FROM losses WHERE loss IS NOT NULL")
def loss_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relevant document that a search loses, with the first stage that loses it."""
    return _losses(spark, sf_dir)


@query(f"WITH {_STAGES}, {_LOSS} SELECT * FROM losses WHERE loss IS NOT NULL AND key % 2 = 1")
def new_loss_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses that a baseline, here that of even documents, does not have."""
    found = _losses(spark, sf_dir)
    return e.new_findings(found, found.filter("key % 2 = 0"), ["case_id", "key", "loss"])


FUSED = "(SELECT 'q' || CAST(l_suppkey AS STRING) AS case_id, l_partkey AS key, CAST(l_quantity * 10 + l_linenumber AS BIGINT) AS rank FROM lineitem) AS fused"
DIRECT = "(SELECT 'q' || CAST(l_suppkey + 1 AS STRING) AS case_id, l_partkey + 3 * (l_linenumber % 2) AS key, CAST(floor(l_extendedprice) AS BIGINT) AS rank FROM lineitem) AS direct"
_FIRST = "(SELECT case_id, key, min(rank) AS rank FROM {} GROUP BY case_id, key)"


@query(f"""WITH f AS (SELECT case_id, list(key ORDER BY rank, key) AS f FROM {_FIRST.format(FUSED)} GROUP BY case_id), d AS (SELECT case_id, list(key ORDER BY rank, key)[1:8] AS d FROM {_FIRST.format(DIRECT)} GROUP BY case_id),
  j AS (SELECT case_id, coalesce(f, []) AS f, coalesce(d, []) AS d FROM f FULL JOIN d USING (case_id)), n AS (SELECT *, list_filter(d, lambda x: NOT list_contains(f[1:8], x)) AS late, list_filter(f[1:8], lambda x: NOT list_contains(d, x)) AS free FROM j),
  k AS (SELECT *, list_filter(f[1:8], lambda x: NOT list_contains(free[greatest(len(free) - len(late), 0) + 1:], x)) AS kept FROM n), o AS (SELECT case_id, list_concat(kept, late, list_filter(f, lambda x: NOT list_contains(kept, x) AND NOT list_contains(late, x))) AS keys FROM k)
  SELECT case_id, unnest(keys) AS key, unnest(range(1, len(keys) + 1))::INT AS place FROM o""")
def quota_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of which the first eight places take in the best eight direct hits."""
    return e.quota_ranking(derived(spark, sf_dir, FUSED), derived(spark, sf_dir, DIRECT), 8)


@query(f"""WITH {TOP}, every AS (SELECT case_id, key, CASE WHEN key % 4 = 0 THEN 0 ELSE 1 END AS block, CASE WHEN key % 4 = 0 THEN -(key % 97) ELSE rank END AS pos FROM top)
  SELECT case_id, key, row_number() OVER (PARTITION BY case_id ORDER BY block, pos, key)::INT AS place FROM every QUALIFY place <= 20""")
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _hits(spark, sf_dir)
    scored = top.filter("key % 4 = 0").select("case_id", "key", (F.col("key") % 97).cast("double").alias("score"))
    return e.rerank_merge(scored, top, 20)


@query(f"WITH {TOP} SELECT top.case_id, top.key, rank FROM top JOIN documents d ON d.doc_id = top.key WHERE d.lang <> 'fr' AND rank <= greatest(8, 32)")
def hydrated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a pool for 8 results whose document has not changed since; here those in French have."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "lang")
    found = _hits(spark, sf_dir).filter(F.col("rank") <= e.candidate_limit(8)).join(docs.select("key", F.when(F.col("lang") == "fr", "old").otherwise(F.col("hash")).alias("hash")), "key")
    return e.live_candidates(found, docs.select("key", "hash"), ["key"]).select("case_id", "key", "rank")
