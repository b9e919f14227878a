"""Search queries over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..functions.vectors import dequantise, quantise, scale_of
from ..operators import retrieval as r
from .registry import query, table

QUERY = "the thing ration"
TERMS = query_terms(QUERY)


def _hits(text: str = "text") -> str:
    """SQL for the number of term occurrences."""
    hay = f"lower(coalesce({text}, ''))"
    return " + ".join(f"((length({hay}) - length(replace({hay}, '{t}', ''))) // {len(t)})" for t in TERMS)


LEX = f"SELECT doc_id, lang, source, text, ({_hits()})::INT AS score FROM documents"
COS = """SELECT v.vec_id, v.label, CASE WHEN list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 THEN 0.0
  ELSE list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) END AS score
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.lexical_scores(table(spark, sf_dir, "documents"), TERMS)


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return r.semantic_scores(v, v.filter("vec_id = 0"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = _lexical(spark, sf_dir).filter("score > 0")
    semantic = _semantic(spark, sf_dir).withColumn("score", F.round("score", 4))
    return r.ranked(lexical, "lexical", [F.desc("score"), "doc_id"], "doc_id").union(r.ranked(semantic, "semantic", [F.desc("score"), "vec_id"], "vec_id"))


SIGNALS = f"""lex AS (SELECT 'lexical' AS signal, doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({LEX}) WHERE score > 0 QUALIFY rank <= 32),
  sem AS (SELECT 'semantic' AS signal, vec_id AS key, row_number() OVER (ORDER BY round(score, 4) DESC, vec_id) AS rank FROM ({COS}) QUALIFY rank <= 32),
  signals AS (SELECT * FROM lex UNION ALL SELECT * FROM sem)"""


@query(f"""WITH {SIGNALS} SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(signal, ',' ORDER BY signal) AS signals
  FROM signals GROUP BY key ORDER BY score DESC, key LIMIT 8""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.fuse(_signals(spark, sf_dir), 8)


@query(f"""WITH {SIGNALS}, grid(candidate, w_lex, w_sem) AS (VALUES (1, 1.0, 1.0), (2, 2.0, 1.0), (3, 1.0, 2.0), (4, 0.5, 1.5)),
  fused AS (SELECT candidate, key, round(sum(CASE signal WHEN 'lexical' THEN w_lex ELSE w_sem END::DOUBLE / (60 + rank)), 9) AS score,
    string_agg(signal, ',' ORDER BY signal) AS signals FROM signals, grid GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, key)::INT AS place FROM fused QUALIFY place <= 8""")
def rrf_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion replayed for each candidate of a small grid of weights."""
    grid = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 1.0, 2.0), (4, 0.5, 1.5)], "candidate int, w_lex double, w_sem double")
    swept = _signals(spark, sf_dir).crossJoin(F.broadcast(grid)).withColumn("weight", F.when(F.col("signal") == "lexical", F.col("w_lex")).otherwise(F.col("w_sem")))
    return r.fuse(swept.drop("w_lex", "w_sem"), 8, by=["candidate"])


@query(f"SELECT doc_id, score FROM ({LEX})")
def lexical_term_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("doc_id", "score")


@query(f"SELECT doc_id, score FROM ({LEX}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query(f"SELECT source, lang, sum(score)::BIGINT AS score FROM ({LEX}) WHERE score > 0 GROUP BY ALL")
def lexical_page_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).filter("score > 0").groupBy("source", "lang").agg(F.sum("score").alias("score"))


@query(f"SELECT vec_id, round(score, 4) AS score FROM ({COS}) WHERE score >= 0.1 ORDER BY round(score, 4) DESC, vec_id LIMIT 8")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.threshold_top_k(_semantic(spark, sf_dir), 0.1, 8, ["vec_id"]).select("vec_id", "score")


@query(f"SELECT vec_id, round(score, 4) AS score FROM ({COS}) WHERE round(score, 4) >= 0.15 ORDER BY score DESC, vec_id LIMIT 5")
def seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.threshold_top_k(_semantic(spark, sf_dir), 0.15, 5, ["vec_id"], round_first=True).select("vec_id", "score")


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({COS}) WHERE label = 3 AND score >= 0")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets apply before scoring."""
    v = table(spark, sf_dir, "embeddings")
    return r.semantic_scores(v.filter("label = 3"), v.filter("vec_id = 0")).filter("score >= 0").select("vec_id", F.round("score", 6).alias("score"))


Q8 = """SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN m = 0 THEN 1.0 ELSE m / 127 END AS scale FROM (
  SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings)"""


@query(f"SELECT vec_id, round(scale, 9) AS scale, array_to_string(list_transform(e, lambda x: least(127, greatest(-127, round_even(x / scale, 0)::INT))), ',') AS q FROM ({Q8})")
def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("scale", scale_of(F.col("embedding")))
    q = F.transform(quantise(F.col("embedding"), F.col("scale")), lambda x: x.cast("string"))
    # apart from the rounded scale: within one select, a lambda takes "scale" for that one
    return v.withColumn("q", F.array_join(q, ",")).select("vec_id", F.round("scale", 9).alias("scale"), "q")


@query(f"""WITH d AS (SELECT vec_id, list_transform(e, lambda x: least(127, greatest(-127, round_even(x / scale, 0))) * scale) AS e FROM ({Q8}))
  SELECT d.vec_id, round(list_cosine_similarity(d.e, q.e), 6) AS score FROM d, (SELECT e FROM d WHERE vec_id = 0) q""")
def dequantized_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("scale", scale_of(F.col("embedding")))
    v = v.select("vec_id", dequantise(quantise(F.col("embedding"), F.col("scale")), F.col("scale")).alias("embedding"))
    return r.semantic_scores(v, v.filter("vec_id = 0")).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT label, max_by(vec_id, (round(score, 6), -vec_id)) AS vec_id, round(max(score), 6) AS score FROM ({COS}) WHERE vec_id <> 0 GROUP BY label""")
def related_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best neighbour in each group, without the query itself."""
    s = _semantic(spark, sf_dir).filter("vec_id <> 0").withColumn("score", F.round("score", 6))
    return s.groupBy("label").agg(F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("vec_id"), F.max("score").alias("score"))


@query(f"""SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INT AS place FROM ({LEX}) WHERE score > 0 QUALIFY place <= 3""")
def fanout_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _lexical(spark, sf_dir).filter("score > 0").select("source", "doc_id", "score")
    return r.cap_per_group(hits, ["source"], [F.desc("score"), "doc_id"], 3)


HITS = f"""SELECT source AS case_id, doc_id AS key, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INT AS rank FROM ({LEX}) WHERE score > 0"""
METRICS = f"""hits AS ({HITS}), relevant AS (SELECT d.source AS case_id, d.doc_id AS key, 1 + quality + (1 - toxic) AS grade FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1),
  ideal AS (SELECT case_id, count(*) AS n_all, sum(CASE WHEN place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) END) AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, key) AS place FROM relevant) GROUP BY case_id),
  got AS (SELECT case_id, count(*) AS n, min(rank) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM hits JOIN relevant USING (case_id, key) WHERE rank <= 10 GROUP BY case_id),
  metrics AS (SELECT case_id, round(coalesce(n / n_all, 0), 9) AS recall, round(coalesce(1 / first, 0), 9) AS mrr, round(coalesce(dcg / best, 0), 9) AS ndcg
    FROM (SELECT case_id FROM hits UNION SELECT case_id FROM relevant) LEFT JOIN ideal USING (case_id) LEFT JOIN got USING (case_id))"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    hits = _lexical(spark, sf_dir).filter("score > 0").select(F.col("source").alias("case_id"), F.col("doc_id").alias("key"), F.row_number().over(order).alias("rank")).filter("rank <= 10")
    labels = table(spark, sf_dir, "labels").filter("quality = 1")
    relevant = table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("key"), (1 + F.col("quality") + (1 - F.col("toxic"))).alias("grade"))
    return r.metrics_at_k(hits, relevant, 10)


@query(f"WITH {METRICS} SELECT * FROM metrics")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, MRR and nDCG at 10 of the lexical ranking, a case per source."""
    return _metrics(spark, sf_dir)


@query(f"""WITH {METRICS}, m AS (SELECT 'recall' AS metric, round(avg(recall), 6) AS value FROM metrics UNION ALL SELECT 'mrr', round(avg(mrr), 6) FROM metrics UNION ALL SELECT 'ndcg', round(avg(ndcg), 6) FROM metrics),
  gates(metric, op, bound) AS (VALUES ('recall', '>=', 0.01), ('mrr', '>=', 0.1), ('ndcg', '<', 0.05), ('latency', '<', 1.0))
  SELECT metric, value, coalesce(CASE op WHEN '<' THEN value < bound WHEN '>=' THEN value >= bound END, false) AS passed FROM gates LEFT JOIN m USING (metric)""")
def gate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quality import evaluate_gates

    mean = _metrics(spark, sf_dir).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])
    values = mean.selectExpr("stack(3, 'recall', recall, 'mrr', mrr, 'ndcg', ndcg) as (metric, value)")
    gates = spark.createDataFrame([("recall", ">=", 0.01), ("mrr", ">=", 0.1), ("ndcg", "<", 0.05), ("latency", "<", 1.0)], "metric string, op string, bound double")
    return evaluate_gates(values, gates)

