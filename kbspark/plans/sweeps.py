"""Sweeps of search settings: hard negatives, and candidates against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluation as e
from .registry import derived, query

_S = "CAST({} AS STRING)".format
_MODE = "CASE {} % 2 WHEN 0 THEN 'hybrid' ELSE 'lexical' END AS mode".format
#: Orders name hard negatives of forty cases; nations and regions their traces, line items the candidates of a search.
TARGETS = f"(SELECT 'q' || {_S('o_custkey % 40')} AS case_id, {_MODE('o_orderkey')}, 'k' || {_S('o_orderkey % 60')} AS key FROM orders) AS targets"
RELEVANT = f"(SELECT 'q' || {_S('c_custkey % 40')} AS case_id, 'k' || {_S('c_custkey * 7 % 60')} AS key FROM customer) AS relevant"
TRACES = f"(SELECT 'q' || {_S('n_nationkey')} AS case_id, 'hybrid' AS mode, 20 AS k FROM nation UNION ALL SELECT 'q' || {_S('n_nationkey')}, 'lexical', 25 FROM nation UNION ALL SELECT 'q' || {_S('r_regionkey')}, 'hybrid', 30 FROM region) AS traces"
POOL = f"(SELECT 'q' || {_S('l_suppkey % 40')} AS case_id, {_MODE('l_orderkey')}, 'k' || {_S('l_partkey % 60')} AS key, CAST(min(l_quantity) AS INT) * 4 AS rank FROM lineitem GROUP BY l_suppkey % 40, l_orderkey % 2, l_partkey % 60) AS pool"
FINAL = f"(SELECT 'q' || {_S('p_size % 40')} AS case_id, {_MODE('p_partkey')}, 'k' || {_S('p_partkey % 60')} AS key FROM part) AS final"
STATES = f"""targets AS (FROM {TARGETS}), relevant AS (FROM {RELEVANT}), traces AS (FROM {TRACES}), pool AS (FROM {POOL}), final AS (FROM {FINAL}),
  v AS (SELECT t.*, (case_id, key) IN (SELECT (case_id, key) FROM relevant) AND count(*) OVER (PARTITION BY case_id, mode, key) = 1 AND (SELECT count(*) FROM traces x WHERE x.case_id = t.case_id AND x.mode = t.mode) = 1 AS valid FROM targets t),
  hard AS (SELECT case_id, mode, key, CASE WHEN NOT valid THEN 'invalid' WHEN p.rank > k AND (case_id, mode, key) NOT IN (SELECT (case_id, mode, key) FROM final) THEN 'active' ELSE 'unavailable' END AS state, CASE WHEN valid THEN p.rank END AS baseline_rank
    FROM v LEFT JOIN pool p USING (case_id, mode, key) LEFT JOIN (SELECT case_id, mode, min(k) AS k FROM traces GROUP BY ALL) USING (case_id, mode))"""


def _hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.hard_negative_states(*[derived(spark, sf_dir, t) for t in (TARGETS, RELEVANT, TRACES, POOL, FINAL)])


@query(f"WITH {STATES} SELECT * REPLACE (coalesce(baseline_rank, 0) AS baseline_rank) FROM hard")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives with their states; rank 0 for those that have none."""
    return _hard(spark, sf_dir).fillna(0, ["baseline_rank"])


#: Five sizes with a metric for each mode, of which the last lacks one; only 64 loses what the baseline of 32 does not.
_SIZE = "16 * (1 + {} % 5)".format
METRICS = f"""(SELECT {_S(_SIZE('o_custkey'))} AS candidate, {_MODE('o_orderkey')}, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) % 7 AS DOUBLE) / 7 AS recall, CAST(sum(o_orderkey) % 5 AS DOUBLE) / 5 AS coverage, CAST(count(*) % 89 AS DOUBLE) / 89 AS ndcg
  FROM orders WHERE o_custkey % 5 <> 4 OR o_orderkey % 2 = 0 GROUP BY o_custkey % 5, o_orderkey % 2) AS metrics"""
FOUND = f"(SELECT DISTINCT {_S(_SIZE('l_suppkey'))} AS candidate, 'q' || {_S('l_orderkey % 3')} AS case_id, CASE WHEN l_suppkey % 5 = 3 AND l_linenumber = 7 THEN 'k9' ELSE 'k1' END AS key, 'hydration_drop' AS loss FROM lineitem) AS found"
LATENCY = f"(SELECT {_S(_SIZE('p_partkey'))} AS candidate, CAST(sum(p_size * (p_partkey % 5 + 1)) AS DOUBLE) AS p95 FROM part GROUP BY p_partkey % 5) AS latency"
RANKING = f"""(SELECT '48' AS candidate, 'q' || {_S('l_suppkey % 40')} AS case_id, {_MODE('l_orderkey')}, 'k' || {_S('l_partkey % 60')} AS key, 1 AS rank, 2 AS k FROM lineitem
  UNION ALL SELECT {_S(_SIZE('l_orderkey'))}, 'q' || {_S('l_suppkey % 40')}, {_MODE('l_orderkey')}, 'k' || {_S('l_partkey % 60')}, CAST(l_linenumber AS INT), 2 FROM lineitem WHERE l_orderkey % 5 <> 2) AS ranking"""


@query(f"WITH {STATES}, active AS (SELECT DISTINCT case_id, mode, key FROM hard WHERE state = 'active') SELECT candidate, count(DISTINCT a.case_id || ' ' || a.mode || ' ' || a.key) = (SELECT count(*) FROM active) AS recovered FROM {RANKING} LEFT JOIN active a ON a.case_id = ranking.case_id AND a.mode = ranking.mode AND a.key = ranking.key AND rank <= k GROUP BY candidate")
def recovered_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.recovered(derived(spark, sf_dir, RANKING), _hard(spark, sf_dir))


_GATES = f"""m AS (SELECT * FROM {METRICS}), b AS (SELECT * FROM m WHERE candidate = '32'), c AS (SELECT DISTINCT candidate FROM m), j AS (SELECT c.candidate, b.*, m.recall AS r, m.coverage AS v, m.ndcg AS n FROM c CROSS JOIN b LEFT JOIN m ON m.candidate = c.candidate AND m.mode = b.mode),
  fnd AS (SELECT * FROM {FOUND}), lat AS (SELECT * FROM {LATENCY}), new AS (SELECT candidate FROM fnd WHERE (case_id, key, loss) NOT IN (SELECT (case_id, key, loss) FROM fnd WHERE candidate = '32')),
  slow AS (SELECT candidate FROM lat WHERE ((SELECT p95 FROM lat WHERE candidate = '32') - p95) / (SELECT p95 FROM lat WHERE candidate = '32') * 100 < 25),
  t AS (SELECT candidate, unnest([CASE WHEN {{lost}} THEN 'confirmed_loss_not_recovered' END, CASE WHEN bool_or(v < coverage) THEN 'intent_coverage_regression' END, CASE WHEN bool_or(r IS NULL) THEN 'missing_baseline_mode' END, CASE WHEN bool_or(n < ndcg - 0.01) THEN 'ndcg_loss_exceeds_limit' END,
    CASE WHEN candidate IN (FROM new) THEN 'new_loss_finding' END, CASE WHEN {{slow}} THEN 'p95_improvement_below_limit' END, CASE WHEN bool_or(r < recall) THEN 'recall_regression' END]) AS reason FROM j GROUP BY candidate)
  SELECT candidate, coalesce(string_agg(reason, ',' ORDER BY reason) FILTER (candidate <> '32'), '') AS reasons, count(reason) FILTER (candidate <> '32') = 0 AS passed FROM t GROUP BY candidate"""
_RECOVERED = f"SELECT candidate, count(DISTINCT a.case_id || ' ' || a.mode || ' ' || a.key) = (SELECT count(*) FROM active) AS recovered FROM {RANKING} LEFT JOIN active a ON a.case_id = ranking.case_id AND a.mode = ranking.mode AND a.key = ranking.key AND rank <= k GROUP BY candidate"


@query("WITH " + _GATES.format(lost="false", slow="candidate IN (FROM slow)"))
def rerank_batch_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch sizes of a reranker that keep quality and are a quarter faster than the baseline of 32."""
    return e.gated_candidates(derived(spark, sf_dir, METRICS), derived(spark, sf_dir, FOUND), derived(spark, sf_dir, LATENCY), "32")


@query(f"WITH {STATES}, active AS (SELECT DISTINCT case_id, mode, key FROM hard WHERE state = 'active'), rec AS ({_RECOVERED}), " + _GATES.format(lost="candidate NOT IN (SELECT candidate FROM rec WHERE recovered)", slow="false"))
def fusion_weight_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a fusion that keep quality and bring confirmed losses back."""
    return e.gated_candidates(derived(spark, sf_dir, METRICS), derived(spark, sf_dir, FOUND), None, "32", e.recovered(derived(spark, sf_dir, RANKING), _hard(spark, sf_dir)))
