"""Search evaluation beyond rank metrics: intents, sources, latencies, losses, backlogs, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import staged

#: Severities from the worst down, and the losses of a relevant item in the order in which they are told.
SEVERITIES = ("high", "medium", "low")
LOSSES = ("missing_from_chunks", "missing_from_index", "stale_index_chunk", "signal_recall_miss", "lost_during_fusion", "lost_after_fusion_topk", "hydration_drop", "rerank_worsened_order")


def intent_coverage(hits: DataFrame, intents: DataFrame, k: int) -> DataFrame:
    """The share of each case's intents with a hit among its first k: ``hits(case_id, key, rank)``, ``intents(case_id, intent, key)``."""
    top = hits.filter(F.col("rank") <= k).select("case_id", "key").distinct().withColumn("hit", F.lit(1))
    met = intents.join(top, ["case_id", "key"], "left").groupBy("case_id", "intent").agg(F.max(F.coalesce("hit", F.lit(0))).alias("met"))
    return met.groupBy("case_id").agg(F.avg("met").alias("coverage"))


def source_mix(results: DataFrame, fields: list[str]) -> DataFrame:
    """How often each label occurs in each of the fields; a missing label counts as unknown. One scan for all fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("unknown")).alias("label")) for f in fields])
    return results.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.label").agg(F.count("*").alias("n"))


def latency_summary(stages: DataFrame) -> DataFrame:
    """Milliseconds by case and stage, and each case's total: ``stages(case_id, stage, ms)``."""
    summed = stages.rollup("case_id", "stage").agg(F.round(F.sum("ms"), 3).alias("ms"), F.grouping_id().alias("level"))
    return summed.filter("level < 2").select("case_id", F.when(F.col("level") == 1, "total").otherwise(F.col("stage")).alias("stage"), "ms")


def roll_up(summaries: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means of the cases' metrics and their number, by mode."""
    return summaries.groupBy(by).agg(F.count("*").alias("cases"), *[F.avg(m).alias(m) for m in metrics])


def ranked_backlog(findings: DataFrame) -> DataFrame:
    """Findings by class with their number and worst severity, the gravest first: ``findings(class, severity)``."""
    weight = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    grouped = findings.groupBy("class").agg(F.count("*").alias("n"), F.min(weight).alias("w"))
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("w").cast("int"))
    place = F.row_number().over(Window.orderBy("w", F.desc("n"), "class"))  # over the few classes
    return grouped.select("class", "n", worst.alias("severity"), place.alias("place"))


def hit_rate(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """The share of cases with a relevant hit, and the mean reciprocal rank of the first one."""
    first = hits.join(relevant.select("case_id", "key").distinct(), ["case_id", "key"]).groupBy("case_id").agg(F.min("rank").alias("first"))
    all_ = relevant.select("case_id").distinct().join(first, "case_id", "left")
    return all_.agg(F.avg(F.col("first").isNotNull().cast("int")).alias("recall_at_k"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr_at_k"))


def classify_losses(wanted: DataFrame, stages: dict[str, DataFrame], k: int) -> DataFrame:
    """Why each relevant item is not among a case's first k: the first stage that does not have it.

    ``wanted(case_id, key, hash)``; ``stages``: chunks and index (key, hash), and by case signals, fused (rank), hydrated
    and final (rank). Items that stay in the first k are left out.
    """
    has = lambda df, keys, name, *more: df.select(*keys, *more).distinct().withColumn(name, F.lit(True))
    case = ["case_id", "key"]
    j = wanted.join(has(stages["chunks"], ["key"], "in_chunks"), "key", "left")
    j = j.join(has(stages["index"], ["key"], "in_index", F.col("hash").alias("indexed_hash")), "key", "left")
    j = j.join(has(stages["signals"], case, "in_signals"), case, "left").join(has(stages["fused"], case, "in_fused", F.col("rank").alias("fused_rank")), case, "left")
    j = j.join(has(stages["hydrated"], case, "in_hydrated"), case, "left").join(has(stages["final"], case, "in_final", F.col("rank").alias("final_rank")), case, "left")
    conditions = [
        F.col("in_chunks").isNull(),
        F.col("in_index").isNull(),
        F.col("indexed_hash") != F.col("hash"),
        F.col("in_signals").isNull(),
        F.col("in_fused").isNull(),
        F.col("fused_rank") > k,
        F.col("in_hydrated").isNull(),
        F.col("final_rank").isNull() | (F.col("final_rank") > k),
    ]
    loss = F.coalesce(*[F.when(c, F.lit(name)) for c, name in zip(conditions, LOSSES, strict=True)])
    return j.select("case_id", "key", loss.alias("loss")).filter("loss is not null")


def new_findings(findings: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that the baseline does not have."""
    return findings.join(baseline.select(*keys).distinct(), keys, "left_anti")


def quota_ranking(fused: DataFrame, direct: DataFrame, k: int) -> DataFrame:
    """Each case's first k with its direct hits let in from the tail: ``(case_id, key, place)``; the others follow.

    ``fused`` and ``direct`` have case_id, key and rank. The first k direct hits are reserved: those beyond the first k of
    the fused ranking take the places of its last unreserved ones, behind those that stay.
    """
    first = lambda df: df.groupBy("case_id", "key").agg(F.min("rank").alias("rank"))
    place = lambda *by: F.row_number().over(Window.partitionBy("case_id").orderBy(*by))
    ranked = staged(first(fused).withColumn("n", place("rank", "key")).select("case_id", "key", "n"))
    reserved = first(direct).withColumn("turn", place("rank", "key")).filter(F.col("turn") <= k).select("case_id", "key", "turn")
    reserved = staged(reserved.join(ranked, ["case_id", "key"], "left"))
    is_late = F.col("n").isNull() | (F.col("n") > k)

    # the head of a case, of 2 k rows at most, is ordered by itself; what follows moves by the rows that leave and pass it
    late = reserved.filter(is_late)
    moved = late.groupBy(F.col("case_id").alias("_case")).agg(F.count("*").alias("late"), F.collect_list("n").alias("from"))
    top = ranked.filter(F.col("n") <= k)
    kept = reserved.filter(~is_late).select("case_id", "key", F.lit(True).alias("kept"))
    top = top.join(kept, ["case_id", "key"], "left").join(moved, F.col("case_id").eqNullSafe(F.col("_case")), "left")
    free = Window.partitionBy("case_id", F.col("kept").isNull()).orderBy(F.desc("n"))
    out = F.col("kept").isNull() & (F.row_number().over(free) <= F.coalesce("late", F.lit(0)))
    head = top.select("case_id", "key", F.when(out, 2).otherwise(0).alias("block"), F.col("n").alias("at"))
    head = head.union(late.select("case_id", "key", F.lit(1), "turn")).select("case_id", "key", place("block", "at").alias("place"))
    tail = ranked.filter(F.col("n") > k).join(moved, F.col("case_id").eqNullSafe(F.col("_case")), "left")
    before = F.size(F.filter(F.coalesce("from", F.array().cast("array<int>")), lambda x: x < F.col("n")))
    tail = tail.filter(~F.coalesce(F.array_contains("from", F.col("n")), F.lit(False)))
    return head.union(tail.select("case_id", "key", (F.col("n") + F.coalesce("late", F.lit(0)) - before).cast("int")))


def rerank_merge(scored: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Reranked keys first, then the candidates without a score in their order, k in all: ``(case_id, key, place)``."""
    rest = candidates.join(scored.select("case_id", "key"), ["case_id", "key"], "left_anti")
    every = scored.select("case_id", "key", F.lit(0).alias("block"), (-F.col("score")).alias("at")).unionByName(rest.select("case_id", "key", F.lit(1).alias("block"), F.col("rank").cast("double").alias("at")))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("block", "at", "key"))
    return every.withColumn("place", place).filter(F.col("place") <= k).select("case_id", "key", "place")


def candidate_limit(k: Column | int, least: int = 32) -> Column:
    """How many candidates a search for k results looks at."""
    return F.greatest(F.lit(k) if isinstance(k, int) else k, F.lit(least))


def live_candidates(candidates: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose chunk is still there with the same hash."""
    return candidates.join(chunks.select(*keys, "hash"), [*keys, "hash"])


#: Why a candidate of a sweep fails, in the order of their names.
REASONS = ("confirmed_loss_not_recovered", "intent_coverage_regression", "missing_baseline_mode", "ndcg_loss_exceeds_limit", "new_loss_finding", "p95_improvement_below_limit", "recall_regression")


def hard_negative_states(targets: DataFrame, relevant: DataFrame, traces: DataFrame, candidates: DataFrame, final: DataFrame) -> DataFrame:
    """The state of each hard negative ``targets(case_id, mode, key)``, with its rank before fusion cut it off.

    ``invalid`` unless the key is relevant to its case, named once, and its case and mode have exactly one trace
    (``traces(case_id, mode, k)``); ``active`` if it is among the candidates (``rank`` from 1) beyond the first k and not in
    the final ranking; else ``unavailable``.
    """
    keys = ["case_id", "mode", "key"]
    named = targets.groupBy(*keys).agg(F.count("*").alias("named"))
    traced = traces.groupBy("case_id", "mode").agg(F.count("*").alias("traced"), F.min("k").alias("k"))
    j = named.join(traced, ["case_id", "mode"], "left").join(relevant.select("case_id", "key").distinct().withColumn("known", F.lit(True)), ["case_id", "key"], "left")
    j = j.join(candidates.groupBy(*keys).agg(F.min("rank").alias("rank")), keys, "left").join(final.select(*keys).distinct().withColumn("ranked", F.lit(True)), keys, "left")
    valid = F.coalesce(F.col("known") & (F.col("named") == 1) & (F.col("traced") == 1) & (F.col("k") > 0), F.lit(False))
    active = F.coalesce(F.col("rank") > F.col("k"), F.lit(False)) & F.col("ranked").isNull()
    state = F.when(~valid, "invalid").when(active, "active").otherwise("unavailable")
    return j.select(*keys, state.alias("state"), F.when(valid, F.col("rank")).alias("baseline_rank"), F.explode(F.sequence(F.lit(1), F.col("named"))).alias("copy")).drop("copy")


def gated_candidates(metrics: DataFrame, findings: DataFrame, latency: DataFrame | None, baseline: str, recovers: DataFrame | None = None, ndcg_loss: float = 0.01, faster: float = 25.0) -> DataFrame:
    """Each candidate of a sweep with why it fails against the baseline: ``(candidate, reasons, passed)``.

    ``metrics(candidate, mode, recall, coverage, ndcg)``; ``findings(candidate, case_id, key, loss)``;
    ``latency(candidate, p95)``, if given, must fall by ``faster`` percent; so must ``recovers(candidate, recovered)`` be true.
    The baseline itself passes.
    """
    own = metrics.filter(F.col("candidate") == baseline)
    base = own.select("mode", *[F.col(c).alias(f"base_{c}") for c in ("recall", "coverage", "ndcg")])
    names = metrics.select("candidate").distinct()
    pairs = names.join(F.broadcast(base)).join(metrics, ["candidate", "mode"], "full_outer")  # a row for each mode, of which there are a few
    worse = lambda c: F.coalesce(F.col(c) < F.col(f"base_{c}"), F.lit(False))
    found = pairs.groupBy("candidate").agg(
        F.max(worse("coverage")).alias("intent_coverage_regression"),
        F.max(F.col("recall").isNull() | F.col("base_recall").isNull()).alias("missing_baseline_mode"),
        F.max(F.coalesce(F.col("ndcg") < F.col("base_ndcg") - ndcg_loss, F.lit(False))).alias("ndcg_loss_exceeds_limit"),
        F.max(worse("recall")).alias("recall_regression"),
    )
    keys = ["case_id", "key", "loss"]
    new = findings.join(findings.filter(F.col("candidate") == baseline).select(keys).distinct(), keys, "left_anti").select("candidate").distinct().withColumn("new_loss_finding", F.lit(True))
    found = found.join(new, "candidate", "left")
    if latency is not None:
        was = latency.filter(F.col("candidate") == baseline).select(F.col("p95").alias("was"))
        gain = latency.join(F.broadcast(was)).select("candidate", (((F.col("was") - F.col("p95")) / F.col("was") * 100) < faster).alias("p95_improvement_below_limit"))  # was is one row
        found = found.join(gain, "candidate", "left").withColumn("p95_improvement_below_limit", F.coalesce("p95_improvement_below_limit", F.lit(True)))
    if recovers is not None:
        lost = recovers.select("candidate", (~F.col("recovered")).alias("confirmed_loss_not_recovered"))
        found = found.join(lost, "candidate", "left").withColumn("confirmed_loss_not_recovered", F.coalesce("confirmed_loss_not_recovered", F.lit(True)))
    told = [F.when(F.col(r) & (F.col("candidate") != baseline), r) for r in REASONS if r in found.columns]
    reasons = F.array_join(F.array_compact(F.array(*told)), ",")
    return found.select("candidate", reasons.alias("reasons")).withColumn("passed", F.col("reasons") == "")


def recovered(ranking: DataFrame, hard: DataFrame) -> DataFrame:
    """Candidates that bring every active hard negative into its case's first k: ``ranking(candidate, case_id, mode, key, rank, k)``."""
    wanted = hard.filter("state = 'active'").select("case_id", "mode", "key")
    got = ranking.filter("rank <= k").join(wanted, ["case_id", "mode", "key"]).groupBy("candidate").agg(F.count_distinct("case_id", "mode", "key").alias("got"))
    total = wanted.agg(F.count("*").alias("total"))
    every = ranking.select("candidate").distinct().join(got, "candidate", "left").join(F.broadcast(total))  # one row
    return every.select("candidate", (F.coalesce("got", F.lit(0)) == F.col("total")).alias("recovered"))
