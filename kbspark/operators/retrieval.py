"""Search operators: seeds, top-k, fusion and evaluation. Every order is total, so results do not depend on the plan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import term_score
from ..functions.vectors import cosine
from ..sources.versioned import staged

#: The smoothing constant of reciprocal-rank fusion and the least candidate pool.
RRF_K, POOL = 60, 32


def semantic_scores(vectors: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` with the cosine to the one vector of ``query``, which is a single row."""
    one = query.select(F.col(vector).alias("_query")).limit(1)
    return vectors.crossJoin(F.broadcast(one)).withColumn("score", cosine(F.col(vector), F.col("_query"))).drop("_query")


def threshold_top_k(scored: DataFrame, threshold: float, k: int, keys: Sequence[str], *, round_first: bool = False) -> DataFrame:
    """The k best rows at or over a threshold, scores rounded to 4 places before it (seeds) or after it (plain search)."""
    if round_first:
        scored = scored.withColumn("score", F.round("score", 4))
    kept = scored.filter(F.col("score") >= threshold).withColumn("score", F.round("score", 4))
    return kept.orderBy(F.desc("score"), *keys).limit(k)


def lexical_scores(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """``docs`` with the number of term occurrences as ``score``."""
    return docs.withColumn("score", term_score(F.col(text), terms))


def ranked(signal: DataFrame, name: str, order: Sequence[Column | str], key: str, weight: float = 1.0, k: int = POOL) -> DataFrame:
    """The first ``k`` rows of a signal with their ranks: (signal, weight, key, rank)."""
    top = signal.orderBy(*order).limit(k)  # bounded, so one task may rank it
    return top.select(F.lit(name).alias("signal"), F.lit(weight).alias("weight"), F.col(key).alias("key"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(signals: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Weighted reciprocal-rank fusion; a repeated key counts at its first rank in each signal."""
    first = signals.groupBy(*by, "signal", "key").agg(F.min("rank").alias("rank"), F.max("weight").alias("weight"))
    parts = F.array_sort(F.collect_list(F.struct("signal", (F.col("weight") / (RRF_K + F.col("rank"))).alias("part"))))
    fused = first.groupBy(*by, "key").agg(parts.alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"])
    fused = fused.select(*by, "key", F.round(score, 9).alias("score"), F.array_join(F.transform("parts", lambda x: x["signal"]), ",").alias("signals"))
    if by:
        best = Window.partitionBy(*by).orderBy(F.desc("score"), "key")
        return fused.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return fused.orderBy(F.desc("score"), "key").limit(k)


def cap_per_group(hits: DataFrame, group: Sequence[str], order: Sequence[Column | str], cap: int) -> DataFrame:
    """At most ``cap`` hits of each group, the first ones in order."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= cap)


def metrics_at_k(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recall, MRR and nDCG of each case: ``hits(case_id, key, rank)`` against ``relevant(case_id, key, grade)``.

    A repeated hit counts at its first rank only; cases without relevant keys score 0.
    """
    first = hits.groupBy("case_id", "key").agg(F.min("rank").alias("rank")).filter(F.col("rank") <= k)
    graded = relevant.filter("grade > 0")
    found = first.join(graded, ["case_id", "key"])
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    got = found.groupBy("case_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "key"))
    # the limit stands right above the ranking, so tasks keep k rows of a case; all of them are counted apart
    best = graded.withColumn("place", place).filter(F.col("place") <= k).groupBy("case_id").agg(F.sum(gain / F.log2(F.col("place") + 1)).alias("best"))
    ideal = graded.groupBy("case_id").agg(F.count("*").alias("all")).join(best, "case_id", "left")
    cases = hits.select("case_id").union(relevant.select("case_id")).distinct()
    out = cases.join(ideal, "case_id", "left").join(got, "case_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return out.select("case_id", zero(F.col("n") / F.col("all")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("best")).alias("ndcg"))


#: Sections that one call of ``related`` may ask for, as each is compared with all records; the rows and targets of a block.
MAX_TARGETS, BLOCK_ROWS, BLOCK_TARGETS = 1_000_000, 4096, 1024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(float)
    return flat.reshape(len(column), -1)


def _rounded_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of both, 0 for zero vectors, rounded to four digits; near a border summed in the components' order."""
    dot, norm = a @ b.T, np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
    z = 1e4 * np.divide(dot, norm, out=np.zeros_like(dot), where=norm != 0)
    for i, j in np.argwhere(np.abs(np.abs(z - np.trunc(z)) - 0.5) < 1e-8):
        x, y = a[i], b[j]
        in_order = [np.cumsum(v)[-1] for v in (x * y, x * x, y * y)]
        z[i, j] = 1e4 * (in_order[0] / (np.sqrt(in_order[1]) * np.sqrt(in_order[2])))
    return np.trunc(z + np.copysign(0.5, z)) / 1e4


def _nearest(others: DataFrame, own: DataFrame, k: int, n_targets: int) -> DataFrame:
    """Each target's k nearest sections ``(target, section, score)`` of every block of rows, and a few more in all.

    Rows and targets are dealt into blocks by hash, a section's rows into one; every block of rows meets every block of
    targets in a task that holds just these two, so neither all targets nor all scores are anywhere at once.
    """
    finite = lambda c: F.forall(c, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows_ = others.filter(finite("embedding")).select("section", F.col("embedding").cast("array<double>").alias("vector"))
    targets = own.filter(F.col("wanted").isNotNull() & finite("wanted")).select("target", F.col("wanted").cast("array<double>").alias("vector"))
    n, m = (-(-max(count, 1) // size) for count, size in ((others.count(), BLOCK_ROWS), (n_targets, BLOCK_TARGETS)))
    dealt = lambda df, key, own_, other, size, other_size: df.select("*", F.size("vector").alias("dim"), F.pmod(F.xxhash64(key), F.lit(size)).alias(own_), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_size - 1).cast("long"))).alias(other))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("section")
            names, starts = np.unique(np.array(left["section"].to_pylist(), dtype=object), return_index=True)
            scores = _rounded_cosines(_matrix(left["vector"]), _matrix(right["vector"]))
            best = np.maximum.reduceat(scores, starts, axis=0).T.copy()  # sections in the order of their names
            place = {name: i for i, name in enumerate(names)}
            for target, row in zip(right["target"].to_pylist(), best, strict=True):
                if target in place:
                    row[place[target]] = -np.inf
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                found = np.flatnonzero(row >= least)
                found = found[np.argsort(-row[found], kind="stable")][:k]
                out += [(target, names[i], float(row[i])) for i in found if row[i] > -np.inf]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["target", "section", "score"])

    keys = ["dim", "row_block", "target_block"]
    left = dealt(rows_, "section", "row_block", "target_block", n, m).filter("dim > 0").groupBy(*keys)
    return left.cogroup(dealt(targets, "target", "target_block", "row_block", m, n).groupBy(*keys)).applyInArrow(meet, "target string, section string, score double")


def related(records: DataFrame, targets: DataFrame, links: DataFrame, k: int, depth: int) -> DataFrame:
    """What is related to each of ``targets(section)``: ``(target, source, item, score, place)``.

    ``records(section, page, kind, embedding)`` may hold several vectors of a section, of which the best counts; summaries
    (any other ``kind`` than ``section``) are no neighbours, nor are vectors that are empty, of another length or hold null
    or non-finite components. Sections come by cosine, rounded to four digits, then by name. A target that has no vector
    neighbour gets the pages within ``depth`` links of its page instead, the nearest first. Targets without a record have
    nothing. At most ``MAX_TARGETS`` targets, which is checked, are compared with all records.
    """
    asked = targets.select(F.col("section").alias("target")).distinct()
    n_targets = asked.limit(MAX_TARGETS + 1).count()
    if n_targets > MAX_TARGETS:
        raise ValueError(f"over {MAX_TARGETS} targets")
    own = staged(records.join(asked, records["section"] == asked["target"]).groupBy("target").agg(F.min(F.struct("page", F.col("embedding"))).alias("r")).select("target", F.col("r.page").alias("home"), F.col("r.embedding").alias("wanted")))
    others = records.filter("kind = 'section' and section is not null and embedding is not null").select("section", "embedding")
    order = Window.partitionBy("target").orderBy(F.desc("score"), "section")
    near = _nearest(others, own, k, n_targets).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    near = staged(near.select("target", F.lit("vector").alias("source"), F.col("section").alias("item"), "score", "place"))

    left = own.join(near.select("target").distinct(), "target", "left_anti").select("target", F.col("home").alias("item"))
    level, reached = left, None
    for step in range(1, depth + 1):
        next_ = level.join(links.select(F.col("source").alias("item"), F.col("target").alias("_to")), "item").select("target", F.col("_to").alias("item")).distinct()
        if reached is not None:
            next_ = next_.join(reached.select("target", "item"), ["target", "item"], "left_anti")
        level = staged(next_.withColumn("step", F.lit(step)))
        reached = level if reached is None else reached.unionByName(level)
        level = level.select("target", "item")
    if reached is None:
        return near
    walk = Window.partitionBy("target").orderBy("step", "item")
    return near.unionByName(reached.select("target", F.lit("graph").alias("source"), "item", F.lit(None).cast("double").alias("score"), F.row_number().over(walk).alias("place")))
