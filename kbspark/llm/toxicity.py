"""Toxicity scores from the nearest labelled examples.

Examples and documents are TF-IDF vectors over words, and over the word starts that tell the classes apart. A feature's
weight is its inverse document frequency times a base weight, raised by how surely and how strongly the labels say that
it goes with one class (supervised term weighting). The nearest examples by exact cosine come from a block-max inverted
index: for each feature, each block of examples has its largest weight, so a document visits blocks in the order of their
best possible cosine and stops when no unvisited block can enter its k nearest. The neighbours' distance-weighted vote,
calibrated on the examples themselves (each left out of its own vote), is the score; the nearest examples come along as
evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, materialise, slices
from .language_id import id_bucket

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word starts that are features besides whole words.
STARTS = range(3, 9)


def word_features(word: str) -> list[str]:
    """A word and its starts; a start ends in ``*``."""
    return [word] + [word[:k] + "*" for k in STARTS if len(word) > k]


class Model(NamedTuple):
    """All that scoring needs; its size is bounded by ``max_examples``."""

    weight_of: np.ndarray  # of each feature: inverse document frequency times supervised weight
    ids: list
    toxic: np.ndarray
    weight: np.ndarray  # of each example: how many labelled documents it stands for
    entries: np.ndarray  # where each feature's entries start; an entry is a feature in a block
    block_of: np.ndarray  # of each entry
    largest: np.ndarray  # of each entry: its largest weight
    starts: np.ndarray  # where each entry's postings start
    postings: np.ndarray  # example numbers
    values: np.ndarray
    blocks: int
    k: int
    base: float
    steps: np.ndarray  # calibration: ends of the votes' pools, and their scores
    scores: np.ndarray


def _vector(which: np.ndarray, times: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
    w = (1 + np.log(times)) * weight_of[which]
    return w / np.linalg.norm(w)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0], ..., high[0] - 1, low[1], ..."""
    n = high - low
    return np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())


def nearest(model: Model, which: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k examples with the largest cosine over 0 (ties: smaller example number), exactly.

    Blocks are visited by their bounds; where very many are left that the bounds cannot rule out, all are read at once.
    """
    low, high = model.entries[which], model.entries[which + 1]
    entry, each = _ranges(low, high), np.repeat(w, high - low)
    block = model.block_of[entry]
    upper = np.bincount(block, model.largest[entry] * each, minlength=model.blocks)
    order = np.argsort(-upper, kind="stable")
    order = order[upper[order] > 0]
    best, sims, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
    while at < len(order) and not (len(sims) == k and upper[order[at]] < sims[-1] - 1e-9):
        left = order[at:] if len(sims) < k else order[at:][upper[order[at:]] >= sims[-1] - 1e-9]
        if at and len(left) > model.blocks // 3:
            first, last = model.starts[low], model.starts[high]
            factor = np.repeat(w, last - first)
            best, sims, at = best[:0], sims[:0], len(order)
        else:
            chosen = np.zeros(model.blocks, bool)
            chosen[order[at : at + step]] = True  # the next best blocks, more at a time the longer it takes
            place = np.flatnonzero(chosen[block])
            first, last = model.starts[entry[place]], model.starts[entry[place] + 1]
            factor = np.repeat(each[place], last - first)
            at, step = at + step, 2 * step
        found = _ranges(first, last)
        total = np.bincount(model.postings[found], model.values[found] * factor)
        hit = np.flatnonzero(total)
        if len(hit) > k:
            hit = hit[total[hit] >= np.partition(total[hit], -k)[-k] - 1e-11]
        best, sims = np.r_[best, hit], np.r_[sims, total[hit].round(12)]
        top = np.lexsort((best, -sims))[:k]
        best, sims = best[top], sims[top]
    return best, sims


def vote(model: Model, found: np.ndarray, sims: np.ndarray) -> float:
    """The weighted share of toxic neighbours; closer ones count more, and few or far ones fall back to the base rate."""
    w = sims**4 * model.weight[found]
    prior = 0.05
    return float((w @ model.toxic[found] + prior * model.base) / (w.sum() + prior))


def _calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: the lowest and highest vote of each pool, and its share."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, t, w in zip(votes[order], y[order], weight[order], strict=True):
        pools.append([v, v, t * w, w])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            _, high, s, w2 = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + s, pools[-1][3] + w2]
    return np.array([x for p in pools for x in p[:2]]), np.repeat([p[2] / p[3] for p in pools], 2)


def informative(toxic: Column, clean: Column, all_toxic: Column, all_clean: Column, sure: float) -> Column:
    """How strongly a feature goes with one class: the log of the ratio of its shares, shrunk by its significance.

    With a log-likelihood ratio statistic of ``sure`` or less it is 0; beyond, it tends to the whole log ratio.
    """
    p, q = (toxic + 0.5) / (all_toxic + 1), (clean + 0.5) / (all_clean + 1)
    both = (toxic + clean) / (all_toxic + all_clean)
    part = lambda n, whole: F.when(n > 0, n * F.log(n / (whole * both))).otherwise(0.0)
    rest = lambda n, whole: F.when(n < whole, (whole - n) * F.log((whole - n) / (whole * (1 - both)))).otherwise(0.0)
    statistic = 2 * (part(toxic, all_toxic) + part(clean, all_clean) + rest(toxic, all_toxic) + rest(clean, all_clean))
    return F.when(statistic > sure, F.abs(F.log(p / q)) * (1 - sure / statistic)).otherwise(0.0)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = 2000,
    k: int = 15,
    base_weight: float = 0.05,
    sure: float = 20.0,
    max_share: float = 0.1,
    evidence: int = 3,
) -> DataFrame:
    """A calibrated toxicity score for every whole text, and its nearest labelled examples.

    ``learn`` (a condition on the id) says which labels may be learnt from. Examples are at most about ``max_examples``
    documents per class, chosen by a hash of the id and weighted back to the class's share; that bound is a parameter.
    The cosine is over all words that two examples or more have, but for stop words that over ``max_share`` of the
    examples have and that go with neither class, and over the word starts that go with one class. A feature weighs
    (1 + log of its count) * inverse document frequency * (``base_weight`` + ``informative``). Document frequencies cover
    all documents. A null or empty text, or one without any feature, scores the share of toxic ones among such examples
    (without those, of all). Rows with null labels teach nothing; an id with several labels is toxic if one is. Without
    examples of both classes every score is the share of toxic examples (0 without any). One row per input row:
    ``score``, ``predicted`` (1 from 0.5 on), ``evidence``, and ``text_hash``, the text's xxhash64. Repeated and null ids
    stay; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    taught = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) if learn is None else labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    taught = taught.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, max_examples / c) for t, c in n.items()}
    rate = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    chosen = taught.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_003)) < rate * 1_000_003)

    # Both sides of this join are read once; the examples' side is bounded by max_examples. Rows that repeat an id and a
    # text are one example.
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    examples = source.join(F.broadcast(chosen), "id").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda chunk: tuple(f for w in WORD.findall(chunk) for f in word_features(w)), size=lambda fs: 80 * len(fs))
        found, toxic = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = list(found)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found.values(), pa.int64()), pa.array([toxic[f] for f in names], pa.int64())], ["feature", "docs", "toxic"])
            found.clear(), toxic.clear()
            return out

        for b in slices(batches, 64):
            for text, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = set()
                for chunk in set((text or "").lower().split()):
                    own.update(memo[chunk])
                own.add("")  # counts the documents
                found.update(own)
                if t:
                    toxic.update(own)
            if len(found) > 400_000:
                yield flush()
        yield flush()

    counts = materialise(examples.mapInArrow(spread, "feature string, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")))
    whole = counts.filter("feature = ''").first()
    all_toxic = float(whole["toxic"]) if whole else 0.0
    all_clean = float(whole["docs"] - whole["toxic"]) if whole else 0.0
    both = all_toxic > 0 and all_clean > 0
    telling = informative(F.col("toxic"), F.col("docs") - F.col("toxic"), F.lit(all_toxic), F.lit(all_clean), sure)
    known = counts.filter("feature <> '' and docs > 1").select("feature", "docs", telling.alias("telling"))
    word = ~F.endswith("feature", F.lit("*")) & (F.col("docs") <= max_share * (all_toxic + all_clean))
    known = known.filter((F.col("telling") > 0) | word).select("feature", "telling").toPandas() if both else None  # bounded by the examples
    order = np.lexsort((known["feature"].to_numpy(str), -known["telling"].to_numpy())) if both and len(known) else []
    features = {known["feature"][i]: n for n, i in enumerate(order)}  # the most telling ones first
    strength = base_weight + np.array([known["telling"][i] for i in order])
    table = spark.sparkContext.broadcast(features)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        heads = {f[: STARTS[0]] for f in known if f.endswith("*")}  # no start that is a feature has another beginning

        def hits(chunk: str) -> tuple[int, ...]:
            words = WORD.findall(chunk)
            found = [known[w] for w in words if w in known]
            return tuple(found + [known[f] for w in words if w[: STARTS[0]] in heads for f in word_features(w)[1:] if f in known])

        memo = Memo(hits, size=lambda fs: 40 * len(fs))
        for b in slices(batches):
            which, times, sizes = [], [], []
            for text in b.column(1).to_pylist():
                found = list(chain.from_iterable(map(memo.__getitem__, (text or "").lower().split())))
                own, n = np.unique(np.array(found, np.int32), return_counts=True)
                which.append(own), times.append(n.astype(np.int32)), sizes.append(len(own))
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (which, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, b.column(2)], ["id", "which", "times", "text_hash"])

    vectors = materialise(source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sparse, f"id {kind}, which array<int>, times array<int>, text_hash long"))
    n_docs = vectors.count()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(table.value), np.int64)
        for b in batches:
            sums += np.bincount(b.column(0).flatten().to_numpy(), minlength=len(sums))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["f", "n"])

    frequency = np.zeros(len(features))
    if features:
        got = vectors.select("which").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # a row for each feature
        frequency[got["f"].to_numpy(int)] = got["n"].to_numpy(float)
    weight_of = (np.log((n_docs + 1) / (frequency + 1)) + 1e-3) * strength
    model = build_index(vectors.join(F.broadcast(chosen), "id").dropDuplicates(["id", "text_hash"]).collect() if both else [], weight_of, share, k, all_toxic / max(1.0, all_toxic + all_clean))
    shipped = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        memo: dict[bytes, tuple[float, list]] = {}
        for b in slices(batches):
            scores, shown = [], []
            edge = b.column(1).offsets.to_numpy()
            which, times = b.column(1).values.to_numpy(), b.column(2).values.to_numpy()
            for low, high in zip(edge[:-1], edge[1:], strict=True):
                if low == high or not len(model.toxic):
                    s, e = model.base, []
                else:
                    own, n = which[low:high], times[low:high]
                    key = xxhash.xxh3_128_digest(own.tobytes() + n.tobytes())
                    if key not in memo:  # copies are searched for once
                        if len(memo) >= 50_000:
                            memo.clear()
                        near, sims = nearest(model, own, _vector(own, n, model.weight_of), model.k)
                        memo[key] = calibrated(model, vote(model, near, sims)), [(model.ids[i], float(c), int(model.toxic[i])) for i, c in zip(near[:evidence], sims, strict=False)]
                    s, e = memo[key]
                scores.append(min(1.0, max(0.0, s)))
                shown.append([{"id": str(i), "cosine": c, "toxic": t} for i, c, t in e])
            kinds = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(shown, kinds), b.column(3)], ["id", "score", "evidence", "text_hash"])

    out = vectors.mapInArrow(score, f"id {kind}, score double, evidence array<struct<id:string,cosine:double,toxic:int>>, text_hash long")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "text_hash")


def calibrated(model: Model, share: float) -> float:
    """The score of a vote, linear between the calibration's pools."""
    return float(np.interp(share, model.steps, model.scores)) if len(model.scores) else share


def build_index(rows: list, weight_of: np.ndarray, share: dict[int, float], k: int, base: float, block: int = 128) -> Model:
    """The block-max index over the examples; like examples lie in the same blocks."""
    rows = sorted(rows, key=lambda r: (r["which"][:8], r["times"][:8], str(r["id"])))
    weight = np.array([1 / share[r["toxic"]] for r in rows])
    toxic = np.array([r["toxic"] for r in rows], float)
    bare = np.array([not r["which"] for r in rows], bool)
    if bare.any():  # what a document without any feature scores
        base = float(toxic[bare] @ weight[bare] / weight[bare].sum())
    rows, weight, toxic = [r for r, b in zip(rows, bare, strict=True) if not b], weight[~bare], toxic[~bare]
    which = [np.array(r["which"], np.int64) for r in rows]
    vectors = [_vector(w, np.array(r["times"]), weight_of) for w, r in zip(which, rows, strict=True)]
    owner = np.repeat(np.arange(len(rows)), [len(w) for w in which]) if rows else np.zeros(0, np.int64)
    feature = np.concatenate(which) if rows else np.zeros(0, np.int64)
    values = np.concatenate(vectors) if rows else np.zeros(0)
    blocks = max(1, -(-len(rows) // block))
    order = np.lexsort((owner, feature))
    feature, owner, values = feature[order], owner[order], values[order]
    cell = feature * blocks + owner // block
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    largest = np.maximum.reduceat(values, starts) if len(cell) else values
    entries = np.searchsorted(feature[starts], np.arange(len(weight_of) + 1))
    model = Model(weight_of, [r["id"] for r in rows], toxic, weight, entries, cell[starts] % blocks, largest, np.append(starts, len(cell)), owner, values, blocks, k, base, np.zeros(0), np.zeros(0))
    votes = np.zeros(len(rows))
    for i, (w, v) in enumerate(zip(which, vectors, strict=True)):
        near, sims = nearest(model, w, v, k + 1)
        other = near != i
        votes[i] = vote(model, near[other][:k], sims[other][:k])
    steps, scores = _calibrate(votes, toxic, weight) if rows else (np.zeros(0), np.zeros(0))
    return model._replace(steps=steps, scores=scores)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """Score every document, learning from labels outside the held-out fold (crc32(id as text) mod ``folds``)."""
    out = score_toxicity(docs, labels, learn=id_bucket(id_col, folds) != held_out, id_col=id_col, **options)
    return out.withColumn("held_out", id_bucket(id_col, folds) == held_out).select(id_col, "held_out", "score", "predicted", "evidence")
