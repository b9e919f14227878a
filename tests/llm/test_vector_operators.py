"""The vector operators and the components against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kbspark.llm import embedding_dedup, graph, vector_search


def table(spark, n=240, dim=16):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((n, dim)) * 0.3
    v[40:80] = v[0] + rng.standard_normal((40, dim)) * 0.02
    v[80:90] = v[5]
    v[90] = v[5] * 3
    rows = [(i, [float(np.float32(x)) for x in v[i]], i % 2 if i < 40 or i > 90 else 0, "clash") for i in range(n)]
    bad = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] * dim, [math.inf] * dim]
    rows += [(1000 + i, b, 0, "clash") for i, b in enumerate(bad)] + [(2000, rows[5][1], None, "clash"), (2001, [1.0, 2.0], 0, "clash"), (3, rows[3][1], 1, "clash")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark):
    rows, df = table(spark)
    use = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v, *_ in rows if good(v)]
    want = []
    for a, (q, x) in enumerate(use):
        if q % 20 == 0:
            scores = sorted((-int(x @ y), i) for b, (i, y) in enumerate(use) if a != b and len(y) == len(x))[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    for options in ({}, {"block_rows": 30, "query_rows": 4, "bits": 3}):
        got = vector_search.top_k_inner_product(df, F.col("vec_id") % 20 == 0, **options).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert vector_search.top_k_inner_product(df.limit(0), F.lit(True)).count() == 0


def test_near_duplicates(spark):
    rows, df = table(spark)
    part, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, (_, v, la, _) in enumerate(rows):
        for b, (_, w, lb, _) in enumerate(rows[:a]):
            if la is None or la != lb or not good(v) or not good(w) or len(v) != len(w) or not any(v) or not any(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                part[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))
    for options in ({}, {"block_rows": 8}, {"block_rows": 16, "direct_rows": 10, "bucket_rows": 8}):
        assert sorted(map(tuple, embedding_dedup.near_duplicate_vectors(df, **options).collect())) == want
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    coder = embedding_dedup.Codes(64, 4)
    x = rng.standard_normal((300, 64))
    y = np.vstack([x[:150] + 0.1 * rng.standard_normal((150, 64)), rng.standard_normal((150, 64))])
    (_, _, parts, step), (code, factor, _, _) = coder.encode(x), coder.encode(y)
    true = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert (coder.upper(parts, step, code, factor, 6.0) >= true).all()
    estimate = coder.upper(parts, step, code, factor, 0.0) - np.outer(step * 4, (1 / factor).mean(1)) - 1e-4
    assert abs((estimate - true).mean()) < 2e-3 and np.std(estimate - true) < 0.06


def test_approximation_bounds_hold():
    rng = np.random.default_rng(7)
    v, q = rng.integers(-90, 90, (500, 12)), rng.integers(-90, 90, (40, 12))
    cells = vector_search.Cells(v.min(0), v.max(0), 4)
    middle, half = cells.bounds(q.astype(float), cells.encode(v))
    assert (np.abs(q @ v.T - middle) <= half[:, None]).all()
    i, j = vector_search.contenders(middle, half, np.full(40, -1), 20)
    kept = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert all((a, b) in kept for a in range(40) for b in np.argsort(-(q @ v.T)[a], kind="stable")[:20].tolist()) and len(kept) < 40 * 500


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 3)]
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(part))
