"""Small cases of the operators: ties, nulls, empty tables."""

import hashlib

from pyspark.sql import functions as F

from kbspark.functions.text import normalise_tag, query_terms, slugify, term_score, tokens
from kbspark.functions.vectors import cosine, dequantise, quantise, scale_of
from kbspark.operators import chunking, code, graph, logs, quality, retrieval


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()["x"]


def test_text(spark):
    assert query_terms("The a of refresh_token the") == ["the", "refresh_token", "the"]
    assert one(spark, "API: the /v1 endpoint!", "string", slugify) == "api-the-v1-endpoint"
    assert one(spark, "Data / Flow", "string", slugify) == "data--flow"
    assert one(spark, " Read_Me / now ", "string", normalise_tag) == "read-me-now"
    assert one(spark, "batch_Run pkg.B", "string", tokens) == ["b", "batch", "pkg", "run"]
    assert one(spark, "needle Needle x", "string", lambda c: term_score(c, ["needle"])) == 2
    assert one(spark, None, "string", lambda c: term_score(c, ["needle"])) == 0


def test_vectors(spark):
    v = [0.1, -0.5, 0.9, -1.0, 0.0]
    back = one(spark, v, "array<double>", lambda c: dequantise(quantise(c, scale_of(c)), scale_of(c)))
    assert all(abs(a - b) <= 1 / 127 for a, b in zip(v, back, strict=True))
    assert one(spark, [0.0, 0.0], "array<double>", scale_of) == 1.0
    assert one(spark, [0.0, 0.0], "array<double>", lambda c: cosine(c, c)) == 0.0


def test_fusion_orders_ties_by_key_and_counts_repeats_once(spark):
    signals = spark.createDataFrame([("semantic", 1.0, "a", 1), ("semantic", 1.0, "b", 2), ("lexical", 1.0, "b", 1), ("lexical", 1.0, "c", 2), ("lexical", 1.0, "b", 3)], "signal string, weight double, key string, rank int")
    got = retrieval.fuse(signals, 3).collect()
    assert [r["key"] for r in got] == ["b", "a", "c"] and got[0]["signals"] == "lexical,semantic"
    assert retrieval.fuse(signals.limit(0), 3).count() == 0


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "hybrid", 1), ("q", "config", 2), ("q", "surface", 3)], "case_id string, key string, rank int")
    relevant = spark.createDataFrame([("q", "surface", 3), ("q", "hybrid", 2)], "case_id string, key string, grade int")
    got = retrieval.metrics_at_k(hits, relevant, 3).first()
    assert got["mrr"] == 1.0 and abs(got["ndcg"] - 0.730929) < 1e-6
    assert retrieval.metrics_at_k(hits, relevant, 2).first()["recall"] == 0.5
    assert retrieval.metrics_at_k(hits, relevant.limit(0), 2).first()["ndcg"] == 0.0


def test_windows(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "x"), (3, None), (4, "")], "k int, text string")
    got = rows(chunking.word_windows(docs, ["k"], "text", 2, 0))
    assert got == [(1, 0, "one two"), (1, 1, "three four"), (1, 2, "five"), (2, 0, "x")]


def test_traversal(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "semantic", 1), ("b", "lexical", 1)], "node string, origin string, seed_rank int")
    assert rows(graph.capped_traversal(edges, seeds, 2, 10)) == [("a", 0, "semantic", 1), ("b", 0, "lexical", 1), ("c", 1, "lexical", 1)]
    star = spark.createDataFrame([("s", f"leaf{i:03}") for i in range(250)], "src string, dst string")
    seed = spark.createDataFrame([("s", "x", 1)], "node string, origin string, seed_rank int")
    got = [r[0] for r in rows(graph.capped_traversal(star, seed, 2, 11))]
    assert got == [f"leaf{i:03}" for i in range(10)] + ["s"]


def test_log(spark):
    log = spark.createDataFrame([("p", 1, "ingest"), ("p", 2, "delete"), ("q", 1, "delete"), ("q", 2, "ingest"), ("q", 3, "noise")], "page string, seq int, op string")
    assert rows(logs.latest_by_key(log, "page", "seq", "op", "delete", ["ingest", "delete"])) == [("q", "ingest", 2)]


def test_incremental_plan(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    old = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, h string")
    assert rows(chunking.incremental_plan(new, old, "k", "h")) == [(1, "reuse"), (2, "update"), (3, "insert"), (4, "delete")]


def test_drift_parity_and_gates(spark):
    tags = spark.createDataFrame([("auth",), ("auths",), ("authentication",), ("kitten",), ("mitten",), ("zzz",), (None,)], "tag string")
    assert rows(quality.tag_drift(tags)) == [("auth", "authentication"), ("auth", "auths"), ("kitten", "mitten")]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(quality.parity(a, b, ["k"])) == [(1, "missing"), (3, "extra")]
    gates = spark.createDataFrame([("m", "<", 1.0), ("gone", "<", 1.0)], "metric string, op string, bound double")
    assert rows(quality.evaluate_gates(spark.createDataFrame([("m", 0.5)], "metric string, value double"), gates).select("metric", "passed")) == [("gone", False), ("m", True)]


def test_revision_is_order_free(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "k int, v string")
    revision = lambda d: quality.set_revision(d, "k", F.col("v")).first()["revision"]
    assert revision(a) == revision(a.orderBy(F.desc("k"))) != revision(a.filter("k < 49"))


def test_revision_is_the_one_by_hand(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "k int, v string")
    revision = lambda d: quality.set_revision(d, "k", F.col("v")).first()["revision"]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = [digest(f"{i}:{digest(str(i))}") for i in range(50)]
    by_hand = lambda own: digest(":".join([str(len(own)), *[str(sum(int(h[15 * k : 15 * k + 15], 16) for h in own)) for k in range(4)]]))
    assert revision(a) == by_hand(lines) and revision(a.limit(0)) == by_hand([])
    grouped = quality.set_revision(a.withColumn("g", F.col("k") % 2), "k", F.col("v"), by=("g",))
    assert rows(grouped) == [(g, by_hand(lines[g::2]), 25) for g in (0, 1)]


def test_unresolved_and_ambiguous_references(spark):
    refs = spark.createDataFrame([(1, "m.f"), (2, "m.x"), (3, "n")], "ref_id int, target string")
    symbols = spark.createDataFrame([("m.f", "s1"), ("m.f", "s2")], "qualified_name string, entity_id string")
    got = rows(code.resolve_references(refs, symbols, spark.createDataFrame([("m",)], "module string")).na.fill("-"))
    assert got == [(1, "s1", "ambiguous"), (1, "s2", "ambiguous"), (2, "m", "partially_resolved"), (3, "-", "unresolved")]


def test_quantised_components_are_steps_of_the_scale_before_it_is_rounded(spark, tmp_path):
    from kbspark.plans import search

    scale, x = 0.0027754187114595427, 0.24562455713748932  # 88.5000004 steps, 88.4999998 of the scale with nine digits
    spark.createDataFrame([(1, [127 * scale, x])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in search.quantize_int8(spark, str(tmp_path)).collect()] == [(1, round(scale, 9), "127,89")]
