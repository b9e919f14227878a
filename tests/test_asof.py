"""As-of joins against brute force, with one key over many ranges, ties and nulls; states of pages worked out by hand."""

import random

import pytest

from kbspark.operators import asof


@pytest.mark.parametrize("wide", [False, True])
def test_the_last_row_up_to_then(spark, wide):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(i, key(), rng.choice([rng.randrange(2000), rng.randrange(2000), None]), "clash") for i in range(1500)]
    right = [(key(), rng.choice([rng.randrange(2000), rng.randrange(2000), None]), rng.randrange(50)) for _ in range(300 if wide else 20)]
    if wide:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof.as_of_join(spark.createDataFrame(left, "i long, k string, at long, _x string").repartition(5), spark.createDataFrame(right, "k string, ts long, v long"), "k", "at", "ts").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(left) and got[0].__fields__ == ["i", "k", "at", "_x", "ts", "v"]
    for r in got:
        seen = [(ts, v) for k, ts, v in right if k is not None and ts is not None and r["k"] == k and r["at"] is not None and ts <= r["at"]]
        assert (r["ts"], r["v"]) == max(seen, default=(None, None))


def test_no_rows(spark):
    left, right = spark.createDataFrame([(1, "a", 5)], "i long, k string, at long"), spark.createDataFrame([], "k string, ts long")
    assert [tuple(r) for r in asof.as_of_join(left, right, "k", "at", "ts").collect()] == [(1, "a", 5, None)]
    assert asof.as_of_join(left.limit(0), right, "k", "at", "ts").count() == 0


def test_states(spark):
    log = [("p", 10, "ingest", "s", "h1"), ("p", 12, "ingest", None, "h9"), ("p", 30, "delete", None, None), ("p", 40, "ingest", "t", None), ("q", 5, "ingest", "lost", "h1")]
    sources = [("s", 1, "h1", False), ("s", 20, "h2", False), ("s", 25, "h1", False), ("t", 35, "x", False), ("t", 50, "y", False), ("t", 60, None, True)]
    asks = [("p", at) for at in (5, 10, 15, 20, 26, 30, 39, 40, 50, 60, 99)] + [("q", 9), ("none", 9), (None, 9), ("p", None)]
    got = asof.page_states(spark.createDataFrame(asks, "page string, at long"), spark.createDataFrame(log, "page string, ts long, op string, source string, src_hash string"), spark.createDataFrame(sources, "source string, changed long, hash string, gone boolean"))
    told = {(r["page"], r["at"]): r["state"] for r in got.collect()}
    assert [told["p", at] for at in (5, 10, 15, 20, 26, 30, 39, 40, 50, 60, 99)] == ["no_record", "fresh", "fresh", "stale", "fresh", "no_record", "no_record", "fresh", "stale", "missing_source", "missing_source"]
    assert told["q", 9] == "missing_source" and told["none", 9] == told[None, 9] == told["p", None] == "no_record"
