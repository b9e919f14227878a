"""Versions of tables: commits, untouched buckets, readers, corruption, imports, hash trees, links kept up to date."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kbspark.operators.linkgraph import refresh_domains, refresh_links
from kbspark.sources.snapshots import Conflict, Snapshots, differing_rows, hash_tree, slot, tree_differences
from kbspark.streaming import log


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v long")


def filled(spark, path, n=60):
    store = Snapshots(spark, str(path), buckets=8)
    first = store.manifest()
    store.commit(first, {"t": store.replaced(first, "t", "k", table(spark, [(f"k{i}", i) for i in range(n)] + [(None, 1)]))})
    return store


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = filled(spark, tmp_path)
    old = store.manifest()
    changes = table(spark, [("k3", 100), ("new", 1), ("new", 2)])
    new = store.commit(old, {"t": store.replaced(old, "t", "k", changes, table(spark, [("k4", 0), (None, 0), ("unknown", 0)]))})
    touched = {r[0] for r in table(spark, [(k, 0) for k in ("k3", "new", "k4", "unknown")]).select(slot(F.col("k"), 8)).collect()}
    assert {int(b) for b in old["tables"]["t"]["folders"] if old["tables"]["t"]["folders"][b] != new["tables"]["t"]["folders"].get(b)} <= touched < set(range(8))
    want = {f"k{i}": i for i in range(60)} | {"k3": 100}
    del want["k4"]
    assert rows(store.read(new, "t")) == sorted([*want.items(), ("new", 1), ("new", 2)], key=str)
    # a reader of the version before still sees it whole
    assert rows(store.read(store.manifest(1), "t")) == sorted(((f"k{i}", i) for i in range(60)), key=str)
    assert store.read(new, "none") is None and store.replaced(new, "t", "k", changes.limit(0)) == new["tables"]["t"]


def test_slots_are_first_digits_modulo_any_number(spark):
    keys = table(spark, [(f"k{i}", i) for i in range(40)])
    for n in (1, 8, 12, 16, 100, 256, 4096):
        want = [int(hashlib.md5(f"k{i}".encode()).hexdigest()[:8], 16) % n for i in range(40)]
        assert [r[0] for r in keys.orderBy("v").select(slot(F.col("k"), n)).collect()] == want, n


def test_one_of_two_writers_commits(spark, tmp_path):
    store = filled(spark, tmp_path)
    base = store.manifest()
    one, two = (store.replaced(base, "t", "k", table(spark, [("k1", v)])) for v in (7, 8))
    store.commit(base, {"t": one})
    with pytest.raises(Conflict):
        store.commit(base, {"t": two})
    assert store.version() == 2 and ("k1", 7) in rows(store.read(store.manifest(), "t"))


def test_corrupt_buckets_are_found_and_put_aside(spark, tmp_path):
    store = filled(spark, tmp_path)
    base = store.manifest()
    store.commit(base, {"t": store.replaced(base, "t", "k", table(spark, [("k5", 55)]))})
    sealed = store.commit(store.manifest(), store.sealed(store.manifest()))
    assert store.verify(sealed) == {}
    new_bucket = spark.createDataFrame([("k5",)], "k string").select(slot(F.col("k"), 8)).first()[0]
    folders = sealed["tables"]["t"]["folders"]
    other = next(int(b) for b in folders if int(b) != new_bucket)
    for b, text in ((new_bucket, b"not parquet"), (other, b"")):  # broken in one bucket, cut off in the other
        for f in Path(tmp_path, "data", folders[str(b)], f"_bucket={b}").glob("*"):
            f.write_bytes(text) if f.suffix == ".parquet" else f.unlink()
        for f in Path(tmp_path, "data", folders[str(b)], f"_bucket={b}").glob(".*crc"):
            f.unlink()
    bad = store.verify(sealed)
    assert bad == {"t": sorted([new_bucket, other])}
    fixed = store.quarantine(sealed, bad)
    assert fixed["note"]["lost"] == {"t": [other]} and set(fixed["note"]["quarantined"]["t"]) == {str(new_bucket), str(other)}
    left = dict(rows(store.read(fixed, "t")))
    assert left["k5"] == 5 and len(left) == 60 - sum(1 for i in range(60) if spark.createDataFrame([(f"k{i}",)], "k string").select(slot(F.col("k"), 8)).first()[0] == other)


def test_imports_are_made_once(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), buckets=4)
    broken = table(spark, [("a", 1)]).withColumn("v", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        store.import_once("f", {"good": ("k", table(spark, [("a", 1)])), "bad": ("k", broken)})
    assert store.manifest()["version"] == 0  # nothing is seen of a load that failed
    load = {"good": ("k", table(spark, [("a", 1), ("b", 2)]))}
    assert store.import_once("f", load) == {"good": 2, "already_imported": False}
    assert store.import_once("f", load) == {"good": 2, "already_imported": True} and store.version() == 1
    with pytest.raises(ValueError):
        store.import_once("g", load)


def test_trees_find_what_differs(spark):
    rng = random.Random(3)
    was = {f"k{i}": rng.randrange(5) for i in range(700)}
    now = {k: (v + 1 if rng.random() < 0.01 else v) for k, v in was.items() if rng.random() > 0.01} | {"more": 1}
    a, b = table(spark, list(was.items())), table(spark, list(now.items()))
    want = [(k, "removed" if k not in now else "added" if k not in was else "changed") for k in {*was, *now} if was.get(k) != now.get(k)]
    assert rows(differing_rows(a, b.repartition(5), "k")) == sorted(want, key=str) and len(want) > 5
    assert differing_rows(a, a, "k").count() == 0 and tree_differences(hash_tree(a, "k"), hash_tree(a, "k")).count() == 0
    assert rows(differing_rows(a.limit(0), table(spark, [(None, 1)]), "k")) == [(None, "added")]
    swapped = hash_tree(table(spark, [("x", 1), ("x", 2)]), "k"), hash_tree(table(spark, [("x", 2), ("x", 1)]), "k")
    assert tree_differences(*swapped).count() == 0  # the order of rows does not matter
    assert [r["n_rows"] for r in hash_tree(a, "k").filter("level = 0").collect()] == [700]


def test_links_follow_each_change(spark, tmp_path):
    rng = random.Random(9)
    store, state = Snapshots(spark, str(tmp_path), buckets=4), {}
    name = lambda: f"p{rng.randrange(25)}"
    for turn in range(4):
        pages = {name(): ([(name(), rng.choice(["", "x", "y"])) for _ in range(rng.randrange(4))], set(rng.sample("xyz", rng.randrange(3)))) for _ in range(14 if turn == 0 else 5)}
        gone = [name() for _ in range(turn)]
        links = [(p, t, a) for p, (own, _) in pages.items() for t, a in own] + [("not a changed page", "p1", "")]
        anchors = [(p, a) for p, (_, own) in pages.items() for a in own] + [("not a changed page", "x")]
        refresh_links(store, spark.createDataFrame([(p, str(turn)) for p in pages], "page string, hash string"), spark.createDataFrame(links, "source string, target string, anchor string"), spark.createDataFrame(anchors, "page string, anchor string"), spark.createDataFrame([(g,) for g in gone], "page string"))
        state = {p: v for p, v in state.items() if p not in gone} | pages
        want = {(t, p, a, "broken_page" if t not in state else "broken_anchor" if a and a not in state[t][1] else "ok") for p, (own, _) in state.items() for t, a in own}
        now = store.manifest()
        assert rows(store.read(now, "incoming")) == sorted(want, key=str)
        assert {r[0] for r in rows(store.read(now, "pages").select("page"))} == set(state)


def test_stream_rewrites_only_its_buckets_and_again_nothing(spark, tmp_path):
    schema, store = "k string, seq long, v string", Snapshots(spark, str(tmp_path / "store"), buckets=4)
    for part in ([("a", 1, "x"), ("b", 5, "y"), (None, 9, "n")], [("a", 2, "z"), ("b", 4, "old"), ("c", None, "n")], [("a", 2, "z")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log.last_wins_buckets(log.events_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema)), store, "t", "k", "seq", str(tmp_path / "ck")).awaitTermination()
    newest = store.manifest()
    assert rows(store.read(newest, "t")) == [("a", 2, "z"), ("b", 5, "y")] and newest["note"] == {"batch": 2}
    for f in (tmp_path / "ck" / "commits").glob("*2*"):  # as if the last batch had committed its rows, but not that it was done
        f.unlink()
    log.last_wins_buckets(log.events_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema)), store, "t", "k", "seq", str(tmp_path / "ck")).awaitTermination()
    assert store.version() == newest["version"]


def test_only_domains_that_are_not_current_are_parsed(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), buckets=4)
    day = lambda pages: spark.createDataFrame([(d, f, t) for (d, f), t in pages.items()], "domain string, file string, markdown string")
    pages = {("a", "x.md"): "[y](y.md) [z](z.md#top)", ("a", "y.md"): "# Top\n[x](x.md)", ("b", "x.md"): "[y](y.md)", ("b", "index.md"): "[x](x.md)", ("c", "w.md"): None}
    _, wrong = refresh_domains(store, day(pages))
    assert rows(wrong) == [("a", "new"), ("b", "new"), ("c", "new")]
    same, wrong = refresh_domains(store, day(pages).repartition(3))
    assert same["version"] == 1 and wrong.count() == 0  # nothing to do, nothing written
    pages |= {("a", "z.md"): "# Top", ("a", "x.md"): "[z](z.md#top)"}
    del pages["b", "x.md"], pages["b", "index.md"]
    now, wrong = refresh_domains(store, day(pages))
    assert rows(wrong) == [("a", "stale"), ("b", "gone")]
    assert rows(store.read(now, "incoming")) == [("a/x", "a/y", "", "ok"), ("a/z", "a/x", "top", "ok")]
    assert rows(store.read(now, "pages").select("page")) == [("a/x",), ("a/y",), ("a/z",), ("c/w",)]
    fresh = Snapshots(spark, str(tmp_path / "fresh"), buckets=2)
    whole, _ = refresh_domains(fresh, day(pages))
    for t in ("pages", "links", "anchors", "incoming", "domains"):
        assert rows(store.read(now, t)) == rows(fresh.read(whole, t)), t
