"""Catalog joins, page files, discovery, generated pages, records, verified links, lint and publication at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from kbspark.operators import catalog, code, lint, publication, retrieval
from kbspark.operators.ordering import ranked
from kbspark.sources.snapshots import Snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scopes(spark):
    asks = spark.createDataFrame([(1, "all", None), (2, None, None), (3, "bound", None), (4, "all", ["x", "x"]), (5, None, [])], "request int, scope string, named array<string>")
    domains, bound = spark.createDataFrame([("a",), ("b",)], "domain string"), spark.createDataFrame([(2, "b"), (2, "gone"), (1, "b"), (4, "b")], "request int, domain string")
    # named, as they are; all; bound; nothing bound: all; an empty list: none
    assert rows(catalog.scope(asks, domains, bound)) == [(1, "a"), (1, "b"), (2, "b"), (2, "gone"), (3, "a"), (3, "b"), (4, "x")]
    assert catalog.scope(asks.limit(0), domains, bound).count() == 0


def test_chunks_links_and_empty_domains(spark):
    pages = spark.createDataFrame([("p", "a"), ("q", "b"), ("r", None)], "page string, domain string")
    scope = spark.createDataFrame([("a",), ("empty",)], "domain string")
    chunks = spark.createDataFrame([("p", 0, "h", [1.0, 0.0]), ("p", 1, "h", [0.0, 0.0]), ("q", 0, "h", [1.0, 0.0]), ("gone", 0, "h", [1.0, 0.0])], "page string, ordinal int, heading string, embedding array<double>")
    got = catalog.scoped_chunks(chunks, pages, scope, spark.createDataFrame([([2.0, 0.0],)], "embedding array<double>"))
    assert rows(got) == [("a", "p", 0, "h", 1.0), ("a", "p", 1, "h", 0.0)]
    links = spark.createDataFrame([("p", "p"), ("p", "q"), ("q", "p"), ("p", "gone"), (None, "p")], "source string, target string")
    assert rows(catalog.scoped_links(links, pages, scope)) == [("a", "p", "a", "p")]
    assert rows(catalog.domain_pages(scope, pages)) == [("a", "p"), ("empty", None)]


def test_code_states(spark):
    domains = spark.createDataFrame([(x,) for x in "abcd"], "domain string")
    pointers = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "gone")], "domain string, snapshot string")
    snapshots = spark.createDataFrame([("a", "1", "r", "m", 1), ("b", "1", "r", "m", 1), ("b", "2", "r2", "m", 1)], "domain string, snapshot string, revision string, markdown_revision string, generation int")
    now = spark.createDataFrame([("a", "m", 1), ("b", "m", 2)], "domain string, current_revision string, current_generation int")
    assert rows(catalog.code_states(domains, pointers, snapshots, now)) == [("a", "ready", "r", False), ("b", "ready", "r", True), ("c", "missing_snapshot", None, False), ("d", "missing_snapshot", None, False)]


def test_pages_are_read_from_files(spark, tmp_path):
    for name, text in {"d1/a.md": "# A\n[b](sub/b.md) [i](index.md) [up](#a)", "d1/sub/b.md": "text", "d1/empty.md": "", "d1/index.md": "[a](a.md)", "d1/note.txt": "no", "d2/a b.md": "x\n", "d2/log.md": "x"}.items():
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text(text)
    pages = catalog.read_pages(spark, str(tmp_path / "w"))
    (tmp_path / "w" / "d2" / "bad.md").write_bytes(b"\xff\xfe")
    assert [r[:2] for r in rows(pages)] == [("d1", "a.md"), ("d1", "index.md"), ("d1", "sub/b.md"), ("d2", "a b.md"), ("d2", "log.md")]
    assert {r[:2]: r[2] for r in rows(catalog.read_pages(spark, str(tmp_path / "w")))}["d2", "bad.md"] is None
    own, anchors, edges = catalog.page_snapshot(pages)
    assert {r["page"] for r in own.collect()} >= {"d1/a", "d1/sub/b"} and own.filter("page like '%index' or page like '%log'").count() == 0
    assert rows(anchors) == [("d1/a", "a", "A")]
    assert rows(edges.select("source", "target", "anchor")) == [("d1/a", "d1/a", "a"), ("d1/a", "d1/sub/b", "")]
    hashes = {r["page"]: r["link_hash"] for r in own.collect()}
    assert hashes["d1/a"] != hashes["d1/sub/b"]
    listed = {r["path"]: r["length"] for r in catalog.list_files(spark, str(tmp_path / "w")).collect()}
    assert listed["d1/note.txt"] == 2 and len(listed) == 7


def test_sources_are_discovered(spark):
    names = ["b.py", "a.py", "x/.git/c.py", "build", "x/build/c.py", "build.py", "k/id_rsa", "secrets.py", "../up.py", "/abs.py", "big.py", "n.js", None, "a.py"]
    listing = spark.createDataFrame([(n, 999 if n == "big.py" else 5) for n in names], "path string, length long")
    assert rows(catalog.source_files(listing, ["py"], max_bytes=100, max_files=10)) == [("a.py", 5, 1), ("b.py", 5, 2), ("build.py", 5, 3)]
    assert rows(catalog.source_files(listing, ["py"], max_bytes=100, max_files=1, ignored=["a.*"])) == [("b.py", 5, 1)]
    assert catalog.source_files(listing.limit(0), ["py"], max_bytes=1, max_files=1).count() == 0


def test_generated_pages(spark):
    pages = spark.createDataFrame([("d", "b"), ("d", "a"), ("d", "a"), ("e", None)], "domain string, slug string")
    assert rows(catalog.index_pages(pages)) == [("d", "# Index\n\n- [a](a.md)\n- [b](b.md)\n")]
    log = spark.createDataFrame([("d", 2, "day", "ingest", None), ("d", 1, None, None, "p")], "domain string, seq int, date string, op string, page string")
    assert rows(catalog.log_pages(log)) == [("d", "# Log\n\n-   p\n- day ingest\n")]


def test_records_and_reuse(spark):
    schema = "page string, kind string, heading string, chunk int, body string, embedding array<float>"
    made = catalog.chunk_records(spark.createDataFrame([("p", "section", "h", 0, "x", [1.0, -2.0]), ("p", "summary", "h", 0, "x", [0.0, 0.0])], schema)).collect()
    assert json.loads(made[0]["slot"]) == {"kind": "section", "heading": "h", "chunk": 0} and made[0]["dim"] == 2 and made[0]["q"] == [64, -127] and made[1]["scale"] == 1.0
    one = spark.createDataFrame([("p", "a", "h", 2), ("p", "b", "h", 2), ("p", "c", "h", 2)], "page string, slot string, hash string, dim int")
    two = spark.createDataFrame([("p", "a", "h", 2), ("p", "b", "h", 3), ("p", "d", "h", 2)], "page string, slot string, hash string, dim int")
    assert rows(catalog.reused_records(one, two)) == [("p", "a", "keep"), ("p", "b", "replace"), ("p", "c", "remove"), ("p", "d", "add")]


def test_incoming_pages_are_believed_only_if_they_are_as_indexed(spark):
    edges = spark.createDataFrame([("s", "t", "x"), ("u", "t", ""), ("v", "w", ""), ("gone", "z", "")], "source string, target string, anchor string")
    indexed = spark.createDataFrame([("s", "1"), ("u", "1"), ("v", "1"), ("gone", "1")], "page string, content_hash string")
    pages = spark.createDataFrame([("s", "1"), ("u", "1"), ("v", "2")], "page string, content_hash string")
    asks = spark.createDataFrame([("t", None), ("t", "X"), ("t", "none"), ("w", None), ("z", None), ("nobody", None), ("t", None)], "target string, anchor string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(catalog.verified_incoming(asks, edges, indexed, pages))}
    assert got == {("t", None): ("ok", "s,u"), ("t", "X"): ("ok", "s"), ("t", "none"): ("ok", ""), ("w", None): ("stale", None), ("z", None): ("stale", None), ("nobody", None): ("ok", "")}


def test_result_order_and_quality(spark):
    found = spark.createDataFrame([("e1", "b", "path"), ("e2", "a", "path"), ("e3", "z", "qualified_exact"), ("e0", "a", "path")], "entity_id string, qualified_name string, match string")
    assert [r["entity_id"] for r in ranked(found, *catalog.result_order(found, code.RANKS)).orderBy("place").collect()] == ["e3", "e0", "e2", "e1"]
    told = lambda pairs: spark.createDataFrame(pairs, "what string, name string")
    got = catalog.quality(told([("f", "a"), ("f", "b"), ("f", "b"), ("only found", "x")]), told([("f", "a"), ("f", "c"), ("only wanted", "y")]), "what", ["name"])
    assert rows(got) == [("f", 2, 2, 1, 0.5, 0.5), ("only found", 0, 1, 0, 0.0, 1.0), ("only wanted", 1, 0, 0, 0.0, 0.0)]


def test_owners(spark):
    schema = "file_id string, entity_id string, start int, stop int"
    spans = [("f", "whole", 1, 99), ("f", "in", 5, 20), ("f", "twin", 5, 20), ("f", "leaf", 6, 7), ("f", "across", 15, 30), ("g", "leaf2", 6, 7), (None, "x", 1, 2), ("f", None, 1, 2)]
    got = dict(rows(code.declaration_owners(spark.createDataFrame(spans, schema))))
    assert got == {"whole": None, "in": "twin", "twin": "in", "leaf": "in", "across": "whole", "leaf2": None}
    assert code.declaration_owners(spark.createDataFrame([], schema)).count() == 0


def test_lint_findings(spark):
    pages = spark.createDataFrame([("a", "[b](b.md#h) [c](c.md) [x](wiki://far/q.md#z) [y](wiki://far/q.md) [h](wiki://hid/q.md) ![i](wiki://hid/p.md) `[n](gone.md)`"), ("b", "# H\n[self](#h) [i](sub/index.md)"), ("null", None)], "slug string, markdown string")
    visible = spark.createDataFrame([("d", "a", ""), ("d", "b", ""), ("d", "b", "h"), ("d", "null", ""), ("far", "q", "")], "domain string, page string, anchor string")
    states = spark.createDataFrame([("a", "stale"), ("b", "fresh"), ("null", "missing_source")], "page string, state string")
    got = {r for r in rows(lint.lint_findings(pages, "d", visible, states)) if r[0] not in ("section", "missing_front_matter")}
    assert got == {("broken", "a", "c"), ("broken", "a", "far/q#z"), ("unavailable_domain", "a", "hid/q"), ("reserved_target", "b", "sub/index"), ("orphan", "a", ""), ("orphan", "null", ""), ("stale", "a", ""), ("missing_source", "null", "")}


def test_lint_reads_links_once(spark):
    """Links are tables to the findings: of the passes over texts only that over the caller's anchors may be left."""
    pages = spark.createDataFrame([("a", "[b](b.md)")], "slug string, markdown string")
    visible = spark.createDataFrame([("d", "a", "")], "domain string, page string, anchor string")
    states = spark.createDataFrame([], "page string, state string")
    assert "MapInArrow" not in lint.lint_findings(pages, "d", visible, states)._jdf.queryExecution().optimizedPlan().toString()


def test_related_falls_back_on_links(spark, monkeypatch):
    records = spark.createDataFrame([("s1", "p1", "section", [1.0, 0.0]), ("s2", "p2", "section", [1.0, 0.1]), ("s2", "p2", "section", [0.0, 1.0]), ("s3", "p3", "summary", [1.0, 0.0]), ("s4", "p4", "section", None)], "section string, page string, kind string, embedding array<double>")
    links = spark.createDataFrame([("p4", "x"), ("x", "y"), ("y", "p4"), ("p4", "a"), (None, "b")], "source string, target string")
    targets = spark.createDataFrame([("s1",), ("s4",), ("none",), ("s1",)], "section string")
    got = rows(retrieval.related(records, targets, links, 5, 2))
    assert got == [("s1", "vector", "s2", 0.995, 1), ("s4", "graph", "a", None, 1), ("s4", "graph", "x", None, 2), ("s4", "graph", "y", None, 3)]
    monkeypatch.setattr(retrieval, "MAX_TARGETS", 1)
    with pytest.raises(ValueError):
        retrieval.related(records, targets, links, 5, 2)


def test_graphs_are_published_whole_or_not(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), buckets=4)
    files = spark.createDataFrame([("f",), ("g",)], "path string")
    symbols = spark.createDataFrame([("a", "f", 1, 2), ("b", "g", 3, 3)], "entity_id string, path string, start int, stop int")
    relations = spark.createDataFrame([("a", "b")], "src string, dst string")
    one, wrong = publication.publish_graph(store, files, symbols, relations)
    assert one["version"] == 1 and wrong.count() == 0 and one["note"]["counts"] == {"files": 2, "symbols": 2, "relations": 1}
    same, wrong = publication.publish_graph(store, files.limit(1), symbols, relations)
    assert same["version"] == 1 == store.version() and rows(wrong)[0][0] == "file"
    two, _ = publication.publish_graph(store, files, symbols.filter("entity_id = 'b'"), relations.limit(0))
    assert rows(store.read(two, "symbols")) == [("b", "g", 3, 3)] and store.read(two, "relations").count() == 0 and two["note"]["revision"] != one["note"]["revision"]
    again, _ = publication.publish_graph(store, files, symbols.repartition(3), relations)
    assert again["note"]["revision"] == one["note"]["revision"]


def test_a_graph_is_published_without_the_one_before(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path), buckets=4)
    files = spark.createDataFrame([("f",)], "path string")
    symbols = spark.createDataFrame([(f"s{i}", "f", 1, 2) for i in range(40)], "entity_id string, path string, start int, stop int")
    relations = spark.createDataFrame([(f"s{i}", f"s{j}") for i in range(40) for j in (0, 7)] + [("s1", "s1"), ("s1", "s1")], "src string, dst string")
    one, _ = publication.publish_graph(store, files, symbols, relations)
    for f in (tmp_path / "data").rglob("*.parquet"):  # whoever reads older rows now fails
        f.write_bytes(b"spoilt")
    kept = symbols.filter("entity_id <> 's1'").withColumn("doc", F.lit(None).cast("string"))  # with a column that is new
    two, wrong = publication.publish_graph(store, files, kept, relations.filter("src <> 's1' and dst <> 's1'"))
    assert two["version"] == 2 and wrong.count() == 0 and two["note"]["counts"] == {"files": 1, "symbols": 39, "relations": 78}
    assert rows(store.read(two, "symbols")) == rows(kept) and rows(store.read(two, "relations")) == sorted((f"s{i}", f"s{j}") for i in range(40) for j in (0, 7) if i != 1)
    assert not {f for e in one["tables"].values() for f in e["folders"].values()} & {f for e in two["tables"].values() for f in e["folders"].values()}


def test_related_meets_all_rows_block_by_block(spark, monkeypatch):
    import numpy as np

    vectors = np.random.default_rng(5).normal(size=(2100, 3))
    vectors[7] = 0
    names = [f"s{i // 2}" for i in range(1900)] + [f"s{i}" for i in range(1900, 2100)]
    odd = [("s1", [1.0, None, 0.0]), ("s2", [1.0]), ("s2001", [float("nan"), 0.0, 1.0]), (None, [1.0, 0.0, 0.0])]
    records = spark.createDataFrame([(n, "p", "section", v) for n, v in [*zip(names, vectors.tolist(), strict=True), *odd]], "section string, page string, kind string, embedding array<double>")
    targets = spark.createDataFrame([(f"s{i}",) for i in range(3, 2100)], "section string")  # 1147 of them have a record
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 700)
    monkeypatch.setattr(retrieval, "BLOCK_TARGETS", 500)
    got = {}
    for r in retrieval.related(records, targets, spark.createDataFrame([], "source string, target string"), 3, 1).orderBy("target", "place").collect():
        got.setdefault(r["target"], []).append((r["item"], r["score"]))
    first = {}
    for n, v in zip(names, vectors.tolist(), strict=True):
        first[n] = min(first.get(n, v), v)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for t in [*list(first)[3:950:40], "s2000", "s2099"]:
        w = np.array(first[t])
        best = {}
        for n, c in zip(names, np.round(unit @ (w / max(np.linalg.norm(w), 1e-300)), 4).tolist(), strict=True):
            best[n] = max(best.get(n, -2), c)
        assert got[t] == sorted(((n, c) for n, c in best.items() if n != t), key=lambda x: (-x[1], x[0]))[:3], t
    assert len(got) == 1147


def test_quota_ranking_sorts_a_case_once(spark):
    """Whole cases stand in few sorts of a task: the windows over them are of their first rows only."""
    from kbspark.operators import evaluation

    fused = spark.range(40).selectExpr("'c' as case_id", "id as key", "id as rank")
    direct = spark.createDataFrame([("c", 30, 1), ("c", 1, 2), ("c", 99, 3), ("d", 5, 1)], "case_id string, key long, rank long")
    out = evaluation.quota_ranking(fused, direct, 4)
    places = [r["key"] for r in out.filter("case_id = 'c'").orderBy("place").collect()]
    assert places == [0, 1, 30, 99, 2, 3, *range(4, 30), *range(31, 40)] and out.count() == 42
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 3 and "FullOuter" not in plan
