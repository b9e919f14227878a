"""The budgeted context against a sequential walk over random graphs, sources and pages of a context, places by ranges."""

import hashlib
import random

import pytest

from kbspark.operators import context
from kbspark.operators.ordering import ranked

ENTITY = "entity_id string, entity_type string, file_id string, module_id string"
RELATION = "relation_id string, relation_type string, src string, dst string, reference string, start long"


def graph(seed):
    rng = random.Random(seed)
    files = [f"f{i}" for i in range(8)]
    entities = [(f, "file", f, f"m{f}" if i % 3 else None) for i, f in enumerate(files)] + [(f"m{f}", "module", f, f"m{f}") for i, f in enumerate(files) if i % 3]
    entities += [(f"s{i}", "symbol", f, None) for i in range(30) for f in [rng.choice(files)]]
    ids = [e[0] for e in entities]
    relations = []
    for i in range(90):
        kind = rng.choice(context.RELATION_TYPES)
        dst = rng.choice([*ids, None, "gone"])
        relations.append((f"r{i:02}", kind, rng.choice(ids), dst if dst is None or not dst.startswith("f") else "s1", "name" if dst is None else None, rng.randrange(4)))
    seeds = rng.sample(ids, 4) + ["unknown"] * (seed % 2) + ["s3", "s3"]
    return entities, relations, seeds


def walk(entities, relations, seeds, direction, depth, types, max_nodes, max_files):
    """One entity after the other."""
    known = {e[0]: e for e in entities}
    nodes, files, passed, warnings = {}, [], {}, []
    if set(seeds) - set(known):
        warnings.append("unknown_seed")

    def admit(e, level):
        if e in nodes:
            return True
        why = "max_nodes_exhausted" if len(nodes) >= max_nodes else "max_files_exhausted" if known[e][2] not in files and len(files) >= max_files else None
        if why:
            warnings.append(why)
            return False
        if known[e][2] not in files:
            files.append(known[e][2])
        nodes[e] = level
        return True

    for s in seeds:
        if s in known and admit(s, 0) and known[s][1] == "file" and known[s][3] in known:
            admit(known[s][3], 0)
    over = lambda: any(w.endswith("exhausted") for w in warnings)
    for level in range(1, depth + 1):
        if over():
            break
        front = {e for e, d in nodes.items() if d == level - 1}
        follows = lambda e, k: k in types and (known[e][1] != "module" or k in ("DECLARES", "IMPORTS"))
        near = [r for r in relations if (direction != "in" and r[2] in front and follows(r[2], r[1])) or (direction != "out" and r[3] in front and known[r[3]][1] != "file" and follows(r[3], r[1]))]
        for r in sorted(near, key=lambda r: (r[1], r[2], r[3] or r[4] or "", r[5], r[0])):
            other = r[3] if r[2] in front else r[2]
            if other is not None and other not in nodes:
                if other not in known:
                    continue
                if not admit(other, level):
                    break
            passed.setdefault(r[0], len(passed) + 1)
    return list(nodes.items()), files, passed, list(dict.fromkeys(warnings))


@pytest.mark.parametrize("seed,direction,depth,max_nodes,max_files", [(1, "both", 3, 50, 20), (2, "both", 3, 14, 8), (3, "out", 3, 40, 5), (4, "in", 2, 12, 4), (5, "both", 2, 3, 8), (6, "both", 2, 50, 2), (7, "both", 0, 5, 2)])
def test_context_walks_in_order(spark, seed, direction, depth, max_nodes, max_files):
    entities, relations, seeds = graph(seed)
    types = ("CALLS", "DECLARES", "IMPORTS") if seed % 2 else context.RELATION_TYPES
    e, r = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(relations, RELATION)
    s = spark.createDataFrame([(x, i) for i, x in enumerate(seeds)], "entity_id string, place long")
    got = context.budgeted_context(e, r, s, direction=direction, depth=depth, types=types, max_nodes=max_nodes, max_files=max_files)
    nodes, files, passed, warnings = walk(entities, relations, seeds, direction, depth, types, max_nodes, max_files)
    assert [(x["entity_id"], x["depth"]) for x in got.nodes.orderBy("admitted").collect()] == nodes
    assert [x["file_id"] for x in got.files.orderBy("admitted").collect()] == files
    assert [x["relation_id"] for x in got.relations.orderBy("admitted").collect()] == list(passed)
    assert got.warnings == warnings and got.truncated == any(w != "unknown_seed" for w in warnings)
    assert sorted(x["admitted"] for x in got.nodes.collect()) == list(range(1, len(nodes) + 1))


def test_context_without_anything(spark):
    got = context.budgeted_context(spark.createDataFrame([], ENTITY), spark.createDataFrame([], RELATION), spark.createDataFrame([("x", 0)], "entity_id string, place long"))
    assert got.nodes.count() == got.relations.count() == got.files.count() == 0 and got.warnings == ["unknown_seed"] and not got.truncated


def test_sources_fit_what_is_left(spark):
    files = spark.createDataFrame([(f"f{i}", i) for i in range(1, 6)], "file_id string, admitted long")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("f1", "aaaa", sha("aaaa")), ("f2", "b" * 9, sha("b" * 9)), ("f3", "é", sha("é")), ("f4", "", sha("")), ("f5", "ccc", sha("ccc"))]
    sources = lambda rows: spark.createDataFrame(rows, "file_id string, source string, content_hash string")
    got = lambda rows: [tuple(r) for r in context.context_sources(context.Context(None, None, files, []), sources(rows), 8).orderBy("file_id").collect()]
    assert got(rows) == [("f1", "ok", "aaaa"), ("f2", "max_source_bytes_exhausted", None), ("f3", "ok", "é"), ("f4", "ok", ""), ("f5", "max_source_bytes_exhausted", None)]
    changed = got([rows[0], ("f2", "x", sha("y")), *rows[3:]])  # one changed, one missing: nothing is given out
    assert [r[1] for r in changed] == ["ok", "source_changed", "source_unavailable", "ok", "ok"] and not any(r[2] for r in changed)


def test_places_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).selectExpr("(id * 7919) % 5000 as x").repartition(6)
        assert sorted(tuple(r) for r in ranked(rows, "x").collect()) == [(x, x + 1) for x in range(5000)]
        assert ranked(rows.limit(0), "x").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
