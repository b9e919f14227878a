"""Python extraction, Markdown and publication against values worked out by hand, with nulls and odd inputs."""

from pyspark.sql import functions as F

from kbspark.functions import paths
from kbspark.operators import extraction, markdown
from kbspark.plans import codegraph

FILES = """(VALUES ('app/__init__.py', 'from .core import run'), ('app/core.py', concat_ws(chr(10), 'import os.path as p, json', 'from ..outside import gone', 'from . import util', 'class Base:', '    def step(self): return json.dumps(1)', '    def run(self):', '        self.step()', '        helper()',
    'class Fast(Base):', '    def step(self): return util.twice(2)', 'async def run(x: int = 1): return Fast().run()', 'def helper(): p.join()')), ('app/sub/mod.py', 'def f(): pass'), ('app/sub/deep/__init__.py', ''), ('app/sub/deep/leaf.py', 'x = ('), ('tool.py', NULL)) AS files(path, source)"""


def files_of(spark):
    return spark.sql(f"SELECT * FROM {FILES}")


def test_python_extraction(spark):
    rows = extraction.extract(files_of(spark)).collect()
    of = lambda kind, path="app/core.py": [r for r in rows if r["kind"] == kind and r["path"] == path]
    assert [(r["name"], r["owner"], r["start"], r["stop"]) for r in of("method")] == [("app.core.Base.step", "app.core.Base", 5, 5), ("app.core.Base.run", "app.core.Base", 6, 8), ("app.core.Fast.step", "app.core.Fast", 10, 10)]
    assert [(r["name"], r["signature"]) for r in of("async_function")] == [("app.core.run", "(x: int=1)")]
    # "..outside" leads out of the top package and binds nothing
    assert [(r["target"], r["binding"]) for r in of("IMPORTS")] == [("os.path", "p"), ("json", "json"), ("app.util", "util")]
    assert [r["target"] for r in of("INHERITS")] == ["app.core.Base"]
    assert [(r["name"], r["target"]) for r in of("CALLS")] == [
        ("app.core.Base.step", "json.dumps"),
        ("app.core.Base.run", "app.core.Base.step"),
        ("app.core.Base.run", "app.core.helper"),
        ("app.core.Fast.step", "app.util.twice"),
        ("app.core.run", "app.core.Fast.run"),
        ("app.core.run", "app.core.Fast"),
        ("app.core.helper", "os.path.join"),
    ]
    assert [(r["target"], r["binding"]) for r in of("IMPORTS", "app/__init__.py")] == [("app.core.run", "run")]
    assert [r["signature"] for r in of("error", "app/sub/deep/leaf.py")] == ["SyntaxError"] and not [r for r in rows if r["path"] == "tool.py"]
    assert {r["module"] for r in rows if r["path"] == "app/sub/deep/leaf.py"} == {"deep.leaf"}


def test_overridden_calls_and_ids(spark):
    extracted = extraction.extract(files_of(spark))
    refs, declared = extraction.references(extracted), extraction.symbols(extracted)
    over = extraction.overridable_calls(refs, declared).join(refs, "ref_id").collect()
    assert [(r["source"], r["target"], r["overrides"]) for r in over] == [("app.core.Base.run", "app.core.Base.step", 1)]
    again = extraction.symbols(extraction.extract(files_of(spark).union(files_of(spark))))
    assert sorted(r["entity_id"] for r in again.collect()) == sorted(r["entity_id"] for r in declared.collect())
    state = {(r["source"], r["target"]): r["state"] for r in codegraph.resolved_references(extracted).collect()}
    assert state["app.core.Base.run", "app.core.Base.step"] == "ambiguous" and state["app.core.Base.run", "app.core.helper"] == "resolved"
    assert state["app.core.Base.step", "json.dumps"] == "unresolved" and extraction.extract(files_of(spark).limit(0)).count() == 0


def test_targets_are_resolved_not_references(spark):
    """References of a file twice given are one each, a target's candidates meet all of them, and no join deals out their ids."""
    files = spark.createDataFrame([("p/__init__.py", ""), ("p/a.py", "from .b import go as run\ndef one(): run(); x.y()\ndef two(): run(); run()"), ("p/b.py", "def go(): pass\ndef go(*a): pass\nz()()")], "path string, source string")
    extracted = extraction.extract(files.union(files))
    out = codegraph.resolved_references(extracted)
    got = sorted((r["source"], r["target"] or "", r["start"], r["state"]) for r in out.collect())
    twice = [(n, "p.b.go", i, "ambiguous") for n, i in (("p.a", 1), ("p.a.one", 2), ("p.a.two", 3)) for _ in range(2)]
    assert got == sorted([*twice, ("p.a.one", "x.y", 2, "unresolved"), ("p.b", "", 3, "unresolved"), ("p.b", "z", 3, "unresolved")])
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("ref_id" in line for line in joins)


def test_small_files_are_parsed_in_several_tasks(spark):
    files = spark.range(40).selectExpr("concat('f', id, '.py') as path", "'def f(): pass' as source")
    assert extraction.extract(files).select(F.spark_partition_id().alias("at")).distinct().count() > 1


def test_relative_modules():
    r = extraction.relative_module
    assert [r(0, "x", "a.b", False), r(1, "x", "a.b", False), r(1, None, "a.b", True), r(2, "x", "a.b", True), r(2, "x", "a.b", False), r(3, "x", "a.b", True)] == ["x", "a.x", "a.b", "a.x", None, None]


def test_code_is_masked():
    mask = markdown.mask_code
    assert mask("a `b` c ``d ` e`` f") == "a" + " " * 5 + "c" + " " * 11 + "f"
    assert mask("```py\n[x](y)\n```\nz") == " " * 5 + "\n" + " " * 6 + "\n   \nz"
    assert mask("~~~\n```\n~~~\n[a](b)").endswith("\n[a](b)") and mask("`open [a](b)") == "`open [a](b)"
    links = markdown.page_links("![i](a.md) [x](b.md#C%20d) [y](../up.md) [z](https://e.org) [[w|label]] [s](#here)")
    assert [(p, f, old) for _, p, f, old in links] == [("b", "C d", False), ("w", "", True), ("", "here", False)] and markdown.page_links(None) == []


def test_section_edits(spark):
    page = "# T\n\n## One\n\nfirst\n\n## Two\n\nsecond\n\n## External links\n\n- x\n"
    pages = spark.createDataFrame([(k, page) for k in "abcdefghijk"] + [("null", None)], "slug string, markdown string")
    edits = [
        ("a", "replace", "## One", "new\n", None, None), ("b", "replace", "One", "x", None, "0" * 16), ("c", "insert", "Three", "third", "One", None), ("d", "insert", "two", "again", None, None),
        ("e", "delete", "One", None, None, None), ("f", "delete", "External links", None, None, None), ("g", "move", "Two", None, None, None), ("h", "move", "One", None, "Two", None),
        ("i", "replace", "None", "x", None, None), ("j", "replace", "One", "## bad", None, None), ("k", "insert", "Nine", "n", "Lost", None), ("null", "insert", "First", "text", None, None),
    ]
    got = {r["slug"]: (r["status"], r["markdown"]) for r in markdown.edit_sections(pages, spark.createDataFrame(edits, "slug string, op string, heading string, body string, target string, expected string")).collect()}
    assert got["a"] == ("ok", "# T\n\n## One\n\nnew\n\n## Two\n\nsecond\n\n## External links\n\n- x\n")
    assert got["c"] == ("ok", "# T\n\n## One\n\nfirst\n\n## Three\n\nthird\n\n## Two\n\nsecond\n\n## External links\n\n- x\n")
    assert got["e"] == ("ok", "# T\n\n## Two\n\nsecond\n\n## External links\n\n- x\n")
    assert got["g"] == ("ok", "# T\n\n## One\n\nfirst\n\n## External links\n\n- x\n\n## Two\n\nsecond\n\n")
    assert got["h"] == ("ok", "# T\n\n## Two\n\nsecond\n\n## One\n\nfirst\n\n## External links\n\n- x\n")
    assert {k: got[k][0] for k in "bdfijk"} == {"b": "conflict", "d": "collision", "f": "reserved", "i": "missing", "j": "nested", "k": "missing"}
    assert all(got[k][1] == page for k in "bdfijk")


def test_conforming_twice_changes_nothing(spark):
    from kbspark.plans.markdown import pages

    from kbspark.sources.versioned import staged

    once = staged(markdown.conformed_pages(pages(spark, "/root/testdata/sf0.001")).withColumnRenamed("rewritten", "markdown"))
    assert once.count() == 200 and markdown.conformed_pages(once).count() == 0


def test_globs():
    assert paths.glob_regex("**") == "(?:[^/]+(?:/[^/]+)*)?" and paths.glob_regex("a/**") == "a(?:/[^/]+)*" and paths.glob_regex("a/**/b") == "a/(?:[^/]+/)*b"


def test_selectors_with_nulls_ties_and_empty_tables(spark):
    from kbspark.operators import selectors as s

    named = spark.createDataFrame([("p", "file", "a/b.py"), ("p", "file", "a/b.py"), ("p", "source_glob", "a/*.py"), ("p", "source_glob", "**"), ("q", "symbol", "m.f"), ("q", "file", None), ("r", "source_glob", "z/[ab].py")], "page string, kind string, selector string")
    files = spark.createDataFrame([("a/b.py",), ("a/b.py",), ("top.py",), (None,)], "path string")
    symbols = spark.createDataFrame([("m.f", "s1"), ("m.f", "s2"), (None, "s3")], "qualified_name string, entity_id string")
    linked = s.links(s.matches(s.verdicts(named, []).filter("verdict is null"), files, symbols))
    assert sorted(map(tuple, linked.collect())) == [("p", "file", "a/b.py", "file", "a/b.py"), ("p", "file", "top.py", "source_glob", "**"), ("q", "symbol", "s1", "symbol", "m.f"), ("q", "symbol", "s2", "symbol", "m.f")]
    found = s.findings(named, files, symbols, [], linked.union(linked))
    got = sorted((r["page"], r["finding"], r["n"]) for r in found.collect())
    assert got == [("p", "conflicting_selectors", 3), ("q", "ambiguous_symbol", 2), ("q", "unsafe_selector", 0), ("r", "empty_glob", 0)]
    assert s.findings(named.limit(0), files, symbols, ["*"], linked.limit(0)).count() == 0
    # the links of a page that is gone are stale
    assert [r["finding"] for r in s.findings(named.limit(0), files, symbols, [], linked.filter("page = 'q'")).collect()] == ["stale_revision"]


def test_snapshot_batches_hold_all_rows_within_bounds(spark, monkeypatch):
    import json

    import pytest

    from kbspark.operators import publication

    rows = publication.canonical_rows(spark.range(300).selectExpr("lpad(id, 5, '0') as id", "if(id % 7 = 0, null, repeat('é', cast(id % 50 as int))) as text"), "page", "id")
    for size in (publication.RANGE_BYTES, 2000):  # one range, then several
        monkeypatch.setattr(publication, "RANGE_BYTES", size)
        got = sorted(publication.snapshot_batches(rows, 25, 900).collect(), key=lambda r: r["ordinal"])
        assert [r["ordinal"] for r in got] == list(range(len(got))) and all(r["n_rows"] <= 25 and r["n_bytes"] == len(r["payload"].encode()) <= 900 for r in got)
        assert [x["id"] for r in got for x in json.loads(r["payload"])] == [f"{i:05d}" for i in range(300)]
    assert publication.snapshot_batches(rows.limit(0), 25, 900).count() == 0
    with pytest.raises(Exception, match="larger than a batch"):
        publication.snapshot_batches(rows, 25, 50)


def calls_of(source, module="m"):
    return [r["target"] for r in extraction.read_python(source, module, False) if r["kind"] == "CALLS"]


def test_names_that_cannot_be_told_call_nothing():
    assert calls_of("import json\ndef f(json): json.dumps(1)\njson.load(1)") == [None, "json.load"]
    assert calls_of("import json\njson = thing()\njson.load(2)\ndef f(): json.load(3)") == ["thing", None, None]
    assert calls_of("try:\n  import a as x\nexcept E:\n  import b as x\nx.f()\ndef g(): x.f()") == [None, None]
    assert calls_of("import a as x\nx.f()\nimport b as x\nx.f()\ndef g(): x.f()") == ["a.f", "b.f", None]
    assert calls_of("x.f()\nimport a as x") == [None]  # not yet bound
    assert calls_of("def k():\n  y.f()\n  import c as y\n  y.f()\n  for y in (): pass\ndef l(): y.f()") == [None, None, "y.f"]
    assert calls_of("import a\n[a.f() for a in b()]\nlambda a: a.f()\nwith z() as a: pass\na.f()") == ["b", None, None, "z", None]
    assert calls_of("import a\ndef f():\n  global a\n  a = 1\n  a.g()\ndef h(): a.g()") == [None, None]
    assert calls_of("match v():\n  case {'k': w, **rest}: w.f(); rest.g()\n  case [*s]: s.h()") == ["v", None, None, None]


def test_receivers_and_instances():
    source = "class A:\n  def m(this): this.n(); this(); A().n()\n  @staticmethod\n  def s(x): x.n()\n  def r(self):\n    self = 1\n    self.n()\n  def t(self):\n    def inner(): self.n()\n    f().g().h()"
    assert sorted(map(str, calls_of(source))) == ["None"] * 4 + ["f", "f.g", "m.A", "m.A.n", "m.A.n", "m.A.n"]
    assert calls_of("from other import *\nrun(); len(1)", "pkg.mod") == ["pkg.mod.run", "len"]


def test_deep_sources_are_read():
    assert calls_of("x = " + "+".join(["f()"] * 900)) == ["f"] * 900
    assert [r["kind"] for r in extraction.read_python("x = " + "+".join(["f()"] * 200_000), "m", False)] == ["error"]
    nested = "\n".join(" " * i + f"def f{i}():" for i in range(60)) + "\n" + " " * 60 + "f0()"
    assert calls_of(nested) == ["m.f0"]


def by_hand(bindings):
    """Each alias followed by itself, one longest prefix after the other."""
    names = {}
    for name, target in bindings:
        if name is not None and target is not None and name != target:
            names.setdefault(name, set()).add(target)

    def end(name):
        if len(names[name]) > 1:
            return "ambiguous"
        target, steps = next(iter(names[name])), 0
        while True:
            parts = target.split(".")
            via = next((".".join(parts[:k]) for k in range(len(parts), 0, -1) if ".".join(parts[:k]) in names), None)
            if via is None:
                return "resolved", target
            if len(names[via]) > 1:
                return "ambiguous"
            target, steps = next(iter(names[via])) + target[len(via) :], steps + 1
            if steps > 200:
                return "cycle"

    out = {}
    for name in names:
        e = end(name)
        out[name] = (e[1], e[0]) if isinstance(e, tuple) else (min(names[name]), e)
    return out


def test_aliases_against_following_each(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(37)]
    circle = [("a", "b"), ("b", "d"), ("d", "a"), ("into", "a.x"), ("own", "own.part")]
    tails = [("p.tool", "q.impl"), ("q.impl", "r.deep.impl"), ("r.deep", "s"), ("late", "p.tool.run"), ("s.impl.run", "end")]
    several = [("two", "x"), ("two", "y"), ("of.two", "two.z"), ("same", "x"), ("same", "x"), (None, "x"), ("n", None), ("self", "self")]
    rows = [*chain, *circle, *tails, *several]
    got = {r["name"]: (r["target"], r["state"]) for r in extraction.resolve_aliases(spark.createDataFrame(rows, "name string, target string")).collect()}
    assert got == by_hand(rows)
    assert got["late"] == ("end", "resolved") and got["c0"] == ("c37", "resolved") and got["into"][1] == "cycle" and got["of.two"][1] == "ambiguous"
    assert extraction.resolve_aliases(spark.createDataFrame([], "name string, target string")).count() == 0
    refs = spark.createDataFrame([("1", "late.more"), ("2", "own.x"), ("3", "free"), ("4", None)], "ref_id string, target string")
    aliases = spark.createDataFrame([(k, *v) for k, v in got.items()], "name string, target string, state string")
    assert {r["ref_id"]: r["target"] for r in extraction.dealiased(refs, aliases).collect()} == {"1": "end.more", "2": None, "3": "free", "4": None}


def test_star_imports_pass_names_on(spark):
    files = [("p/__init__.py", ""), ("p/a.py", "from .b import *\nfrom .b import own as mine\ndef kept(): pass"), ("p/b.py", "from .c import *\nfrom .c import _hidden\ndef own(): pass\ndef _private(): pass"), ("p/c.py", "from .a import *\ndef far(): pass\ndef kept(): pass\ndef _hidden(): pass")]
    extracted = extraction.extract(spark.createDataFrame(files, "path string, source string"))
    aliases = extraction.resolve_aliases(extraction.alias_bindings(extracted, extraction.symbols(extracted)))
    got = {r["name"]: r["target"] for r in aliases.filter("state = 'resolved'").collect()}
    assert got["p.a.mine"] == "p.b.own" and got["p.a.far"] == "p.c.far" and got["p.a.own"] == "p.b.own" and got["p.b._hidden"] == "p.c._hidden"
    assert "p.a.kept" not in got and "p.a._private" not in got and "p.a._hidden" not in got


def test_edits_see_those_before_them(spark):
    page = "# T\n\n## One\n\nfirst\n\n## Two\n\nsecond\n"
    pages = spark.createDataFrame([("a", page), ("still", page), ("null", None), ("empty", "")], "slug string, markdown string")
    edits = [
        ("a", 2, "replace", "New", "changed", None, None, None, "Newer"),
        ("a", 1, "insert", "New", "made", None, None, "Two", None),
        ("a", 3, "replace", "New", "gone by that name", None, None, None, None),
        ("a", 4, "move", "One", None, None, None, None, None),
        ("a", 5, "insert", "Both", "x", "One", None, "Two", None),
        ("a", 6, "replace", "Two", "x", None, None, None, "One"),
        ("a", 7, "odd", "Two", None, None, None, None, None),
        ("null", 1, "insert", "X", "y", None, None, None, None),
        ("empty", 1, "insert", "X", "y", None, None, None, None),
        ("absent", 1, "delete", "X", None, None, None, None, None),
        (None, 1, "delete", "X", None, None, None, None, None),
    ]
    table = spark.createDataFrame(edits, "slug string, seq int, op string, heading string, body string, target string, expected string, before string, new_heading string")
    got = {r["slug"]: (r["markdown"], [tuple(a) for a in r["answers"]]) for r in markdown.fold_edits(pages, table).collect()}
    assert got["a"] == ("# T\n\n## Newer\n\nchanged\n\n## Two\n\nsecond\n\n## One\n\nfirst\n\n", [(1, "ok"), (2, "ok"), (3, "missing"), (4, "ok"), (5, "ambiguous"), (6, "collision"), (7, "unknown")])
    assert got["still"] == (page, []) and got["absent"][1] == [(1, "missing")] and got["absent"][0] is None
    assert got["empty"] == ("## X\n\ny\n\n", [(1, "ok")]) and set(got) == {"a", "still", "null", "empty", "absent"}


def test_a_fold_is_one_edit_after_the_other(spark):
    import random

    rng = random.Random(5)
    page = "# T\n" + "".join(f"## S{i}\n\nbody {i}\n" for i in range(4))
    name = lambda: rng.choice(["S0", "S1", "S2", "S3", "S4", "## S5"])
    edits = [(f"p{p}", k, rng.choice(["replace", "insert", "delete", "move"]), name(), rng.choice(["new", "## bad", None]), rng.choice([None, name()]), None) for p in range(12) for k in range(5)]
    schema = "slug string, seq int, op string, heading string, body string, target string, expected string"
    pages = spark.createDataFrame([(f"p{p}", page) for p in range(12)], "slug string, markdown string")
    folded = {r["slug"]: (r["markdown"], [a["status"] for a in r["answers"]]) for r in markdown.fold_edits(pages, spark.createDataFrame(edits, schema)).collect()}
    now, told = pages, {f"p{p}": [] for p in range(12)}
    for k in range(5):
        step = markdown.edit_sections(now, spark.createDataFrame([e for e in edits if e[1] == k], schema)).collect()
        for r in step:
            told[r["slug"]].append(r["status"])
        now = spark.createDataFrame([(r["slug"], r["markdown"]) for r in step], "slug string, markdown string")
    assert folded == {r["slug"]: (r["markdown"], told[r["slug"]]) for r in now.collect()} and "ok" in sum(told.values(), [])


def test_links_are_rewritten_in_place(spark):
    page = "[old.md](old.md) [é](./old#A) ![i](old.md) `[c](old.md)` [[ old ]] [[old#H|l]] [[old.md]] [x](https://e.org/old.md) [o](older.md)\n```\n[[old]]\n```\n[two](dir/b)"
    pages = spark.createDataFrame([("a", page), ("none", "no links"), ("null", None), ("a", "[x](old)")], "slug string, markdown string")
    moves = spark.createDataFrame([("old", "new/place"), ("dir/b", "c"), ("dir/b", "d"), ("older", "older"), (None, "x")], "old string, new string")
    got = [(r["slug"], r["changed"], r["markdown"]) for r in markdown.rewrite_links(pages.filter("markdown is null or markdown not like '%(old)'"), moves).collect()]
    want = "[old.md](new/place.md) [é](new/place.md#A) ![i](old.md) `[c](old.md)` [[new/place]] [[new/place#H|l]] [[new/place]] [x](https://e.org/old.md) [o](older.md)\n```\n[[old]]\n```\n[two](c.md)"
    assert sorted(got, key=str) == sorted([("a", 6, want), ("none", 0, "no links"), ("null", 0, None)], key=str)
    assert markdown.rewrite_links(pages.limit(0), moves).count() == 0


def test_old_links_become_markdown(spark):
    page = "[[a]] [[a#Some Part]] [[a#P|label]] [[b|é]] `[[c]]` [m](x.md)"
    pages = spark.createDataFrame([("s", page), ("t", None)], "slug string, markdown string")
    once = markdown.modern_links(pages)
    got = {r["slug"]: (r["changed"], r["markdown"]) for r in once.collect()}
    assert got == {"s": (4, "[a](a.md) [Some Part](a.md#some-part) [label](a.md#p) [é](b.md) `[[c]]` [m](x.md)"), "t": (0, None)}
    assert markdown.modern_links(once.drop("changed")).filter("changed > 0").count() == 0


def test_matched_selectors_are_as_all_their_matches(spark):
    from kbspark.operators import selectors as s

    named = [(p, "source_glob", g) for p in ("a", "b", "c", None) for g in ("x/*.py", "x/1*.py", "none/*")] + [("a", "file", "x/11.py"), ("a", "file", "x/2.py"), ("c", "file", "gone"), ("d", "symbol", "f"), ("d", "file", "x/2.py"), (None, "file", "x/11.py")]
    selectors = spark.createDataFrame(named, "page string, kind string, selector string")
    files = spark.range(30).selectExpr("concat('x/', id, '.py') as path")
    symbols = spark.createDataFrame([("f", "s1"), ("f", "s2")], "qualified_name string, entity_id string")
    matched, every = s.Matched(selectors, files, symbols), s.matches(selectors, files, symbols)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(matched.links()) == rows(s.links(every)) and rows(matched.page_links()) == rows(s.page_links(s.links(every)))
    assert rows(matched.conflicts()) == rows(every.filter("target_type = 'file'").groupBy("page", "target").agg(F.count("*").alias("n")).filter("n > 1"))


def test_links_of_pages_with_the_same_globs_are_not_shuffled(spark):
    from kbspark.operators import selectors as s

    from .test_resolution import shuffled

    named = spark.range(800).selectExpr("concat('p', id) as page", "'source_glob' as kind", "'x/*' as selector")
    files = spark.range(800).selectExpr("concat('x/', id) as path")
    symbols = spark.createDataFrame([], "qualified_name string, entity_id string")
    n, written = shuffled(spark, s.Matched(named, files, symbols).links())
    assert n == 640_000 and written < 200_000
