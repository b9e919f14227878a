"""Selectors by which pages name code: the links that follow from them, and those that are wrong.

``selectors(page, kind, selector)`` with the kinds symbol, file and source_glob; ``files(path)``;
``symbols(qualified_name, entity_id)``. Repeated rows count once. A null selector is unsafe and names nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import paths
from ..sources.versioned import staged

#: Kinds of selectors from the most to the least specific.
KINDS = ("symbol", "file", "source_glob")


@F.pandas_udf(StringType())
def _regex(glob: pd.Series) -> pd.Series:
    return glob.map(lambda g: f"^(?:{paths.glob_regex(g)})$", na_action="ignore")


def verdicts(selectors: DataFrame, ignore: list[str]) -> DataFrame:
    """The selectors with ``verdict``: unsafe_selector, secret_selector, ignored_selector, or null if it may be looked up."""
    is_path = F.col("kind") != "symbol"
    s = F.col("selector")
    unsafe = s.isNull() | (s == "") | (is_path & ~paths.is_safe(s))
    verdict = F.when(unsafe, "unsafe_selector").when(is_path & paths.is_secret(s), "secret_selector").when(is_path & paths.is_ignored(s, ignore), "ignored_selector")
    return selectors.select("page", "kind", "selector").distinct().withColumn("verdict", verdict)


def _hits(usable: DataFrame, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets of each distinct selector: of symbols, files and globs, each ``(selector, target)`` without repeats.

    A glob meets only the files below its literal folder: files are joined by each of their folders, so no pattern is
    held against all paths unless it starts with a wildcard.
    """
    of = lambda kind: usable.filter(F.col("kind") == kind).select("selector").distinct()
    paths_ = files.select("path").distinct()
    by_name = of("symbol").join(symbols.select(F.col("qualified_name").alias("selector"), F.col("entity_id").alias("target")).distinct(), "selector")
    by_path = of("file").join(paths_.select(F.col("path").alias("selector"), F.col("path").alias("target")), "selector")
    folder = F.regexp_replace(F.regexp_extract("selector", r"^((?:[^*?\[/]+/)*)", 1), "/$", "")
    globs = of("source_glob").select("selector", folder.alias("folder"), _regex("selector").alias("regex"))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    by_glob = paths_.select("path", F.explode(folders).alias("folder")).join(globs, "folder").filter(F.expr("path rlike regex")).select("selector", F.col("path").alias("target"))
    return by_name, by_path, by_glob


def matches(usable: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every target of every selector: ``(page, kind, selector, target_type, target)``."""
    rows = [usable.filter(F.col("kind") == kind).join(hits, "selector") for kind, hits in zip(KINDS, _hits(usable, files, symbols), strict=True)]
    rows = [r.select("page", "kind", "selector", F.lit("symbol" if kind == "symbol" else "file").alias("target_type"), "target") for kind, r in zip(KINDS, rows, strict=True)]
    return rows[0].union(rows[1]).union(rows[2])


class Matched:
    """What usable ``selectors(page, kind, selector)`` match, kept by distinct selector.

    Pages with the same globs are one ``crowd``. What a crowd's globs match is told once; only ``links`` and the files
    that several globs of a crowd match are multiplied by its pages, in a last join whose rows are not dealt out again.
    """

    def __init__(self, usable: DataFrame, files: DataFrame, symbols: DataFrame):
        self.usable = staged(usable.select("page", "kind", "selector").filter("selector is not null").distinct())
        self.hits = dict(zip(KINDS, map(staged, _hits(self.usable, files, symbols)), strict=True))
        globs = self.usable.filter("kind = 'source_glob'").groupBy("page").agg(F.sort_array(F.collect_set("selector")).alias("globs"))
        crowds = staged(globs.select("globs").distinct().withColumn("crowd", F.monotonically_increasing_id()))
        self.pages = staged(globs.join(crowds, "globs").select("page", "crowd"))
        met = crowds.select("crowd", F.explode("globs").alias("selector")).join(self.hits["source_glob"], "selector")
        #: the files that a crowd's globs match, by the first of them, with how many do
        self.crowded = staged(met.groupBy("crowd", "target").agg(F.min("selector").alias("source"), F.count("*").alias("n")))
        #: the files that pages name themselves
        self.named = staged(self.usable.filter("kind = 'file'").join(self.hits["file"], "selector").select("page", "selector", "target"))
        #: those of them that a glob of the page matches too
        crowd = self.pages.select(F.col("page").alias("_page"), "crowd")
        self.both = staged(self.named.join(crowd, F.col("page").eqNullSafe(F.col("_page"))).join(self.crowded, ["crowd", "target"]).select("page", "target", "n"))

    def _of_globs(self, crowded: DataFrame) -> DataFrame:
        """Each page's rows of ``crowded`` but for the files that the page names itself."""
        met, both = self.pages.join(crowded, "crowd"), self.both.select("page", "target")
        return met.join(both, met["page"].eqNullSafe(both["page"]) & (met["target"] == both["target"]), "left_anti")

    def links(self) -> DataFrame:
        """As ``links`` of all matches."""
        row = lambda df, type_, kind: df.select("page", F.lit(type_).alias("target_type"), "target", F.lit(kind).alias("kind"), "source")
        of_symbols = self.usable.filter("kind = 'symbol'").join(self.hits["symbol"], "selector").groupBy("page", "target").agg(F.min("selector").alias("source"))
        of_files = self.named.select("page", "target", F.col("selector").alias("source"))
        return row(of_symbols, "symbol", "symbol").union(row(of_files, "file", "file")).union(row(self._of_globs(self.crowded), "file", "source_glob"))

    def page_links(self) -> DataFrame:
        """As ``page_links`` of all links: a page's first selector that matches anything, with the first target of that."""
        place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
        found = [hits.groupBy("selector").agg(F.min("target").alias("target")).withColumn("kind", F.lit(kind)) for kind, hits in self.hits.items()]
        first = self.usable.join(found[0].union(found[1]).union(found[2]), ["kind", "selector"])
        best = first.groupBy("page").agg(F.min(F.struct(place.alias("place"), "selector", "target", "kind")).alias("b"))
        return best.select("page", "b.kind", F.col("b.selector").alias("source"), "b.target")

    def counts(self) -> DataFrame:
        """The number of targets of each distinct selector that has any: ``(kind, selector, n)``."""
        found = [hits.groupBy("selector").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "selector", "n") for kind, hits in self.hits.items()]
        return found[0].union(found[1]).union(found[2])

    def conflicts(self) -> DataFrame:
        """Files that several selectors of a page match, with their number: ``(page, target, n)``."""
        with_name = self.both.select("page", "target", (F.col("n") + 1).alias("n"))
        return with_name.union(self._of_globs(self.crowded.filter("n > 1")).select("page", "target", "n"))


def links(matched: DataFrame) -> DataFrame:
    """One link for each page and target, by its most specific selector: ``(page, target_type, target, kind, source)``."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = matched.groupBy("page", "target_type", "target").agg(F.min(F.struct(place.alias("place"), "selector", "kind")).alias("b"))
    return best.select("page", "target_type", "target", "b.kind", F.col("b.selector").alias("source"))


def page_links(linked: DataFrame) -> DataFrame:
    """Of all links to the same code, each page's most specific one, the first by source and target."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = linked.groupBy("page").agg(F.min(F.struct(place.alias("place"), "source", "target", "kind")).alias("b"))
    return best.select("page", "b.kind", "b.source", "b.target")


def findings(selectors: DataFrame, files: DataFrame, symbols: DataFrame, ignore: list[str], actual: DataFrame, repeats: bool = True) -> DataFrame:
    """What is wrong: ``(page, finding, kind, selector, n)``.

    A verdict on the selector itself; unknown_symbol, missing_file and empty_glob if nothing matches; ambiguous_symbol
    with the number of symbols; conflicting_selectors for a file that several selectors of a page name (``selector`` is
    the file, ``n`` their number); stale_revision for a page whose links (``actual``, without repeats if
    ``repeats`` is false) are not those that follow now.
    """
    judged = staged(verdicts(selectors, ignore))
    usable = judged.filter("verdict is null").drop("verdict")
    matched = Matched(usable, files, symbols)
    seen = usable.join(matched.counts(), ["kind", "selector"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    none = F.when(F.col("kind") == "symbol", "unknown_symbol").when(F.col("kind") == "file", "missing_file").otherwise("empty_glob")
    finding = F.when(F.col("n") == 0, none).when((F.col("kind") == "symbol") & (F.col("n") > 1), "ambiguous_symbol")
    shape = ["page", "finding", "kind", "selector", "n"]
    nothing: Column = F.lit(None).cast("string")
    out = judged.filter("verdict is not null").select("page", F.col("verdict").alias("finding"), "kind", "selector", F.lit(0).cast("long").alias("n"))
    out = out.union(seen.withColumn("finding", finding).filter("finding is not null").select(shape))
    out = out.union(matched.conflicts().select("page", F.lit("conflicting_selectors").alias("finding"), F.lit("file").alias("kind"), F.col("target").alias("selector"), "n"))
    stale = _stale(matched.links(), once(actual) if repeats else actual)
    return out.union(stale.select("page", F.lit("stale_revision"), nothing, nothing, F.lit(0).cast("long")))


def once(linked: DataFrame) -> DataFrame:
    """Links without repeats."""
    return linked.select("page", "target_type", "target", "kind", "source").distinct()


def _stale(wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """Pages whose links differ, both without repeats, by a count and sums of two 64-bit hashes of a page's links.

    Tasks add up pages before anything is shuffled. Sums stay exact: a hash counts as its upper and lower half.
    """
    keys = ["target_type", "target", "kind", "source"]
    hashes = [F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)]
    halves = [h for x in hashes for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(0xFFFFFFFF))]
    marks = lambda df, sign: df.select("page", F.lit(sign).cast("long").alias("h0"), *[(sign * h).alias(f"h{i}") for i, h in enumerate(halves, 1)])
    names = [f"h{i}" for i in range(5)]
    sums = marks(wanted, 1).union(marks(actual, -1)).groupBy("page").agg(*[F.sum(h).alias(h) for h in names])
    return sums.filter(" or ".join(f"{h} <> 0" for h in names)).select("page")
