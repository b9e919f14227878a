"""Context around code entities: a breadth-first search that admits entities in one order, under budgets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import staged
from .ordering import ranked

#: The relations that a context may follow, those of modules, and how closely a selector names an entity.
RELATION_TYPES = ("DECLARES", "IMPORTS", "CALLS", "INHERITS")
MODULE_TYPES = ("DECLARES", "IMPORTS")
SPECIFICITY = ("source_glob", "file", "symbol")


class Context(NamedTuple):
    """``nodes(entity_id, entity_type, file_id, depth, admitted)``, ``relations(relation_id, relation_type, src, dst,
    reference, depth, admitted)``, ``files(file_id, admitted)``; why it was cut short, in the order in which that
    happened. ``admitted`` counts from 1."""

    nodes: DataFrame
    relations: DataFrame
    files: DataFrame
    warnings: list[str]

    @property
    def truncated(self) -> bool:
        return any(w.endswith("_exhausted") for w in self.warnings)


def _first(df: DataFrame, what: Column) -> int | None:
    """One number of a distributed aggregate: all that the driver gets to see of a level."""
    return df.agg(what).first()[0]


def _seed_nodes(entities: DataFrame, seeds: DataFrame, max_nodes: int, max_files: int) -> tuple[DataFrame, list[str]]:
    """Seeds in order, a file's module right behind it; one that does not fit is passed over, the others are still tried."""
    asked = seeds.groupBy("entity_id").agg(F.min("place").alias("place"))
    found = staged(asked.join(entities.select("entity_id", "entity_type", "file_id", "module_id"), "entity_id"))
    modules = found.filter("entity_type = 'file' and module_id is not null").select(F.col("module_id").alias("entity_id"), "place")
    modules = modules.join(entities.select("entity_id", "entity_type", "file_id"), "entity_id")
    both = found.select("entity_id", "entity_type", "file_id", (2 * F.col("place")).alias("place")).unionByName(modules.withColumn("place", 2 * F.col("place") + 1))
    firsts = both.groupBy("entity_id").agg(F.min("place").alias("place"), F.first("entity_type").alias("entity_type"), F.first("file_id").alias("file_id"))
    files = ranked(firsts.groupBy("file_id").agg(F.min("place").alias("first")), "first", name="nth").filter(F.col("nth") <= max_files)
    marked = firsts.join(files.select("file_id", F.lit(True).alias("fits")), "file_id", "left")
    marked = ranked(marked, F.col("fits").asc_nulls_last(), "place", name="nth")  # those that fit first, so numbered alone
    taken = staged(marked.filter(F.col("fits") & (F.col("nth") <= max_nodes)).select("entity_id", "entity_type", "file_id", F.lit(0).alias("depth"), F.col("nth").alias("admitted"), "place"))
    n, last = taken.agg(F.count("*"), F.max("place")).first()
    warnings = [] if asked.join(found, "entity_id", "left_anti").isEmpty() else ["unknown_seed"]
    left = marked.join(taken.select("entity_id"), "entity_id", "left_anti")
    full = F.lit(n == max_nodes) & (F.col("place") > F.lit(last))
    late = left.agg(F.min(F.when(full, F.col("place"))), F.min(F.when(~full, F.col("place")))).first()
    why = sorted((p, w) for p, w in zip(late, ("max_nodes_exhausted", "max_files_exhausted"), strict=True) if p is not None)
    return taken.drop("place"), warnings + [w for _, w in why]


def budgeted_context(
    entities: DataFrame,
    relations: DataFrame,
    seeds: DataFrame,
    *,
    direction: str = "both",
    depth: int = 1,
    types: tuple[str, ...] = RELATION_TYPES,
    max_nodes: int = 50,
    max_files: int = 20,
) -> Context:
    """What lies around ``seeds(entity_id, place)`` within ``depth`` steps, ``max_nodes`` entities and ``max_files`` files.

    ``entities(entity_id, entity_type, file_id, module_id)`` are files, modules and symbols with ids of their own;
    ``relations(relation_id, relation_type, src, dst, reference, start)`` join them, ``dst`` null while unresolved. From a
    module only declarations and imports are followed, into a file nothing.

    A level's relations are put in one order (type, source, target or reference, start, id). An entity is admitted by the
    first of them that reaches it. Places of first arrivals, numbered by ranges, are the running count of entities, those
    of their files the running count of files; the first arrival that a budget has no room for ends the context, so its
    relation and all after it are left out. Each level is a table in the shared folder, and the driver sees three numbers
    of it. Relations to entities that are not there are left out. Nulls, unknown and repeated seeds are passed over.
    """
    nodes, warnings = _seed_nodes(entities, seeds, max_nodes, max_files)
    kept, frontier = None, nodes
    files = ranked(nodes.groupBy("file_id").agg(F.min("admitted").alias("by")), "by", name="admitted").drop("by")
    known = entities.select(F.col("entity_id").alias("neighbour"), "entity_type", "file_id")
    usable = relations.filter(F.col("relation_type").isin(*types))
    allowed = (F.col("entity_type") != "module") | F.col("relation_type").isin(*MODULE_TYPES)
    for level in range(1, depth + 1):
        if any(w.endswith("_exhausted") for w in warnings) or frontier.isEmpty():
            break
        ends = frontier.select(F.col("entity_id").alias("_end"), "entity_type")
        out = usable.join(ends, F.col("src") == F.col("_end")).filter(allowed).withColumn("neighbour", F.col("dst"))
        into = usable.join(ends.filter("entity_type <> 'file'"), F.col("dst") == F.col("_end")).filter(allowed).withColumn("neighbour", F.col("src"))
        near = (out if direction == "out" else into if direction == "in" else out.unionByName(into)).drop("_end", "entity_type").dropDuplicates(["relation_id"])
        near = ranked(near, "relation_type", "src", F.coalesce("dst", "reference", F.lit("")), "start", "relation_id")

        arrivals = near.groupBy("neighbour").agg(F.min("place").alias("place")).join(nodes.select(F.col("entity_id").alias("neighbour")), "neighbour", "left_anti")
        arrivals = ranked(arrivals.join(known, "neighbour"), "place", name="nth")
        new_files = arrivals.join(files, "file_id", "left_anti").groupBy("file_id").agg(F.min("place").alias("place"))
        new_files = ranked(new_files, "place", name="nth")
        room, file_room = max_nodes - nodes.count(), max_files - files.count()
        cuts = [(_first(arrivals.filter(F.col("nth") == room + 1), F.min("place")), "max_nodes_exhausted"), (_first(new_files.filter(F.col("nth") == file_room + 1), F.min("place")), "max_files_exhausted")]
        cuts = [(p, -k, w) for k, (p, w) in enumerate(reversed(cuts)) if p is not None]  # at one relation the entities' budget is asked first
        cut, _, why = min(cuts, default=(None, 0, None))
        fits = F.lit(True) if cut is None else F.col("place") < cut
        warnings += [why] if why else []

        there = arrivals.select("neighbour").unionByName(nodes.select(F.col("entity_id").alias("neighbour"))).withColumn("_there", F.lit(True))
        passed = near.filter(fits).join(there, "neighbour", "left").filter("_there or neighbour is null").drop("_there", "neighbour")
        passed = passed.select("relation_id", "relation_type", "src", "dst", "reference", F.lit(level).alias("depth"), "place")
        kept = passed if kept is None else kept.unionByName(passed.join(kept.select("relation_id"), "relation_id", "left_anti"))
        base, file_base = max_nodes - room, max_files - file_room
        frontier = arrivals.filter(fits).select(F.col("neighbour").alias("entity_id"), "entity_type", "file_id", F.lit(level).alias("depth"), (F.col("nth") + base).alias("admitted"))
        nodes = staged(nodes.unionByName(frontier))
        files = staged(files.unionByName(new_files.filter(fits).select("file_id", (F.col("nth") + file_base).alias("admitted"))))
        frontier = nodes.filter(F.col("depth") == level)
    if kept is None:
        kept = relations.filter("false").select("relation_id", "relation_type", "src", "dst", "reference", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"))
    return Context(nodes, ranked(kept, "depth", "place", name="admitted").drop("place"), files, warnings)


def context_pages(context: Context, links: DataFrame) -> DataFrame:
    """The page of each of ``links(page_id, selector_kind, relation_type, source, file_id, symbol_id)`` that names an
    admitted file or symbol, once, by its most specific selector; of equally specific ones the first source counts."""
    symbols = context.nodes.filter("entity_type = 'symbol'").select(F.col("entity_id").alias("symbol_id"))
    hit = links.join(symbols, "symbol_id", "left_semi").select(links.columns).unionByName(links.join(context.files.select("file_id"), "file_id", "left_semi").select(links.columns))
    rank = F.array_position(F.array(*[F.lit(k) for k in SPECIFICITY]), F.col("selector_kind"))
    best = hit.groupBy("page_id").agg(F.min(F.struct((-rank).alias("rank"), "source", "selector_kind", "relation_type")).alias("b"))
    return best.select("page_id", "b.selector_kind", "b.relation_type", "b.source")


def context_sources(context: Context, sources: DataFrame, max_bytes: int) -> DataFrame:
    """``(file_id, status, source)`` of the admitted files from ``sources(file_id, source, content_hash)``, in order.

    A file is taken if its bytes fit what is left of the budget, so a small one may follow a large one that did not
    (``max_source_bytes_exhausted``). One without a source is ``source_unavailable``, one whose hash differs
    ``source_changed``; if there is any such file, no source is given out at all. The fold is over the admitted files,
    whose number ``max_files`` bounds.
    """
    rows = context.files.join(sources, "file_id", "left").withColumn("size", F.octet_length("source"))
    sized = F.array_sort(F.collect_list(F.struct("admitted", "file_id", "size", (F.sha2("source", 256) == F.col("content_hash")).alias("same"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<file_id:string,status:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size"] <= max_bytes
        status = F.when(x["size"].isNull(), "source_unavailable").when(~fits, "max_source_bytes_exhausted").when(~F.coalesce(x["same"], F.lit(False)), "source_changed").otherwise("ok")
        used = acc["used"] + F.when(fits, x["size"]).otherwise(0)
        return F.struct(F.coalesce(used, acc["used"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["file_id"].cast("string").alias("file_id"), status.alias("status")))).alias("out"))

    told = rows.agg(F.aggregate(sized, start, step)["out"].alias("out")).select(F.explode("out").alias("o")).select("o.*")
    unsafe = F.max(F.col("status").isin("source_unavailable", "source_changed")).over(Window.partitionBy(F.lit(1)))
    told = told.withColumn("unsafe", unsafe).join(sources.select("file_id", "source"), "file_id", "left")
    return told.select("file_id", "status", F.when((F.col("status") == "ok") & ~F.col("unsafe"), F.col("source")).alias("source"))
