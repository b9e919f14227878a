"""Domains, pages, chunks, links and code entities joined into what readers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, vectors
from ..functions.text import content_hash, slugify
from . import markdown

#: Generated files that are no pages, folders that hold no sources.
RESERVED_FILES = ("index.md", "log.md")
SKIPPED_FOLDERS = (".git", ".venv", "venv", "node_modules", "dist", "build", "coverage", "__pycache__", "vendor", "generated")


def scope(asks: DataFrame, domains: DataFrame, bound: DataFrame) -> DataFrame:
    """The domains that each request reads: ``(request, domain)``.

    ``asks(request, scope, named)``: the domains in the array ``named`` if it is not null (an empty one reads none);
    otherwise all of ``domains(domain)`` if the scope is ``all`` or nothing is bound to the request; otherwise those of
    ``bound(request, domain)``. Requests are few beside domains, which are broadcast if Spark finds them small.
    """
    named = asks.filter("named is not null").select("request", F.explode("named").alias("domain"))
    rest = asks.filter("named is null")
    own = rest.filter("scope is null or scope <> 'all'").join(bound, "request").select("request", "domain")
    whole = rest.join(own.select("request").distinct(), "request", "left_anti").select("request", F.lit(1).alias("_one"))
    every = whole.join(domains.select("domain", F.lit(1).alias("_one")), "_one").select("request", "domain")
    return named.union(own).union(every).distinct()


def scoped_chunks(chunks: DataFrame, pages: DataFrame, domains: DataFrame, query: DataFrame) -> DataFrame:
    """Chunks of the pages of some domains with their cosine to the one vector of ``query``: ``chunks(page, ordinal, heading,
    embedding)``, ``pages(page, domain)``, ``domains(domain)``."""
    own = chunks.join(pages.join(domains, "domain", "left_semi").select("page", "domain"), "page")
    wanted = query.select(F.col("embedding").alias("_query")).limit(1)
    scored = own.join(F.broadcast(wanted), F.lit(True))  # a single row
    return scored.select("domain", "page", "ordinal", "heading", vectors.cosine(F.col("embedding"), F.col("_query")).alias("score"))


def scoped_links(links: DataFrame, pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Links ``(source, target)`` whose both ends lie in some domains, with these."""
    end = lambda name: pages.join(domains, "domain", "left_semi").select(F.col("page").alias(name), F.col("domain").alias(f"{name}_domain"))
    return links.join(end("source"), "source").join(end("target"), "target").select("source_domain", "source", "target_domain", "target")


def domain_pages(domains: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of every domain, and one row with a null page for a domain without any."""
    return domains.join(pages, "domain", "left")


def code_states(domains: DataFrame, pointers: DataFrame, snapshots: DataFrame, revisions: DataFrame) -> DataFrame:
    """What a domain's code graph is worth: ``(domain, state, revision, links_stale)``.

    ``pointers(domain, snapshot)`` name the active one of ``snapshots(domain, snapshot, revision, markdown_revision,
    generation)``; ``revisions(domain, current_revision, current_generation)`` are those of the pages now. Links are stale if
    pages have changed since, by content or by generation. ``missing_snapshot`` where there is no pointer or no snapshot.
    """
    j = domains.join(pointers, "domain", "left").join(snapshots, ["domain", "snapshot"], "left").join(revisions, "domain", "left")
    there = F.col("revision").isNotNull()
    stale = there & ~(F.col("markdown_revision").eqNullSafe(F.col("current_revision")) & F.col("generation").eqNullSafe(F.col("current_generation")))
    return j.select("domain", F.when(there, "ready").otherwise("missing_snapshot").alias("state"), F.when(there, F.col("revision")).alias("revision"), stale.alias("links_stale"))


def entity_lookup(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files, modules and symbols by their ids, each once, however often it is asked for."""
    return entities.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")


def alias_imports(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """What explicit aliases stand for: ``(binding, entity_id, entity_type, file_id)``, each once.

    ``relations(relation_type, dst, binding, binding_kind, state)``; aliases of imports that resolve at least in part.
    """
    named = relations.filter("relation_type = 'IMPORTS' and binding_kind = 'explicit_alias' and state in ('resolved', 'ambiguous', 'partially_resolved')")
    return named.select("binding", F.col("dst").alias("entity_id")).distinct().join(entities, "entity_id").select("binding", "entity_id", "entity_type", "file_id")


def ambiguous_aliases(targets: DataFrame) -> DataFrame:
    """``targets`` with how many entities their binding stands for, and whether that is more than one."""
    n = targets.groupBy("binding").agg(F.count_distinct("entity_id").alias("alias_target_count"))
    return targets.join(n, "binding").withColumn("alias_ambiguous", F.col("alias_target_count") > 1)


def page_snapshot(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, anchors and edges of ``pages(domain, file, markdown)`` as a link graph keeps them; generated files are left out.

    A page is ``domain/file`` without ``.md``, with the hash of its text and one of its links, by which a change that
    leaves all links as they are is told apart.
    """
    named = pages.filter(F.col("file").endswith(".md") & ~F.col("file").isin(*RESERVED_FILES))
    own = named.select(F.concat("domain", F.lit("/"), F.regexp_replace("file", r"\.md$", "")).alias("page"), "domain", "file", F.coalesce("markdown", F.lit("")).alias("markdown"))
    anchors = markdown.heading_anchors(own, "page").select("page", "anchor", "heading")
    links = markdown.link_targets(own, "page").join(own.select("page", "domain"), "page")
    # a bare fragment names the page itself, which has its domain already
    target = F.when(F.col("target") == F.col("page"), F.col("target")).otherwise(F.concat("domain", F.lit("/"), "target"))
    edges = links.select(F.col("page").alias("source"), target.alias("target"), "anchor", "legacy").filter(~F.element_at(F.split("target", "/"), -1).isin(*[f.removesuffix(".md") for f in RESERVED_FILES]))
    line = F.concat_ws("#", "target", "anchor")
    linked = edges.groupBy(F.col("source").alias("page")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("link_hash"))
    told = own.select("page", "domain", "file", F.sha2("markdown", 256).alias("content_hash")).join(linked, "page", "left")
    return told.withColumn("link_hash", F.coalesce("link_hash", F.sha2(F.lit(""), 256))), anchors, edges


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(domain, file, markdown)`` of all ``.md`` files below ``folder``, whose own folders are the domains; a file that is
    not UTF-8 has a null text. Spark's scans pass over files of no length, so these are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    below = F.regexp_extract("path", r"^.*?" + _escaped(folder) + r"/+(.*)$", 1)
    return files.select(F.substring_index(below, "/", 1).alias("domain"), F.regexp_replace(below, "^[^/]*/", "").alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("markdown"))


def _escaped(folder: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in folder.split("://")[-1].rstrip("/"))


def source_files(listing: DataFrame, extensions: list[str], *, max_bytes: int, max_files: int, ignored: list[str] = ()) -> DataFrame:
    """Source files of ``listing(path, length)`` in the order of their paths: ``(path, length, place)``.

    Left out are other endings, files in folders that hold none, secrets, unsafe and ignored paths, files over
    ``max_bytes``, and, the listing being cut there, those after the first ``max_files``. Only that many are sorted at last.
    """
    ending = F.element_at(F.split("path", r"\."), -1)
    skipped = F.arrays_overlap(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), F.array(*[F.lit(f) for f in SKIPPED_FOLDERS]))
    good = ending.isin(*extensions) & ~skipped & ~paths.is_secret(F.col("path")) & paths.is_safe(F.col("path")) & (F.col("length") <= max_bytes)
    if ignored:
        good &= ~paths.is_ignored(F.col("path"), list(ignored))
    first = listing.filter(good).select("path", "length").distinct().orderBy("path").limit(max_files)
    return first.withColumn("place", F.row_number().over(Window.orderBy("path")))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of all files below a folder but empty ones, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", r"^.*?" + _escaped(folder) + r"/+(.*)$", 1).alias("path"), "length")


def index_pages(pages: DataFrame) -> DataFrame:
    """Each domain's generated index: ``(domain, markdown)``, a heading and a link for each of ``pages(domain, slug)``.

    A domain's index is one text, so its slugs come together; they are made distinct before.
    """
    own = pages.filter("slug is not null").select("domain", "slug").distinct().groupBy("domain")
    lines = F.transform(F.array_sort(F.collect_list("slug")), lambda s: F.concat(F.lit("- ["), s, F.lit("]("), s, F.lit(".md)")))
    return own.agg(F.concat(F.lit("# Index\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("markdown"))


def log_pages(log: DataFrame) -> DataFrame:
    """Each domain's generated log: ``(domain, markdown)``, a line for each of ``log(domain, seq, date, op, page)`` in order."""
    part = lambda x, c: F.coalesce(x[c], F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct("seq", "date", "op", "page")))
    lines = F.transform(rows, lambda x: F.rtrim(F.concat(F.lit("- "), part(x, "date"), F.lit(" "), part(x, "op"), F.lit(" "), part(x, "page"))))
    return log.groupBy("domain").agg(F.concat(F.lit("# Log\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("markdown"))


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Records of an index of ``chunks(page, kind, heading, chunk, body, embedding)``: slot, hash, size, scale and bytes.

    The slot (kind, heading, chunk) is what a chunk is known by in its page; a vector may be kept for it as long as the
    hash of the text and the vector's size are the same.
    """
    slot = F.to_json(F.struct("kind", "heading", "chunk"))
    scaled = chunks.withColumn("scale", vectors.scale_of(F.col("embedding")))
    return scaled.select("page", slot.alias("slot"), content_hash(F.col("body")).alias("hash"), F.size("embedding").alias("dim"), "scale", vectors.quantise(F.col("embedding"), F.col("scale")).alias("q"))


def reused_records(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """What becomes of each slot: ``keep``, ``replace`` (its text or vector size has changed), ``add`` or ``remove``."""
    keys = ["page", "slot"]
    j = stored.select(*keys, F.col("hash").alias("_hash"), F.col("dim").alias("_dim")).join(wanted.select(*keys, "hash", "dim"), keys, "full_outer")
    same = (F.col("hash") == F.col("_hash")) & (F.col("dim") == F.col("_dim"))
    return j.select(*keys, F.when(F.col("_hash").isNull(), "add").when(F.col("hash").isNull(), "remove").when(same, "keep").otherwise("replace").alias("action"))


def verified_incoming(asks: DataFrame, edges: DataFrame, indexed: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that link to each of ``asks(target, anchor)``, and whether the index can be believed: ``(target, anchor, state, sources)``.

    ``edges(source, target, anchor)`` and ``indexed(page, content_hash)`` are the index, ``pages(page, content_hash)`` the
    pages now. If any page that the index names for a target has another text by now, or is gone, the answer is ``stale`` and
    has no sources; without an anchor all links to the page count.
    """
    normal = asks.select("target", "anchor", slugify(F.coalesce("anchor", F.lit(""))).alias("_anchor")).distinct()
    all_links = edges.select(F.col("target").alias("_to"), F.col("anchor").alias("_at"), "source")
    meets = (F.col("target") == F.col("_to")) & (F.col("anchor").isNull() | (F.col("_at") == F.col("_anchor")))
    hits = normal.join(all_links, meets, "left").select("target", "anchor", "source").distinct()
    known = indexed.select(F.col("page").alias("source"), F.col("content_hash").alias("_was")).join(pages.select(F.col("page").alias("source"), F.col("content_hash").alias("_now")), "source", "left")
    j = hits.join(known, "source", "left")
    bad = F.coalesce(F.max(F.col("source").isNotNull() & ~F.col("_was").eqNullSafe(F.col("_now"))), F.lit(False))
    told = j.groupBy("target", "anchor").agg(bad.alias("bad"), F.array_sort(F.collect_set("source")).alias("sources"))
    return told.select("target", "anchor", F.when(F.col("bad"), "stale").otherwise("ok").alias("state"), F.when(~F.col("bad"), F.array_join("sources", ",")).alias("sources"))


def quality(found: DataFrame, expected: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Recall and falseness of what was extracted, by kind: ``(by, expected, found, right, recall, false_share)``."""
    e, f = expected.select(by, *keys).distinct().withColumn("_e", F.lit(1)), found.select(by, *keys).distinct().withColumn("_f", F.lit(1))
    j = e.join(f, [by, *keys], "full_outer").groupBy(by).agg(F.count("_e").alias("expected"), F.count("_f").alias("found"), F.count(F.col("_e") + F.col("_f")).alias("right"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return j.select("*", share(F.col("right"), F.col("expected")).alias("recall"), share(F.col("found") - F.col("right"), F.col("found")).alias("false_share"))


def result_order(results: DataFrame, ranks: tuple[str, ...]) -> list[Column]:
    """The order of search results, total because ids are unique: strength of the match, qualified name, id."""
    return [F.array_position(F.array(*[F.lit(r) for r in ranks]), results["match"]), results["qualified_name"], results["entity_id"]]
