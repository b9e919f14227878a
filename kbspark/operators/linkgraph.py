"""A link graph kept up to date: pages, links by their source, links by their target with what they resolve to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from ..sources.versioned import staged
from .catalog import page_snapshot
from .quality import set_revision


def _resolved(links: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links by target with their state: ``ok``, ``broken_page`` or ``broken_anchor``."""
    j = links.select("target", "source", "anchor").distinct().join(pages.select(F.col("page").alias("target"), F.lit(True).alias("_page")), "target", "left")
    j = j.join(anchors.select(F.col("page").alias("target"), "anchor", F.lit(True).alias("_anchor")).distinct(), ["target", "anchor"], "left")
    state = F.when(F.col("_page").isNull(), "broken_page").when((F.col("anchor") != "") & F.col("_anchor").isNull(), "broken_anchor").otherwise("ok")
    return j.select("target", "source", "anchor", state.alias("state"))


def refresh_links(store: Snapshots, pages: DataFrame, links: DataFrame, anchors: DataFrame, gone: DataFrame, more: dict[str, dict] | None = None) -> dict:
    """Replace ``pages(page, hash)`` with their ``links(source, target, anchor)`` and ``anchors(page, anchor)``, drop the
    pages of ``gone(page)``, and commit all four tables as one version.

    Of the links of other pages only those to a page that has changed, come or gone are resolved again; they are found by
    their target. Buckets without such a page are neither read nor written. A page in both tables is replaced.
    ``more`` are entries of other tables for the same version.
    """
    base = store.manifest()
    new = staged(pages.dropDuplicates(["page"]))
    gone = staged(gone.select("page").distinct().join(new.select("page"), "page", "left_anti"))
    changed = staged(new.select("page").union(gone))
    links = staged(links.join(new.select(F.col("page").alias("source")), "source", "left_semi").select("source", "target", "anchor").distinct())
    anchors = staged(anchors.join(new.select("page"), "page", "left_semi").select("page", "anchor").distinct())
    tables = {
        "pages": store.replaced(base, "pages", "page", new, gone),
        "anchors": store.replaced(base, "anchors", "page", anchors, changed),
        "links": store.replaced(base, "links", "source", links, changed.withColumnRenamed("page", "source")),
    }
    after = {**base, "tables": {**base["tables"], **tables}}

    touched = links.select("target").union(changed.withColumnRenamed("page", "target"))
    old_links = store.read(base, "links")
    if old_links is not None:  # what the changed pages pointed to before
        touched = touched.union(old_links.join(changed.withColumnRenamed("page", "source"), "source", "left_semi").select("target"))
    touched = staged(touched.distinct())
    into = links
    old_into = store.read(base, "incoming")
    if old_into is not None:
        others = old_into.join(touched, "target", "left_semi").join(changed.withColumnRenamed("page", "source"), "source", "left_anti")
        into = into.unionByName(others.select("source", "target", "anchor"))
    known, marks = (store.read(after, t).join(touched.withColumnRenamed("target", "page"), "page", "left_semi") for t in ("pages", "anchors"))
    tables["incoming"] = store.replaced(base, "incoming", "target", _resolved(into, known, marks), touched)
    return store.commit(base, {**tables, **(more or {})}, note={"changed": changed.count()})


def refresh_domains(store: Snapshots, pages: DataFrame) -> tuple[dict, DataFrame]:
    """Bring the link graph of ``pages(domain, file, markdown)`` up to date, domain by domain: the version, and the domains
    that were not current (``stale``, ``new`` or ``gone``).

    A domain is current as long as the order-free hash of its files' texts is the one that its version was built from; pages
    of current domains are hashed, but neither parsed nor written. Within a domain that is not, pages with the same text keep
    their links too.
    """
    base = store.manifest()
    texts = pages.select("domain", "file", F.coalesce("markdown", F.lit("")).alias("markdown"))
    now = staged(set_revision(texts, "file", F.col("markdown"), by=("domain",)).select("domain", "revision"))
    stored = store.read(base, "domains")
    before = now.select("domain", F.lit(None).cast("string").alias("was")).filter("false") if stored is None else stored.select("domain", F.col("revision").alias("was"))
    both = now.join(before, "domain", "full_outer").filter("not (revision <=> was)")
    state = F.when(F.col("was").isNull(), "new").when(F.col("revision").isNull(), "gone").otherwise("stale")
    wrong = staged(both.select("domain", state.alias("state")))
    if wrong.isEmpty():
        return base, wrong
    own, anchors, edges = page_snapshot(texts.join(wrong, "domain", "left_semi"))
    own = staged(own.select("page", "domain", "content_hash"))
    old = store.read(base, "pages")
    if old is None:
        changed, gone = own, own.filter("false")
    else:
        theirs = staged(old.join(wrong.select("domain"), "domain", "left_semi").select("page", F.col("content_hash").alias("_was")))
        changed = own.join(theirs, "page", "left").filter("not (content_hash <=> _was)").select(own.columns)
        gone = theirs.join(own, "page", "left_anti")
    fresh = now.join(wrong, "domain", "left_semi")
    domains = store.replaced(base, "domains", "domain", fresh, wrong.filter("state = 'gone'"))
    return refresh_links(store, changed, edges.select("source", "target", "anchor"), anchors.select("page", "anchor"), gone, {"domains": domains}), wrong
