"""The health report of a domain as one tall table of findings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..sources.versioned import staged
from . import markdown, quality
from .catalog import RESERVED_FILES

#: The kinds of findings.
KINDS = ("broken", "orphan", "stale", "missing_source", "legacy_link", "section", "missing_front_matter", "tag_drift", "reserved_target", "unavailable_domain")


def cross_links(pages: DataFrame, scheme: str, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Links ``scheme://domain/page.md#anchor`` outside code: (key, domain, page, anchor), each once."""
    link = re.compile(rf"(!?)\[[^\]]*\]\({re.escape(scheme)}://([^/\s)]+)/([^\s)#]+)(?:#([^\s)]*))?\)")
    find = lambda t: [(m[2], m[3].removesuffix(".md"), m[4] or "") for m in link.finditer(markdown.mask_code(t or "")) if not m[1]]
    found = markdown._found(pages, key, text, find, "_domain string, _named string, _anchor string")
    return found.select(key, F.col("_domain").alias("domain"), F.col("_named").alias("page"), F.col("_anchor").alias("anchor")).distinct()


def lint_findings(pages: DataFrame, domain: str, visible: DataFrame, states: DataFrame, scheme: str = "wiki") -> DataFrame:
    """All findings of ``pages(slug, markdown)`` of one domain: ``(kind, page, detail)``.

    ``visible(domain, page, anchor)`` are the pages and anchors of the domains that can be seen, the own one among them (a
    row with an empty anchor for each page); ``states(page, state)`` tell pages that are ``stale`` or lack their source.
    Links to a page or anchor that is not there are ``broken``, to a generated page ``reserved_target``, into a domain that
    cannot be seen ``unavailable_domain``. A page that no other page of the domain links to is an ``orphan``. A null page is
    an empty one.
    """
    own = pages.select("slug", F.coalesce("markdown", F.lit("")).alias("markdown"))
    # links are tables: five findings read them, each of which would go through all texts again
    targets = staged(markdown.link_targets(own))
    inner = targets.select("slug", F.lit(domain).alias("to"), F.col("target").alias("page"), "anchor", F.lit(True).alias("inner"))
    outer = cross_links(own, scheme).select("slug", F.col("domain").alias("to"), "page", "anchor", F.lit(False).alias("inner"))
    links = inner.union(staged(outer))
    reserved = F.element_at(F.split("page", "/"), -1).isin(*[f.removesuffix(".md") for f in RESERVED_FILES])
    ref = F.concat(F.when(F.col("to") == domain, F.lit("")).otherwise(F.concat("to", F.lit("/"))), "page", F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(""))
    row = lambda df, kind, page, detail: df.select(F.lit(kind).alias("kind"), F.col(page).alias("page") if page else F.lit(None).cast("string").alias("page"), detail.alias("detail"))

    plain = links.filter(~reserved)
    domains = visible.select(F.col("domain").alias("to")).distinct()
    seen = plain.join(domains, "to", "left_semi")
    there = visible.select(F.col("domain").alias("to"), "page", "anchor").distinct()
    broken = seen.join(there, ["to", "page", "anchor"], "left_anti")
    linked = inner.filter("slug <> page").filter(~reserved).select(F.col("page").alias("slug")).distinct()
    meta, _ = md.front_matter(F.col("markdown"))
    fields = own.select("slug", "markdown", meta.alias("meta"))
    tags = fields.select(F.explode(md.tag_list(F.col("meta")["tags"])).alias("tag")).distinct()
    sections = own.select("slug", F.explode(md.page_findings(F.col("markdown"))).alias("f"))
    out = [
        row(broken, "broken", "slug", ref),
        row(links.filter(reserved), "reserved_target", "slug", ref),
        row(plain.join(domains, "to", "left_anti"), "unavailable_domain", "slug", ref),
        row(own.join(linked, "slug", "left_anti"), "orphan", "slug", F.lit("")),
        row(targets.filter("legacy").select("slug").distinct(), "legacy_link", "slug", F.lit("")),
        row(sections, "section", "slug", F.concat_ws(" ", "f.finding", "f.detail")),
        row(fields.filter(F.size("meta") == 0), "missing_front_matter", "slug", F.lit("")),
        row(quality.tag_drift(tags), "tag_drift", None, F.concat_ws(" ", "a", "b")),
        states.filter("state in ('stale', 'missing_source')").select(F.col("state").alias("kind"), F.col("page").cast("string").alias("page"), F.lit("").alias("detail")),
    ]
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.distinct()
