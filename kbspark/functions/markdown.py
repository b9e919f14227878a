"""Markdown pages as expressions: front matter, sections, titles, findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings that hold links or the overview, page types, states and limits of the page format.
RESERVED = ("outgoing links", "external links")
OVERVIEW = "overview"
TYPES = ("architecture", "api", "guide", "reference", "runbook", "concept")
STATES = ("stub", "developing", "stable", "deprecated")
DEFAULT_TYPE, DEFAULT_STATE, MAX_TAGS, LEAD_MAX = "concept", "stub", 5, 250
KEYS = ("type", "title", "description", "status", "tags", "source", "updated")

_H2 = r"(?md)(?=^##[ \t]+\S)"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sections(text: Column) -> Column:
    """The ``##`` sections of a page: array of (ordinal, heading, body, start, body_start, stop), offsets in characters.

    ``body_start`` is the end of the heading's line; text before the first section belongs to none.
    """
    pieces = F.split(_text(text), _H2)
    # running ends: one pass that appends the last end plus a length; lambdas below see each piece and its start only
    ends = F.aggregate(F.transform(pieces, F.length), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def made(piece: Column, start: Column) -> Column:
        line = F.regexp_extract(piece, r"^([^\n]*)", 1)
        return F.struct(
            F.trim(F.regexp_replace(line, r"^##[ \t]+|[ \t]+$", "")).alias("heading"),
            F.substring(piece, F.length(line) + 2, F.length(piece)).alias("body"),
            start.alias("start"),
            (start + F.length(line)).alias("body_start"),
            (start + F.length(piece)).alias("stop"),
            F.startswith(piece, F.lit("##")).alias("is_section"),
        )

    found = F.filter(F.zip_with(pieces, ends, made), lambda s: F.coalesce(s["is_section"], F.lit(False)))
    return F.transform(found, lambda s, i: F.struct(i.alias("ordinal"), *[s[c].alias(c) for c in ("heading", "body", "start", "body_start", "stop")]))


def section_hash(body: Column) -> Column:
    """What an optimistic edit of a section is checked against: the body without line ends around it."""
    return F.substring(F.sha2(F.regexp_replace(body, r"^\n+|\n+$", ""), 256), 1, 16)


def front_matter(text: Column) -> tuple[Column, Column]:
    """The metadata block's lines as a map, list items joined by commas, and the page below it.

    A page without a closed block has no metadata and is all body.
    """
    whole = r"(?s)\A---\n(.*?)\n---[ \t]*(?:\n|\z)(.*)\z"
    has = F.regexp_like(_text(text), F.lit(whole))
    block = F.regexp_replace(F.regexp_extract(_text(text), whole, 1), r"\n[ \t]*-[ \t]+", ",")
    lines = F.filter(F.split(block, "\n"), lambda x: F.regexp_like(x, F.lit(r"^[A-Za-z_]+:")))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[A-Za-z_]+:", "")), r"""^[\["',\s]+|[\]"'\s]+$""", "")
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([A-Za-z_]+):", 1)).alias("key"), value(x).alias("value")))
    # of a repeated key the last line counts
    last = F.filter(entries, lambda e: F.lit(True))
    distinct = F.filter(last, lambda e, i: ~F.exists(F.slice(last, i + 2, F.size(last)), lambda later: later["key"] == e["key"]))
    meta = F.when(has, F.map_from_entries(distinct)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return meta, F.when(has, F.regexp_extract(_text(text), whole, 2)).otherwise(_text(text))


def tag_list(value: Column) -> Column:
    """Distinct normalised tags of a comma-separated value, in order, ``MAX_TAGS`` at most."""
    tags = F.transform(F.split(_text(value), ","), lambda t: F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), r"[\s_\[\]]+", "-"), r"^-+|-+$|(?<=-)-+", ""))
    return F.slice(F.array_distinct(F.filter(tags, lambda t: t != "")), 1, MAX_TAGS)


def page_type(value: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit(DEFAULT_TYPE))


def page_state(value: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit(DEFAULT_STATE))


def title(body: Column, slug: Column) -> Column:
    """The first ``#`` heading before the sections, or else the words of the slug's last part."""
    head = F.get(F.split(_text(body), _H2), F.lit(0))
    named = F.trim(F.regexp_extract(F.when(F.startswith(head, F.lit("##")), F.lit("")).otherwise(head), r"(?md)^#[ \t]+([^\n]*)$", 1))
    return F.coalesce(F.nullif(named, F.lit("")), F.trim(F.regexp_replace(F.element_at(F.split(slug, "/"), -1), "[-_]", " ")))


def description(body: Column) -> Column:
    """The overview's text if the first section is the overview, otherwise empty."""
    first = F.get(sections(body), F.lit(0))
    return F.when(F.lower(first["heading"]) == OVERVIEW, collapse(first["body"])).otherwise(F.lit(""))


def render(meta: Column, body: Column) -> Column:
    """A page from metadata and body: keys in fixed order, empty ones left out, tags as a list."""
    line = lambda k: F.when(_text(meta[k]) != "", F.concat(F.lit(f"{k}: "), F.concat(F.lit("["), F.array_join(tag_list(meta[k]), ", "), F.lit("]")) if k == "tags" else meta[k]))
    lines = F.array_compact(F.array(*[line(k) for k in KEYS]))
    return F.when(F.size(lines) == 0, body).otherwise(F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body))


def _once(value: Column, made) -> Column:
    """``made(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def page_findings(text: Column) -> Column:
    """What is wrong with a page's form: array of (finding, severity, detail); ``block`` findings refuse an edit."""
    meta, body = front_matter(text)
    # the first paragraph, its lines trimmed and joined
    lead = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_extract(s["body"], r"(?s)\A\s*(.*?)(?:\n\s*\n|\z)", 1), r"\s*\n\s*", " "), r"\s+$", "")
    prose = lambda b: F.transform(F.filter(sections(b), lambda s: ~F.lower(s["heading"]).isin(*RESERVED)), lambda s: F.struct(s["heading"].alias("heading"), lead(s).alias("lead")))
    # nothing around an explode is computed once by itself, and each use of a part would go through the text anew
    return _once(F.struct(meta.alias("meta"), body.alias("body")), lambda p: _once(prose(p["body"]), lambda own: _findings(p["meta"], p["body"], own)))


def _findings(meta: Column, body: Column, prose: Column) -> Column:
    pre = F.get(F.split(body, _H2), F.lit(0))
    pre = F.when(F.startswith(pre, F.lit("##")), F.lit("")).otherwise(pre)
    finding = lambda name, severity, detail="": F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    one = lambda cond, *what: F.when(cond, F.array(finding(*what))).otherwise(F.array().cast("array<struct<finding:string,severity:string,detail:string>>"))
    known = F.size(F.map_keys(meta)) > 0
    return F.concat(
        one(F.regexp_like(body, F.lit(r"(?md)^#{3,}[ \t]+\S")), "deep_heading", "block"),
        one(F.exists(F.split(pre, "\n"), lambda x: (F.trim(x) != "") & ~F.regexp_like(x, F.lit(r"^#[ \t]"))), "pre_h2_text", "block"),
        F.transform(F.filter(prose, lambda s: s["lead"] == ""), lambda s: finding("missing_lead", "advisory", s["heading"])),
        F.transform(F.filter(prose, lambda s: F.length(s["lead"]) > LEAD_MAX), lambda s: finding("long_lead", "advisory", s["heading"])),
        one(known & (_text(meta["type"]) == ""), "missing_type", "advisory"),
        one(known & (_text(meta["type"]) != "") & ~meta["type"].isin(*TYPES), "unknown_type", "advisory", meta["type"]),
        one(known & (_text(meta["description"]) == ""), "missing_description", "advisory"),
        one(known & (_text(meta["status"]) != "") & ~page_state(meta["status"]).isin(*STATES), "unknown_status", "advisory", meta["status"]),
    )
