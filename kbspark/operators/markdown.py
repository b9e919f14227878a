"""Sections, edits, front matter, links and anchors of Markdown pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import content_hash, slugify


def page_sections(pages: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """A row for each section, with offsets and the hash of its body; a null page has none."""
    rows = pages.select(key, F.explode(md.sections(F.col(text))).alias("s")).select(key, "s.*")
    return rows.withColumn("section_hash", md.section_hash(F.col("body")))


def section_chunks(pages: DataFrame, size: int, overlap: int, key: str = "slug", text: str = "markdown") -> DataFrame:
    """What is embedded of a page: its description as summary (ordinal -1), then word windows of its sections.

    Sections of links and the overview are left out before sections are numbered; windows of sections with one heading
    are numbered on. Everything is made inside a page's row.
    """
    meta, body = md.front_matter(F.col(text))
    kept = F.filter(md.sections(body), lambda s: ~F.lower(s["heading"]).isin(md.OVERVIEW, *md.RESERVED))
    step = max(1, size - overlap)

    def windows(s: Column, ordinal: Column) -> Column:
        words = F.filter(F.split(s["body"], r"\s+"), lambda w: w != "")
        piece = lambda w, at: F.concat(F.lit("## "), s["heading"], F.lit("\n"), F.array_join(F.slice(w, at + 1, F.lit(size)), " "))
        last = lambda w: F.when(F.size(w) <= size, F.lit(0)).otherwise(F.size(w) - 1)
        row = lambda w, at: F.struct(s["heading"].alias("heading"), ordinal.cast("int").alias("ordinal"), piece(w, at).alias("body"))
        # an array of the words alone binds them, so that they are split once
        return F.flatten(F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), last(w), F.lit(step)), lambda at: row(w, at))))

    made = pages.select(key, md.collapse(F.coalesce(meta["description"], F.lit(""))).alias("summary"), F.flatten(F.transform(kept, windows)).alias("w"))
    # windows of a heading stand together in an order by heading, so that a place less that of its heading's first is a number
    by_heading = F.array_sort(F.transform("w", lambda x, i: F.struct(x["heading"].alias("heading"), i.alias("at"), x["ordinal"].alias("ordinal"), x["body"].alias("body"))))
    firsts = F.map_from_entries(F.array_compact(F.transform("_sorted", lambda x, i: F.when((i == 0) | (F.get("_sorted", i - 1)["heading"] != x["heading"]), F.struct(x["heading"], i)))))
    made = made.withColumn("_sorted", by_heading).withColumn("_firsts", firsts)
    numbered = F.transform("_sorted", lambda x, i: F.struct(x["heading"].alias("heading"), x["ordinal"].alias("ordinal"), x["body"].alias("body"), (i - F.element_at("_firsts", x["heading"])).alias("chunk")))
    summary = F.when(F.col("summary") != "", F.array(F.struct(F.lit("").alias("heading"), F.lit(-1).alias("ordinal"), F.col("summary").alias("body"), F.lit(0).alias("chunk"))))
    empty = F.array().cast("array<struct<heading:string,ordinal:int,body:string,chunk:int>>")
    rows = made.select(key, F.explode(F.concat(F.coalesce(summary, empty), numbered)).alias("c")).select(key, "c.*")
    return rows.withColumn("hash", content_hash(F.col("body")))


EDIT = "op string, heading string, body string, target string, expected string, before string, new_heading string"


def _bound(value: Column, made) -> Column:
    """``made(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def edit_step(page: Column, e: Column) -> Column:
    """The struct (status, markdown) of a page's text after the edit ``e`` with the fields of ``EDIT``."""
    name = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^#+", ""))
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\n+|\n+$", "")
    ahead = lambda c: F.when((c == "") | c.endswith("\n\n"), c).otherwise(F.concat(F.regexp_replace(c, r"\n+$", ""), F.lit("\n\n")))
    part = lambda low, high: F.substring(page, low + 1, high - low)

    def judged(all_: Column) -> Column:
        found = lambda wanted: F.filter(all_, lambda s: s["heading"] == wanted)
        return _bound(F.struct(name(e["heading"]).alias("h"), name(F.coalesce(e["target"], e["before"])).alias("t"), name(F.coalesce(e["new_heading"], e["heading"])).alias("named")), lambda n: _bound(F.struct(found(n["h"]).alias("mine"), found(n["t"]).alias("to")), lambda f: done(all_, n, f["mine"], f["to"])))

    def done(all_: Column, n: Column, mine: Column, to: Column) -> Column:
        op, own, there = e["op"], F.get(mine, F.lit(0)), F.get(to, F.lit(0))
        placed = op.isin("insert", "move")
        heads = F.regexp_extract_all(page, F.lit(r"(?md)^(#{1,6}[ \t]+[^\n]*)$"), F.lit(1))
        # a page's own heading may keep its anchor: it counts as often as it stands there under its own name
        anchors = F.transform(heads, lambda x: slugify(F.regexp_replace(x, r"^#{1,6}[ \t]+", "")))
        taken = F.size(F.filter(anchors, lambda x: x == slugify(n["named"]))) > F.when((op == "replace") & (slugify(n["h"]) == slugify(n["named"])), 1).otherwise(0)
        status = (
            F.when((op != "insert") & (F.size(mine) == 0), "missing")
            .when((op != "insert") & (F.size(mine) > 1), "ambiguous")
            .when(placed & e["target"].isNotNull() & e["before"].isNotNull(), "ambiguous")
            .when(placed & (n["t"] != "") & (F.size(to) == 0), "missing")
            .when(placed & (F.size(to) > 1), "ambiguous")
            .when((op != "insert") & e["expected"].isNotNull() & (e["expected"] != md.section_hash(own["body"])), "conflict")
            .when(op.isin("replace", "insert") & F.regexp_like(F.coalesce(e["body"], F.lit("")), F.lit(r"(?md)^##[ \t]+\S")), "nested")
            .when(op.isin("replace", "insert") & (slugify(n["named"]) == ""), "missing")
            .when(((op == "insert") | ((op == "replace") & e["new_heading"].isNotNull())) & taken, "collision")
            .when(op.isin("delete", "move") & F.lower(n["h"]).isin(md.OVERVIEW, *md.RESERVED), "reserved")
            .when((op == "delete") & (F.size(all_) <= 1), "last")
            .when((op == "move") & (n["t"] == n["h"]), "collision")
            .when(~op.isin("replace", "insert", "delete", "move"), "unknown")
            .otherwise("ok")
        )
        end = F.length(page)
        at = F.when(n["t"] == "", end).when(e["target"].isNull(), there["start"]).otherwise(there["stop"])
        block = F.concat(F.regexp_replace(part(own["start"], own["stop"]), r"\n+$", ""), F.lit("\n\n"))
        up = F.concat(ahead(part(F.lit(0), at)), block, part(at, own["start"]), part(own["stop"], end))
        down = F.concat(ahead(F.concat(part(F.lit(0), own["start"]), part(own["stop"], at))), block, part(at, end))
        line = F.when(e["new_heading"].isNotNull(), F.concat(F.lit("## "), n["named"])).otherwise(part(own["start"], own["body_start"]))
        edited = (
            F.when(op == "replace", F.concat(part(F.lit(0), own["start"]), line, F.lit("\n\n"), strip(e["body"]), F.lit("\n\n"), part(own["stop"], end)))
            .when(op == "insert", F.concat(ahead(part(F.lit(0), at)), F.lit("## "), n["h"], F.lit("\n\n"), strip(e["body"]), F.lit("\n\n"), part(at, end)))
            .when(op == "delete", F.concat(part(F.lit(0), own["start"]), part(own["stop"], end)))
            .otherwise(F.when(at <= own["start"], up).otherwise(down))
        )
        return _bound(status, lambda s: F.struct(s.alias("status"), F.when(s == "ok", edited).otherwise(page).alias("markdown")))

    return _bound(md.sections(page), judged)


def _edit(edits: DataFrame) -> Column:
    have = {f.split()[0]: f.split()[1] for f in EDIT.split(", ")}
    return F.struct(*[(F.col(c) if c in edits.columns else F.lit(None)).cast(t).alias(c) for c, t in have.items()])


def edit_sections(pages: DataFrame, edits: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Apply one edit to each page: ``edits(slug, op, heading, body, target, expected)``, op replace, insert, delete or move.

    ``insert`` and ``move`` put the section behind ``target``, before ``before`` (if there is such a column), or at the end
    without either; ``replace`` may give a ``new_heading``. Status ``ok``, or why the page stays as it is: ``missing``,
    ``ambiguous`` (of heading or target), ``conflict`` (the section's hash is not ``expected``), ``nested`` (a body with a
    heading), ``collision`` (a new heading's anchor exists), ``reserved`` or ``last`` (a section that stays), ``unknown`` op.
    Pages without an edit are left out; ``fold_edits`` keeps them.
    """
    j = pages.select(key, F.col(text).alias("_page")).join(edits.select(key, _edit(edits).alias("_edit")), key)
    return j.select(key, edit_step(F.col("_page"), F.col("_edit")).alias("_e")).select(key, "_e.status", F.col("_e.markdown").alias(text))


def fold_edits(pages: DataFrame, edits: DataFrame, key: str = "slug", text: str = "markdown", seq: str = "seq") -> DataFrame:
    """Each page after all its edits in the order of ``seq``, each made on what those before it left: (key, text, answers).

    ``answers`` are (seq, status) as ``edit_sections`` says; an edit that is refused changes nothing and the next ones go
    on. Pages without edits stay as they are, edits of a page that is not there are answered ``missing``. Of edits with
    equal ``seq`` the order is that of their fields. A page's edits come together in its row, as each needs the last.
    """
    own = edits.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).cast("long").alias("seq"), _edit(edits).alias("e")))).alias("_edits"))
    j = pages.select(key, F.col(text).alias("_page")).join(own, key, "full_outer")
    none = F.array().cast("array<struct<seq:bigint,status:string>>")

    def step(acc: Column, x: Column) -> Column:
        return _bound(edit_step(acc["markdown"], x["e"]), lambda r: F.struct(r["markdown"].alias("markdown"), F.concat(acc["answers"], F.array(F.struct(x["seq"].alias("seq"), r["status"].alias("status")))).alias("answers")))

    folded = F.aggregate("_edits", F.struct(F.col("_page").alias("markdown"), none.alias("answers")), step)
    j = j.select(key, F.when(F.col("_edits").isNull(), F.struct(F.col("_page").alias("markdown"), none.alias("answers"))).otherwise(folded).alias("_f"))
    return j.select(key, F.col("_f.markdown").alias(text), "_f.answers")


def conformed_pages(pages: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Pages whose front matter is not in its normal form, rewritten: (key, rewritten).

    What is written counts before what is derived: the type and state in lower case or by default, tags normalised, the
    title of the first heading or the slug, the description of the overview. Rewriting twice changes nothing more.
    """
    meta, body = md.front_matter(F.col(text))
    own = pages.select(key, text, meta.alias("m"), body.alias("b"))
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col("m")[c]), F.lit("")), F.lit(""))
    or_else = lambda c, other: F.when(value(c) != "", value(c)).otherwise(other)
    made = {
        "type": md.page_type(value("type")),
        "title": or_else("title", md.title(F.col("b"), F.col(key))),
        "description": or_else("description", md.description(F.col("b"))),
        "status": md.page_state(value("status")),
        "tags": F.array_join(md.tag_list(F.col("m")["tags"]), ","),
        "source": value("source"),
        "updated": value("updated"),
    }
    full = F.create_map(*[x for k, v in made.items() for x in (F.lit(k), v)])
    # Behind a generator the comparison stays above what it compares; pushed down, it would make all of it anew for each use.
    both = F.explode(F.array(F.struct(F.coalesce(text, F.lit("")).alias("was"), md.render(full, F.col("b")).alias("rewritten"))))
    return own.select(key, both.alias("r")).filter("r.rewritten <> r.was").select(key, "r.rewritten")


_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})([^\n]*)")
_TICKS = re.compile(r"`+")


def mask_code(text: str) -> str:
    """The text with what stands in fenced or inline code blanked out, so that offsets stay."""
    out, fence = [], None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            closes = m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip()
            fence = None if closes else fence
            line = " " * len(line)
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence, line = m[1], " " * len(line)
        out.append(line)
    masked = "\n".join(out)
    at, parts = 0, []
    while m := _TICKS.search(masked, at):
        # a run of backticks closes at the next run of the same length
        end = next((x for x in _TICKS.finditer(masked, m.end()) if len(x[0]) == len(m[0])), None)
        stop = end.end() if end else m.end()
        inside = masked[m.start() : stop]
        parts += [masked[at : m.start()], re.sub(r"[^\n]", " ", inside) if end else inside]
        at = stop
    return "".join(parts) + masked[at:]


_LINK = re.compile(r"(?P<image>!?)\[[^\]]*\]\((?P<target>[^)\s]+)\)|\[\[(?P<wiki>[^\]|]+)(?:\|[^\]]*)?\]\]")


def page_links(text: str | None) -> list[tuple[int, str, str, bool]]:
    """Links to other pages outside code: position, target page, fragment, whether in the old ``[[page]]`` form.

    Images, links with a scheme and unsafe paths are none; a link may leave out ``.md``.
    """
    found = []
    for m in _LINK.finditer(mask_code(text or "")):
        raw = m["wiki"] or m["target"]
        page, _, fragment = (unquote(raw) if m["target"] else raw.strip()).partition("#")
        if m["image"] or re.match(r"[A-Za-z][\w+.-]*:", page) or page.startswith("/") or "\\" in page:
            continue
        page = page.removesuffix(".md")
        if any(part in ("", ".", "..") for part in page.split("/")) if page else not fragment:
            continue
        found.append((m.start(), page, fragment, bool(m["wiki"])))
    return found


def _found(pages: DataFrame, key: str, text: str, find, schema: str) -> DataFrame:
    """A row for each thing that ``find`` tells of a page's text, in Arrow batches."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    key_type = next(f.dataType.simpleString() for f in pages.schema.fields if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                told = find(batch.column(1)[i].as_py())
                rows += told
                at += [i] * len(told)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["_key", *names])

    return pages.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {key_type}, {schema}").withColumnRenamed("_key", key)


def link_targets(pages: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Distinct links of each page: target page (the page itself for a bare fragment), anchor, first position, old form."""
    rows = _found(pages, key, text, page_links, "at int, _named string, fragment string, legacy boolean")
    page = F.when(F.col("_named") == "", F.col(key)).otherwise(F.col("_named"))
    rows = rows.select(key, page.alias("target"), slugify(F.col("fragment")).alias("anchor"), "at", "legacy")
    return rows.groupBy(key, "target", "anchor").agg(F.min("at").alias("at"), F.max("legacy").alias("legacy"))


_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(\S[^\n]*)$", re.M)


def heading_anchors(pages: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """The anchors of each page's headings outside code; of headings with one anchor the first names it."""
    rows = _found(pages, key, text, lambda t: [(i, m[1]) for i, m in enumerate(_HEADING.finditer(mask_code(t or "")))], "at int, heading string")
    rows = rows.withColumn("heading", F.trim(F.regexp_replace("heading", r"(^|[ \t]+)#+[ \t]*$", ""))).withColumn("anchor", slugify(F.col("heading"))).filter("anchor <> ''")
    return rows.groupBy(key, "anchor").agg(F.min_by("heading", "at").alias("heading"))


def link_spans(text: str | None) -> list[tuple[int, int, str, str, str, bool]]:
    """Where links outside code name a page: start and end of the name with its ending, the page, what follows the page
    within the link, the label, and whether it is in the old form. Images and links with a scheme are none."""
    found = []
    for m in _LINK.finditer(mask_code(text or "")):
        group = "wiki" if m["wiki"] else "target"
        raw = m[group]
        if m["image"] or re.match(r"[A-Za-z][\w+.-]*:", raw):
            continue
        name, sep, rest = raw.partition("#")
        page = name.strip() if m["wiki"] else name.removeprefix("./")
        label = text[m.start() + 2 : m.end() - 2].partition("|")[2] if m["wiki"] else ""
        found.append((m.start(group), m.start(group) + len(name), page.removesuffix(".md"), sep + rest, label.strip(), bool(m["wiki"])))
    return found


_SPAN = "start int, stop int, _named string, rest string, label string, legacy boolean"


def spliced(pages: DataFrame, spans: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Pages with each of ``spans(key, start, stop, new)`` of their text replaced, and how many were: (key, text, changed).

    All spans of a page are put in at once, in order; they must not overlap. Pages without spans stay as they are.
    """
    own = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "new"))).alias("_spans"))
    j = pages.select(key, F.col(text).alias("_page")).join(own, key, "left").withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<start:int,stop:int,new:string>>")))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_spans", i - 1)["stop"])
    pieces = F.transform("_spans", lambda x, i: F.concat(F.substring(F.col("_page"), before(i) + 1, x["start"] - before(i)), x["new"]))
    last = F.coalesce(F.element_at("_spans", F.when(F.size("_spans") > 0, -1).otherwise(None))["stop"], F.lit(0))
    tail = F.substring(F.col("_page"), last + 1, F.length("_page"))
    return j.select(key, F.when(F.size("_spans") == 0, F.col("_page")).otherwise(F.concat(F.array_join(pieces, ""), tail)).alias(text), F.size("_spans").alias("changed"))


def rewrite_links(pages: DataFrame, moves: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Pages whose links to a moved page name its new place: ``moves(old, new)`` -> (key, text, changed).

    Only the page's name within a link is replaced, so labels, anchors, code and images stay; ``[a](old.md#x)``,
    ``[a](./old)`` and ``[[old#x|a]]`` are all followed. Links meet the moves in a join, however many there are; of several
    new places of one page the first by name counts, and a move onto itself is none.
    """
    once = moves.filter("old is not null and new is not null and old <> new").groupBy("old").agg(F.min("new").alias("new"))
    spans = _found(pages, key, text, link_spans, _SPAN).join(once, F.col("_named") == F.col("old"))
    new = F.when(F.col("legacy"), F.col("new")).otherwise(F.concat("new", F.lit(".md")))
    return spliced(pages, spans.select(key, "start", "stop", new.alias("new")), key, text)


def modern_links(pages: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Pages with links in the old form as Markdown links: (key, text, changed). Doing it twice changes nothing more.

    ``[[page#Heading|label]]`` becomes ``[label](page.md#heading)``; without a label the heading or the page is shown.
    """
    spans = _found(pages, key, text, link_spans, _SPAN).filter("legacy")
    heading = F.trim(F.substr(F.col("rest"), F.lit(2)))
    shown = F.coalesce(F.nullif("label", F.lit("")), F.nullif(heading, F.lit("")), F.col("_named"))
    anchor = F.when(heading != "", F.concat(F.lit("#"), slugify(heading))).otherwise("")
    whole = F.concat(F.lit("["), shown, F.lit("]("), "_named", F.lit(".md"), anchor, F.lit(")"))
    # the whole of [[...]]: the name begins behind two brackets, the rest and a label end before two
    stop = F.position(F.lit("]]"), F.col("_text"), F.col("stop") + 1) + 1
    j = spans.join(pages.select(key, F.col(text).alias("_text")), key)
    return spliced(pages, j.select(key, (F.col("start") - 2).alias("start"), stop.cast("int").alias("stop"), whole.alias("new")), key, text)


def link_report(pages: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Links to pages or anchors that are not there, pages in the old link form, and pages that no other page links to."""
    links, anchors = link_targets(pages, key, text), heading_anchors(pages, key, text)
    known = pages.select(F.col(key).alias("target"))
    detail = F.when(F.col("anchor") == "", F.col("target")).otherwise(F.concat_ws("#", "target", "anchor"))
    row = lambda df, name, what: df.select(F.col(key), F.lit(name).alias("finding"), what.alias("detail"))
    broken = row(links.join(known, "target", "left_anti"), "broken_page", detail)
    there = links.filter("anchor <> ''").join(known, "target", "left_semi")
    lost = row(there.join(anchors.select(F.col(key).alias("target"), "anchor"), ["target", "anchor"], "left_anti"), "broken_anchor", detail)
    old = row(links.filter("legacy").select(key).distinct(), "legacy_link", F.lit(""))
    linked = links.filter(F.col(key) != F.col("target")).select(F.col("target").alias(key)).distinct()
    return broken.union(lost).union(old).union(row(pages.join(linked, key, "left_anti"), "orphan", F.lit("")))
