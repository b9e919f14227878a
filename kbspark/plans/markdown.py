"""Markdown queries over pages made from ``documents`` and with sections, links and front matter of known kinds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..operators import markdown as m
from .registry import derived, query, table

_D = "CAST(doc_id AS STRING)"


def _lines(*lines: str) -> str:
    """A text of lines; ``{x}`` in a line stands for an SQL expression."""
    quoted = ["'" + re.sub(r"\{([^}]*)\}", lambda m: "' || " + m[1] + " || '", line) + "'" for line in lines]
    return f"concat_ws(chr(10), {', '.join(quoted)})"


_FLAT = "replace(coalesce(text, ''), chr(10), ' ')"
_KINDS = [
    _lines("---", "type: Guide", "tags: [First Steps, first_steps, {upper(lang)}]", "---", "# Page {" + _D + "}", "", "## Overview", "", "What  {source} does.", "", "## Install", "", "Run the tool {" + _D + "}.", "See [use](guide/d{CAST(doc_id + 4 AS STRING)}.md#next-step) and [gone](guide/d{CAST(doc_id + 1 AS STRING)}).", "", "## Outgoing links", "", "- [home](d1.md)"),
    _lines("# Using {" + _D + "}", "## Next step", "Read `[not](a/link.md)` and [home](d{CAST(doc_id + 1 AS STRING)}#top).", "```", "[code](no/where.md)", "## not a heading", "```", "## Last", "![image](pic.md) [site](https://example.com) [[guide/d{CAST(doc_id + 3 AS STRING)}|old form]] [[d2#Top]]"),
    _lines("---", "type: concept", "description: The page {" + _D + "}", "status: stable", "tags: []", "---", "Loose text", "### Deep", "## Empty", "", "## Top", "text", "## Top", "more {" + _FLAT + "}"),
    _lines("no sections at all {source}"),
    _lines("---", "type: odd", "status: weird", "---", "## References", "", "{" + _FLAT + "}"),
]
#: A page for each document, of one of six kinds; every fourth is in a folder, every sixth is null.
PAGES = f"(SELECT CASE doc_id % 4 WHEN 0 THEN 'guide/d' ELSE 'd' END || {_D} AS slug, CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_KINDS)) + " END AS markdown, CAST(doc_id % 6 AS INT) AS k, doc_id AS d FROM documents) AS pages"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PAGES).select("slug", "markdown")


DERIVED = "md AS (SELECT doc_id, '# ' || source || chr(10) || replace(text, chr(10), chr(10) || '## ') AS markdown FROM documents)"


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document whose further lines are section headings."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("markdown"))


LINES = """l AS (SELECT {key}, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS n FROM {source} WHERE markdown IS NOT NULL),
  marked AS (SELECT *, regexp_matches(line, '^##[ \\t]+\\S') AS head, sum(CASE WHEN regexp_matches(line, '^##[ \\t]+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY n) AS part,
    sum(length(line) + 1) OVER (PARTITION BY {key} ORDER BY n) - length(line) - 1 AS pos, max(n) OVER (PARTITION BY {key}) AS final FROM l),
  secs AS (SELECT {key}, (part - 1)::INT AS ordinal, trim(regexp_replace(min_by(line, n), '^##[ \\t]+', '')) AS heading, min(pos)::INT AS start,
    coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), '') AS inner_text, (max(pos + length(line) + CASE WHEN n = final THEN 0 ELSE 1 END))::INT AS stop
    FROM marked WHERE part > 0 GROUP BY {key}, part)"""
_TRIM = "regexp_replace(inner_text, '^\\n+|\\n+$', '', 'g')"


@query(f"WITH {DERIVED}, {LINES.format(key='doc_id', source='md')} SELECT doc_id, ordinal, heading, start, stop, left(sha256({_TRIM}), 16) AS section_hash FROM secs")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.page_sections(_derived(spark, sf_dir), "doc_id").select("doc_id", "ordinal", "heading", "start", "stop", "section_hash")


@query(f"WITH p AS (SELECT * FROM {PAGES}), {LINES.format(key='slug', source='p')} SELECT slug, ordinal, heading, start, stop, left(sha256({_TRIM}), 16) AS section_hash FROM secs")
def markdown_sections_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.page_sections(pages(spark, sf_dir)).select("slug", "ordinal", "heading", "start", "stop", "section_hash")


WANTED = f"(SELECT CASE doc_id % 4 WHEN 0 THEN 'guide/d' ELSE 'd' END || {_D} AS slug, CASE doc_id % 7 WHEN 0 THEN 'Last' WHEN 1 THEN 'Top' WHEN 2 THEN '## Empty' WHEN 3 THEN '# Install' WHEN 4 THEN 'References' ELSE 'Nope' END AS wanted FROM documents) AS wanted"


@query(f"""WITH p AS (SELECT * FROM {PAGES}), {LINES.format(key='slug', source='p')}
  SELECT w.slug, wanted, CASE count(heading) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN count(heading) = 1 THEN min(left(sha256({_TRIM}), 16)) END AS section_hash
  FROM {WANTED[:-len('wanted')] + 'w'} LEFT JOIN secs s ON s.slug = w.slug AND heading = trim(ltrim(wanted, '#')) GROUP BY w.slug, wanted""")
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section by its heading, with the hash that an edit must name."""
    wanted = derived(spark, sf_dir, WANTED).withColumn("heading", F.trim(F.regexp_replace("wanted", "^#+", "")))
    found = wanted.join(m.page_sections(pages(spark, sf_dir)), ["slug", "heading"], "left")
    n = F.count("ordinal")
    return found.groupBy("slug", "wanted").agg(F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous").alias("status"), F.when(n == 1, F.min("section_hash")).alias("section_hash"))


EDITS = """(SELECT slug, op, heading, body, target, expected FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'guide/d' ELSE 'd' END || CAST(doc_id AS STRING) AS slug, CASE doc_id % 6 WHEN 0 THEN 'replace' WHEN 1 THEN 'move' WHEN 3 THEN 'insert' ELSE 'delete' END AS op,
  CASE doc_id % 6 WHEN 0 THEN 'Install' WHEN 1 THEN 'Next step' WHEN 2 THEN 'Empty' WHEN 3 THEN 'Added' WHEN 4 THEN 'References' ELSE 'Top' END AS heading, CASE doc_id % 6 WHEN 0 THEN 'New text' WHEN 3 THEN 'Fresh ' || source END AS body,
  CAST(NULL AS STRING) AS target, CASE WHEN doc_id % 6 = 0 AND doc_id % 5 = 0 THEN '0000000000000000' END AS expected FROM documents) AS inner_edits) AS edits"""
_CUT = lambda heading: f"(SELECT e.markdown[start + 1:stop] FROM secs WHERE secs.slug = e.slug AND heading = '{heading}')"


@query(f"""WITH p AS (SELECT * FROM {PAGES}), {LINES.format(key='slug', source='p')}, e AS (SELECT slug, markdown, k, d FROM p)
  SELECT slug, CASE WHEN k = 5 THEN 'missing' WHEN k = 4 THEN 'last' WHEN k = 0 AND d % 5 = 0 THEN 'conflict' ELSE 'ok' END AS status, CASE
    WHEN k = 0 AND d % 5 <> 0 THEN replace(markdown, {_CUT('Install')}, '## Install' || chr(10) || chr(10) || 'New text' || chr(10) || chr(10))
    WHEN k = 1 THEN replace(markdown, {_CUT('Next step')}, '') || chr(10) || chr(10) || {_CUT('Next step')} || chr(10)
    WHEN k = 2 THEN replace(markdown, {_CUT('Empty')}, '')
    WHEN k = 3 THEN markdown || chr(10) || chr(10) || '## Added' || chr(10) || chr(10) || 'Fresh ' || substr(markdown, 20) || chr(10) || chr(10) ELSE markdown END AS markdown FROM e""")
def section_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.edit_sections(pages(spark, sf_dir), derived(spark, sf_dir, EDITS))


#: Three edits of every page in an order of their own, which see each other: a section is put in, changed, then a third moved behind it.
_CHAIN = "(" + " UNION ALL ".join(
    f"SELECT CASE doc_id % 4 WHEN 0 THEN 'guide/d' ELSE 'd' END || {_D} AS slug, {seq} AS seq, '{op}' AS op, '{heading}' AS heading, {body} AS body, {target} AS target, CAST(NULL AS STRING) AS expected FROM documents{which}"
    for seq, op, heading, body, target, which in [
        (9, "insert", "Second", "'three'", "CASE WHEN doc_id % 2 = 0 THEN 'First' END", ""),
        (5, "replace", "First", "'two ' || source", "CAST(NULL AS STRING)", ""),
        (3, "insert", "First", "'one'", "CAST(NULL AS STRING)", ""),
        (8, "delete", "First", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", " WHERE doc_id % 3 = 0"),
    ]
) + ") AS edits"


@query(f"""WITH p AS (SELECT pages.slug, k, d, rtrim(coalesce(markdown, ''), chr(10)) AS cut, documents.source FROM {PAGES} JOIN documents ON doc_id = d),
  f AS (SELECT *, CASE WHEN k = 5 OR cut = '' THEN '' ELSE cut || chr(10) || chr(10) END AS base, d % 3 = 0 AND k NOT IN (3, 5) AS gone, d % 3 = 0 AND k IN (3, 5) AS kept_last FROM p)
  SELECT slug, CASE WHEN gone AND d % 2 = 0 THEN base ELSE base || CASE WHEN gone THEN '' ELSE '## First' || chr(10) || chr(10) || 'two ' || source || chr(10) || chr(10) END || '## Second' || chr(10) || chr(10) || 'three' || chr(10) || chr(10) END AS markdown,
    CASE WHEN d % 3 <> 0 THEN '3:ok 5:ok 9:ok' WHEN kept_last THEN '3:ok 5:ok 8:last 9:ok' WHEN d % 2 = 0 THEN '3:ok 5:ok 8:ok 9:missing' ELSE '3:ok 5:ok 8:ok 9:ok' END AS answers FROM f""")
def section_edit_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several edits of each page, each made on what the one before it left; null pages are edited as empty ones."""
    made = derived(spark, sf_dir, PAGES).select("slug", F.coalesce("markdown", F.lit("")).alias("markdown"))
    folded = m.fold_edits(made, derived(spark, sf_dir, _CHAIN))
    return folded.withColumn("answers", F.array_join(F.transform("answers", lambda a: F.concat_ws(":", a["seq"], a["status"])), " "))


@query(f"""SELECT slug, CASE k WHEN 0 THEN 'guide' WHEN 4 THEN 'odd' ELSE 'concept' END AS type, CASE k WHEN 0 THEN 'first-steps,' || lang ELSE '' END AS tags, CASE k WHEN 0 THEN 'Page ' || d WHEN 1 THEN 'Using ' || d ELSE 'd' || d END AS title,
  CASE k WHEN 0 THEN 'What ' || source || ' does.' ELSE '' END AS overview FROM {PAGES} JOIN documents ON doc_id = d""")
def front_matter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta, body = md.front_matter(F.col("markdown"))
    p = pages(spark, sf_dir).select("slug", meta.alias("m"), body.alias("b"))
    return p.select("slug", md.page_type(F.col("m")["type"]).alias("type"), F.array_join(md.tag_list(F.col("m")["tags"]), ",").alias("tags"), md.title(F.col("b"), F.col("slug")).alias("title"), md.description(F.col("b")).alias("overview"))


@query(f"""WITH p AS (SELECT slug, k, length(trim(coalesce(text, ''))) AS n FROM {PAGES} JOIN documents ON doc_id = d), f AS (SELECT slug, unnest(CASE k WHEN 0 THEN [('unknown_type', 'advisory', 'Guide'), ('missing_description', 'advisory', '')]
    WHEN 2 THEN [('deep_heading', 'block', ''), ('pre_h2_text', 'block', ''), ('missing_lead', 'advisory', 'Empty'), CASE WHEN n > 245 THEN ('long_lead', 'advisory', 'Top') END] WHEN 3 THEN [('pre_h2_text', 'block', '')]
    WHEN 4 THEN [('unknown_type', 'advisory', 'odd'), ('missing_description', 'advisory', ''), ('unknown_status', 'advisory', 'weird'), CASE WHEN n > 250 THEN ('long_lead', 'advisory', 'References') WHEN n = 0 THEN ('missing_lead', 'advisory', 'References') END] END) AS x FROM p)
  SELECT slug, x[1] AS finding, x[2] AS severity, x[3] AS detail FROM f WHERE x IS NOT NULL""")
def page_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("slug", F.explode(md.page_findings(F.col("markdown"))).alias("f")).select("slug", "f.*")


@query(f"""WITH p AS (SELECT slug, coalesce(markdown, '') AS markdown, k, d, source, lang FROM {PAGES} JOIN documents ON doc_id = d), made AS (SELECT *, CASE k WHEN 0 THEN ['type: guide', 'title: Page ' || d, 'description: What ' || source || ' does.', 'status: stub', 'tags: [first-steps, ' || lang || ']']
    WHEN 2 THEN ['type: concept', 'title: d' || d, 'description: The page ' || d, 'status: stable'] WHEN 4 THEN ['type: odd', 'title: d' || d, 'status: weird'] ELSE ['type: concept', 'title: ' || CASE k WHEN 1 THEN 'Using ' ELSE 'd' END || d, 'status: stub'] END AS head FROM p)
  SELECT slug, '---' || chr(10) || array_to_string(head, chr(10)) || chr(10) || '---' || chr(10) || CASE WHEN k IN (0, 2, 4) THEN regexp_replace(markdown, '^---\n(?:[^\n]*\n)*?---\n', '') ELSE markdown END AS rewritten FROM made""")
def conformance_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.conformed_pages(pages(spark, sf_dir))


_MASKED = f"x AS (SELECT slug, regexp_replace(regexp_replace(coalesce(markdown, ''), '```[^`]*```', '', 'g'), '`[^`]*`', '', 'g') AS t FROM {PAGES})"
_LINKS = f"""{_MASKED}, raw AS (SELECT slug, unnest(regexp_extract_all(t, '(?:^|[^!])\\[[^\\]\\[]*\\]\\(([^)\\s]+)\\)', 1)) AS target, false AS legacy FROM x
    UNION ALL SELECT slug, unnest(regexp_extract_all(t, '\\[\\[([^\\]|]+)', 1)), true FROM x),
  links AS (SELECT slug, replace(string_split(raw.target, '#')[1], '.md', '') AS target, lower(coalesce(string_split(raw.target, '#')[2], '')) AS anchor, bool_or(legacy) AS legacy FROM raw WHERE raw.target NOT LIKE '%:%' GROUP BY ALL)"""


@query(f"WITH {_LINKS} SELECT * FROM links")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.link_targets(pages(spark, sf_dir)).drop("at")


_ANCHORS = "heads AS (SELECT slug, unnest(regexp_extract_all(t, '(?m)^#{1,6}[ \\t]+([^\\n]+)$', 1)) AS heading FROM x), anchors AS (SELECT DISTINCT slug, replace(lower(heading), ' ', '-') AS anchor, heading FROM heads)"


@query(f"WITH {_MASKED}, {_ANCHORS} SELECT * FROM anchors")
def heading_anchor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.heading_anchors(pages(spark, sf_dir))


@query(f"""WITH {_LINKS}, {_ANCHORS}, p AS (SELECT slug FROM {PAGES}) SELECT slug, 'broken_page' AS finding, target || CASE anchor WHEN '' THEN '' ELSE '#' || anchor END AS detail FROM links WHERE target NOT IN (FROM p)
  UNION ALL SELECT slug, 'broken_anchor', target || '#' || anchor FROM links l WHERE anchor <> '' AND target IN (FROM p) AND NOT EXISTS (SELECT 1 FROM anchors a WHERE a.slug = l.target AND a.anchor = l.anchor)
  UNION ALL SELECT DISTINCT slug, 'legacy_link', '' FROM links WHERE legacy UNION ALL SELECT slug, 'orphan', '' FROM p WHERE slug NOT IN (SELECT target FROM links WHERE target <> slug)""")
def link_and_anchor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.link_report(pages(spark, sf_dir))


@query(f"""WITH p AS (SELECT * FROM {PAGES}), {LINES.format(key='slug', source='p')}, kept AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ordinal) - 1 AS k FROM secs WHERE lower(heading) NOT IN ('overview', 'outgoing links', 'external links')),
  w AS (SELECT *, list_filter(regexp_split_to_array(inner_text, '\\s+'), lambda x: x <> '') AS w FROM kept), s AS (SELECT *, unnest(CASE WHEN len(w) <= 3 THEN [0] ELSE range(0, len(w), 2) END) AS pos FROM w),
  c AS (SELECT slug, heading, k::INT AS ordinal, (row_number() OVER (PARTITION BY slug, heading ORDER BY k, pos) - 1)::INT AS chunk, '## ' || heading || chr(10) || array_to_string(w[pos + 1:pos + 3], ' ') AS body FROM s)
  SELECT slug, heading, ordinal, chunk, left(sha256(body), 16) AS hash FROM c UNION ALL SELECT slug, '', -1, 0, left(sha256('The page ' || d), 16) FROM p WHERE k = 2""")
def section_chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.section_chunks(pages(spark, sf_dir), 3, 1).drop("body")


#: Pages in the folder move out of it, and one in five of the others moves into it.
_MOVES = """(SELECT CASE doc_id % 4 WHEN 0 THEN 'guide/d' ELSE 'd' END || CAST(doc_id AS STRING) AS old, CASE WHEN doc_id % 4 = 0 THEN 'moved/x' || CAST(doc_id AS STRING) WHEN doc_id % 5 = 0 THEN 'guide/y' || CAST(doc_id AS STRING) ELSE 'd' || CAST(doc_id AS STRING) END AS new FROM documents) AS moves"""


@query(f"""WITH m AS (SELECT * FROM {_MOVES} WHERE old <> new), p AS (SELECT * FROM {PAGES}),
  t AS (SELECT *, CASE k WHEN 0 THEN ['guide/d' || d + 4, 'guide/d' || d + 1, 'd1'] WHEN 1 THEN ['d' || d + 1, 'guide/d' || d + 3, 'd2'] ELSE [] END AS links, CASE k WHEN 0 THEN ['(guide/d' || d + 4 || '.md#', '(guide/d' || d + 1 || ')', '(d1.md)'] WHEN 1 THEN ['(d' || d + 1 || '#', '[[guide/d' || d + 3 || '|', '[[d2#'] ELSE [] END AS forms FROM p),
  w AS (SELECT *, (SELECT new FROM m WHERE old = links[1]) AS a, (SELECT new FROM m WHERE old = links[2]) AS b, (SELECT new FROM m WHERE old = links[3]) AS c FROM t)
  SELECT slug, CASE k WHEN 0 THEN replace(replace(replace(markdown, forms[1], CASE WHEN a IS NULL THEN forms[1] ELSE '(' || a || '.md#' END), forms[2], CASE WHEN b IS NULL THEN forms[2] ELSE '(' || b || '.md)' END), forms[3], CASE WHEN c IS NULL THEN forms[3] ELSE '(' || c || '.md)' END)
    WHEN 1 THEN replace(replace(replace(markdown, forms[1], CASE WHEN a IS NULL THEN forms[1] ELSE '(' || a || '.md#' END), forms[2], CASE WHEN b IS NULL THEN forms[2] ELSE '[[' || b || '|' END), forms[3], CASE WHEN c IS NULL THEN forms[3] ELSE '[[' || c || '#' END) ELSE markdown END AS markdown,
    ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT)::INT AS changed FROM w""")
def rewritten_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after some have moved, with their links to them rewritten in place, and how many were."""
    return m.rewrite_links(pages(spark, sf_dir), derived(spark, sf_dir, _MOVES))


@query("SELECT slug, CASE k WHEN 1 THEN replace(replace(markdown, '[[guide/d' || d + 3 || '|old form]]', '[old form](guide/d' || d + 3 || '.md)'), '[[d2#Top]]', '[Top](d2.md#top)') ELSE markdown END AS markdown, CASE k WHEN 1 THEN 2 ELSE 0 END AS changed FROM " + PAGES)
def modern_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in the old form as Markdown links."""
    return m.modern_links(pages(spark, sf_dir))
