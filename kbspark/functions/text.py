"""Text expressions that stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_terms(query: str) -> list[str]:
    """Lower-case word terms of a query that are longer than two characters; repeated terms stay."""
    return [t for t in re.findall(r"\w+", query.lower()) if len(t) > 2]


def term_score(text: Column, terms: list[str]) -> Column:
    """How often the terms occur in a text, without overlaps and regardless of case; null counts as empty."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for t in terms:
        total = total + ((F.length(hay) - F.length(F.replace(hay, F.lit(t), F.lit("")))) / len(t)).cast("int")
    return total


def slugify(heading: Column) -> Column:
    """Anchor of a heading: trimmed, lower case, without punctuation, each white space as a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"(?U)[^\w\s-]", ""), r"(?U)\s", "-")


def normalise_tag(tag: Column) -> Column:
    """Lower case with single hyphens between words."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), r"[\s_/-]+", "-"), r"^-+|-+$", "")


def tokens(*values: Column) -> Column:
    """Sorted distinct word tokens; the underscore separates."""
    found = [F.regexp_extract_all(F.lower(F.coalesce(v, F.lit(""))), F.lit(r"(?U)[^\W_]+"), F.lit(0)) for v in values]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)
