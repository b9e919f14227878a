"""Sections and word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def word_windows(sections: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` words, each starting ``size - overlap`` words after the one before; a short text is one window."""
    step = max(1, size - overlap)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    cut = sections.withColumn("_words", words).filter(F.size("_words") > 0)
    last = F.when(F.size("_words") <= size, F.lit(0)).otherwise(F.size("_words") - 1)
    starts = cut.select(*keys, "_words", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("window", "start"))
    body = F.array_join(F.slice("_words", F.col("start") + 1, F.lit(size)), " ")
    return starts.select(*keys, "window", body.alias("body"))


def paragraph_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line, numbered from 0 in order."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return docs.select(key, F.posexplode(lines).alias("ordinal", "section"))


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 40, overlap: int = 8) -> DataFrame:
    """Windows of all sections with a running chunk number per document and the hash of what is embedded.

    A document's windows are numbered in the array that they are made in, so its text never leaves its row.
    """
    step = max(1, size - overlap)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")

    def windows(line: Column, ordinal: Column) -> Column:
        words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
        last = lambda w: F.when(F.size(w) <= size, F.lit(0)).otherwise(F.size(w) - 1)
        starts = lambda w: F.when(F.size(w) > 0, F.sequence(F.lit(0), last(w), F.lit(step))).otherwise(F.array().cast("array<int>"))
        row = lambda w, s: F.struct(ordinal.alias("ordinal"), content_hash(F.array_join(F.slice(w, s + 1, F.lit(size)), " ")).alias("hash"))
        # an array of the words alone binds them, so that they are split once
        return F.flatten(F.transform(F.array(words), lambda w: F.transform(starts(w), lambda s: row(w, s))))

    chunks = docs.select(key, F.posexplode(F.flatten(F.transform(lines, windows))).alias("chunk", "c"))
    return chunks.select(key, "c.ordinal", "chunk", "c.hash")


def incremental_plan(new: DataFrame, old: DataFrame, key: str, hash_col: str) -> DataFrame:
    """What an incremental index does with each slot: reuse, embed again, embed as new, or delete."""
    both = new.select(key, F.col(hash_col).alias("new_hash")).join(old.select(key, F.col(hash_col).alias("old_hash")), key, "full_outer")
    action = F.when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash") == F.col("old_hash"), "reuse").otherwise("update")
    return both.select(key, action.alias("action"))
