"""Page edits as new versions of a table, each with one status row per request.

Tables are immutable here: an operator returns what the next version holds, and the caller writes it and moves the pointer.
A request's key is unique within its request table; of a repeated key every row gets the same status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_status(pages: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(key, status)`` per request: ``created``, or ``exists`` for a key that the table already has. Null keys are created."""
    known = pages.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(1))
    return new.select(key).join(known, key, "left").select(key, F.when(F.col("_known").isNull(), "created").otherwise("exists").alias("status"))


def insert_pages(pages: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the rows of ``new`` whose keys it does not have; it never overwrites."""
    return pages.unionByName(new.join(pages.select(key).distinct(), key, "left_anti").select(pages.columns))


def update_status(pages: DataFrame, changes: DataFrame, key: str, revision: str) -> DataFrame:
    """``(key, status, current)`` per request of ``changes(key, revision, ...)``, optimistically.

    ``updated`` if the page still has the expected revision, ``conflict`` if it has another, ``missing`` if there is no
    such page; ``current`` is the page's own revision, null if missing. Null revisions equal each other.
    """
    current = pages.select(key, F.col(revision).alias("_current"), F.lit(1).alias("_known"))
    joined = changes.select(key, F.col(revision).alias("_expected")).join(current, key, "left")
    fits = F.col("_expected").eqNullSafe(F.col("_current"))
    status = F.when(F.col("_known").isNull(), "missing").when(fits, "updated").otherwise("conflict")
    return joined.select(key, status.alias("status"), F.col("_current").alias("current"))


def update_pages(pages: DataFrame, changes: DataFrame, key: str, revision: str, sets: dict[str, Column]) -> DataFrame:
    """The table after every change whose expected revision holds; ``sets`` gives the new values, over columns of ``changes`` named ``new_*``."""
    values = [c for c in changes.columns if c.startswith("new_")]
    asked = changes.select(key, F.col(revision).alias("_expected"), *values, F.lit(1).alias("_asked"))
    joined = pages.join(asked, key, "left")
    applies = F.col("_asked").isNotNull() & F.col("_expected").eqNullSafe(F.col(revision))
    return joined.select(*[F.when(applies, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in pages.columns])


def delete_pages(pages: DataFrame, requests: DataFrame, key: str, revision: str) -> DataFrame:
    """The table without the pages that a request names with their current revision."""
    named = pages.join(requests.select(key, F.col(revision).alias("_expected")), key)
    gone = named.filter(F.col("_expected").eqNullSafe(F.col(revision))).select(key).distinct()
    return pages.join(gone, key, "left_anti").select(pages.columns)


def move_pages(pages: DataFrame, links: DataFrame, moves: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Pages under their new names and links that follow them; ``moves(old, new)`` renames, chains are not followed."""
    names = moves.select("old", "new")

    def renamed(rows: DataFrame, column: str) -> DataFrame:
        out = rows.join(names, rows[column] == names["old"], "left")
        return out.select(*[F.coalesce("new", rows[c]).alias(c) if c == column else rows[c] for c in rows.columns])

    return renamed(pages, key), renamed(links, target)


def expired_staging(sessions: DataFrame, lease: str, now: Column, limit: int, key: str) -> DataFrame:
    """The sessions to clean up in one pass: the ``limit`` longest expired ones (the bound is the feature), ties by key."""
    return sessions.filter(F.col(lease) < now).orderBy(lease, key).limit(limit)


def remediation(findings: DataFrame) -> DataFrame:
    """Routes ``findings(kind, page, source_known)``: a stale page with a known source is updated, a page whose source is gone is
    a candidate to delete, and what has no source to go by is blocked."""
    route = F.when((F.col("kind") == "stale") & F.col("source_known"), "update").when(F.col("kind") == "missing_source", "delete").otherwise("blocked")
    return findings.withColumn("route", route)
