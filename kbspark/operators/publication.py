"""Snapshots published in batches: begun, staged, checked, made current or given up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from ..sources.versioned import shared_path, staged
from .quality import set_revision

#: Bytes of rows in one sorted range.
RANGE_BYTES = 128 << 20


def staged_batches(batches: DataFrame) -> DataFrame:
    """Batches once each: ``batches(session, kind, ordinal, hash, n_rows)``; a batch that was sent again with another
    hash is a conflict."""
    return batches.groupBy("session", "kind", "ordinal").agg(F.min("hash").alias("hash"), F.max("n_rows").alias("n_rows"), (F.min("hash") != F.max("hash")).alias("conflict"))


def session_states(headers: DataFrame, batches: DataFrame, active: DataFrame) -> DataFrame:
    """What finalising each session comes to: ``headers(session, domain, base_revision, revision, kinds, aborted)``.

    ``aborted``; ``batch_conflict``; ``gap`` if a kind's ordinals are not 0, 1, ... or a promised kind has no batch;
    ``revision_conflict`` if the domain's active revision (``active(domain, revision)``, none: null) is not the one that
    the session began from; else ``ready``.
    """
    one = staged_batches(batches)
    kinds = one.groupBy("session", "kind").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.sum("n_rows").alias("n_rows"), F.max("conflict").alias("conflict"))
    whole = kinds.groupBy("session").agg(F.count("*").alias("kinds_sent"), F.max(F.col("n") != F.col("last") + 1).alias("gap"), F.max("conflict").alias("conflict"), F.sum("n_rows").alias("n_rows"))
    j = headers.join(whole, "session", "left").join(active.select("domain", F.col("revision").alias("current")), "domain", "left")
    state = (
        F.when(F.col("aborted"), "aborted")
        .when(F.coalesce("conflict", F.lit(False)), "batch_conflict")
        .when(F.coalesce("gap", F.lit(True)) | (F.coalesce("kinds_sent", F.lit(0)) < F.size("kinds")), "gap")
        .when(~F.col("current").eqNullSafe(F.col("base_revision")), "revision_conflict")
        .otherwise("ready")
    )
    return j.select("session", "domain", "revision", state.alias("state"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def activate(states: DataFrame, active: DataFrame) -> DataFrame:
    """The pointers after all ready sessions: of several that began from one revision the first by name wins; each change
    raises the domain's generation by one."""
    first = F.row_number().over(Window.partitionBy("domain").orderBy("session"))
    ready = states.filter("state = 'ready'").withColumn("turn", first).filter("turn = 1").select("domain", F.col("revision").alias("new"))
    j = active.join(ready, "domain", "full_outer")
    changed = F.col("new").isNotNull()
    return j.select("domain", F.coalesce("new", "revision").alias("revision"), (F.coalesce("generation", F.lit(0)) + changed.cast("int")).cast("int").alias("generation"))


def row_violations(symbols: DataFrame, files: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows of a snapshot that break its rules: spans, files and ends that are not there, repeated ids. Must be empty."""
    bad = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("id"))
    own = symbols.withColumnRenamed("entity_id", "id")
    spans = bad(own.filter("start > stop or start < 1"), "span")
    lost = bad(own.join(files.select("path").distinct(), "path", "left_anti"), "file")
    twice = bad(own.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    ends = relations.select(F.col("src").alias("id")).union(relations.select(F.col("dst").alias("id"))).distinct()
    return spans.union(lost).union(twice).union(bad(ends.join(own.select("id"), "id", "left_anti"), "end"))


def canonical_rows(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """Rows as compact JSON with sorted names, nulls kept: ``(kind, id, json)``."""
    columns = F.struct(*[F.col(c) for c in sorted(rows.columns)])
    return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.to_json(columns, {"ignoreNullFields": "false"}).alias("json"))


def snapshot_batches(rows: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Canonical rows in the order of their ids as batches of JSON: ``(kind, ordinal, n_rows, n_bytes, hash, payload)``.

    A batch is closed before it would pass ``max_rows`` or ``max_bytes``; a row that alone is larger is an error. The order
    is dealt by ranges of about RANGE_BYTES, at whose borders a batch ends too, so a kind of any size spreads over tasks
    that hold one batch at a time. Ordinals of a kind are 0, 1, ... An empty table gives no batch.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("json"))).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, kind, at, held, size = TaskContext.get().partitionId(), None, 0, [], 2

        def close() -> pa.RecordBatch:
            payload = "[" + ",".join(held) + "]"
            row = {"kind": kind, "place": place, "at": at, "n_rows": len(held), "n_bytes": size, "hash": hashlib.sha256(payload.encode()).hexdigest(), "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for k, json in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(json.encode())
                if held and (k != kind or len(held) >= max_rows or size + 1 + n > max_bytes):
                    yield close()
                    at, held, size = at + 1, [], 2
                if n + 2 > max_bytes:
                    raise ValueError(f"a row of {k} is larger than a batch may be")
                kind, size = k, size + n + (1 if held else 0)
                held.append(json)
        if held:
            yield close()

    schema = pa.schema([("kind", pa.string()), ("place", pa.int32()), ("at", pa.int32()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("hash", pa.string()), ("payload", pa.string())])
    ranged = rows.repartitionByRange(max(1, -(-total // RANGE_BYTES)), "kind", "id").sortWithinPartitions("kind", "id", "json").select("kind", "json")
    path = shared_path(spark, "batches")
    ranged.mapInArrow(cut, "kind string, place int, at int, n_rows long, n_bytes long, hash string, payload string").write.parquet(path)
    made = spark.read.parquet(path)
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    offsets = made.groupBy("kind", "place").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("before", F.coalesce(before, F.lit(0)))  # a row for each range
    numbered = made.join(offsets, ["kind", "place"])
    return numbered.select("kind", (F.col("before") + F.col("at") - F.col("first")).cast("int").alias("ordinal"), "n_rows", "n_bytes", "hash", "payload")


def publish_graph(store: Snapshots, files: DataFrame, symbols: DataFrame, relations: DataFrame) -> tuple[dict, DataFrame]:
    """Make ``files(path, ..)``, ``symbols(entity_id, path, start, stop, ..)`` and ``relations(src, dst, ..)`` current, all
    three in one version, with the revision of what they hold in its note; returns the version and what is wrong.

    Rows that break a rule (``row_violations``) refuse the whole: the version stays the one before. Relations are kept by
    their source, so those of a symbol lie together; what is not among the new rows goes, so older rows are not read.
    """
    base = store.manifest()
    wrong = staged(row_violations(symbols, files, relations))
    if not wrong.isEmpty():
        return base, wrong
    tables = {name: store.whole(name, key, rows) for name, key, rows in (("files", "path", files), ("symbols", "entity_id", symbols), ("relations", "src", relations))}
    whole = {"tables": tables}
    line = lambda t: F.to_json(F.struct(*sorted(store.read(whole, t).columns)))
    parts = [set_revision(store.read(whole, t).withColumn("_line", line(t)), "_line", F.lit(t)).first() for t in ("files", "symbols", "relations")]
    revision = hashlib.sha256(":".join(p["revision"] for p in parts).encode()).hexdigest()
    return store.commit(base, tables, note={"revision": revision, "counts": {t: p["n_rows"] for t, p in zip(("files", "symbols", "relations"), parts, strict=True)}}), wrong
