"""Prefix trie of conversations: rolling prefix fingerprints, verified groups, and figures summed up to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOW_31, POINT, PRIME, materialise, mod_prime, times

#: Bits of a fingerprint.
FINGERPRINT_BITS = 61
#: Ids of a chunk of a node's ends: what one row of the last pass holds.
CHUNK_IDS = 4096
NODE = ["depth", "fp", "path"]
_PRIME, _31 = np.uint64(PRIME), np.uint64(31)


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime."""
    high, low = np.cumsum(x >> _31, dtype=np.uint64), np.cumsum(x & LOW_31, dtype=np.uint64)
    return mod_prime(times(mod_prime(high), np.full(1, 1 << 31, np.uint64)) + mod_prime(low))


def _powers(at: np.ndarray) -> np.ndarray:
    """The base to each power, by squaring."""
    out, square, rest = np.ones(len(at), np.uint64), np.full(1, POINT, np.uint64), at.astype(np.uint64)
    while rest.any():
        out = np.where(rest & np.uint64(1), times(out, square), out)
        square, rest = times(square, square), rest >> np.uint64(1)
    return out


def running_sums(rows: DataFrame, key: str, order: list[str], value: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """``rows`` with ``_kb_sum``: the sum of ``value`` modulo the prime over a key's rows up to this one, in ``order``.

    Rows are dealt by ranges of key and order, so a key with any share of them spreads over tasks. Each task sums its
    own stretch of every key; what the tasks before it had of its first key, a row for each border of ranges, is added
    afterwards. Rows that are equal in key and order stay together. Null orders come first; null keys must not occur.
    """
    fields = rows.schema.add("_kb_value", "long").add("_kb_sum", "long").add("_kb_at", "long").add("_kb_part", "integer")
    place = rows.columns.index(key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, count = TaskContext.get().partitionId(), None, np.uint64(0), 0
        for batch in batches:
            n, keys = batch.num_rows, batch.column(place)
            if not n:
                continue
            fresh = np.r_[keys[0].as_py() != last, pc.not_equal(keys[1:], keys[: n - 1]).to_numpy(zero_copy_only=False)]
            own = value(batch)
            sums, heads = _sums(own), np.flatnonzero(fresh)
            group = np.cumsum(fresh)  # 0: still the key of the batch before
            before = np.r_[carry and _PRIME - carry, mod_prime(sums[heads] + _PRIME - own[heads])]
            sums = mod_prime(sums + _PRIME - before[group])
            at = np.arange(n) + 1 - np.r_[-count, heads][group]
            last, carry, count = keys[n - 1].as_py(), sums[-1], int(at[-1])
            more = [pa.array(own.astype(np.int64)), pa.array(sums.astype(np.int64)), pa.array(at), pa.array(np.full(n, part, np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [f.name for f in fields.fields])

    dealt = rows.repartitionByRange(key, *[F.col(c).asc_nulls_first() for c in order])
    pieces = materialise(dealt.sortWithinPartitions(key, *[F.col(c).asc_nulls_first() for c in order]).mapInArrow(scan, fields))
    spans = pieces.groupBy(key).agg(F.min("_kb_part").alias("_kb_low"), F.max("_kb_part").alias("_kb_high")).filter("_kb_low < _kb_high")
    totals = pieces.join(F.broadcast(spans.select(key)), key).groupBy(key, "_kb_part").agg(F.max_by("_kb_sum", "_kb_at").alias("_kb_total"))
    earlier = Window.partitionBy(key).orderBy("_kb_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.withColumn("_kb_carry", F.sum(F.col("_kb_total").cast("decimal(38,0)")).over(earlier)).filter("_kb_carry is not null")
    carries = carries.select(key, "_kb_part", (F.col("_kb_carry") % PRIME).cast("long").alias("_kb_carry"))
    whole = (F.col("_kb_sum") + F.coalesce("_kb_carry", F.lit(0))) % PRIME
    # At most one key goes on at a border of ranges, so both broadcast tables have fewer rows than there are ranges.
    return pieces.join(F.broadcast(carries), [key, "_kb_part"], "left").withColumn("_kb_sum", whole).drop("_kb_part", "_kb_at", "_kb_carry")


def turn_contents(turns: DataFrame, role: Column, text: Column, bits: int) -> DataFrame:
    """The distinct contents of turns, each once: ``(content, twin, role, text, words)``.

    ``content`` is a hash; texts are compared whole (Spark aggregates equal ones before it shuffles them), and contents
    of one hash are told apart by ``twin``, 0 for all but the rare collision.
    """
    one = turns.select(_content(role, text, bits).alias("content"), role.alias("role"), text.alias("text")).distinct()
    one = materialise(one.withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))))
    twins = one.groupBy("content").agg(F.count("*").alias("_kb_n")).filter("_kb_n > 1").select("content")
    if twins.isEmpty():
        return one.withColumn("twin", F.lit(0))
    order = Window.partitionBy("content").orderBy("role", "text")
    told = one.join(twins, "content").withColumn("twin", F.row_number().over(order) - 1)
    return materialise(one.join(twins, "content", "left_anti").withColumn("twin", F.lit(0)).unionByName(told))


def _content(role: Column, text: Column, bits: int) -> Column:
    return F.xxhash64(role, text).bitwiseAND((1 << bits) - 1)


def number_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bits: int = FINGERPRINT_BITS) -> tuple[DataFrame, DataFrame]:
    """Turns as small rows ``(conv_id, place, content, twin, words)``, numbered from 0, and the contents they stand for.

    Turns are ordered by ``turn_col``, null first, equal ones by their contents' hashes. Null roles and texts count as
    empty; turns without a conversation take no part; other columns are not read.
    """
    own = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).filter("conv_id is not null")
    contents = turn_contents(own, F.col("role"), F.col("text"), bits)
    small = own.select("conv_id", "turn", _content(F.col("role"), F.col("text"), bits).alias("content"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), "role", "text")
    told = contents.filter("twin > 0").select("content", "role", "text", "twin")
    if told.isEmpty():
        small = small.withColumn("twin", F.lit(0))
    else:
        small = small.join(told, ["content", "role", "text"], "left").withColumn("twin", F.coalesce("twin", F.lit(0)))
    small = small.select("conv_id", "turn", "content", "twin", "words")
    placed = running_sums(small, "conv_id", ["turn", "content", "twin"], lambda batch: np.ones(batch.num_rows, np.uint64))
    return materialise(placed.select("conv_id", (F.col("_kb_sum") - 1).alias("place"), "content", "twin", "words")), contents


def _coefficient(batch: pa.RecordBatch) -> np.ndarray:
    """What a turn adds to the fingerprints of all prefixes that hold it: its content times a power of its place."""
    place, content, twin = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.uint64) for c in ("place", "content", "twin"))
    return times(mod_prime(mod_prime(content) + mod_prime(twin * np.uint64(0x9E3779B1)) + np.uint64(1)), _powers(place))


def prefixes(rows: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Every prefix of every conversation: ``(conv_id, depth, fp, path, content, twin, words)``; a node is ``NODE``.

    Prefixes of one depth and fingerprint are a group. Its members are checked against its representative, the smallest
    conversation: with the same last turn, and a prefix before it of the same fingerprint, which is checked the same
    way, they are equal turn by turn. A least and a greatest value for each group tell, summed before the shuffle, so a
    group of any size is no burden. Groups that fail are split: each distinct (fingerprint before, last turn) is a class
    of its own, and ``path`` names the classes other than the representative's that a prefix went through.
    """
    mask = (1 << bits) - 1
    scanned = running_sums(rows.select("conv_id", "place", "content", "twin", "words"), "conv_id", ["place"], _coefficient)
    before = ((F.col("_kb_sum") - F.col("_kb_value") + PRIME) % PRIME).bitwiseAND(mask)
    out = scanned.select("conv_id", (F.col("place") + 1).alias("depth"), F.col("_kb_sum").bitwiseAND(mask).alias("fp"), before.alias("_kb_before"), "content", "twin", "words")
    out = materialise(out)
    what = ["_kb_before", "content", "twin"]
    groups = out.groupBy("depth", "fp").agg(*[f(c).alias(f"{n}{c}") for c in what for n, f in (("low", F.min), ("high", F.max))])
    failed = groups.filter(" or ".join(f"low{c} < high{c}" for c in what)).select("depth", "fp")
    if failed.isEmpty():
        return out.drop("_kb_before").withColumn("path", F.lit(""))
    classes = out.join(failed, ["depth", "fp"]).groupBy("depth", "fp", *what).agg(F.min("conv_id").alias("_kb_first"))
    order = Window.partitionBy("depth", "fp").orderBy("_kb_first")
    classes = classes.withColumn("_kb_class", F.row_number().over(order) - 1).filter("_kb_class > 0").drop("_kb_first")
    out = out.join(classes, ["depth", "fp", *what], "left")
    step = F.when(F.col("_kb_class") > 0, F.concat_ws(":", "depth", "_kb_class"))
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    moved = out.filter("_kb_class > 0").select("conv_id").distinct()
    turned = out.join(moved, "conv_id").withColumn("path", F.concat_ws(",", F.collect_list(step).over(so_far)))
    straight = out.join(moved, "conv_id", "left_anti").withColumn("path", F.lit(""))
    return materialise(turned.unionByName(straight).drop("_kb_before", "_kb_class"))


def end_digests(ends: DataFrame) -> DataFrame:
    """``NODE`` and ``ends_sha256`` of ``ends(conv_id, depth, fp, path)``: ids in ascending order, joined by commas.

    Ids are sorted by ranges, so that a node with very many of them spreads over tasks, which write them out in chunks;
    only the digest, which no two tasks can share, passes over a node's few chunks in one task, holding one at a time.
    """
    node = [(f.name, f.dataType.simpleString()) for f in ends.select(*NODE).schema.fields]
    chunk_schema = ", ".join([*(f"{n} {t}" for n, t in node), "part int", "seq long", "ids string"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids = TaskContext.get().partitionId(), 0, None, []

        def chunk() -> tuple:
            return (*held, part, seq, ",".join(map(str, ids)))

        for batch in batches:
            rows: list[tuple] = []
            for key, conv in zip(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True), batch.column(3).to_pylist(), strict=True):
                if key != held or len(ids) == CHUNK_IDS:
                    if ids:
                        rows.append(chunk())
                        seq += 1
                    held, ids = key, []
                ids.append(conv)
            yield _batch(rows)
        if ids:
            yield _batch([chunk()])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["depth", "fp", "path", "part", "seq", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []
        names = [*NODE, "ends_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 5)), strict=True):
                if key != held:
                    if held:
                        out.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], names)
            out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*held, state.hexdigest()), kinds, strict=True)], names)

    small = ends.select(*[F.col(c).cast(t) for c, t in zip(NODE, ("long", "long", "string"), strict=True)], F.col("conv_id").cast("long"))
    chunks = small.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(write, chunk_schema)
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part", "seq").mapInArrow(digest, "depth long, fp long, path string, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame | None = None, *, contents: DataFrame | None = None, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """The nodes of the prefix trie of ``rows(conv_id, place, content, twin, words)``; places count from 0 without gaps.

    ``convs(conv_id)`` also names conversations without turns, which end at the root; null ids are ignored, repeated
    ones count once. Returns per node ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``; with ``contents`` also the ``role`` and ``text``
    of its last turn (null for the root). No conversations give no nodes.

    A conversation is the smallest member of a stretch of nodes, from some depth to its end. What the nodes of that
    stretch sum up to, from each depth on, is due to each node that the conversation passes, so subtree sums are one
    join and one aggregation over prefixes of such conversations, however deep the trie is; copies own no node and add
    nothing to it.
    """
    all_convs = rows.select("conv_id") if convs is None else rows.select("conv_id").union(convs.select("conv_id"))
    ids = materialise(all_convs.filter("conv_id is not null").distinct())
    every = prefixes(rows, bits)
    root = [F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit("").alias("path")]
    top = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.select(*root, "conv_id", "n_convs", F.lit(0).cast("long").alias("weight"), F.lit(None).cast("long").alias("content"), F.lit(None).cast("int").alias("twin"))
    nodes = every.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("content").alias("content"), F.max("twin").alias("twin"))
    weight = ((F.col("n_convs") - 1) * F.col("words")).alias("weight")
    nodes = materialise(top.unionByName(nodes.select(*NODE, "conv_id", "n_convs", weight, "content", "twin")))

    owners = materialise(nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max("depth").alias("last"), F.sum("weight").alias("total")))
    passed = every.select("conv_id", *NODE).join(owners.select("conv_id", "first", "total"), "conv_id").filter("depth < first")
    passed = passed.select("conv_id", *NODE, "first", "total").unionByName(owners.filter("first > 0").select("conv_id", *root, "first", "total"))
    passed = materialise(passed)
    heads = passed.filter("depth = first - 1").select(*NODE, F.col("conv_id").alias("child"))
    kids = heads.groupBy(*NODE).agg(F.count("*").alias("kids"))

    parents = heads.join(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE).select(F.col("child").alias("conv_id"), "parent_conv_id")
    summed = running_sums(nodes.select("conv_id", *NODE, "weight"), "conv_id", ["depth"], lambda batch: batch.column(batch.schema.get_field_index("weight")).to_numpy().astype(np.uint64))
    own = nodes.drop("weight").join(summed.select(*NODE, F.col("_kb_sum").alias("sum"), "weight"), NODE)
    own = own.join(owners.join(parents, "conv_id", "left"), "conv_id").join(kids, NODE, "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    own = materialise(own)
    leaves = own.filter("depth = last and kids = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    due = passed.join(leaves, "conv_id", "left").groupBy(*NODE).agg(F.sum("total").alias("due"), F.sum("leaf").alias("leaves"))

    lengths = every.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("fp", "depth").alias("fp"), F.max_by("path", "depth").alias("path"))
    empty = ids.join(lengths.select("conv_id"), "conv_id", "left_anti").select("conv_id", *root)
    digests = end_digests(lengths.unionByName(empty))

    out = own.join(due, NODE, "left").join(digests, NODE, "left").join(leaves, "conv_id", "left")
    zero = F.lit(0).cast("long")
    result = [
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.col("kids") + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"),
        (F.coalesce("leaves", zero) + F.coalesce("leaf", zero)).alias("n_leaves"),
        (F.coalesce("due", zero) + F.col("total") - F.col("sum") + F.col("weight")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ]
    if contents is None:
        return out.select(*result)
    return out.join(contents.select("content", "twin", "role", "text"), ["content", "twin"], "left").select(*result, "role", "text")


def conversation_trie(turns: DataFrame, *, keep_turns: bool = False, bits: int = FINGERPRINT_BITS, **columns: str) -> DataFrame:
    """``prefix_trie`` of a table of turns as they are; ``columns`` are those of ``number_turns``.

    Nodes are by conversation ids of type long. Turns with nulls, ties, repeated rows and empty tables: see
    ``number_turns`` and ``prefix_trie``. Texts of any length are compared whole.
    """
    rows, contents = number_turns(turns, bits=bits, **columns)
    return prefix_trie(rows, contents=contents if keep_turns else None, bits=bits)
