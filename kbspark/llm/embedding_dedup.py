"""Near-duplicate vectors by randomised-rotation binary codes.

A vector's code is the sign pattern of its direction under a few random rotations; a correction factor for each rotation
is the inner product of the rotated direction and its signs. Dividing the product of another vector and the signs by
that factor estimates the cosine without bias, with a confidence bound that the factor also gives (Gao and Long, 2024);
the mean over the rotations has a narrower bound. Codes, factors and the direction in one byte a component are stored
once, as a table, and the bounds come from them alone. A block of vectors that meet rejects the pairs whose upper bound
is under the threshold; only the vectors of pairs left undecided are then read exactly, and those pairs are computed in
double precision.

Which vectors meet follows from the same codes: runs of signs are the keys of tables, and a pair that shares a key in
one of them is estimated. The number of signs grows with the rows of a label, and the number of tables grows with it so
that a pair at the threshold is missed with probability ``miss`` at most; few rows of a label meet in one table without
keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, task_partitions
from .graph import Forest, connected_components
from .vectors import matrix, usable


def rotation(dim: int, number: int) -> np.ndarray:
    """The ``number``-th pseudo-random rotation of a space."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(rows: Column, threshold: float, miss: float, direct_rows: int, bucket_rows: int) -> tuple[Column, Column]:
    """Signs in a key and number of tables, for so many rows of one label; up to ``direct_rows`` all meet in one table."""
    same = 1 - math.acos(min(1.0, threshold)) / math.pi  # the chance of one equal sign at the threshold
    signs = F.when(rows <= direct_rows, 0).otherwise(F.ceil(F.log2(rows / bucket_rows))).cast("int")
    signs = F.least(signs, F.lit(60))
    tables = F.when((signs == 0) | (F.lit(same) >= 1), 1).otherwise(F.ceil(F.lit(math.log(miss)) / F.log(1 - F.pow(F.lit(same), signs))))
    return signs, tables.cast("int")


class Codes:
    """Codes of unit vectors: signs under ``turns`` rotations, correction factors, and bytes of the components."""

    def __init__(self, dim: int, turns: int):
        self.dim, self.turns = dim, turns
        self.rotations = np.concatenate([rotation(dim, r) for r in range(turns)])

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of vectors: packed signs, factors (rows x turns), components in steps (int8), and the steps."""
        u = v / np.abs(v).max(1, keepdims=True)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        turned = u @ self.rotations.T
        factor = np.abs(turned).reshape(len(v), self.turns, self.dim).sum(2) / math.sqrt(self.dim)
        step = np.abs(u).max(1) / 127
        return np.packbits(turned >= 0, axis=1), factor.astype(np.float32), np.rint(u / step[:, None]).astype(np.int8), step.astype(np.float32)

    def signs(self, packed: np.ndarray) -> np.ndarray:
        return np.unpackbits(packed, axis=1, count=self.turns * self.dim)

    def upper(self, parts: np.ndarray, step: np.ndarray, packed: np.ndarray, factor: np.ndarray, confidence: float) -> np.ndarray:
        """Upper bounds of the cosines of the vectors of ``parts`` and ``step`` with those of ``packed`` and ``factor``."""
        x = (parts * step[:, None]).astype(np.float32)
        code = (self.signs(packed).astype(np.float32) * 2 - 1) / math.sqrt(self.dim)
        code = (code.reshape(len(packed), self.turns, self.dim) / factor[:, :, None] / self.turns).reshape(len(packed), -1)
        estimate = (x @ self.rotations.T.astype(np.float32)) @ code.T
        spread = np.sqrt(np.maximum(0, 1 / factor.astype(float) ** 2 - 1).sum(1)) / self.turns / math.sqrt(max(1, self.dim - 1))
        rounding = step * math.sqrt(self.dim) / 2  # by which the bytes may move a vector
        return estimate + confidence * spread + np.outer(rounding, (1 / factor).mean(1)) + 1e-4


def key_bits(signs: np.ndarray, width: int, table: int) -> np.ndarray:
    """The key of each row of signs in one table."""
    return signs[:, table * width : (table + 1) * width].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def exact_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs whose cosine in double precision is ``threshold`` or more."""
    unit = lambda a: a / np.maximum(np.abs(a).max(1, keepdims=True), 1e-300)
    ux, uy = unit(x), unit(y)
    nx, ny = np.linalg.norm(ux, axis=1), np.linalg.norm(uy, axis=1)
    i, j = np.nonzero((ux / nx[:, None]) @ (uy / ny[:, None]).T >= threshold - 1e-9)
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 65536):
        p, q = i[a : a + 65536], j[a : a + 65536]
        keep[a : a + 65536] = np.einsum("ij,ij->i", ux[p], uy[q]) / (nx[p] * ny[q]) >= threshold
    return i[keep], j[keep]


def near_duplicate_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    miss: float = 1e-6,
    confidence: float = 6.0,
    turns: int = 4,
    block_rows: int = 2048,
    direct_rows: int = 8192,
    bucket_rows: int = 1024,
) -> DataFrame:
    """Links between rows of one label whose cosine is ``threshold`` or more, and their components.

    One row per vector: ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable, its own
    included), ``kept`` (its id is its component's). Rows with a null label, and vectors that are null, empty, zero or
    hold null or non-finite components, link with nothing; vectors of different lengths, which may be any, do not link.
    Equal vectors are linked and are compared once. Repeated ids stay rows of their own. An empty table gives an empty
    result; other columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    value = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), value.alias("v"), usable(vector_col).alias("ok"))
    rows = materialise(rows.withColumn("ok", F.col("ok") & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)))
    # Exact copies become one class, pre-aggregated, so a group of copies is one vector from here on.
    classes = rows.filter("ok").groupBy("label", F.xxhash64("v").alias("h"), "v").agg(F.min("row").alias("node"), F.count("*").alias("size"))
    classes = materialise(classes.withColumn("dim", F.size("v")))
    signs, tables = table_plan(F.col("n"), threshold, miss, direct_rows, bucket_rows)
    plan = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("signs", signs).withColumn("tables", tables)
    plan = materialise(plan.withColumn("family", F.monotonically_increasing_id()).withColumn("turns", F.greatest(F.lit(turns), F.ceil(F.col("signs") * F.col("tables") / F.col("dim"))).cast("int")))
    planned = classes.join(plan, ["label", "dim"]).select("family", "dim", "signs", "tables", "turns", "node", "size", "v")
    names = ["family", "dim", "signs", "tables", "turns", "node", "size"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[tuple[int, int], Codes] = {}
        for b in slices(batches):
            kinds = list(zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True))
            out = [None] * len(kinds)
            for kind in set(kinds):
                if kind not in coders:
                    coders[kind] = Codes(*kind)
                at = [i for i, k in enumerate(kinds) if k == kind]
                for i, *code in zip(at, *coders[kind].encode(matrix(b.column(7).take(pa.array(at)))), strict=True):
                    out[i] = [x.tobytes() for x in code]
            columns = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], *columns], [*names, "code", "factor", "parts", "step"])

    coded = materialise(planned.mapInArrow(encode, "family long, dim int, signs int, tables int, turns int, node long, size long, code binary, factor binary, parts binary, step binary"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = []
            for dim, s, t, r, code in zip(*(b.column(c).to_pylist() for c in ("dim", "signs", "tables", "turns", "code")), strict=True):
                bits = np.unpackbits(np.frombuffer(code, np.uint8), count=r * dim)[None]
                keys.append([int(key_bits(bits, s, k)[0]) if s else 0 for k in range(t)])
            yield pa.RecordBatch.from_arrays([b.column("family"), b.column("node"), pa.array(keys, pa.list_(pa.int64()))], ["family", "node", "keys"])

    spread = coded.mapInArrow(keyed, "family long, node long, keys array<long>").select("family", "node", F.posexplode("keys").alias("table", "key"))
    spread = materialise(spread)
    # A bucket over block_rows is cut into chunks, and each pair of chunks becomes a block of its own.
    bucket = ["family", "table", "key"]
    block = [*bucket, "left", "right"]
    shared = spread.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").withColumn("chunks", F.ceil(F.col("n") / block_rows).cast("int"))
    members = spread.join(shared.drop("n"), bucket).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = members.withColumn("other", other).withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
    groups = task_partitions(spark, coded.count(), 4096) * 2
    task = F.pmod(F.xxhash64(*block), F.lit(groups)).cast("int")
    placed = placed.drop("other", "chunks").join(coded.drop("family", "tables"), "node").withColumn("task", task)

    def blocks_of(table: pa.Table) -> Iterator[tuple[tuple, pa.Table, np.ndarray, np.ndarray]]:
        """Each block's key and rows, and the positions of its two sides in these (the same if a chunk meets itself)."""
        where: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*(table.column(c).to_pylist() for c in block), strict=True)):
            where.setdefault(k, []).append(i)
        for k, at in where.items():
            part = table.take(pa.array(at))
            chunk = part.column("chunk").to_numpy()
            yield k, part, np.flatnonzero(chunk == k[3]), np.flatnonzero(chunk == k[4])

    raw = lambda part, name, kind, shape: np.frombuffer(b"".join(part.column(name).to_pylist()), kind).reshape(len(part), shape)

    def bound(table: pa.Table) -> pa.Table:
        """The vectors that have an undecided pair, by block."""
        found, coder = [], None
        for k, part, one, two in blocks_of(table):
            dim, r = part.column("dim")[0].as_py(), part.column("turns")[0].as_py()
            if coder is None or (coder.dim, coder.turns) != (dim, r):
                coder = Codes(dim, r)
            code, factor = raw(part, "code", np.uint8, -1), raw(part, "factor", np.float32, r)
            parts, step = raw(part, "parts", np.int8, dim), raw(part, "step", np.float32, 1)[:, 0]
            open_ = coder.upper(parts[one], step[one], code[two], factor[two], confidence) >= threshold
            if k[3] == k[4]:
                np.fill_diagonal(open_, False)
            live = np.union1d(one[open_.any(1)], two[open_.any(0)])
            if len(live):
                node, chunk = part.column("node").to_numpy()[live], part.column("chunk").to_numpy()[live]
                found.append(np.c_[np.tile(np.array(k, np.int64), (len(live), 1)), chunk, node])
        got = np.concatenate(found) if found else np.zeros((0, 7), np.int64)
        return pa.table({n: got[:, i] for i, n in enumerate([*block, "chunk", "node"])})

    longs = ", ".join(f"{n} long" for n in [*block, "chunk", "node"])
    undecided = materialise(placed.groupBy("task").applyInArrow(bound, longs))
    exact = coded.select("node", "size", "dim", "signs", "turns", "code").join(classes.select("node", "v"), "node")
    undecided = undecided.join(exact, "node").withColumn("task", task)

    def link(table: pa.Table) -> pa.Table:
        linked = []
        for k, part, one, two in blocks_of(table):
            v, dim, width = matrix(part.column("v")), part.column("dim")[0].as_py(), part.column("signs")[0].as_py()
            i, j = exact_pairs(v[one], v[two], threshold)
            i, j = one[i], two[j]
            if k[3] == k[4]:
                i, j = i[i < j], j[i < j]
            signs = np.unpackbits(raw(part, "code", np.uint8, -1), axis=1, count=part.column("turns")[0].as_py() * dim)
            for earlier in range(k[1]):  # a pair counts in the first table that it shares
                keys = key_bits(signs, width, earlier)
                new = keys[i] != keys[j]
                i, j = i[new], j[new]
            if not len(i):
                continue
            forest = Forest(len(part))
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                forest.union(p, q)
            involved, size, node = np.unique(np.r_[i, j]), part.column("size").to_numpy(), part.column("node").to_numpy()
            count = np.bincount(i, size[j], len(part)) + np.bincount(j, size[i], len(part))
            root = [forest.find(p) for p in involved.tolist()]
            linked.append(np.c_[node[involved], count[involved].astype(np.int64), node[root]])
        got = np.concatenate(linked) if linked else np.zeros((0, 3), np.int64)
        return pa.table({"node": got[:, 0], "n": got[:, 1], "root": got[:, 2]})

    links = materialise(undecided.groupBy("task").applyInArrow(link, "node long, n long, root long"))
    parts = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("n").alias("n"))
    of_class = classes.select("label", "h", "v", "node", "size").join(counted, "node", "left").join(parts, "node", "left")
    of_class = of_class.select("label", "h", "v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "node").alias("part"))
    # Classes are few rows for many copies; their copies come back by the vector's hash and value.
    joined = rows.withColumn("h", F.when(F.col("ok"), F.xxhash64("v"))).join(of_class, ["label", "h", "v"], "left").select("row", "id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("part", "row").alias("part"))
    joined = materialise(joined)
    first = joined.groupBy("part").agg(F.min("id").alias("component_id"))
    out = joined.join(first, "part")
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
