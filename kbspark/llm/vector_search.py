"""Exact top-k inner products by a vector-approximation file.

The approximation file is a table of its own: every component of every vector is one of ``2**bits`` cells of its
position's range, a byte each. A scan of the approximations alone, in blocks, gives each query a lower and an upper bound
for every vector, and keeps those that the bounds leave in the race for the block's first k. Over all blocks no vector
whose upper bound is under the k-th largest lower bound can be among the first k; only what is left has its exact vector
read, and the exact products are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .vectors import matrix, usable


class Cells:
    """The cells of one vector length: for each position its lowest value and the width of a cell."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.low, self.top = low.astype(float), (1 << bits) - 1
        self.width = np.maximum((high - low) / (1 << bits), 1e-9)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.low) / self.width, 0, self.top).astype(np.uint8)

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The middles of the bounds of all products, queries x vectors, and half their distance, for each query."""
        middle = (queries @ (self.low + self.width / 2))[:, None] + (queries * self.width) @ codes.T.astype(float)
        # what rounding adds is under a thousandth of a millionth of the sizes of the terms
        terms = np.abs(queries) @ (np.abs(self.low) + self.width * (self.top + 1))
        return middle, np.abs(queries) @ (self.width / 2) + 1e-9 * (1 + terms)


def contenders(middle: np.ndarray, half: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and vectors (positions) whose upper bound reaches the query's k-th largest lower bound; ``own`` (-1: none) is out."""
    asks = np.flatnonzero(own >= 0)
    middle[asks, own[asks]] = -np.inf
    n = middle.shape[1]
    floor = np.partition(middle, n - k, 1)[:, n - k] - 2 * half if k < n else np.full(len(middle), -np.inf)
    return np.nonzero((middle >= floor[:, None]) & (middle > -np.inf))


def top_k_inner_product(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, bits: int = 8, query_rows: int = 2048, block_rows: int = 32768
) -> DataFrame:
    """For every row with ``is_query``, the ``k`` other rows with the largest integer inner products.

    A component x counts as floor(scale * x). Ties go to the smaller id (of equal ids: to the earlier row). Vectors that
    are null or hold null or non-finite components take no part; vectors of another length than the query's, which may
    be any, are no candidates. A row is never its own candidate, a repeated row is one. Fewer candidates than ``k`` give
    fewer rows, an empty table none. Scores must fit 64-bit integers. Other columns of ``vectors`` are not read. The
    driver holds the range of each position of each vector length.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), usable(vector_col).alias("ok"), F.col(vector_col).alias("v")
    ).filter("ok")
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "asks", F.size("v").alias("dim"), ints.alias("v")))

    def by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            yield d, at, matrix(b.column("v").take(pa.array(at))).reshape(len(at), d)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches, 8192):
            for d, _, v in by_dim(b):
                low, high = seen.get(d, (v[0], v[0]))
                seen[d] = np.minimum(low, v.min(0)), np.maximum(high, v.max(0))
        kinds = [pa.int32(), *[pa.list_(pa.int64())] * 2]
        columns = [list(seen), *([x[i].tolist() for x in seen.values()] for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["dim", "low", "high"])

    found = rows.select("dim", "v").mapInArrow(ranges, "dim int, low array<long>, high array<long>")
    found = found.select("dim", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dim", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).orderBy("dim", "at").toPandas()
    cells = spark.sparkContext.broadcast({int(d): Cells(g["low"].to_numpy(), g["high"].to_numpy(), bits) for d, g in found.groupby("dim")} | {0: Cells(np.zeros(0), np.zeros(0), bits)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            codes = [b""] * len(b)
            for d, at, v in by_dim(b):
                for i, code in zip(at.tolist(), cells.value[d].encode(v), strict=True):
                    codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("dim"), pa.array(codes, pa.binary())], ["row", "dim", "code"])

    file = materialise(rows.select("row", "dim", "v").mapInArrow(encode, "row long, dim int, code binary"))
    # Blocks by a hash of the row; as many blocks as the counts need, so none outgrows a task.
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-asking // query_rows))
    block, group = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    plain = file.select("row", "dim", "code", F.lit(None).cast("array<long>").alias("v"), block.cast("int").alias("block"), every(groups).alias("group"))
    asked = rows.filter("asks").select("row", "dim", F.lit(None).cast("binary").alias("code"), "v", every(blocks).alias("block"), group.cast("int").alias("group"))

    def scan(table: pa.Table) -> pa.Table:
        q = np.array(table.column("code").is_null().to_pylist(), bool)
        asked, data = table.filter(pa.array(q)), table.filter(pa.array(~q))
        out: list[tuple] = []
        if len(asked) and len(data):
            dim = data.column("dim")[0].as_py()
            codes = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(len(data), dim)
            queries = matrix(asked.column("v")).reshape(len(asked), dim).astype(float)
            data_rows, asked_rows = data.column("row").to_numpy(), asked.column("row").to_numpy()
            order = np.argsort(data_rows)
            place = np.minimum(np.searchsorted(data_rows[order], asked_rows), len(order) - 1)
            own = np.where(data_rows[order][place] == asked_rows, order[place], -1)
            for a in range(0, len(asked), 128):
                middle, half = cells.value[dim].bounds(queries[a : a + 128], codes)
                i, j = contenders(middle, half, own[a : a + 128], k)
                out.append((asked_rows[a + i], data_rows[j], middle[i, j] - half[i], middle[i, j] + half[i]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table(dict(zip(["query_row", "row", "lower", "upper"], columns, strict=True)))

    left = materialise(plain.union(asked).groupBy("dim", "block", "group").applyInArrow(scan, "query_row long, row long, lower double, upper double"))
    by_lower = Window.partitionBy("query_row").orderBy(F.desc("lower"))
    kth = left.withColumn("n", F.row_number().over(by_lower)).filter(F.col("n") <= k).groupBy("query_row").agg(F.count("*").alias("n"), F.min("lower").alias("floor"))
    kth = kth.select("query_row", F.when(F.col("n") == k, F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor"))
    left = left.join(kth, "query_row").filter("upper >= floor").select("query_row", "row")
    queries = rows.filter("asks").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = left.join(rows.select("row", "id", "v"), "row").join(queries, "query_row")
    score = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    ranked = exact.select("query_row", "query_id", "row", "id", score.alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
