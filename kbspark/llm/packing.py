"""Packing along a space-filling curve.

Every document becomes a hashed vector (the mean of a fixed pseudo-random row for each of its token ids) in a few
dimensions, whose Hilbert key orders the documents so that neighbours are alike. The documents then form one stream
along the curve that is cut every ``max_tokens`` ids, so only the stream's end can leave room; that end is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, read_bytes, slices, task_partitions

DIMENSIONS, BITS, SEED = 4, 12, 20240117


@lru_cache(2)
def encoder(data: bytes) -> tiktoken.Encoding:
    """An encoder that gives the ids of a byte-level BPE file of the tokenizers library.

    The file's merges must make ids in increasing order, as they do in this family; else ValueError.
    """
    spec = json.loads(data)
    vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(chars[c] for c in token): i for token, i in vocab.items() if token not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(made) or len(made) + 256 != len(ranks):
        raise ValueError("ids do not follow the order of the merges")
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def hilbert_key(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of points with integer coordinates below 2**bits (points x dimensions), after Skilling (2004)."""
    x = axes.astype(np.int64).T.copy()
    n, top = len(x), np.int64(1) << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def cuts(start: int, length: int, total: int, width: int) -> list[tuple[int, int, int]]:
    """The pieces of a document at [start, start + length) in a stream of ``total`` ids: (from, to, sequence)."""
    full = total // width
    ends, at, rest = [], full * width, total % width
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            at += 1 << b
            ends.append(at)
    out, a, stop = [], start, start + length
    while a < stop:
        if a < full * width:
            seq, end = a // width, (a // width + 1) * width
        else:
            k = next(i for i, e in enumerate(ends) if a < e)
            seq, end = full + k, ends[k]
        out.append((a, min(end, stop), seq))
        a = min(end, stop)
    return out


def sequence_start(sequence: int, total: int, width: int) -> int:
    """Where a sequence starts in the stream."""
    full, rest = total // width, total % width
    at = min(sequence, full) * width
    bits = [b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return at + sum(1 << b for b in bits[: max(0, sequence - full)])


def pack_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 1, max_tokens: int = 2048, keep_ids: bool = False
) -> DataFrame:
    """Pack all documents into sequences of at most ``max_tokens`` ids; a row for each piece of a document.

    A document is the ids of its text (none for a null or empty text) and ``end_id``. Every sequence is full but those
    of the stream's end, whose lengths are different powers of two. Rows with equal or null ids are documents of their
    own; equal keys are ordered by id. ``ids`` come along with ``keep_ids``. An empty table gives no pieces.
    A text of any length is encoded whole and cut wherever a sequence ends; other columns are not read.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_bytes(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")))
    kind = docs.schema[id_col].dataType.simpleString()
    dims = [f"v{i}" for i in range(DIMENSIONS)]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped.value)
        project = np.random.default_rng(SEED).standard_normal((enc.max_token_value + 1, DIMENSIONS)).astype(np.float32)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches):
            n, blobs, v = [], [], []
            for text in b.column(1).to_pylist():
                ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), end_id).astype("<u4")
                n.append(len(ids))
                v.append(project[ids].mean(0))
                blobs.append(squeeze((ids.astype("<u2") if enc.max_token_value < 65536 else ids).tobytes()))
            v = np.array(v, np.float64).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(blobs, pa.binary()), *map(pa.array, v.T)], ["id", "n", "blob", *dims])

    tokens = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        tokenise, f"id {kind}, n long, blob binary, {', '.join(f'{d} double' for d in dims)}"
    )
    tokens = materialise(tokens.withColumn("row", F.monotonically_increasing_id()))
    stats = tokens.agg(F.count("*").alias("rows"), F.sum("n").alias("total"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.mean, F.stddev_pop)]).first()
    rows, total = stats["rows"], stats["total"] or 0
    mean = np.array([stats[f"mean_{d}"] or 0.0 for d in dims])
    spread = np.array([stats[f"stddev_pop_{d}"] or 1.0 for d in dims])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = (np.column_stack([b.column(i).to_numpy() for i in range(3, 3 + DIMENSIONS)]) - mean) / spread
            axes = np.clip((np.tanh(z / 2) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(hilbert_key(axes))], ["row", "id", "n", "key"])

    # Ties of the key (copies) are dealt out by id, so no group of copies lands in one range.
    ranges = task_partitions(spark, rows, 200_000)
    order = ["key", "id", "row"]
    light = tokens.select("row", "id", "n", *dims).mapInArrow(keyed, f"row long, id {kind}, n long, key long")
    placed = materialise(light.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy("range").agg(F.sum("n").alias("n_range"))
    base = sums.select("range", (F.sum("n_range").over(Window.orderBy("range")) - F.col("n_range")).alias("base"))  # a row for each range
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.join(F.broadcast(base), "range").select("row", "id", "n", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, widen = encoder(shipped.value).max_token_value >= 65536, zstandard.ZstdDecompressor().decompress
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
        for b in slices(batches):
            out: list[list] = [[] for _ in names]
            for id_, n, at, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(widen(blob), "<u4" if wide else "<u2").astype("<u4")
                for a, e, seq in cuts(at, n, total, max_tokens):
                    mine = ids[a - at : e - at]
                    values = [id_, a - at, e - a, zlib.crc32(mine.tobytes()), n, seq, a - sequence_start(seq, total, max_tokens)]
                    for column, value in zip(out, values + [mine] * keep_ids, strict=True):
                        column.append(value)
            kinds = [b.schema.field(0).type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    pieces = starts.join(tokens.select("row", "blob"), "row").select("id", "n", "at", "blob")
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = pieces.mapInArrow(cut, f"id {kind}, " + ", ".join(f"{c} long" for c in longs) + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("id", id_col)
