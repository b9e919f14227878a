"""What the training-data operators share: shared storage, broadcasts and Arrow helpers."""

from __future__ import annotations

import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows handled at once inside a task; bounds a Python worker's memory whatever the Arrow batch size.
SLICE_ROWS = 512
#: Bytes that a per-worker memo may take before it is emptied, and the longest key that it keeps.
MEMO_BYTES, MEMO_KEY = 64 << 20, 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only in local mode, where driver and executors are
    one process, a temporary folder takes its place; a cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark, "_kbspark_shared", None) or tempfile.mkdtemp(prefix="kbspark-")
        spark._kbspark_shared = root
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, so what follows survives lost executors without computing ``df`` again, and a plan that
    needs ``df`` twice computes it once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kbspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kbspark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._kbspark_path)
        path.getFileSystem(conf).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``rows`` rows, without copying."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Memo(dict):
    """A memo bounded in bytes: ``compute(key)`` on a miss; emptied when it is full, and long keys are never kept.

    ``size`` tells the bytes of a value; without it values count as small. A key counts with up to four bytes a character.
    """

    def __init__(self, compute: Callable, limit: int = MEMO_BYTES, size: Callable | None = None):
        super().__init__()
        self.compute, self.limit, self.size, self.held = compute, limit, size, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= MEMO_KEY:
            self.held += 4 * len(key) + 200 + (self.size(value) if self.size else 0)
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[key] = value
        return value


class BatchMemo(dict):
    """A memo that is filled for a batch of keys at once: ``compute(keys)`` gives the values of those it lacks.

    ``base`` stays for good. After a batch ``settle`` drops long keys, and all but ``base`` once the rest is full.
    """

    def __init__(self, compute: Callable, base: dict, size: Callable = lambda value: 32, limit: int = MEMO_BYTES):
        super().__init__(base)
        self.compute, self.base, self.size, self.limit, self.held, self.long = compute, base, size, limit, 0, []

    def learn(self, found: set) -> None:
        new = list(found - self.keys())
        for key, value in zip(new, self.compute(new), strict=True):
            self[key] = value
            if len(key) > MEMO_KEY:
                self.long.append(key)
            else:
                self.held += sys.getsizeof(key) + self.size(value) + 100

    def settle(self) -> None:
        for key in self.long:
            del self[key]
        self.long.clear()
        if self.held > self.limit:
            self.clear()
            self.update(self.base)
            self.held = 0


#: Fingerprints are polynomials modulo this prime, at a fixed random point.
PRIME = (1 << 61) - 1
POINT = 0x1B873593CC9E2D51 % PRIME
_P, _30, _31, _61 = np.uint64(PRIME), np.uint64(30), np.uint64(31), np.uint64(61)
LOW_30, LOW_31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


def mod_prime(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves that 64 bits hold."""
    a1, a0, b1, b0 = a >> _31, a & LOW_31, b >> _31, b & LOW_31
    mid = a0 * b1 + a1 * b0
    return mod_prime(((a1 * b1) << np.uint64(1)) + (mid >> _30) + ((mid & LOW_30) << _31) + a0 * b0)


def powers(point: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a point, by doubling."""
    out, step = np.ones(1, np.uint64), point
    while len(out) < n:
        out, step = np.r_[out, times(out, np.full(1, step, np.uint64))], step * step % PRIME
    return out[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once, and the longest word that is hashed as a polynomial.
HASH_BYTES = 1 << 19
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_TABLES: list[np.ndarray] = []


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and each text's number of words.

    Words are runs of anything but the space and the control characters 09 to 0D. A word's hash is a polynomial in its
    bytes modulo a prime, so the hashes of a whole buffer come from running sums, without an object for each word; two
    words of n bytes collide with a probability of n / 2**61. (Modulo a power of two some words would collide at any
    point.) Words over ``HASH_BYTES`` bytes are hashed one by one instead.
    """
    if not _TABLES:
        power = powers(POINT, HASH_BYTES)
        _TABLES.extend([power >> _31, power & LOW_31, powers(pow(POINT, -1, PRIME), HASH_BYTES)])
    high, low, inverse = _TABLES
    whole = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[whole]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        first = starts[at]
        to = int(np.searchsorted(ends, first + HASH_BYTES, "right"))
        if to == at:
            out[at] = int.from_bytes(hashlib.blake2b(whole[first : ends[at]].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        part = whole[first : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        begin, end = starts[at:to] - first, ends[at:to] - first
        sums = []
        for half in (high, low):  # under 2**31 times 2**8 for each of 2**19 bytes: no overflow
            running = np.r_[np.zeros(1, np.uint64), np.cumsum(part * half[: len(part)])]
            sums.append(mod_prime(running[end] - running[begin]))
        out[at:to] = times(mod_prime(times(sums[0], np.full(1, 1 << 31, np.uint64)) + sums[1]), inverse[begin])
        at = to
    out = (out ^ (out >> np.uint64(32))) * _MIX[0]
    out = (out ^ (out >> np.uint64(29))) * _MIX[1]
    out ^= out >> np.uint64(32)
    stops = np.cumsum([0] + [len(t) + 1 for t in texts])
    return out, np.diff(np.searchsorted(starts, stops + 1)) if len(texts) else np.zeros(0, np.int64)


def read_bytes(path: str) -> bytes:
    """A small vocabulary file, read on the driver and shipped with a broadcast (its size is fixed)."""
    with open(path, "rb") as f:
        return f.read()


def task_partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that each holds about ``per_task`` rows, and at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
