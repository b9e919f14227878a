"""Periodic runs of words: bit planes of word ids, shifted by each lag, and the stretches where nothing differs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import slices

#: Lags under this are all looked at; a longer one only if an aligned block of words recurs at it.
NEAR = 256
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _bits(v: int, n: int) -> np.ndarray:
    """Places of the set bits of an integer under 2**n."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(v.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


class _Planes:
    """The bit planes of the word ids of one text, side by side in one integer: word i of plane k is bit k * n + i."""

    def __init__(self, ids: np.ndarray, distinct: int):
        self.n, self.planes = len(ids), max(1, (distinct - 1).bit_length())
        bits = np.concatenate([((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8) for k in range(self.planes)])
        self.value = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        self.full = (1 << self.n) - 1

    def same(self, lag: int, need: int) -> tuple[np.ndarray, np.ndarray] | None:
        """First and last places that start ``need`` words in a row which are equal to those ``lag`` later, by stretch.

        One XOR with the shifted planes has the differences of every plane, halving folds OR the planes together. Bits
        that a shift brings in from the plane above lie in its last ``lag`` places, which the mask takes away.
        """
        differ, planes = self.value ^ (self.value >> lag), self.planes
        while planes > 1:
            planes = (planes + 1) // 2
            differ |= differ >> (planes * self.n)
        mask = self.full >> lag
        run, have = (differ & mask) ^ mask, 1
        while have < need and run:  # afterwards a bit says that ``need`` places from it on are all equal
            step = min(have, need - have)
            run &= run >> step
            have += step
        if not run:
            return None
        return _bits(run & (run ^ (run << 1)), self.n), _bits(run & (run ^ (run >> 1)), self.n)


class _Runs:
    """The runs found so far, in order of their periods."""

    def __init__(self):
        self.start = self.stop = self.period = np.zeros(0, np.int64)
        self.reach = self.first = self.start

    def add(self, start: np.ndarray, stop: np.ndarray, period: int) -> None:
        self.start, self.stop = np.r_[self.start, start], np.r_[self.stop, stop]
        self.period = np.r_[self.period, np.full(len(start), period)]
        self.first, self.reach = self._by_start(len(self.start))

    def _by_start(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.start[:k], kind="stable")
        return self.start[order], np.maximum.accumulate(self.stop[order])

    def within(self, start: np.ndarray, stop: np.ndarray, period: int | None = None) -> np.ndarray:
        """Which of the stretches lie in a run, one of at most ``period`` if that is given."""
        first, reach = (self.first, self.reach) if period is None else self._by_start(int(np.searchsorted(self.period, period, "right")))
        if not len(first):
            return np.zeros(len(start), bool)
        at = np.searchsorted(first, start, "right") - 1
        return (at >= 0) & (reach[at] >= stop)


def _far_lags(ids: np.ndarray, runs: _Runs) -> Iterator[int]:
    """Lags from ``NEAR`` on that a run may have, in order; the runs of the lags before are in ``runs`` by then.

    A run of period q from 2s on, but under 4s, holds an aligned block of s words once more q words later. Equal blocks
    have equal fingerprints, made by doubling, so no lag is missed; one too many is refuted by the planes. Blocks that
    recur within a known run of a period up to s say nothing new: what has that run's period there is that run.
    """
    n, s = len(ids), 1
    value = ids.astype(np.uint64) * _ODD[0] + _ODD[1]
    while 2 * s <= n // 2:
        if 2 * s >= NEAR:
            i = np.arange(2 * s, len(value))
            j = (i - 2 * s) // s * s
            lags = []
            for block in (j, j - s):
                hit = np.flatnonzero((block >= 0) & (value[i] == value[np.maximum(block, 0)]))
                left, right = block[hit], i[hit]
                new = ~runs.within(left, right + s, s)
                lags.append((right - left)[new])
            far = np.unique(np.concatenate(lags))
            yield from far[far <= n // 2].tolist()
        left, right = value[: len(value) - s], value[s:]
        value = (left * _ODD[1]) ^ (right * _ODD[2] + (right >> np.uint64(31)))
        value = (value ^ (value >> np.uint64(29))) * _ODD[0]
        s *= 2


def word_runs(words: Sequence[bytes], shortest: int = 12) -> np.ndarray:
    """All runs of a text as rows (start, length, period), by start, then period.

    A run is a stretch of words with smallest period q, of at least ``max(shortest, 2 * q)`` words, that no neighbouring
    word extends. Lags are looked at in ascending order, so a stretch that lies in a run of a smaller period has that
    period too and is none of its own.
    """
    n, runs = len(words), _Runs()
    if n >= max(2, shortest):
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, n)
        planes = _Planes(ids, len(number))

        def look(lag: int) -> None:
            need = max(shortest - lag, lag)
            if (found := planes.same(lag, need)) is not None:
                start, stop = found[0], found[1] + need + lag
                new = ~runs.within(start, stop)
                if new.any():
                    runs.add(start[new], stop[new], lag)

        for lag in range(1, min(NEAR - 1, n // 2) + 1):
            look(lag)
        for lag in _far_lags(ids, runs):
            look(lag)
    out = np.stack([runs.start, runs.stop - runs.start, runs.period], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def periodic_runs(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = 12,
    keep: Sequence[str] = (),
    keep_runs: bool = False,
    keep_text: bool = False,
) -> DataFrame:
    """The periodic runs of every whole text, and the text with each run cut to its first period.

    Returns the id, ``n_runs``, the longest run (``start``, ``length``, ``period``, ``exponent_milli``; the first of equal
    ones; nulls without a run), ``runs_sha256`` of the lines ``start,length,period``, ``collapsed_sha256`` of the words
    that stay, joined by a space, the columns in ``keep``, and if asked for the ``runs`` themselves and the
    ``collapsed`` text. Words are runs of anything but the space and the control characters 09 to 0D.

    Every row is judged by itself in its own task: no shuffle, and nothing to lose but the task. A null text has no
    words. Rows with null or repeated ids stay, one output row for each input row; other columns are not read, and those
    in ``keep`` may be named like a result (the kept one comes later). Very long texts cost their words times the lags
    under 256, and times the longer lags at which a block of words recurs; memory is a small multiple of the text.
    """
    kept = [f"_kb_{k}" for k in range(len(keep))]
    chosen = docs.select(F.col(text_col).alias("_kb_text"), F.col(id_col).alias("_kb_id"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for text in batch.column(0):
                words = (text.as_py() or "").encode().split()  # of bytes: exactly the characters 09 to 0D and 20
                runs = word_runs(words, shortest)
                stay = b" ".join([w for w, k in zip(words, kept_words(len(words), runs).tolist(), strict=True) if k] if len(runs) else words)
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist()).encode()
                best = runs[np.argmax(runs[:, 1])].tolist() if len(runs) else [None] * 3
                exponent = 1000 * best[1] // best[2] if len(runs) else None
                rows.append((len(runs), *best, exponent, hashlib.sha256(lines).hexdigest(), hashlib.sha256(stay).hexdigest(), runs.tolist() if keep_runs else None, stay.decode() if keep_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:7]]
            if keep_runs:
                arrays.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in columns[7]], kind))
            if keep_text:
                arrays.append(pa.array(columns[8], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], [f.name for f in schema.fields])

    schema = chosen.drop("_kb_text").schema
    for name in ("n_runs", "start", "length", "period", "exponent_milli"):
        schema = schema.add(f"_kb_{name}", "long")
    for name in ("runs_sha256", "collapsed_sha256"):
        schema = schema.add(f"_kb_{name}", "string")
    if keep_runs:
        schema = schema.add("_kb_runs", ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())))
    if keep_text:
        schema = schema.add("_kb_collapsed", "string")
    out = chosen.mapInArrow(run, schema)
    made = [f.name for f in schema.fields if f.name not in ("_kb_id", *kept)]
    return out.select(F.col("_kb_id").alias(id_col), *[F.col(c).alias(c.removeprefix("_kb_")) for c in made], *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])
