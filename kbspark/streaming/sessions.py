"""Publication sessions as keyed state of a stream: begun, staged under a lease, made current by compare-and-set."""

from __future__ import annotations

import datetime as dt
import json
from collections import namedtuple
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a session's steps are answered with.
ACCEPTED, PUBLISHED, ABORTED, DROPPED = "accepted", "published", "aborted", "dropped"
UNAUTHORIZED, EXPIRED, CONFLICT, BATCH_CONFLICT, INVALID, INCOMPLETE = "unauthorized", "expired", "snapshot_conflict", "batch_conflict", "invalid_batch", "incomplete"
EVENT = "domain string, ts timestamp, seq long, op string, session string, owner string, revision string, expected long, kind string, ordinal int, hash string, n_rows long"
ANSWER = "domain string, session string, op string, ts timestamp, seq long, result string, revision string, generation long"
EPOCH = dt.datetime(1970, 1, 1)
#: Events that are Python objects at once.
CHUNK = 10_000
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us")}
_FIELDS = {c.split()[0]: _KINDS[c.split()[1]] for c in EVENT.split(", ")[1:]}
_Event = namedtuple("_Event", _FIELDS)


def _ordered(batches: Iterable[pd.DataFrame]) -> Iterator[list[_Event]]:
    """A domain's events in their order, CHUNK at a time; meanwhile they are Arrow columns, about 100 bytes an event."""
    parts: dict[str, list[pa.Array]] = {c: [] for c in _FIELDS}
    for b in batches:
        for c, kind in _FIELDS.items():
            parts[c].append(pa.array(b[c], kind, from_pandas=True))
    # one column after the other, so that never all of them are there twice
    held = pa.table({c: pa.chunked_array(parts.pop(c), kind).combine_chunks() for c, kind in _FIELDS.items()})
    order = pc.sort_indices(held, [(c, "ascending") for c in ("ts", "seq", "op", "session")], null_placement="at_start")
    for at in range(0, len(order), CHUNK):
        rows = held.take(order.slice(at, CHUNK))
        yield list(map(_Event, *(c.to_pylist() for c in rows.columns)))


class _Domain:
    """What is known of one domain: the current revision, its generation, and the sessions by name."""

    def __init__(self, text: str | None, ttl: int):
        self.ttl = ttl
        self.revision, self.generation, self.sessions = json.loads(text) if text else (None, 0, {})

    def text(self) -> str:
        return json.dumps([self.revision, self.generation, self.sessions])

    def answer(self, e: Any, now: int) -> str:
        s = self.sessions.get(e.session)
        if e.op == "begin":
            if s or e.session is None:
                return CONFLICT
            self.sessions[e.session] = {"owner": e.owner, "lease": now + self.ttl, "base": self.revision, "new": e.revision, "rows": e.expected, "batches": {}, "end": None}
            return ACCEPTED
        if s is None or s["owner"] != e.owner:
            return UNAUTHORIZED
        if e.op == "abort":
            if s["end"] is None:
                s["end"], s["batches"], s["lease"] = ABORTED, {}, now + self.ttl
            return s["end"]
        if s["end"] is None and s["lease"] <= now:
            return EXPIRED
        if e.op == "finalize":
            return s["end"] or self._finalize(s, now)
        if s["end"]:
            return CONFLICT
        if e.op == "batch":
            if e.kind is None or e.ordinal is None or e.ordinal < 0:
                return INVALID
            held = s["batches"].setdefault(f"{e.kind}\0{e.ordinal}", [e.hash, e.n_rows])
            if held[0] != e.hash:
                return BATCH_CONFLICT
        elif e.op != "renew":
            return INVALID
        s["lease"] = now + self.ttl
        return ACCEPTED

    def _finalize(self, s: dict, now: int) -> str:
        ordinals: dict[str, list[int]] = {}
        for name in s["batches"]:
            kind, _, n = name.rpartition("\0")
            ordinals.setdefault(kind, []).append(int(n))
        if any(max(x) != len(x) - 1 for x in ordinals.values()):
            return INVALID
        if sum(n or 0 for _, n in s["batches"].values()) != s["rows"]:
            return INCOMPLETE
        if s["base"] != self.revision:
            return CONFLICT
        self.revision, self.generation = s["new"], self.generation + 1
        s["end"], s["batches"], s["lease"] = PUBLISHED, {}, now + self.ttl
        return PUBLISHED

    def due(self, retention: int) -> int | None:
        return min((s["lease"] + retention for s in self.sessions.values()), default=None)

    def drop(self, upto: int, retention: int) -> list[str]:
        """Forget sessions that no one has renewed for so long, and what is left of those that have ended."""
        gone = sorted(k for k, s in self.sessions.items() if s["lease"] + retention <= upto)
        return [k for k in gone if self.sessions.pop(k)["end"] is None]


def publication_sessions(stream: DataFrame, *, ttl: dt.timedelta, retention: dt.timedelta, delay: str) -> DataFrame:
    """The answer to each event of ``EVENT``, in order of time and ``seq`` within a domain, and sessions dropped by timer.

    ``begin`` opens a session with a lease from the domain's current revision; ``batch`` and ``renew`` prolong the lease.
    A batch sent again is accepted, one with another hash is a ``batch_conflict``. ``finalize`` makes the session's
    revision current if every kind's ordinals run from 0, the rows are as many as ``expected``, and the current revision is
    still the one that it began from (``snapshot_conflict`` otherwise); it may be tried again. ``abort`` ends it. Whoever is
    not the owner, or names no session, is ``unauthorized``; after the lease all but an abort is ``expired``. An ended
    session answers with its end. Once the watermark has passed a lease by ``retention``, its session is forgotten, and
    ``dropped`` if it was still open. Events without domain or time are left out, as are those behind the watermark.

    All state is in the checkpoint: per domain its pointer and the hashes of the batches of open sessions. A domain's
    events of one micro-batch are in memory at once as Arrow columns, and CHUNK of them as Python objects.
    """
    ttl_us, retention_us = (int(x / dt.timedelta(microseconds=1)) for x in (ttl, retention))

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        domain = _Domain(state.get[0] if state.exists else None, ttl_us)
        columns = [c.split()[0] for c in ANSWER.split(", ")]

        def table(out: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(out, columns=columns)
            return made.assign(ts=pd.to_datetime(made["ts"]), seq=made["seq"].astype("Int64"), generation=made["generation"].astype("int64"))

        for events in [] if state.hasTimedOut else _ordered(batches):
            out: list[tuple] = []
            for e in events:
                result = domain.answer(e, int((e.ts - EPOCH) / dt.timedelta(microseconds=1)))
                out.append((key[0], e.session, e.op, e.ts, e.seq, result, domain.revision, domain.generation))
            yield table(out)
        passed = state.getCurrentWatermarkMs() * 1000
        dropped = [(key[0], s, "timer", None, None, DROPPED, domain.revision, domain.generation) for s in domain.drop(passed, retention_us)]
        state.update((domain.text(),))
        due = domain.due(retention_us)
        if due is not None:
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        yield table(dropped)

    known = stream.filter(F.col("domain").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    return known.groupBy("domain").applyInPandasWithState(step, ANSWER, "sessions string", "append", GroupStateTimeout.EventTimeTimeout)


def answers(spark_stream: DataFrame, path: str) -> DataFrame:
    """All answers of a stream that ends when what is there now has been read: written to ``path``, read as a table."""
    query = spark_stream.writeStream.format("parquet").option("path", f"{path}/answers").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark_stream.sparkSession.read.schema(spark_stream.schema).parquet(f"{path}/answers")
