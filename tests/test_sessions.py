"""Publication sessions step by step, over several micro-batches, against a replay of the whole history."""

import datetime as dt
import random

import pytest

from kbspark.streaming import sessions

TTL, RETENTION = dt.timedelta(minutes=30), dt.timedelta(minutes=60)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def event(minute, op, session="s", owner="o", domain="d", revision="r1", expected=3, kind="files", ordinal=0, hash="a", n_rows=3, seq=0):
    return (domain, None if minute is None else at(minute), seq, op, session, owner, revision, expected, kind, ordinal, hash, n_rows)


def told(spark, path, *batches):
    for part in batches:
        spark.createDataFrame(part, sessions.EVENT).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(sessions.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = sessions.answers(sessions.publication_sessions(stream, ttl=TTL, retention=RETENTION, delay="1 minute"), path)
    return sorted(out.collect(), key=lambda r: (r["domain"], r["ts"] or dt.datetime.max, r["seq"] or 0, r["session"] or ""))


def results(rows):
    return [r["result"] for r in rows]


def test_a_session_is_published_once(spark, tmp_path):
    steps = [event(0, "begin"), event(1, "batch"), event(2, "batch"), event(3, "batch", hash="b"), event(4, "batch", ordinal=-1), event(5, "finalize", owner="other"), event(6, "finalize", session="none"), event(7, "finalize"), event(8, "finalize"), event(9, "batch"), event(10, "abort"), event(11, "begin"), event(12, "odd")]
    rows = told(spark, tmp_path, steps[:5], steps[5:], [event(None, "begin"), event(13, "begin", domain=None)])
    assert results(rows) == ["accepted", "accepted", "accepted", "batch_conflict", "invalid_batch", "unauthorized", "unauthorized", "published", "published", "snapshot_conflict", "published", "snapshot_conflict", "snapshot_conflict"]
    assert [r["revision"] for r in rows] == [None] * 7 + ["r1"] * 6 and rows[-1]["generation"] == 1


def test_only_one_of_two_that_began_together_wins(spark, tmp_path):
    two = [event(0, "begin", "a", revision="ra"), event(1, "begin", "b", revision="rb"), event(2, "batch", "a"), event(3, "batch", "b"), event(4, "finalize", "b"), event(5, "finalize", "a"), event(6, "begin", "c", revision="rc"), event(7, "finalize", "c"), event(8, "batch", "c", ordinal=1), event(9, "finalize", "c"), event(10, "batch", "c", n_rows=0), event(11, "finalize", "c")]
    rows = told(spark, tmp_path, two)
    assert results(rows)[4:] == ["published", "snapshot_conflict", "accepted", "incomplete", "accepted", "invalid_batch", "accepted", "published"]
    assert rows[-1]["revision"] == "rc" and rows[-1]["generation"] == 2


def test_leases_run_out_and_timers_drop(spark, tmp_path):
    first = [event(0, "begin", "kept"), event(0, "begin", "left", seq=1), event(29, "renew", "kept"), event(40, "renew", "left"), event(58, "batch", "kept")]
    late = [event(500, "begin", domain="elsewhere")]  # its time alone moves the watermark on
    rows = told(spark, tmp_path, first, late, [event(560, "renew", "kept"), event(2, "renew", "kept", seq=9)])
    of = lambda d: [(r["op"], r["session"], r["result"]) for r in rows if r["domain"] == d]
    assert of("d")[:5] == [("begin", "kept", "accepted"), ("begin", "left", "accepted"), ("renew", "kept", "accepted"), ("renew", "left", "expired"), ("batch", "kept", "accepted")]
    assert ("timer", "left", "dropped") in of("d") and ("timer", "kept", "dropped") in of("d")
    assert ("renew", "kept", "unauthorized") in of("d") and len(of("d")) == 8  # forgotten; the one behind the watermark left out
    assert ("timer", "s", "dropped") not in of("elsewhere")


def test_events_are_ordered_in_chunks_of_plain_values(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(sessions, "CHUNK", 3)
    names = [c.split()[0] for c in sessions.EVENT.split(", ")]
    rows = [event(5 - i // 2, "batch", seq=i, ordinal=None if i == 3 else 0) for i in range(8)]
    made = pd.DataFrame(rows, columns=names)  # a null makes the column of ordinals one of floats
    chunks = list(sessions._ordered(iter([made[:5], made[5:]])))
    assert [len(c) for c in chunks] == [3, 3, 2] and [e.seq for c in chunks for e in c] == [6, 7, 4, 5, 2, 3, 0, 1]
    assert {e.seq: e.ordinal for c in chunks for e in c} == {i: None if i == 3 else 0 for i in range(8)} and all(type(e.ordinal) is int for c in chunks for e in c if e.seq != 3)
    assert chunks[0][0].ts == at(2) and list(sessions._ordered(iter([made[:0]]))) == []


def replayed(events):
    """Each answer from all events before it, without a state that moves on."""
    out = []
    for i, e in enumerate(events):
        past = list(zip(events[:i], out, strict=True))
        domain, ts, _, op, name, owner = e[:6]
        revisions = [p[0] for p in past if p[1] == "published" and p[0][3] == "finalize" and p[0][0] == domain and not any(q[0][4] == p[0][4] and q[1] == "published" for q in past[: past.index(p)] if q[0][0] == domain)]
        new = {p[0][4]: p[0][6] for p in past if p[0][3] == "begin" and p[1] == "accepted" and p[0][0] == domain}
        began = next((p for p in past if p[0][0] == domain and p[0][4] == name and p[0][3] == "begin" and p[1] == "accepted"), None)
        mine = [p for p in past if p[0][0] == domain and p[0][4] == name]
        if op == "begin":
            out.append("snapshot_conflict" if began else "accepted")
            continue
        if not began or began[0][5] != owner:
            out.append("unauthorized")
            continue
        end = next((p[1] for p in mine if p[1] in ("published", "aborted")), None)
        lease = max(p[0][1] for p in mine if p[1] == "accepted") + TTL
        if op == "abort":
            out.append(end or "aborted")
        elif not end and lease <= ts:
            out.append("expired")
        elif op == "finalize":
            batches = {(p[0][8], p[0][9]): p[0][11] for p in reversed(mine) if p[0][3] == "batch" and p[1] == "accepted"}
            kinds = {k for k, _ in batches}
            at_begin = [r for r in revisions if r in events[: events.index(began[0])]]
            if end:
                out.append(end)
            elif any(sorted(o for k, o in batches if k == kind) != list(range(sum(k == kind for k, _ in batches))) for kind in kinds):
                out.append("invalid_batch")
            elif sum(batches.values()) != began[0][7]:
                out.append("incomplete")
            elif [new[r[4]] for r in at_begin][-1:] != [new[r[4]] for r in revisions][-1:]:
                out.append("snapshot_conflict")
            else:
                out.append("published")
        elif end:
            out.append("snapshot_conflict")
        elif op == "batch":
            first = next((p[0][10] for p in mine if p[0][3] == "batch" and p[1] in ("accepted",) and p[0][8:10] == e[8:10]), e[10])
            out.append("accepted" if first == e[10] else "batch_conflict")
        else:
            out.append("accepted")
    return out


@pytest.mark.parametrize("seed,cuts", [(1, 1), (2, 3)])
def test_random_steps_as_replayed(spark, tmp_path, seed, cuts):
    rng = random.Random(seed)
    steps = []
    for i in range(260):
        name = rng.choice("abcdefgh") + str(i // 50)
        op = rng.choice(["begin", "begin", "batch", "batch", "batch", "finalize", "finalize", "renew", "abort"] if i % 5 else ["begin"])
        steps.append(event(i * 0.2, op, name, owner="o" if rng.random() < 0.9 else "p", domain=rng.choice(["d", "d", "e"]), revision=f"r{i}", expected=rng.choice([0, 3, 3]), ordinal=rng.choice([0, 0, 0, 1]), hash=rng.choice("aaab"), seq=i))
    parts = [steps[k * len(steps) // cuts : (k + 1) * len(steps) // cuts] for k in range(cuts)]
    rows = [r for r in told(spark, tmp_path, *parts) if r["op"] != "timer"]
    got = {r["seq"]: r["result"] for r in rows}
    want = replayed(steps)
    assert [got[i] for i in range(len(steps))] == want
    assert {"accepted", "published", "unauthorized", "snapshot_conflict", "incomplete"} <= set(want)
