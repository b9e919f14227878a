"""Page edits and the streams: nulls, conflicts, repeats, empty tables, and batches that come again."""

import datetime as dt

from pyspark.sql import functions as F

from kbspark.operators import mutation
from kbspark.sources.versioned import VersionedTable
from kbspark.streaming import log


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


PAGES = "page string, revision int, title string"


def pages(spark, data=(("a", 1, "A"), ("b", 2, "B"), ("c", None, "C"))):
    return spark.createDataFrame(list(data), PAGES)


def test_insert_never_overwrites(spark):
    new = spark.createDataFrame([("a", 9, "new"), ("d", 1, "D")], PAGES)
    assert rows(mutation.insert_status(pages(spark), new, "page")) == [("a", "exists"), ("d", "created")]
    assert rows(mutation.insert_pages(pages(spark), new, "page")) == rows(pages(spark).union(new.filter("page = 'd'")))
    assert mutation.insert_pages(pages(spark, []), new, "page").count() == 2


def test_update_checks_the_revision(spark):
    changes = spark.createDataFrame([("a", 1, "A2"), ("b", 1, "B2"), ("c", None, "C2"), ("x", 1, "X2")], "page string, revision int, new_title string")
    status = mutation.update_status(pages(spark), changes, "page", "revision")
    assert rows(status) == [("a", "updated", 1), ("b", "conflict", 2), ("c", "updated", None), ("x", "missing", None)]
    done = mutation.update_pages(pages(spark), changes, "page", "revision", {"title": F.col("new_title"), "revision": F.coalesce("revision", F.lit(0)) + 1})
    assert rows(done) == [("a", 2, "A2"), ("b", 2, "B"), ("c", 1, "C2")]


def test_delete_checks_the_revision(spark):
    asked = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("x", 1)], "page string, revision int")
    assert rows(mutation.delete_pages(pages(spark), asked, "page", "revision")) == [("b", 2, "B"), ("c", None, "C")]


def test_move_renames_pages_and_links(spark):
    moves = spark.createDataFrame([("a", "z")], "old string, new string")
    links = spark.createDataFrame([("b", "a"), ("c", None), ("a", "b")], "source string, target string")
    moved, followed = mutation.move_pages(pages(spark), links, moves, "page", "target")
    assert {r[0] for r in moved.collect()} == {"z", "b", "c"}
    assert {tuple(r) for r in followed.collect()} == {("b", "z"), ("c", None), ("a", "b")}


def test_cleanup_takes_the_longest_expired(spark):
    s = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 99), ("e", None)], "key string, lease int")
    assert [r[0] for r in mutation.expired_staging(s, "lease", F.lit(10), 2, "key").collect()] == ["b", "c"]


def test_remediation_routes(spark):
    f = spark.createDataFrame([("stale", "a", True), ("stale", "b", False), ("missing_source", "c", False), ("stale", "d", None)], "kind string, page string, source_known boolean")
    assert [r["route"] for r in mutation.remediation(f).orderBy("page").collect()] == ["update", "blocked", "delete", "blocked"]


def test_last_wins_over_batches_and_again(spark, tmp_path):
    schema = "k string, seq long, v string"
    for n, part in enumerate(([("a", 1, "x"), ("b", 5, "y"), (None, 9, "n")], [("a", 2, "z"), ("b", 4, "old"), ("c", None, "n")], [("a", 2, "z")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        table = VersionedTable(spark, str(tmp_path / "table"))
        log.last_wins(log.events_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema)), table, "k", "seq", str(tmp_path / "ck")).awaitTermination()
    assert rows(table.newest()) == [("a", 2, "z"), ("b", 5, "y")]
    # a version that is written again replaces itself
    table.write(table.read(1), 2)
    assert rows(table.newest()) == [("a", 2, "z"), ("b", 5, "y")]
    assert VersionedTable(spark, str(tmp_path / "none")).newest() is None


def read_all(stream, path):
    q = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(path / "out"))


def at(minute):
    return dt.datetime(2024, 1, 1, 0) + dt.timedelta(minutes=minute)


def test_resent_batches_are_dropped(spark, tmp_path):
    data = spark.createDataFrame([("s", 0, at(0)), ("s", 1, at(1)), ("s", 0, at(2)), ("t", 0, at(2))], "session string, ordinal int, ts timestamp")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = read_all(log.distinct_batches(log.events_stream(spark, str(tmp_path / "in"), data), ["session", "ordinal"], "ts", "1 hour"), tmp_path)
    assert rows(out.select("session", "ordinal")) == [("s", 0), ("s", 1), ("t", 0)]


def test_leases_end_when_the_watermark_passes(spark, tmp_path):
    schema = "k string, ts timestamp"
    for part in ([("a", at(0)), ("a", at(5)), ("b", at(1)), (None, at(1))], [("a", at(300))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = read_all(log.lease_sessions(log.events_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema)), "k", "ts", "10 minutes", "1 minute"), tmp_path)
    got = {(r["k"], r["renewals"], (r["expires"] - r["opened"]).total_seconds()) for r in out.collect()}
    assert got == {("a", 2, 900.0), ("b", 1, 600.0)}
