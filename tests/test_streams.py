"""Streaming jobs: several triggers, replays and state across batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slimlake.operators.scope import Scope
from slimlake.sources.snapshots import SnapshotTable
from slimlake.streaming import jobs
from slimlake.streaming.log import BatchLog
from tests.conftest import rows

LISTING = "path string, size long, mod_time string, blake3 string"


def append(spark, place, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(place)


LISTED = f"{LISTING}, listing string, listing_rows long"


def test_a_listing_over_triggers_is_swept_once_it_is_whole(spark, place):
    source, table = f"{place}/in", SnapshotTable(spark, f"{place}/ledger")

    def run(checkpoint, per_trigger=1, folder=source):
        stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=per_trigger)
        jobs.ingest_listings(stream, table, f"{place}/{checkpoint}", Scope(("p",))).awaitTermination()

    append(spark, source, [("p/a", 1, "t", None, "one", 2)], LISTED)
    run("one")
    assert table.current() is None  # half a listing says nothing about what is gone
    append(spark, source, [("p/b", 2, "t", None, "one", 2)], LISTED)
    run("one")
    assert rows(table.read().select("path")) == [("p/a",), ("p/b",)]
    done = table.read().withColumn("state", F.when(F.col("path") == "p/a", "done").otherwise(F.col("state")))
    table.write(done, "run")
    append(spark, source, [("p/a", 1, "t2", None, "two", 2), ("p/c", 3, "t2", None, "two", 2)], LISTED)
    run("one")
    want = [("p/a", "done"), ("p/c", "pending")]
    assert rows(table.read().select("path", "state")) == want
    version = table.current().version
    run("one")  # nothing new
    assert table.current().version == version
    other = f"{place}/other"
    append(spark, other, [("p/a", 1, "t3", None, "three", 2), ("p/z", 9, "t3", None, "three", 2)], LISTED)
    run("two", folder=other)  # another stream starts at batch 0 as well
    assert rows(table.read().select("path", "state")) == [("p/a", "done"), ("p/z", "pending")]
    before, version = rows(table.read()), table.current().version
    run("three", folder=other)  # the same listing on a new checkpoint
    assert table.current().version == version + 1 and rows(table.read()) == before


def test_deliveries_that_come_twice_count_once(spark, place):
    source, table = f"{place}/in", SnapshotTable(spark, f"{place}/ledger")

    def run():
        schema = spark.read.parquet(source).schema
        stream = jobs.read_stream(spark, source, schema, per_trigger=1)
        jobs.ingest_listings(stream, table, f"{place}/cp", Scope(("p",))).awaitTermination()
        return rows(jobs.waiting_listings(table, schema).select("listing", "n_rows", "listing_rows"))

    append(spark, source, [("p/a", 1, "t", None, "one", 2), ("p/x", 1, "t", None, "other/=%", 3)], LISTED)
    assert run() == [("one", 1, 2), ("other/=%", 1, 3)]
    append(spark, source, [("p/a", 1, "t", None, "one", 2)], LISTED)
    assert run() == [("one", 2, 2), ("other/=%", 1, 3)] and table.current() is None
    append(spark, source, [("p/b", 2, "t", None, "one", 2)], LISTED)
    assert run() == [("other/=%", 1, 3)]  # what was set aside is gone
    assert rows(table.read().select("path")) == [("p/a",), ("p/b",)]
    version = table.current().version
    append(spark, source, [("p/b", 2, "t", None, "one", 2)], LISTED)  # late, after folding
    assert run() == [("other/=%", 1, 3)] and table.current().version == version


@pytest.mark.parametrize("row", [("p/a", 1, "t", None, None, 2), ("p/a", 1, "t", None, "one", None)])
def test_rows_without_a_listing_are_an_error(spark, place, row):
    append(spark, f"{place}/in", [row], LISTED)
    stream = jobs.read_stream(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema)
    table = SnapshotTable(spark, f"{place}/ledger")
    with pytest.raises(Exception, match="lack a name"):
        jobs.ingest_listings(stream, table, f"{place}/cp").awaitTermination()


def test_partial_listings_only_add(spark, place):
    source, table = f"{place}/in", SnapshotTable(spark, f"{place}/ledger")
    append(spark, source, [("p/a", 1, "t", None)], LISTING)
    append(spark, source, [("p/d", 4, "t3", None), ("p/d", 5, "t4", None)], LISTING)
    stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema, per_trigger=1)
    jobs.ingest_listings(stream, table, f"{place}/one", Scope(("p",)), complete=False).awaitTermination()
    assert rows(table.read().select("path", "size")) == [("p/a", 1), ("p/d", 5)]


def test_open_windows_are_given_at_the_end(spark, place):
    source = f"{place}/in"
    data = [("a", 1, "2024-01-01 00:00:01"), ("b", 2, "2024-01-01 00:00:14"), ("c", 3, "2024-01-01 00:09:00")]
    for path, seq, ts in data:
        row = spark.createDataFrame([(path, "s", seq, ts)], "path string, state string, seq long, t string")
        row.select("path", "state", "seq", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema, per_trigger=1)
    log = BatchLog(spark, f"{place}/windows", jobs.WINDOWS)
    jobs.keep_windows(jobs.throttled_progress(stream, "1 minute"), log, f"{place}/cp").awaitTermination()
    assert rows(jobs.final_windows(log.read()).select("path", "updates")) == [("b", 2), ("c", 1)]


def test_hot_path_is_handed_out_once(spark, place):
    source = f"{place}/in"
    data = [("hot" if i % 3 == 0 else f"p{i}", f"2024-01-01 00:00:{i % 60:02}") for i in range(300)]
    df = spark.createDataFrame(data, "path string, t string")
    df.select("path", F.to_timestamp("t").alias("ts")).repartition(4).write.parquet(source)
    stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema, per_trigger=1)
    once = jobs.hand_out_once(stream, "1 hour").select("path")
    jobs.append_rows(once, f"{place}/out", f"{place}/cp").awaitTermination()
    got = [r.path for r in spark.read.parquet(f"{place}/out").collect()]
    assert sorted(got) == sorted({p for p, _ in data})
