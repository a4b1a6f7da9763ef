"""M: streaming jobs, run until all input is read, with their tables as results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from slimlake.catalog.joins import SCOPE, SYNC_COLUMNS
from slimlake.catalog.registry import query
from slimlake.catalog.scalars import BLOCKS_SQL, progress_lines
from slimlake.catalog.tables import VIEWS, Tables
from slimlake.schemas import evolve
from slimlake.session import scratch
from slimlake.sources.snapshots import SnapshotTable
from slimlake.streaming import jobs, keyed
from slimlake.streaming.log import BatchLog


PER_STEP = 4
#: State stores of a keyed stream; fixed when it first starts.
STORES = 8


def _as_files(t: Tables, rows, key: str, steps: int) -> str:
    """All rows, written in ``steps`` steps of rising key, each in ``PER_STEP`` files.

    A trigger takes ``PER_STEP`` files, so several run, each on one step.
    """
    place = scratch(t.spark, "stream")
    first, last = rows.agg(F.min(key), F.max(key)).first()
    width = (last - first) // steps + 1
    step = F.coalesce(F.floor((F.col(key) - first) / width), F.lit(0))
    for number in range(steps):
        rows.where(step == number).repartition(PER_STEP).write.mode("append").parquet(place)
    return place


def _job_stream(t: Tables):
    """The transition log as a stream straight from the events table."""
    source = jobs.read_stream(t.spark, t.folder, t.events.schema, glob="events.parquet")
    return VIEWS["f_jobs"].frame(source).withColumn("ts", F.col("ts").cast("timestamp"))


@query("M1_streaming_ingest", "SELECT * FROM o_sync")
def streaming_ingest(t: Tables):
    """A listing in four files, one per trigger; then again on a new checkpoint."""
    listing = t.f_listing
    listing = listing.withColumns({"listing": F.lit("monthly"), "listing_rows": F.lit(listing.count())})
    place = scratch(t.spark, "stream")
    listing.repartition(4).write.parquet(place)
    table = SnapshotTable(t.spark, scratch(t.spark, "ledger"))
    table.write(evolve(t.f_ledger.drop("doc_id")), "start")
    for _ in range(2):
        stream = jobs.read_stream(t.spark, place, listing.schema, per_trigger=1)
        jobs.ingest_listings(stream, table, scratch(t.spark, "progress"), SCOPE).awaitTermination()
    return table.read().select(*SYNC_COLUMNS)


@query("M2_running_counts", "SELECT state, count(*) AS n FROM f_jobs GROUP BY state")
def running_counts(t: Tables):
    table = SnapshotTable(t.spark, scratch(t.spark, "counts"))
    jobs.running_counts(_job_stream(t), table, scratch(t.spark, "progress")).awaitTermination()
    return table.read()


@query(
    "M3_throttled_progress",
    """SELECT time_bucket(INTERVAL 15 SECOND, ts, TIMESTAMP '2000-01-01') AS window_start, arg_max(path, (ts, seq)) AS path,
 arg_max(state, (ts, seq)) AS state, count(*) AS updates FROM f_jobs GROUP BY 1""",
)
def throttled_progress(t: Tables):
    log = BatchLog(t.spark, scratch(t.spark, "windows"), jobs.WINDOWS)
    rows = jobs.throttled_progress(_job_stream(t), "1 minute")
    jobs.keep_windows(rows, log, scratch(t.spark, "progress")).awaitTermination()
    final = jobs.final_windows(log.read())
    return final.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "M4_latest_counters",
    "SELECT path, max(seq) AS seq, arg_max(state, seq) AS state, arg_max(bytes, seq) AS bytes FROM f_jobs GROUP BY path",
)
def latest_counters(t: Tables):
    rows = t.f_jobs.drop("ts")
    place = _as_files(t, rows, "seq", 4)
    stream = jobs.read_stream(t.spark, place, rows.schema, per_trigger=PER_STEP)
    checkpoint = scratch(t.spark, "progress")
    keyed.latest_counters(stream, checkpoint, partitions=STORES).awaitTermination()
    return keyed.read_state(t.spark, checkpoint).select("path", "seq", "state", "bytes")


@query("M5_hand_out_once", "SELECT DISTINCT path FROM f_jobs WHERE state = 'claimed'")
def hand_out_once(t: Tables):
    out = scratch(t.spark, "claims")
    claims = _job_stream(t).where(F.col("state") == "claimed")
    once = jobs.hand_out_once(claims, "60 days").select("path")
    jobs.append_rows(once, out, scratch(t.spark, "progress")).awaitTermination()
    return t.spark.read.schema(T.StructType([T.StructField("path", T.StringType())])).parquet(out)


@query("M6_progress_blocks", BLOCKS_SQL)
def progress_blocks(t: Tables):
    place = _as_files(t, progress_lines(t), "seq", 3)
    stream = jobs.read_stream(t.spark, place, progress_lines(t).schema, per_trigger=PER_STEP)
    out = scratch(t.spark, "blocks")
    keyed.progress_blocks(stream, out, scratch(t.spark, "progress"), partitions=STORES).awaitTermination()
    return t.spark.read.schema(keyed.BLOCKS).parquet(out)
