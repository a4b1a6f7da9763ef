"""Structured Streaming jobs. State that must outlive a stream is in a table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slimlake import constants as K
from slimlake.operators.ledger import reconcile
from slimlake.operators.scope import EVERYTHING, Scope
from slimlake.schemas import LEDGER
from slimlake.sources.snapshots import SnapshotTable
from slimlake.streaming.log import BatchLog, stream_id


def _start(stream: DataFrame, checkpoint: str, mode: str, work: Callable, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.foreachBatch(work).trigger(**trigger).start()


def _tag(batch: DataFrame, batch_id: int) -> str:
    return f"{stream_id(batch)}/batch-{batch_id}"


class _Arrivals:
    """Rows of listings that are not whole yet: a folder per stream, batch and listing."""

    def __init__(self, table: SnapshotTable, schema: T.StructType):
        self.spark, self.root = table.spark, f"{table.root}/arriving"
        keys = [("stream", T.StringType()), ("batch", T.LongType()), ("key", T.StringType())]
        self.schema = T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in keys)])
        self.columns = schema.names

    def _at(self, pattern: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """A replay replaces what the batch wrote before."""
        place = f"{self.root}/stream={stream_id(batch)}/batch={batch_id}"
        batch.withColumn("key", F.md5("listing")).write.mode("overwrite").partitionBy("key").parquet(place)

    def all(self) -> DataFrame:
        path, fs = self._at("")
        if not fs.exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.root)

    def of(self, stream: str, listing: str) -> DataFrame:
        """The rows of one listing; only its folders are read."""
        own = (F.col("stream") == stream) & (F.col("key") == F.lit(_md5(listing)))
        return self.all().where(own).select(*self.columns)

    def drop(self, stream: str, listing: str) -> None:
        path, fs = self._at(f"stream={stream}/batch=*/key={_md5(listing)}")
        for found in fs.globStatus(path) or []:
            fs.delete(found.getPath(), True)


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def waiting_listings(table: SnapshotTable, schema: T.StructType) -> DataFrame:
    """Listings that have begun to arrive and are not whole: rows so far and in all."""
    rows = _Arrivals(table, schema).all()
    return rows.groupBy("stream", "listing").agg(
        F.count("*").alias("n_rows"), F.max("listing_rows").alias("listing_rows"),
        F.min("batch").alias("since_batch"),
    )


def ingest_listings(
    listings: DataFrame, table: SnapshotTable, checkpoint: str, scope: Scope = EVERYTHING,
    complete: bool = True, every: str | None = None,
) -> StreamingQuery:
    """Fold arriving listing rows into the ledger table.

    With ``complete``, rows carry the ``listing`` they belong to and its row count,
    ``listing_rows`` (different rows); a row without either is an error. They are set aside, by listing,
    until all are in, however the listing is split over micro-batches; then it is folded
    in once, sweeps what it lacks, and what was set aside is removed. A delivery that
    comes twice counts once, also when its listing has been folded. What never becomes
    whole is shown by ``waiting_listings``. Otherwise a micro-batch only adds and
    refreshes. Either is committed under the stream's identity, so a replay changes
    nothing.
    """
    arriving = _Arrivals(table, listings.schema)

    def fold(rows: DataFrame, sweep: bool):
        def change(old: DataFrame | None) -> DataFrame:
            old = table.spark.createDataFrame([], LEDGER) if old is None else old
            return reconcile(old, rows, scope, sweep=sweep)

        return change

    def add(batch: DataFrame, batch_id: int) -> None:
        table.update(fold(batch, sweep=False), "ingest", _tag(batch, batch_id))

    def gather(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch)
        # One row per listing that has rows in this batch.
        found = batch.groupBy("listing").agg(
            F.min("listing_rows").alias("least"), F.max("listing_rows").alias("most"),
            F.count_if(F.col("listing_rows").isNull()).alias("unnumbered"),
        ).collect()
        for name, least, most, unnumbered in found:
            if name is None or unnumbered or least != most:
                raise ValueError(f"rows of listing {name} lack a name, or agree on no row count")
        folded = [r.listing for r in found if table.has_tag(f"{stream}/listing-{r.listing}")]
        arriving.add(batch.where(~F.col("listing").isin(folded)) if folded else batch, batch_id)
        for name, whole in ((r.listing, r.most) for r in found):
            if name not in folded:
                rows = arriving.of(stream, name)
                if rows.count() < whole:
                    continue
                # Some may have come twice.
                rows = rows.distinct()
                n = rows.count()
                if n > whole:
                    raise ValueError(f"listing {name} has {n} rows instead of {whole}")
                if n < whole:
                    continue
                table.update(fold(rows, sweep=True), "ingest", f"{stream}/listing-{name}")
            arriving.drop(stream, name)

    return _start(listings, checkpoint, "append", gather if complete else add, every)


def running_counts(
    transitions: DataFrame, table: SnapshotTable, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep the count per state current; the state is one row per state name."""
    counts = transitions.groupBy("state").agg(F.count("*").alias("n"))

    def work(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, "counts", _tag(batch, batch_id))

    return _start(counts, checkpoint, "complete", work, every)


def throttled_progress(updates: DataFrame, delay: str, seconds: int = K.PROGRESS_SECONDS) -> DataFrame:
    """At most one line per window: the last value seen in it.

    ``updates`` needs a ``ts`` of type TIMESTAMP. The watermark bounds the state: a
    window is dropped from it once final. Windows are given whenever they change, see
    ``keep_windows``.
    """
    return (
        updates.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(
            F.max_by(F.struct("path", "state"), F.struct("ts", "seq")).alias("last"),
            F.count("*").alias("updates"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("last.path").alias("path"),
            F.col("last.state").alias("state"),
            "updates",
        )
    )


WINDOWS = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("updates", T.LongType()),
    ]
)


def keep_windows(windows: DataFrame, log: BatchLog, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Log every change of a window, so those still open at the end are there too."""
    return _start(windows, checkpoint, "update", log.write, every)


def final_windows(rows: DataFrame) -> DataFrame:
    """The last state of each window: a window only gains updates."""
    last = F.max_by(F.struct("path", "state", "updates"), "updates").alias("_last")
    return rows.groupBy("window_start").agg(last).select("window_start", "_last.*")


def append_rows(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append final rows to Parquet, once each."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def newest_per_path(rows: DataFrame) -> DataFrame:
    """The newest counters of each job, from rows at rest; ``keyed`` has them for streams."""
    data = [c for c in rows.columns if c not in ("path", "seq", "stream", "batch")]
    newest = rows.groupBy("path").agg(
        F.max("seq").alias("seq"), F.max_by(F.struct(*data), "seq").alias("_row")
    )
    return newest.select("path", "seq", "_row.*")


def hand_out_once(claims: DataFrame, delay: str, salts: int = 64) -> DataFrame:
    """Drop repeated claims of a path that arrive within ``delay`` of each other.

    Repeats are dropped per path and salt first, so a path with most of the rows
    is thinned in many tasks; at most ``salts`` rows of it reach the second step.
    """
    salted = claims.withWatermark("ts", delay).withColumn(
        "_salt", F.pmod(F.xxhash64("path", "ts"), F.lit(salts))
    )
    thinned = salted.dropDuplicatesWithinWatermark(["path", "_salt"])
    return thinned.dropDuplicatesWithinWatermark(["path"]).drop("_salt")


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, per_trigger: int | None = None):
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)
