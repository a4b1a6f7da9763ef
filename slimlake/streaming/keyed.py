"""Streams that keep one value per key in Spark's state store.

A micro-batch reads and writes the state of its own keys and nothing else; what earlier
batches brought is never read again. The state is checkpointed with the stream, so it
survives restarts, and ``read_state`` gives it as a table. ``partitions`` is the number
of stores, the session's shuffle partitions if not given, and stays as at the first
start. Keys are never dropped: a
stream has as much state as it has met jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from slimlake.operators import progress

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"
STATE = "newest"


def _start(
    writer, checkpoint: str, every: str | None, partitions: int | None, path: str | None = None
) -> StreamingQuery:
    """Start with the state store that keyed state needs; a stream keeps its own settings."""
    spark = SparkSession.getActiveSession()
    settings = {_PROVIDER: _ROCKS_DB} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        trigger = {"processingTime": every} if every else {"availableNow": True}
        writer = writer.option("checkpointLocation", checkpoint).trigger(**trigger)
        return writer.start(path) if path else writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as of the stream's last batch: the key's columns, then the value's."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    if "user_map_key" in state.columns:
        return state.select("user_map_key.*", "user_map_value.*")
    return state.select("key.*", "value.*")


class Newest(StatefulProcessor):
    """Keeps the row of the highest number per key and gives it whenever it changes."""

    def __init__(self, schema: T.StructType, key: str, order: str):
        self.names, self.key, self.order = schema.names, key, order
        self.kept = T.StructType([f for f in schema.fields if f.name != key])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(STATE, self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = self.kept.names.index(self.order)
        held = self.state.get() if self.state.exists() else None
        newest = held
        for row in rows:
            values = tuple(row[name] for name in self.kept.names)
            if values[place] is not None and (newest is None or values[place] > newest[place]):
                newest = values
        if newest is not held:
            self.state.update(newest)
            found = dict(zip(self.kept.names, newest, strict=True)) | {self.key: key[0]}
            yield Row(**{name: found[name] for name in self.names})

    def close(self) -> None:
        pass


def _thinned(key: str, order: str):
    """The newest row per key of each Arrow batch, so a hot key arrives as few rows."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(order))
            batch = batch.filter(column.is_valid())
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).dictionary_encode().indices
            codes = keys.fill_null(-1).to_numpy(zero_copy_only=False)
            numbers = batch.column(batch.schema.get_field_index(order)).to_numpy(zero_copy_only=False)
            placed = np.lexsort((numbers, codes))
            last = np.append(codes[placed][1:] != codes[placed][:-1], True)
            yield batch.take(pa.array(placed[last]))

    return thin


def latest_counters(
    updates: DataFrame, checkpoint: str, key: str = "path", order: str = "seq",
    every: str | None = None, partitions: int | None = None,
) -> StreamingQuery:
    """Keep the newest counters of each job as state; ``read_state`` is the table of them.

    Rows without a number are passed over; of rows with equal numbers the first stays.
    """
    schema = updates.schema
    thin = updates.mapInArrow(_thinned(key, order), schema)
    changed = thin.groupBy(key).transformWithState(
        statefulProcessor=Newest(schema, key, order), outputStructType=schema,
        outputMode="Update", timeMode="None",
    )
    return _start(changed.writeStream.outputMode("update").format("noop"), checkpoint, every, partitions)


BLOCKS = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("out_time_us", T.LongType()),
        T.StructField("speed", T.DoubleType()),
    ]
)
_REACHED = T.StructType([T.StructField("out_time_us", T.LongType()), T.StructField("speed", T.DoubleType())])


_JOB = T.StructType([T.StructField("job", T.StringType())])
_BUCKET = "bucket"


def _in_force(seen: np.ndarray, values: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The last value seen up to each place, ``before`` where its job has none yet.

    ``first`` is the place where the job of each line begins.
    """
    at = np.maximum.accumulate(np.where(seen, np.arange(len(seen)), -1))
    return np.where(at < first, before, values[np.maximum(at, 0)])


class Blocks(StatefulProcessor):
    """Keeps the values in force per job and gives them whenever a block ends.

    A call has the lines of a bucket of jobs, ordered and filled as whole columns; the
    state is a map from job to values, of which only the jobs at hand are read or written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState(STATE, _JOB, _REACHED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(rows)
        codes, jobs = pd.factorize(lines["job"])
        placed = np.lexsort((lines["seq"].to_numpy(), codes))
        lines, codes = lines.iloc[placed], codes[placed]
        starts = np.searchsorted(codes, np.arange(len(jobs)))
        last = np.append(starts[1:], len(codes)) - 1
        known = [self.state.getValue((job,)) for job in jobs]
        held = [tuple(values) if values else (0, 0.0) for values in known]
        times = _in_force(
            lines["sets_time"].to_numpy(bool), lines["time"].to_numpy(np.int64), starts[codes],
            np.array([time for time, _ in held], np.int64)[codes],
        )
        speeds = _in_force(
            lines["sets_speed"].to_numpy(bool), lines["speed"].to_numpy(float), starts[codes],
            np.array([speed for _, speed in held], float)[codes],
        )
        reached = zip(times[last].tolist(), speeds[last].tolist(), strict=True)
        for job, old, before, after in zip(jobs, known, held, reached, strict=True):
            if not old or after != before:
                self.state.updateValue((job,), after)
        ends = lines["ends_block"].to_numpy(bool)
        if ends.any():
            yield pd.DataFrame({
                "job": lines["job"].to_numpy()[ends], "seq": lines["seq"].to_numpy()[ends],
                "out_time_us": times[ends], "speed": speeds[ends],
            })

    def close(self) -> None:
        pass


def progress_blocks(
    lines: DataFrame, out: str, checkpoint: str, every: str | None = None, partitions: int | None = None,
    buckets: int = 1024,
) -> StreamingQuery:
    """Turn ``(job, seq, line)`` rows into one row per finished progress block, once each.

    Batches must arrive in ``seq`` order; a block may span them. Lines that neither set
    a value nor end a block are left out before the shuffle, and so are those without a job,
    as in the batch form. A call into Python costs more than all its lines, so jobs go
    there by ``buckets``, which stay as at the first start. A task orders what one bucket
    has in one micro-batch, so a stream with a very talkative job needs a limit on what
    a trigger takes (``read_stream``'s ``per_trigger``).
    """
    values = progress.line_values(lines)
    sets = values.select(
        "job", "seq", "ends_block",
        F.col("_time").isNotNull().alias("sets_time"), F.coalesce("_time", F.lit(0).cast("long")).alias("time"),
        F.col("_speed").isNotNull().alias("sets_speed"), F.coalesce("_speed", F.lit(0.0)).alias("speed"),
    ).where("job IS NOT NULL AND (ends_block OR sets_time OR sets_speed)")
    bucket = F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("int")
    blocks = sets.withColumn(_BUCKET, bucket).groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=Blocks(), outputStructType=BLOCKS, outputMode="Append", timeMode="None",
    )
    return _start(blocks.writeStream.outputMode("append").format("parquet"), checkpoint, every, partitions, out)
