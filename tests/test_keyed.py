"""Streams on keyed state: several triggers, restarts, hot and null keys."""

from __future__ import annotations

import shutil

import pandas as pd
import pytest

from slimlake.operators import progress
from slimlake.streaming import jobs, keyed
from tests.conftest import rows
from tests.test_streams import append

COUNTERS = "path string, seq long, bytes long, note string"


def test_newest_counters_over_triggers_and_restarts(spark, place):
    source, checkpoint = f"{place}/in", f"{place}/cp"
    steps = [
        [("a", 1, 10, None), ("b", 2, 20, "x")],
        [("a", 5, None, "y"), ("a", 4, 40, None), (None, 3, 7, None), ("c", None, 1, None)],
        [("b", 1, 1, None), (None, 2, 2, None)],
        [("b", 2, 99, "same number"), ("big", 1, 2**62 + 1, None)],
    ]
    for data in steps[:2]:
        append(spark, source, data, COUNTERS)
    for more in (None, *steps[2:]):
        if more:
            append(spark, source, more, COUNTERS)
        stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema, per_trigger=1)
        keyed.latest_counters(stream, checkpoint).awaitTermination()
    want = [("a", 5, None, "y"), ("b", 2, 20, "x"), (None, 3, 7, None), ("big", 1, 2**62 + 1, None)]
    assert rows(keyed.read_state(spark, checkpoint)) == sorted(want, key=repr)


def test_earlier_input_is_not_read_again(spark, place):
    source, checkpoint = f"{place}/in", f"{place}/cp"
    append(spark, f"{source}/one", [("a", 1, 10, None), ("b", 7, 20, "x")], COUNTERS)
    schema = spark.read.parquet(f"{source}/one").schema

    def run():
        keyed.latest_counters(jobs.read_stream(spark, f"{source}/*", schema), checkpoint).awaitTermination()

    run()
    shutil.move(f"{source}/one", f"{place}/gone")
    append(spark, f"{source}/two", [("a", 2, 11, None)], COUNTERS)
    run()
    assert rows(keyed.read_state(spark, checkpoint)) == [("a", 2, 11, None), ("b", 7, 20, "x")]


def test_a_hot_key_arrives_thinned(spark):
    many = spark.range(20_000, numPartitions=4).selectExpr(
        "if(id % 3 = 0, 'hot', concat('p', id % 500)) path", "id seq", "id bytes", "cast(null as string) note"
    )
    thin = many.mapInArrow(keyed._thinned("path", "seq"), many.schema)
    assert thin.where("path = 'hot'").count() <= 8
    newest = jobs.newest_per_path(many)
    assert rows(jobs.newest_per_path(thin)) == rows(newest)


def test_progress_blocks_span_triggers_and_restarts(spark, place):
    schema = "job string, seq long, line string"
    source, checkpoint, out = f"{place}/in", f"{place}/cp", f"{place}/out"
    batches = [
        [("a", 0, "out_time_us=5"), ("b", 1, "speed=2x"), ("a", 2, "speed=N/A"), ("q", 2, "noise")],
        [("a", 3, "progress=continue"), ("b", 4, "out_time_us=9"), (None, 4, "progress=end")],
        [("b", 5, "progress=end"), ("a", 6, "speed=3.5x"), ("a", 7, "progress=end"), ("a", 8, "speed=1x")],
        [("a", 9, "progress=end")],
    ]
    for data in batches:
        append(spark, source, data, schema)
        stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema)
        keyed.progress_blocks(stream, out, checkpoint).awaitTermination()
    got = rows(spark.read.schema(keyed.BLOCKS).parquet(out))
    assert got == sorted([("a", 3, 5, 0.0), ("a", 7, 5, 3.5), ("a", 9, 5, 1.0), ("b", 5, 9, 2.0)], key=repr)
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert rows(progress.progress_blocks(whole)) == got


@pytest.mark.parametrize("lines", [[], [("a", 1, "noise")]])
def test_nothing_to_tell(spark, place, lines):
    append(spark, f"{place}/in", lines, "job string, seq long, line string")
    stream = jobs.read_stream(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema)
    keyed.progress_blocks(stream, f"{place}/out", f"{place}/cp").awaitTermination()
    assert spark.read.schema(keyed.BLOCKS).parquet(f"{place}/out").count() == 0



def test_one_call_takes_the_lines_of_many_jobs():
    asked, kept = [], {("b",): (7, 2.0), ("other",): (1, 1.0)}

    class Values:
        def getValue(self, key):
            asked.append(key)
            return kept.get(key)

        def updateValue(self, key, value):
            kept[key] = value

    lines = [("b", 4, False, False, 0, True, 3.0), ("a", 2, True, False, 0, False, 0.0), ("b", 3, True, False, 0, False, 0.0),
             ("a", 1, False, True, 5, False, 0.0), ("b", 5, True, False, 0, False, 0.0), ("c", 1, True, False, 0, False, 0.0)]
    columns = ["job", "seq", "ends_block", "sets_time", "time", "sets_speed", "speed"]
    blocks = keyed.Blocks()
    blocks.state = Values()
    parts = iter([pd.DataFrame(lines[:4], columns=columns), pd.DataFrame(lines[4:], columns=columns)])
    found = pd.concat(blocks.handleInputRows((0,), parts, None))
    want = [("a", 2, 5, 0.0), ("b", 3, 7, 2.0), ("b", 5, 7, 3.0), ("c", 1, 0, 0.0)]
    assert sorted(found.itertuples(index=False, name=None)) == want
    assert sorted(asked) == [("a",), ("b",), ("c",)]
    assert kept == {("a",): (5, 0.0), ("b",): (7, 3.0), ("c",): (0, 0.0), ("other",): (1, 1.0)}


def test_values_in_force_are_read_as_a_table(spark, place):
    lines = [("a", 1, "out_time_us=5"), ("b", 2, "progress=end"), ("a", 3, "speed=2x"), ("q", 4, "noise")]
    append(spark, f"{place}/in", lines, "job string, seq long, line string")
    stream = jobs.read_stream(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema)
    keyed.progress_blocks(stream, f"{place}/out", f"{place}/cp", buckets=2).awaitTermination()
    assert rows(keyed.read_state(spark, f"{place}/cp")) == [("a", 5, 2.0), ("b", 0, 0.0)]
