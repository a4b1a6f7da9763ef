"""A whole run: admitted, judged, recorded in one version and summed up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slimlake.operators.decide import Limits
from slimlake.operators.scope import Scope
from slimlake.plans import commands
from slimlake.schemas import evolve
from slimlake.sources.snapshots import SnapshotTable
from tests.conftest import rows

MB = 1 << 20
ATTEMPTS = (
    "path string, recipe string, output_path string, output_size long, fidelity string, blake3 string, "
    "error string, interrupted boolean"
)


@pytest.fixture
def table(spark, place):
    data = [
        ("a/won.png", 8 * MB, "pending", None), ("a/small-gain.png", 7 * MB, "pending", None),
        ("a/broken.wav", 6 * MB, "claimed", None), ("a/stopped.wav", 5 * MB, "pending", None),
        ("a/never-tried.jpg", 4 * MB, "pending", None), ("a/tiny.jpg", 100, "pending", None),
        ("a/huge.png", 900 * MB, "pending", None), ("a/text.txt", 9 * MB, "pending", None),
        ("a/waits.jpg", 2 * MB, "pending", None), ("a/failed.jpg", 3 * MB, "failed", "earlier"),
        ("a/old.jpg", 3 * MB, "done", None), ("b/other.png", 8 * MB, "pending", None), ("a/no/x.png", 8 * MB, "pending", None),
    ]
    ledger = spark.createDataFrame(data, "path string, size long, state string, skip_reason string")
    table = SnapshotTable(spark, f"{place}/ledger")
    order = F.col("size").alias("projected_saving")
    table.write(evolve(ledger.select("*", order, F.lit("kept").alias("blake3"))), "scan")
    return table


def attempts(spark):
    data = [
        ("a/won.png", None, "a/won.jxl", 4 * MB, "byte-exact", "new", None, None),
        ("a/small-gain.png", None, "a/small.jxl", 7 * MB - 9, "byte-exact", "new", None, False),
        ("a/broken.wav", None, None, None, None, None, "no sound", False),
        ("a/stopped.wav", None, None, None, None, None, "signal", True),
        ("b/other.png", None, "b/o.jxl", 1, "byte-exact", "new", None, None),
    ]
    return spark.createDataFrame(data, ATTEMPTS)


def test_a_run_is_one_version_and_one_summary(spark, table):
    scope, as_of = Scope(("a",), ("a/no/**",)), F.to_timestamp(F.lit("2024-01-01"))
    version = table.current().version
    limits = Limits(max_file_bytes=1 << 40)
    told = commands.run(table, attempts(spark), limits, 56, 100, as_of, scope=scope, tag="run-1")
    summary = told.first().asDict()
    assert table.current().version == version + 1
    after = {r.path: r for r in table.read().collect()}
    states = {p: (r.state, r.skip_reason) for p, r in after.items()}
    assert states == {
        "a/won.png": ("done", None), "a/small-gain.png": ("skipped", "no_gain"), "a/broken.wav": ("failed", "no sound"),
        "a/stopped.wav": ("pending", None), "a/never-tried.jpg": ("pending", None), "a/tiny.jpg": ("skipped", "too_small"),
        "a/huge.png": ("skipped", "too_large_for_budget"), "a/text.txt": ("skipped", "unsupported"),
        "a/waits.jpg": ("pending", None), "a/failed.jpg": ("failed", "earlier"), "a/old.jpg": ("done", None),
        "b/other.png": ("pending", None), "a/no/x.png": ("skipped", "out_of_scope"),
    }
    won, other = after["a/won.png"], after["a/broken.wav"]
    assert (won.output_path, won.output_size, won.recipe, won.fidelity, won.blake3, won.reclaimed) == (
        "a/won.jxl", 4 * MB, "jxl-from-raster", "byte-exact", "new", 0
    )
    assert str(won.trashed_at) == "2024-01-01 00:00:00" and other.trashed_at is None and other.blake3 == "kept"
    # The row that waits for space has no outcome.
    assert summary == {
        "converted": 1, "skipped": 4, "failed": 1, "cancelled": 2,
        "input_bytes": 8 * MB, "output_bytes": 4 * MB, "saved_bytes": 4 * MB,
    }
    again = commands.run(table, attempts(spark), limits, 56, 100, as_of, scope=scope, tag="run-1")
    assert again.first().converted == 0 and table.current().version == version + 1


def test_retried_failures_and_a_batch_limit(spark, table):
    as_of = F.to_timestamp(F.lit("2024-01-01"))
    told = commands.run(
        table, attempts(spark).limit(0), Limits(), 10_000, 3, as_of, scope=Scope(("a",)), retry_failed=True
    )
    # The three largest: one is no candidate, the others were admitted and not tried.
    assert told.select("skipped", "cancelled", "converted").first() == (1, 2, 0)
    states = dict(rows(table.read().select("path", "state")))
    assert states["a/failed.jpg"] == "pending" and states["a/text.txt"] == "skipped"
