from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from slimlake.functions import media, sizes
from slimlake.operators import checks, reports, scores
from tests.conftest import rows


@pytest.mark.parametrize("n, rank", [(1, 1), (99, 1), (100, 1), (101, 2), (200, 2), (250, 3)])
def test_nearest_rank(spark, n, rank):
    df = spark.createDataFrame([("x", float(i)) for i in range(1, n + 1)], "item string, score double")
    row = scores.score_summary(df.repartition(3), ["item"]).first()
    assert (row.low_percentile, row.min, row.frames) == (float(rank), 1.0, n)


@pytest.mark.parametrize("percent", [0.0, 33.3, 100.0])
def test_percentile_of_any_doubles(spark, percent):
    rng = random.Random(7)
    data = [("hot", 90 + rng.random() * 1e-5) for _ in range(700)] + [("hot", 97.25)] * 300
    data += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 9)) for _ in range(200)]
    data += [("tiny", rng.random() * 1e-12) for _ in range(99)] + [("one", 3.5)]
    data += [(None, float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "item string, score double").repartition(4)
    summary = scores.score_summary(df, ["item"], percent)
    groups = defaultdict(list)
    for name, score in data:
        groups[name].append(score)
    expected = {}
    for name, found in groups.items():
        rank = max(math.ceil(percent / 100.0 * len(found)), 1)
        expected[name] = (min(found), sorted(found)[rank - 1], len(found))
    assert {r["item"]: (r["min"], r["low_percentile"], r["frames"]) for r in summary.collect()} == expected


def test_percentile_with_missing_scores(spark):
    data = [("a", None), ("a", None), ("a", 2.0), ("a", 9.0), ("b", 7.0), ("b", 1.0), ("b", 4.0), ("c", None)]
    df = spark.createDataFrame(data, "item string, score double")
    got = scores.score_summary(df, ["item"], 50.0)
    assert rows(got.select("item", "min", "low_percentile", "frames")) == [
        ("a", 2.0, 2.0, 4), ("b", 1.0, 4.0, 3), ("c", None, None, 1)
    ]


def test_percentile_sorts_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "item string, score double")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    plan = scores.score_summary(df, ["item"])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before


def test_gate_needs_both_sides(spark):
    cases = [("good", 97.0, 95.0), ("mean", 96.99, 99.0), ("low", 99.0, 94.99)]
    df = spark.createDataFrame(cases, "item string, mean double, low_percentile double")
    assert rows(df.where(scores.passes()).select("item")) == [("good",)]


def test_first_passing_attempt(spark):
    data = [
        ("a", 1, 30, 96.0, 95.0), ("a", 2, 28, 97.5, 95.0), ("a", 3, 26, 99.0, 99.0),
        ("b", 1, 30, 90.0, 90.0), ("b", 2, 28, 91.0, 90.0), ("c", 4, 24, 99.0, 99.0),
    ]
    df = spark.createDataFrame(data, "item string, attempt int, crf int, mean double, low_percentile double")
    got = scores.first_passing(df, ["item"]).select("item", "passed", "attempt", "crf")
    assert rows(got) == [("a", True, 2, 28), ("b", False, 2, 28)]


@pytest.mark.parametrize("first, steps", [(30, [30, 28, 26]), (3, [3, 1]), (2, [2]), (0, [0]), (4, [4, 2])])
def test_setting_ladder(spark, first, steps):
    df = spark.createDataFrame([(first,)], "crf int")
    assert df.select(scores.setting_ladder("crf")).first()[0] == steps


def test_gain_and_sizes(spark):
    df = spark.createDataFrame([(100, 97), (100, 98), (0, 0), (100, 150)], "a long, b long")
    assert [r[0] for r in df.select(sizes.is_worthwhile("a", "b")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(sizes.signed_saving_fraction("a", "b")).collect()][2:] == [0.0, -0.5]
    mib = spark.createDataFrame([(0,), (1,), (1 << 20,), ((1 << 20) + 1,), (1 << 60,)], "s long")
    assert [r[0] for r in mib.select(sizes.bytes_to_mib("s")).collect()] == [0, 1, 1, 2, 2**32 - 1]


def test_progress_figures(spark):
    df = spark.createDataFrame(
        [(5_000_000, 2.0, 10.0), (20_000_000, 2.0, 10.0), (5, 0.0, 10.0), (5, 1.0, None), (5, 1.0, 0.0)],
        "t long, s double, d double",
    )
    got = [tuple(r) for r in df.select(sizes.progress_fraction("t", "d"), sizes.eta_secs("t", "s", "d")).collect()]
    assert got[:2] == [(0.5, 2.5), (1.0, 0.0)]
    assert got[2][0] == pytest.approx(5e-7) and got[2][1] is None
    assert got[3:] == [(None, None), (None, None)]


def test_model_by_area(spark):
    df = spark.createDataFrame([(1920, 1080), (3840, 2160), (1920, 2160)], "w int, h int")
    assert [r[0] for r in df.select(media.score_model("w", "h")).collect()] == ["vmaf_v0.6.1", "vmaf_4k_v0.6.1", "vmaf_v0.6.1"]


def test_confirm_write_compares_hashes_without_case(spark):
    meant = spark.createDataFrame([("a", 1, "ab"), ("b", 1, "ab"), ("c", 1, "ab"), ("d", 1, "ab"), ("e", 1, "ab")], "path string, size long, hash string")
    found = spark.createDataFrame([("a", 1, "AB"), ("b", 2, "ab"), ("c", 1, None), ("d", 1, "zz")], "path string, size long, hash string")
    assert rows(checks.confirm_written(meant, found)) == [
        ("a", "ok"), ("b", "size_mismatch"), ("c", "ok_size_only"), ("d", "hash_mismatch"), ("e", "missing"),
    ]


def test_remux_names_the_first_difference(spark):
    schema = "i int, frames long, video string, audio string"
    before = spark.createDataFrame([(i, 3, "v", None if i == 4 else "a") for i in range(6)], schema)
    after = spark.createDataFrame([(0, 3, "v", "a"), (1, 2, "x", "a"), (2, 3, "x", "y"), (3, 3, "v", None), (4, 3, "v", None)], schema)
    assert [o for _, o in rows(checks.compare_remux(before, after, ["i"]))] == [
        "content-exact", "frames_dropped", "video_changed", "audio_changed", "content-exact", "frames_dropped",
    ]


def test_parity(spark):
    schema = "path string, size long, mod_time string, blake3 string"
    a = spark.createDataFrame([("a", 1, "t", "h"), ("b", 1, "t", None), ("c", 1, "t", "h")], schema)
    b = spark.createDataFrame([("a", 1, "t", "h"), ("b", 1, "t", "h"), ("d", 1, "t", "h")], schema)
    assert rows(checks.parity(a, b)) == [("b", "blake3_differs"), ("c", "only_left"), ("d", "only_right")]
    assert rows(checks.parity(a, b, with_hash=False)) == [("c", "only_left"), ("d", "only_right")]
    assert checks.parity(a, a).isEmpty()


def test_failure_histogram_groups_by_prefix(spark):
    long = "e" * 80
    df = spark.createDataFrame([("failed", long + "1"), ("failed", long + "2"), ("skipped", long)], "state string, skip_reason string")
    assert rows(reports.failure_histogram(df)) == [(long, 2)]
