"""Reconciliation, keyed updates, transitions and the books."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slimlake.operators import checks, claims, ledger, recompress, reports
from slimlake.operators.scope import Scope
from slimlake.plans import commands
from slimlake.schemas import LEDGER, evolve
from slimlake.sources.snapshots import SnapshotTable
from tests.conftest import rows

NOW = datetime(2024, 3, 1)
MIB = 1 << 20


def book(spark, *entries):
    """Ledger rows from dicts; unnamed columns are null or their default."""
    names = [f.name for f in LEDGER.fields]
    df = spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], LEDGER)
    return evolve(df)


def listing(spark, *entries):
    return spark.createDataFrame(
        [(p, s, "t1", f"hash-of-{p}") for p, s in entries],
        "path string, size long, mod_time string, blake3 string",
    )


def states(df):
    return {r.path: (r.state, r.size, r.skip_reason) for r in df.collect()}


def test_reconcile_states(spark):
    old = book(
        spark,
        dict(path="a", size=1, state="done", output_path="a.x", output_size=1),
        dict(path="b", size=2, state="skipped", skip_reason="no_gain"),
        dict(path="c", size=3, state="failed", skip_reason="broken"),
        dict(path="gone", size=4, state="pending"),
        dict(path="kept", size=5, state="done", output_path="kept.x", output_size=4),
    )
    new = ledger.reconcile(old, listing(spark, ("a", 1), ("b", 9), ("c", 3), ("d", 7)))
    assert states(new) == {
        "a": ("done", 1, None), "b": ("pending", 9, None), "c": ("failed", 3, "broken"),
        "d": ("pending", 7, None), "kept": ("done", 5, None),
    }
    again = ledger.reconcile(new, listing(spark, ("a", 1), ("b", 9), ("c", 3), ("d", 7)))
    assert rows(again) == rows(new)


def test_a_resized_done_row_is_pending_again_but_not_in_place(spark):
    old = book(
        spark,
        dict(path="a", size=10, state="done", output_path="a.x", output_size=4),
        dict(path="b", size=10, state="done", output_path="b", output_size=4),
        dict(path="c", size=10, state="done", output_path="c", output_size=4),
    )
    new = ledger.reconcile(old, listing(spark, ("a", 4), ("b", 4), ("c", 10)))
    assert states(new) == {"a": ("pending", 4, None), "b": ("done", 10, None), "c": ("pending", 10, None)}


def test_sweep_is_scoped_by_segment_and_case(spark):
    old = book(spark, *[dict(path=p, size=1, state="pending") for p in ("Photos/a", "PhotosOld/a", "photos/a", "Music/a")])
    new = ledger.reconcile(old, listing(spark, ("Photos/b", 1)), Scope(("/Photos/",)))
    assert sorted(states(new)) == ["Music/a", "Photos/b", "PhotosOld/a", "photos/a"]
    counts = ledger.sync_counts(old, listing(spark, ("Photos/b", 1)), Scope(("Photos",))).first()
    assert (counts.seen, counts.removed) == (1, 1)


def test_a_listing_row_outside_its_scope_is_an_error(spark):
    with pytest.raises(PySparkException, match="listed outside the scope: Music/a"):
        ledger.reconcile(book(spark), listing(spark, ("Music/a", 1)), Scope(("Photos",))).collect()


def test_rows_out_of_scope_are_not_shuffled(spark, place):
    book(spark, *[dict(path=f"{d}/{i}", size=1, state="pending") for d in "ab" for i in range(9)]).write.parquet(f"{place}/l")
    merged = ledger.reconcile(spark.read.parquet(f"{place}/l"), listing(spark, ("a/1", 1)), Scope(("a",)))
    assert merged.count() == 10
    plan = merged._jdf.queryExecution().executedPlan().toString()
    outside = plan[plan.index("Union") :].split("\n")
    assert sum("Exchange" in line for line in outside) == 2  # the two sides of the join


def test_hash_options(spark):
    old = book(spark, dict(path="a", size=1, blake3="known", state="skipped"), dict(path="b", size=1, blake3="known", state="skipped"))
    plain = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    lost = {r.path: r.blake3 for r in ledger.reconcile(old, plain).collect()}
    kept = {r.path: r.blake3 for r in ledger.reconcile(old, plain, keep_known_hash=True).collect()}
    assert lost == {"a": None, "b": None}
    assert kept == {"a": "known", "b": None}
    by_hash = ledger.reconcile(old, listing(spark, ("a", 1), ("b", 1)), compare_hash=True)
    assert {s[0] for s in states(by_hash).values()} == {"pending"}


def test_repeated_listing_rows(spark):
    twice = spark.createDataFrame(
        [("a", 1, "t1", None), ("a", 2, "t2", None)], "path string, size long, mod_time string, blake3 string"
    )
    assert states(ledger.reconcile(book(spark), twice)) == {"a": ("pending", 2, None)}


def test_repeated_updates_count_once_and_must_agree(spark):
    old = book(spark, dict(path="a", size=1, state="claimed"), dict(path="b", size=1, state="claimed"))
    skips = [("a", "no_gain"), ("a", "no_gain"), ("b", None), ("b", None)]
    again = spark.createDataFrame(skips, "path string, skip_reason string")
    assert states(ledger.record_skip(old, again)) == {"a": ("skipped", 1, "no_gain"), "b": ("skipped", 1, None)}
    differ = spark.createDataFrame([("a", "no_gain"), ("a", None)], "path string, skip_reason string")
    with pytest.raises(Exception, match="differing updates for a"):
        ledger.record_skip(old, differ).collect()
    claimed = spark.createDataFrame([("a",), ("a",)], "path string")
    assert claims.apply_claims(old, claimed).count() == 2


def test_unknown_update_is_an_error_but_a_hint_is_not(spark):
    old = book(spark, dict(path="a", size=1, state="claimed"))
    updates = spark.createDataFrame([("a", "skipped", "no_gain"), ("x", "done", None)], "path string, state string, skip_reason string")
    with pytest.raises(PySparkException, match="no ledger row for x"):
        ledger.set_state(old, updates).collect()
    assert rows(ledger.unknown_updates(old, updates)) == [("x",)]
    hints = spark.createDataFrame([("a", 30, 3), ("x", 20, 3)], "path string, crf_hint int, crf_hint_preset int")
    assert rows(ledger.record_hints(old, hints).select("path", "crf_hint")) == [("a", 30)]
    bad = spark.createDataFrame([("a", "finished", None)], "path string, state string, skip_reason string")
    with pytest.raises(PySparkException, match="unknown state"):
        ledger.set_state(old, bad).collect()


def test_conversion_replaces_the_hash_and_reason(spark):
    old = book(spark, dict(path="a", size=9, state="failed", skip_reason="x", blake3="listed", reclaimed=1))
    done = spark.createDataFrame(
        [("a", "a.jxl", 5, "jxl-from-jpeg", "byte-exact", "local")],
        "path string, output_path string, output_size long, recipe string, fidelity string, blake3 string",
    )
    row = ledger.record_conversion(old, done, F.lit(NOW)).first()
    assert (row.state, row.skip_reason, row.blake3, row.reclaimed, row.trashed_at) == ("done", None, "local", 0, NOW)


def test_transitions(spark):
    old = book(
        spark,
        dict(path="a", size=1, state="claimed", skip_reason="kept"),
        dict(path="b", size=1, state="failed", skip_reason="x"),
        dict(path="c", size=1, state="skipped", skip_reason="no_gain"),
        dict(path="d", size=1, state="skipped", skip_reason="out_of_scope"),
        dict(path="e", size=1, state="skipped"),
    )
    assert states(ledger.recover_claimed(old))["a"] == ("pending", 1, "kept")
    assert states(ledger.retry_failed(old))["b"] == ("pending", 1, None)
    assert states(ledger.reopen_skipped(old, ["out_of_scope"]))["d"] == ("pending", 1, None)
    assert states(ledger.reopen_skipped(old, [])) == states(old)
    assert states(ledger.reopen_skipped(old, ["no_gain"]))["e"] == ("skipped", 1, None)


def test_reclaiming_twice_releases_nothing(spark):
    old = book(spark, dict(path="a", size=7, state="done", trashed_at=NOW), dict(path="b", size=9, state="done"))
    assert reports.pending_reclaim(old).first().bytes == 7
    once = ledger.mark_reclaimed(old)
    assert reports.pending_reclaim(once).first().bytes == 0
    assert rows(ledger.mark_reclaimed(once)) == rows(once)


def test_retention_is_all_or_nothing(spark):
    at = F.lit(datetime(2024, 3, 31))
    edge = book(spark, dict(path="a", size=1, state="done", trashed_at=NOW))
    assert reports.retention(edge, 30, at).first().ready  # exactly 30 days is old enough
    young = edge.union(book(spark, dict(path="b", size=1, state="done", trashed_at=datetime(2024, 3, 2))))
    row = reports.retention(young, 30, at).first()
    assert (row.files, row.too_recent, row.ready) == (2, 1, False)
    assert not reports.retention(book(spark), 30, at).first().ready
    assert recompress.purge_plan(young, 30, at).count() == 0
    assert recompress.purge_plan(edge, 30, at).count() == 1


def test_purge_is_explicit_and_drops_kept_versions(spark, place):
    at = F.lit(datetime(2024, 3, 31))
    old = book(spark, dict(path="a", size=8, state="done", trashed_at=NOW))
    table = SnapshotTable(spark, f"{place}/t")
    table.write(spark.range(5))
    table.write(spark.range(6))
    assert rows(commands.purge(old, 30, at, table, [1])) == rows(old)
    assert rows(commands.purge(old, 31, at, table, [1], execute=True)) == rows(old)
    assert table.read(1).count() == 5
    after = commands.purge(old, 30, at, table, [1], execute=True)
    assert reports.pending_reclaim(after).first().bytes == 0
    with pytest.raises(Exception, match="(?i)path"):
        table.read(1).count()


def test_claims_never_overlap(spark):
    df = book(spark, *[dict(path=f"p{i:03}", size=i % 7, state="pending", projected_saving=i % 5) for i in range(200)])
    taken: list[str] = []
    for _ in range(5):
        batch = claims.claim_batch(df, 45)
        taken += [r.path for r in batch.collect()]
        df = claims.apply_claims(df, batch)
    assert len(taken) == 200 == len(set(taken))
    workers = claims.assign_workers(claims.pending(ledger.recover_claimed(df)), 8)
    share = [r["count"] for r in workers.groupBy("worker").count().collect()]
    assert share == [25] * 8


def test_a_batch_comes_in_its_order(spark):
    df = book(spark, *[dict(path=f"p{i}", size=i % 9, state="pending", projected_saving=i % 4) for i in range(100)])
    got = [(r.projected_saving, r.size, r.path) for r in claims.first_rows(df, "savings", 37).collect()]
    every = [(i % 4, i % 9, f"p{i}") for i in range(100)]
    assert got == sorted(every, key=lambda r: (-r[0], -r[1], r[2]))[:37]


def test_a_run_limit_ignores_excluded_rows(spark):
    df = book(spark, *[dict(path=f"{d}/{i}", size=9 - i, state="pending") for d in ("x", "y") for i in range(4)])
    got = claims.start_run(df, 3, "size", Scope(excludes=("x/**",)))
    assert rows(got.select("path")) == [("y/0",), ("y/1",), ("y/2",)]


def test_budget_refuses_what_can_never_fit(spark):
    mib = 1 << 20
    files = spark.createDataFrame(
        [("a", 100 * mib, "flac"), ("b", 10 * mib, "flac"), ("c", 10 * mib, None), ("d", 10 * mib, "flac")],
        "path string, size long, recipe string",
    )
    got = claims.admit_within_budget(files, 33, "size")
    assert {r.path: (r.admission, r.reservation_mib) for r in got.collect()} == {
        "a": ("too_large_for_budget", 150), "b": ("admitted", 15), "c": ("admitted", 17), "d": ("waiting", 15),
    }


def test_headroom_and_low_water(spark):
    mib = 1 << 20
    done = spark.createDataFrame(
        [("a", 50 * mib, 30 * mib, 0), ("b", 60 * mib, 40 * mib, 1), ("c", 20 * mib, 1, 0), ("d", 90 * mib, 80 * mib, 0)],
        "path string, size long, output_size long, reclaimed int",
    )
    got = claims.headroom(done, 110 * mib, 10 * mib, ["path"])
    assert [r.headroom_mib for r in got.orderBy("path").collect()] == [70, 90, 89, 9]
    assert rows(claims.low_water_points(got, 20).select("path")) == [("d",)]


def purge_by_loop(done, capacity, floor):
    """(path, admission, purged, headroom, returned, held) with one counter per figure."""
    out, spent, replaced, returned, stopped = [], 0, 0, 0, False
    for path, size, output in sorted(done):
        size, up = size or 0, max(-(-(output or 0) // MIB), 1)
        purged = capacity - spent + -(-returned // MIB) < floor
        returned = replaced if purged else returned
        spent, replaced = spent + up, replaced + size
        left = capacity - spent + -(-returned // MIB)
        stopped = stopped or left < 0
        out.append((path, "waiting", None, None, None, None) if stopped else
                   (path, "uploaded", purged, left, returned, replaced - returned))
    return out


@pytest.mark.parametrize("seed, n, free, floor, gain", [(1, 400, 120, 40, 1.2), (2, 300, 100, 30, 0.8), (3, 60, 5, 20, 1.0), (4, 200, 10**6, 5, 1.0)])
def test_reclaim_goes_on_with_the_space_it_frees(spark, seed, n, free, floor, gain):
    rng = random.Random(seed)
    done = []
    for i in range(n):
        output = rng.choice([None, 0, rng.randrange(12 * MIB)])
        size = rng.choice([None, 0, int((output or 0) * gain), int((output or 0) * gain) + 1])
        done.append((f"f{i:04d}", size, output))
    df = spark.createDataFrame(done, "path string, size long, output_size long").repartition(5)
    got = claims.reclaim_when_low(df, (free + 10) * MIB, 10 * MIB, floor, ["path"])
    expected = purge_by_loop(done, free, floor)
    assert rows(got.drop("size", "output_size")) == expected
    if seed == 1:
        assert 3 < sum(bool(r[2]) for r in expected)
    if seed == 2:
        assert expected[-1][1] == "waiting"


def test_reclaim_of_nothing(spark):
    none = spark.createDataFrame([], "path string, size long, output_size long")
    assert claims.reclaim_when_low(none, 100 * MIB, 0, 10, ["path"]).collect() == []


def test_either_path_finds_a_conversion(spark):
    old = book(
        spark,
        dict(path="a", size=1, state="done", output_path="a.x"), dict(path="b", size=1, state="done", output_path="b"),
        dict(path="c", size=1, state="pending", output_path="c.x"),
    )
    wanted = spark.createDataFrame([("a",), ("a.x",), ("b",), ("c",), ("zz",)], "path string")
    assert rows(ledger.completed_for(old, wanted).select("wanted", "path")) == [("a", "a"), ("a.x", "a"), ("b", "b")]


def test_restore_answers_for_every_wanted_path(spark):
    old = book(
        spark,
        dict(path="a", size=1, state="done", output_path="a.x", recipe="jxl-from-jpeg", fidelity="byte-exact"),
        dict(path="b", size=1, state="done", output_path="b.x", recipe="av1", fidelity="content-exact"),
        dict(path="c", size=1, state="done", output_path="c.x", recipe="flac", fidelity="byte-exact"),
    )
    wanted = spark.createDataFrame([("a.x",), ("b",), ("c",), ("zz",)], "path string")
    got = commands.restorable(old, wanted, listing(spark, ("c", 1)))
    assert {r.wanted: r.refusal for r in got.collect()} == {
        "a.x": None, "b": "b: a lossy re-encode cannot be undone", "c": "c already exists",
        "zz": "no recorded conversion for zz",
    }


def test_verify_needs_a_recorded_hash(spark):
    old = book(
        spark,
        dict(path="a", size=9, blake3=None, state="done", output_path="a.x", output_size=5, fidelity="byte-exact"),
        dict(path="b", size=9, blake3="h", state="done", output_path="b.x", output_size=5, fidelity="byte-exact"),
        dict(path="c", size=9, state="done", output_path="c.x", output_size=5, fidelity="content-exact"),
    )
    there = listing(spark, ("a.x", 5), ("b.x", 5), ("c.x", 5))
    rebuilt = spark.createDataFrame([("a", "h", 9), ("b", "h", 9)], "path string, rebuilt_hash string, rebuilt_size long")
    checked = commands.verify(old, there, rebuilt)
    assert {r.path: (r.status, r.problem) for r in checked.collect()} == {
        "a": ("failed", "no_recorded_hash"), "b": ("rebuilt", None), "c": ("present", None),
    }
    with pytest.raises(RuntimeError, match="1 conversion"):
        checks.require_no_failures(checks.verify_summary(checked))


def test_accounting_keeps_figures_apart(spark):
    old = book(
        spark,
        dict(path="a", size=10, output_size=4, state="done", trashed_at=NOW),
        dict(path="b", size=10, output_size=30, state="done", trashed_at=NOW, reclaimed=1),
    )
    none = spark.createDataFrame([(None,)], "free long")
    row = commands.report(old, none).first()
    assert (row.done, row.logical_bytes, row.pending_files, row.pending_bytes, row.remote_free) == (2, 0, 1, 10, None)
    row = commands.report(book(spark), spark.createDataFrame([(5,)], "free long")).first()
    assert (row.total_bytes, row.logical_bytes, row.remote_free) == (0, 0, 5)


def test_cleanup_flags_a_shortfall(spark):
    old = book(spark, dict(path="a", size=100, state="done", trashed_at=NOW))
    assert [commands.cleanup(old, 10, after).first().short for after in (59, 60, 5)] == [True, False, True]


def test_dry_run_still_records_skips(spark):
    old = book(spark, dict(path="a", size=100, state="claimed"), dict(path="b", size=100, state="claimed"))
    tried = spark.createDataFrame([("a", 100, 97), ("b", 100, 98)], "path string, size long, output_size long")
    assert states(commands.dry_run(old, tried)) == {"a": ("pending", 100, None), "b": ("skipped", 100, "no_gain")}
    assert states(commands.dry_run(old, tried, pure=True)) == states(old)


def test_scan_and_run_end_to_end(spark, place):
    table = SnapshotTable(spark, f"{place}/ledger")
    seen = listing(spark, ("p/a.jpg", 50_000_000), ("p/b.heic", 9_000), ("p/c.png", 40_000_000), ("q/d.jpg", 5_000))
    assert commands.scan(table, seen).first().pending == 4
    limits = commands.Limits()
    ready = commands.prepare_run(table.read(), limits, Scope(("p",), ("**/*.png",)))
    batch = commands.admit_run(ready, limits, 100, 10, scope=Scope(("p",)))
    assert {r.path: r.admission for r in batch.collect()} == {"p/a.jpg": "admitted", "p/b.heic": "skipped"}
    plan = commands.plan(table.read(), limits, Scope(("p",)))
    assert {r.name: r.files for r in plan.collect()} == {"jxl-from-jpeg": 1, "already_optimal": 1, "jxl-from-raster": 1}
