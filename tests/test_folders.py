"""The ledger by folder: what a change reads and writes."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from slimlake.operators import ledger as books
from slimlake.operators.scope import EVERYTHING, Scope
from slimlake.schemas import evolve
from slimlake.sources import folders
from slimlake.sources.folders import FolderLedger
from tests.conftest import rows

LISTING = "path string, size long, mod_time string, blake3 string"


def listing(spark, data):
    return spark.createDataFrame([(p, s, "t", None) for p, s in data], LISTING)


def files(root):
    """Digest of each data file, by folder."""
    found = {}
    for file in Path(root).rglob("*.parquet"):
        found.setdefault(file.parent.name, {})[file.name] = hashlib.sha256(file.read_bytes()).hexdigest()
    return found


def state(table):
    return rows(table.read().select("path", "size", "state"))


@pytest.fixture
def table(spark, place):
    table = FolderLedger(spark, f"{place}/ledger")
    paths = [(f"{top}/{k}.jpg", 10_000 + k) for top in ("2024", "b", "c d=é") for k in range(5)]
    table.reconcile(listing(spark, [*paths, ("top.jpg", 5), ("b", 6)]))
    return table


def test_folders_of_paths(spark):
    df = spark.createDataFrame([("a/b/c/x",), ("a/x",), ("x",), ("a//x",)], "path string")
    one, two = (rows(df.select("path", folders.folder_of("path", d))) for d in (1, 2))
    assert one == [("a//x", "a"), ("a/b/c/x", "a"), ("a/x", "a"), ("x", "/")]
    assert two == [("a//x", "a/"), ("a/b/c/x", "a/b"), ("a/x", "a"), ("x", "/")]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_no_row_of_a_scope_is_outside_its_folders(spark, depth):
    paths = ["a", "a/b", "a/b/c", "a/b/c/d", "a/b/c/d/e", "ab", "ab/c", "a/bc/d", "b/a/b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    df = df.withColumn(folders.FOLDER, folders.folder_of("path", depth))
    for prefix in ("a", "a/b", "a/b/c", "a/b/c/d", "ab"):
        scope = Scope((prefix,))
        assert df.where(scope.contains("path") & ~folders.folders_in(scope, depth)).count() == 0


def test_a_rescan_touches_its_partition_alone(spark, table):
    before = files(table.root)
    assert len(before) == 4
    scope = Scope(("2024",))
    fresh = listing(spark, [("2024/0.jpg", 10_000), ("2024/1.jpg", 99_999), ("2024/new.jpg", 7)])
    plan = table._stored().where(folders.folders_in(scope))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1].split("]")[0]
    want = rows(books.reconcile(table.read(), fresh, scope).select("path", "size", "state"))
    table.reconcile(fresh, scope)
    after = files(table.root)
    # The scope's name could be a file at the top, so that small partition is written too.
    for folder in ("folder=b", "folder=c d%3Dé"):
        assert after[folder] == before[folder]
    assert not set(after["folder=2024"]) & set(before["folder=2024"])
    assert state(table) == want and len(want) == 3 + 5 + 5 + 2


def test_a_folder_that_loses_all_rows_is_emptied(spark, table):
    table.reconcile(listing(spark, []), Scope(("b",)))
    assert not any(p.startswith("b") for p, *_ in state(table))
    table.reconcile(listing(spark, [("b/again.jpg", 1)]), Scope(("b/again.jpg",)))
    assert ("b/again.jpg", 1, "pending") in state(table)


def test_done_rows_and_the_rest_of_a_folder_stay(spark, table):
    updates = spark.createDataFrame([("b/1.jpg", "done", None)], "path string, state string, skip_reason string")
    before = files(table.root)
    table.update(updates, books.set_state)
    assert {k: v for k, v in files(table.root).items() if k != "folder=b"} == {k: v for k, v in before.items() if k != "folder=b"}
    table.reconcile(listing(spark, [("b/1.jpg", 10_001)]), Scope(("b/1.jpg", "b/2.jpg")))
    found = {p: s for p, _, s in state(table) if p.startswith("b/")}
    assert found == {"b/0.jpg": "pending", "b/1.jpg": "done", "b/3.jpg": "pending", "b/4.jpg": "pending"}


def test_many_folders_in_one_update(spark, table, monkeypatch):
    monkeypatch.setattr(folders, "NAMED", 1)
    updates = spark.createDataFrame(
        [(p, "failed", "x") for p in ("b/1.jpg", "2024/1.jpg")], "path string, state string, skip_reason string"
    )
    table.update(updates, books.set_state)
    assert sorted(p for p, _, s in state(table) if s == "failed") == ["2024/1.jpg", "b/1.jpg"]
    with pytest.raises(Exception, match="no ledger row"):
        table.update(updates.withColumn("path", F.lit("b/none")), books.set_state)


def test_an_overwrite_that_was_cut_short_is_done_again(spark, table):
    half = evolve(listing(spark, [("b/only.jpg", 3)]).withColumn("state", F.lit("pending")))
    ready = half.withColumn(folders.FOLDER, folders.folder_of())
    ready.write.partitionBy(folders.FOLDER).parquet(f"{table.root}/_next")
    for file in Path(f"{table.root}/folder=b").glob("*.parquet"):
        file.rename(f"{table.root}/_gone-{file.name}")  # removed, and not yet replaced
    again = FolderLedger(spark, table.root)
    assert [p for p, *_ in state(again) if p.startswith("b/")] == ["b/only.jpg"]
    assert len(state(again)) == 1 + 5 + 5 + 2 and not Path(f"{table.root}/_next").exists()


def test_a_hot_folder_is_written_in_several_files(spark, place):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        table = FolderLedger(spark, f"{place}/ledger")
        hot = spark.range(60_000).selectExpr("concat('hot/', sha2(string(id), 256)) path", "id size", "'t' mod_time", "sha2(string(id), 256) blake3")
        table.reconcile(hot.unionByName(listing(spark, [("cold/1", 1)])))
        found = files(table.root)
        assert len(found["folder=hot"]) > 1 and len(found["folder=cold"]) == 1
        assert table.read().count() == 60_001
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_an_empty_ledger(spark, place):
    table = FolderLedger(spark, f"{place}/ledger")
    assert table.read().count() == 0 and table.read(Scope(("a",))).count() == 0
    table.reconcile(listing(spark, []), EVERYTHING)
    assert table.read().count() == 0
