"""Fingerprints, comparison, the rewrite loop and the snapshot table."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slimlake.operators import digests, recompress
from slimlake.operators.recompress import Setting
from slimlake.schemas import LEDGER, evolve
from slimlake.sources import listing, media, snapshots
from slimlake.sources.snapshots import NothingCommitted, SnapshotTable
from tests.conftest import rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(2000).select(
        "id",
        (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("name-"), F.col("id") % 13)).alias("s"),
        F.create_map(F.lit("k"), F.col("id") % 3).alias("m"),
    )


def test_fingerprint_ignores_order_only(spark, table):
    base = digests.take_fingerprint(table)
    strong = digests.take_proof(table)
    assert digests.take_fingerprint(table.repartition(7, "x")) == base
    assert digests.take_proof(table.orderBy("x")) == strong
    damaged = {
        "value": table.withColumn("x", F.when(F.col("id") == 77, 0.5).otherwise(F.col("x"))),
        "lost": table.where("id <> 77"),
        "repeated": table.union(table.where("id = 77")),
        "swapped for a repeat": table.where("id <> 77").union(table.where("id = 78")),
        "null": table.withColumn("s", F.when(F.col("id") == 77, None).otherwise(F.col("s"))),
        "map": table.withColumn("m", F.when(F.col("id") == 77, F.create_map(F.lit("k"), F.lit(9).cast("long"))).otherwise(F.col("m"))),
    }
    for name, other in damaged.items():
        assert digests.take_fingerprint(other) != base, name
        assert digests.take_proof(other) != strong, name
        assert not digests.multiset_difference(table, other).isEmpty(), name
        assert recompress.verify(table, other) is None, name


def test_nulls_and_signed_zeros_are_told_apart(spark):
    pairs = [([(None, "a")], [("a", None)], "x string, y string"), ([(0.0,)], [(-0.0,)], "x double")]
    for left, right, schema in pairs:
        a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
        assert digests.take_fingerprint(a) != digests.take_fingerprint(b)
        assert digests.multiset_difference(a, b).count() == 2
    nan = spark.createDataFrame([(float("nan"),)], "x double")
    assert digests.multiset_difference(nan, nan).isEmpty()


def test_schema_is_part_of_the_proof(spark):
    a = spark.range(3)
    assert recompress.verify(a, a.select(F.col("id").cast("int"))) is None


def test_symmetric_difference_keeps_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (3,)], "x int")
    got = digests.symmetric_difference(a, b).select("x", "side", "copies")
    assert rows(got) == [(1, "left", 2), (2, "left", 1), (3, "right", 2)]


def test_same_rows_tells_values_apart(spark):
    def table(*data):
        return spark.createDataFrame(list(data), "s string, d double, b binary, m map<string,int>, t timestamp_ntz, a array<string>")

    at = datetime(2024, 5, 6, 7, 8, 9, 123456)
    row = ("x", 0.5, b"\x00", {"p": 1, "q": None}, at, ["u", None])
    assert digests.same_rows(table(row, row), table(row, row))
    assert digests.same_rows(table(row), table(("x", 0.5, b"\x00", {"q": None, "p": 1}, at, ["u", None])))
    for place, value in enumerate(["", -0.5, b"", {"p": 1}, at.replace(microsecond=123457), ["u"]]):
        for other in (value, None):
            changed = (*row[:place], other, *row[place + 1 :])
            assert not digests.same_rows(table(row), table(changed))
    assert not digests.same_rows(table(row, row), table(row))
    zero, minus = ("x", 0.0, None, None, None, None), ("x", -0.0, None, None, None, None)
    assert not digests.same_rows(table(zero), table(minus))
    text = spark.createDataFrame([("1:a", "b")], "x string, y string")
    assert not digests.same_rows(text, spark.createDataFrame([("1", "a1:b")], "x string, y string"))


def make(spark, place, df):
    out = SnapshotTable(spark, f"{place}/t")
    out.write(df, "import", compression="uncompressed")
    return out


def wide(spark):
    return spark.range(20_000).select("id", F.repeat(F.lit("text "), 20).alias("t"))


def damaged(df):
    return {
        "changed": df.withColumn("x", F.when(F.col("id") == 77, -1.0).otherwise(F.col("x"))),
        "lost": df.where("id <> 500"),
        "twice": df.union(df.where("id = 9")),
        "swapped": df.where("id <> 3").union(df.where("id = 4")),
    }


@pytest.fixture
def numbered(spark):
    return spark.range(2000).selectExpr("id", "id % 4 AS k", "cast(id AS double) / 3 AS x", "if(id % 7 = 0, null, string(id)) AS s")


def test_sums_of_buckets_add_up_and_show_where_tables_differ(spark, numbered):
    tree = digests.proof_tree(numbered, ["k"], buckets=16)
    assert rows(digests.merged(tree)) == [tuple(digests.take_proof(numbered).values())]
    assert rows(digests.differing_parts(tree, digests.proof_tree(numbered.repartition(3), ["k"], buckets=16))) == []
    for name, copy in damaged(numbered).items():
        found = digests.differing_parts(tree, digests.proof_tree(copy, ["k"], buckets=16))
        assert 1 <= found.count() <= 2, name
        want = rows(digests.multiset_difference(numbered, copy))
        assert rows(digests.localised_difference(numbered, copy, buckets=16)) == want and want, name
    gone = digests.proof_tree(numbered.where("k <> 2"), ["k"], buckets=16)
    assert {k for k, _ in rows(digests.differing_parts(tree, gone))} == {2}
    nothing = numbered.limit(0)
    assert digests.take_proof(nothing)["rows"] == 0
    assert digests.localised_difference(nothing, nothing).count() == 0


def test_tables_that_agree_shuffle_no_row(spark, numbered):
    plan = digests.merged(digests.proof_tree(numbered, buckets=8))._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and plan.count("partial_sum") > 0


def test_partition_folders_are_kept(spark, place, numbered):
    table = SnapshotTable(spark, f"{place}/t")
    staged = table.staging_place()
    split = numbered.withColumn("day", F.concat(F.lit("2024-0"), (F.col("k") + 1).cast("string")))
    split.write.option("compression", "uncompressed").partitionBy("day", "k").parquet(f"{table.root}/{staged}")
    table.publish(staged, "import")
    before = table.read()
    done = recompress.recompress(table, Setting("zstd", ("id",)))
    assert (done.outcome, done.fidelity) == ("converted", "byte-exact")
    place = f"{table.root}/{table.current().data}"
    assert recompress.partition_columns(spark, place) == ["day", "k"]
    assert rows(table.read()) == rows(before) and table.read().schema == before.schema
    assert recompress.partition_columns(spark, f"{place}/day=2024-01") == ["k"]
    typed = recompress.read_rewritten(spark, place, split)
    assert typed.schema["day"].dataType.simpleString() == "string" and typed.columns == split.columns
    assert digests.take_proof(typed) == digests.take_proof(split)
    table.write(numbered, "flat", compression="uncompressed")
    assert recompress.partition_columns(spark, f"{table.root}/{table.current().data}") == []


def test_largest_inputs_with_every_setting(spark, place):
    text = "concat('some text of row ', id, ' ', repeat('x', 40))"
    df = spark.range(3000).selectExpr(
        "concat('in+put =/%', CASE WHEN id < 2000 THEN 0 WHEN id < 2900 THEN 1 ELSE 2 END) AS name", f"{text} AS text", "id % 3 = 0 AS flag"
    ).union(spark.sql("SELECT cast(null AS string), 'no name', true"))
    found = recompress.bench_inputs(
        df, "name", place + "/b", [Setting("uncompressed"), Setting("zstd", ("text",))], 2, F.octet_length("text")
    ).collect()
    assert sorted((r.name, r.setting, r.rows, r.fidelity, r.outcome) for r in found) == [
        ("in+put =/%0", "uncompressed", 2000, "byte-exact", "no_gain"), ("in+put =/%0", "zstd by text", 2000, "byte-exact", "kept"),
        ("in+put =/%1", "uncompressed", 900, "byte-exact", "no_gain"), ("in+put =/%1", "zstd by text", 900, "byte-exact", "kept"),
    ]
    assert all(r.input_bytes > 0 and r.output_bytes > 0 for r in found)


def test_recompress_keeps_a_gain(spark, place):
    table = make(spark, place, wide(spark).withColumn("u", F.sha2(F.col("id").cast("string"), 256)))
    before = table.read()
    dry = recompress.recompress(table, Setting("zstd"), execute=False)
    assert (dry.outcome, table.current().version) == ("would_convert", 1)
    done = recompress.recompress(table, Setting("zstd", ("t", "id")))
    assert (done.outcome, done.fidelity, done.version) == ("converted", "byte-exact", 2)
    assert done.output_bytes < 0.97 * done.input_bytes
    assert digests.multiset_difference(before, table.read()).isEmpty()
    assert recompress.recompress(table, Setting("zstd", ("t", "id"))).outcome == "no_gain"
    assert table.current().version == 2


def test_restore_checks_the_fingerprint(spark, place):
    table = make(spark, place, wide(spark))
    known = digests.take_fingerprint(table.read())
    table.write(spark.range(5).select("id", F.lit("x").alias("t")), "damage")
    assert recompress.restore(table, 1, known) == 3
    assert table.read().count() == 20_000
    with pytest.raises(RuntimeError):
        recompress.restore(table, 2, known)


def test_gain_gate_edges():
    assert recompress.is_gain(100, 97) and not recompress.is_gain(100, 98)
    assert not recompress.is_gain(0, 0) and not recompress.is_gain(100, 120)


def test_payload_trial_round_trips(spark):
    df = spark.createDataFrame([("a", "x" * 5000), ("a", ""), ("b", "yz" * 300), ("b", None)], "c string, p string")
    summary = recompress.trial_summary(recompress.payload_trial(df, "p", ["c"], ["zlib", "lzma", "bz2"]), ["c"])
    got = {(r.c, r.codec): (r.payloads, r.verified, r.input_bytes) for r in summary.collect()}
    assert got == {(c, k): v for k in ("zlib", "lzma", "bz2") for c, v in {"a": (2, 2, 5000), "b": (1, 1, 600)}.items()}
    assert {r.c for r in recompress.best_ratios(summary, ["c"]).collect()} == {"a", "b"}


# -- snapshots ---------------------------------------------------------------


def test_snapshot_versions(spark, place):
    table = SnapshotTable(spark, f"{place}/t")
    with pytest.raises(NothingCommitted):
        table.read()
    assert table.write(spark.range(3), tag="a") == 1
    assert table.write(spark.range(9), tag="a") == 1  # a replay changes nothing
    assert table.write(table.read().union(spark.range(1)), tag="b") == 2
    assert (table.read().count(), table.read(1).count()) == (4, 3)
    assert table.restore(1) == 3
    assert table.read().count() == 3
    with pytest.raises(ValueError):
        table.drop_data([1])
    table.drop_data([2])
    with pytest.raises(PySparkException):
        table.read(2).count()
    assert table.read().count() == 3


def test_two_writers_both_end_committed(spark, place):
    one, two = make(spark, place, spark.range(3)), SnapshotTable(spark, f"{place}/t")
    calls = []

    def slow(old):
        if not calls:  # another writer commits while this one works
            two.update(lambda other: other.union(spark.range(100, 101)), "two")
        calls.append(1)
        return old.union(spark.range(200, 201))

    assert one.update(slow, "one") == 3
    assert len(calls) == 2
    assert rows(two.read()) == [(0,), (1,), (100,), (2,), (200,)]
    number, data = one._next(), one.staging_place()
    one._publish(number, data, "first", None)
    with pytest.raises(snapshots.WriteConflict):
        two._publish(number, data, "second", None)


def test_many_commits_are_read_from_few_files(spark, place):
    table = make(spark, place, spark.range(3))
    data = table.current().data
    for i in range(2, 2 * snapshots.FOLD + 4):
        table._publish(i, data, f"step {i}", f"tag {i}")
    assert len(table.commits().inputFiles()) <= snapshots.FOLD
    assert table.commits().count() == 2 * snapshots.FOLD + 3
    assert table.has_tag("tag 5") and table.current().version == 2 * snapshots.FOLD + 3
    assert table.read(2).count() == 3


def test_unpublished_data_is_not_seen(spark, place):
    table = make(spark, place, spark.range(3))
    spark.range(99).write.parquet(f"{table.root}/{table.staging_place()}")
    assert table.read().count() == 3
    assert table.write(spark.range(4)) == 2
    assert table.read().count() == 4


def test_kept_copy_refuses_to_overwrite(spark, place):
    snapshots.keep_copy(spark.range(3), f"{place}/kept")
    odd = spark.createDataFrame([("007", 1), ("", 2), (None, 3), ("a/b=c", 4)], "lot string, n int")
    snapshots.keep_copy(odd, f"{place}/odd", ["lot", "n"])
    assert rows(snapshots.read_copy(spark, f"{place}/odd")) == rows(odd)
    assert snapshots.read_copy(spark, f"{place}/odd").schema == odd.schema
    with pytest.raises(PySparkException):
        snapshots.keep_copy(spark.range(3), f"{place}/kept")


def test_evolution_adds_defaults_and_keeps_extras(spark):
    old = spark.createDataFrame([("a", 1, "x")], "path string, size int, extra string")
    new = evolve(old)
    assert new.columns == [*LEDGER.names, "extra"]
    row = new.first()
    assert (row.state, row.reclaimed, row.projected_saving, row.size, row.extra) == ("pending", 0, 0, 1, "x")
    assert rows(evolve(new)) == rows(new)


def test_bucketed_tables_join_without_a_shuffle_of_theirs(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("path"), "id")
    snapshots.save_bucketed(df, "bucketed_ledger", "path", 4)
    joined = spark.table("bucketed_ledger").alias("a").join(
        spark.table("bucketed_ledger").alias("b").hint("merge"), "path"
    )
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE bucketed_ledger")


# -- sources -----------------------------------------------------------------

LISTING = (
    '[{"Path":"b.txt","Name":"b.txt","Size":7,"ModTime":"2024-01-01T00:00:00.123456789Z","IsDir":false,'
    '"Hashes":{"BLAKE3":"abc","md5":"x"}},{"Path":"sub","Size":-1,"IsDir":true},{"Path":"c.bin","Size":-1}]'
)


def test_listing_array(spark, place):
    with open(f"{place}/l.json", "w") as out:
        out.write(LISTING)
    got = listing.read_listing_json(spark, f"{place}/l.json", "/drive/")
    assert rows(got) == [("drive/b.txt", 7, "2024-01-01T00:00:00.123456789Z", "abc"), ("drive/c.bin", 0, None, None)]


@pytest.mark.parametrize("text", [LISTING[:-9], '{"not": "closed"', "[{]"])
def test_damaged_listing_is_an_error(spark, place, text):
    with open(f"{place}/l.json", "w") as out:
        out.write(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        listing.read_listing_json(spark, f"{place}/l.json").collect()


def test_direct_listing(spark, place):
    import os

    tree = {"readme": 3, "q1/jan/day 1.csv": 11, "q1/jan/day 2.csv": 2_000, "q1/feb.csv": 1, "q2/ß.bin": 70}
    os.makedirs(f"{place}/root/q3/nothing")
    for name, size in tree.items():
        os.makedirs(os.path.dirname(f"{place}/root/{name}"), exist_ok=True)
        with open(f"{place}/root/{name}", "wb") as out:
            out.write(bytes(i % 251 for i in range(size)))
    got = listing.list_files(spark, f"{place}/root")
    assert rows(got.select("path", "size")) == sorted(tree.items())
    part = listing.list_files(spark, f"{place}/root", "/q1/jan/", with_hash=True)
    assert rows(part.select("path", F.length("blake3"))) == [("q1/jan/day 1.csv", 64), ("q1/jan/day 2.csv", 64)]
    assert "content" not in got._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    with pytest.raises(PySparkException):
        listing.list_files(spark, f"{place}/absent").collect()
    os.makedirs(f"{place}/root{place}")
    with open(f"{place}/root{place}/deep.txt", "wb") as out:
        out.write(b"x")
    for root in (f"{place}/root/", f"file://{place}/root", f"file:{place}/root"):
        assert (f"{place[1:]}/deep.txt", 1) in rows(listing.list_files(spark, root).select("path", "size"))


def test_probe_json_edges(spark):
    texts = [
        '{"streams":[],"format":{}}', "{}",
        '{"format":{"format_name":"mov,,mp4","duration":"12.5","bit_rate":"-4"},"unknown":1,"streams":['
        '{"codec_type":"video"},{"codec_type":"audio"},{"codec_type":"subtitle"},{"codec_type":"data"},'
        '{"codec_type":"video","codec_name":"hevc","width":4,"height":5,"bit_rate":"x","side_data_list":[{},{"side_data_type":"DoVi conf"}]}]}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, probe string")
    empty, bare, full = [r.probe for r in media.with_probe(df).orderBy("i").collect()]
    assert (empty.video, bare.audio_codecs, bare.duration_secs, bare.subtitle_count) == ([], [], None, 0)
    assert (full.format_names, full.duration_secs, full.bit_rate) == (["mov", "mp4"], 12.5, None)
    assert (full.audio_codecs, full.subtitle_count) == ([""], 1)
    assert [tuple(v) for v in full.video] == [("", 0, 0, None, None, False), ("hevc", 4, 5, None, None, True)]
    bad = spark.createDataFrame([("{nope",)], "probe string")
    with pytest.raises(Exception, match="(?i)malformed"):
        media.with_probe(bad).collect()
    assert media.with_probe(bad, strict=False).first().probe is None
    assert media.with_probe(df, strict=False).where("probe is null").isEmpty()


def test_score_log_drops_unusable_frames(spark):
    log = '{"frames":[{"frameNum":0,"metrics":{"vmaf":98.5}},{"frameNum":1,"metrics":{"vmaf":"NaN"}},{"frameNum":2,"metrics":{}},{"frameNum":3,"metrics":{"vmaf":"Infinity"}}]}'
    df = spark.createDataFrame([("a", log)], "item string, log string")
    assert rows(media.scores_from_log(df, "log", ["item"])) == [("a", 0, 98.5)]
    bare = spark.createDataFrame([("b", '{"frames":[]}'), ("c", "{}"), ("d", '{"frames":[{"frameNum":0,"metrics":{}}]}')], "item string, log string")
    lenient = media.scores_from_log(df.unionByName(bare), "log", ["item"], strict=False)
    assert rows(lenient.select("item", "score", "problem")) == [
        ("a", 98.5, None), *((i, None, "no usable scores") for i in "bcd")
    ]
    with pytest.raises(Exception, match="no usable scores for c"):
        media.scores_from_log(bare.where("item = 'c'"), "log", ["item"]).collect()


def test_quota_fields_are_optional(spark):
    df = spark.createDataFrame([('{"total":5,"free":2,"x":1}',), ("{}",)], "q string")
    assert rows(df.select(listing.parse_quota("q").alias("q")).select("q.*")) == [(5, None, 2, None), (None,) * 4]


def test_rows_of_differing_buckets_are_found_without_digests(spark, numbered):
    found = digests.localised_difference(numbered, numbered.where("id <> 500"), buckets=16)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 0
    nested = spark.sql("SELECT id, array(map('a', id)) AS m FROM range(50)")
    assert digests.proof_tree(nested).agg({"rows": "sum"}).first()[0] == 50


def test_a_reshuffle_has_no_fixed_number_of_tasks(spark):
    from slimlake import catalog

    found = catalog.queries()["V1_fingerprint"](spark, "/root/testdata/sf0.001")
    assert "RebalancePartitions" in found._jdf.queryExecution().toString()
    assert [tuple(r)[1:] for r in found.collect()] == [(True, True, True)]


def test_folders_are_cut_without_a_pattern(spark):
    from slimlake import catalog

    paths = spark.createDataFrame([("file:/t/a=1/b=x%2Fy/part-0.c000.parquet",)], "p string")
    assert rows(paths.select(recompress.folders_of("p", 2))) == [("a=1/b=x%2Fy",)]
    found = catalog.queries()["V6_partitioned_swap"](spark, "/root/testdata/sf0.001")
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("place <> concat('l_linestatus=', l_linestatus, '/l_returnflag=', l_returnflag)").isEmpty()


def test_another_length_is_told_without_digests(spark, numbered, monkeypatch):
    known = {True: digests.take_proof(numbered), False: digests.take_fingerprint(numbered)}

    def refuse(df):
        raise AssertionError("rows were digested")

    monkeypatch.setattr(digests, "take_proof", refuse)
    monkeypatch.setattr(digests, "take_fingerprint", refuse)
    for strict in (True, False):
        for name in ("lost", "twice"):
            assert recompress.verify(numbered, damaged(numbered)[name], known[strict], strict) is None


def test_commas_and_marks_in_texts_are_told_apart(spark):
    schema = "a string, i int, b string, d double"
    data = [
        ("x,1", 2, "y", 1.0), ("x", 1, "2,y", 1.0), ("x", 12, "y", 1.0), ("1:x", 2, "y", 1.0), ("n", None, None, None),
        (None, None, "n", None), (None, None, "", None), (None, 1, None, float("nan")), (None, 1, None, None), ("", 1, None, None),
    ]
    df = spark.createDataFrame(data, schema)
    assert df.select(digests.row_digest(df).alias("d")).distinct().count() == len(data)
    plan = df.select(digests.row_digest(df.select("i", "d")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "length(" not in plan
