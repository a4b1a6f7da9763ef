"""Ordered sums, duplicates and digests with one key holding a third of the rows."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from slimlake.operators import digests, duplicates, progress, scores, skew
from slimlake.operators.ordered import carry_last, follow, ranked, running
from tests.conftest import rows


def skewed(spark, n=3000):
    """``(g, o, v)``: group 0 has a third of the rows, the rest are spread."""
    rng = random.Random(7)
    data = [(0 if i % 3 == 0 else rng.randrange(1, 40), i, rng.randrange(100)) for i in range(n)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "g int, o long, v long").repartition(6)


def few_rows_per_slice(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def test_running_sums_match_a_plain_loop(spark):
    few_rows_per_slice(spark)
    data, df = skewed(spark)
    want, sums = [], {}
    for g, o, v in sorted(data, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + v
        want.append((g, o, sums[g]))
    got = running(df, ["o"], {"s": "v"}, ["g"], totals={"t": "v"})
    assert rows(got.select("g", "o", "s")) == sorted(want, key=repr)
    assert rows(got.groupBy("g").agg(F.max("t"))) == rows(df.groupBy("g").agg(F.sum("v")))
    total, everything = 0, []
    for g, o, v in sorted(data, key=lambda r: (-r[2], r[1])):
        total += v
        everything.append((o, total))
    assert rows(running(df, ["-v", "o"], {"s": "v"}).select("o", "s")) == sorted(everything, key=repr)


def test_a_hot_group_spans_slices(spark):
    few_rows_per_slice(spark)
    from slimlake.operators.ordered import SLICE, slices

    _, df = skewed(spark)
    spread = slices(df, ["o"], ["g"]).where("g = 0").select(SLICE).distinct().count()
    assert spread > 1


def test_ranks_and_counts(spark):
    few_rows_per_slice(spark)
    data, df = skewed(spark)
    got = ranked(df, ["-o"], ["g"], "n", count="c")
    per: dict[int, list[int]] = {}
    for g, o, _ in data:
        per.setdefault(g, []).append(o)
    want = [(g, o, i + 1, len(os)) for g, os in per.items() for i, o in enumerate(sorted(os, reverse=True))]
    assert rows(got.select("g", "o", "n", "c")) == sorted(want, key=repr)


def test_carry_last_crosses_slices(spark):
    few_rows_per_slice(spark)
    data, df = skewed(spark)
    sparse = df.withColumn("x", F.when(F.col("v") == 0, F.col("o")))
    want, last = [], {}
    for g, o, v in sorted(data, key=lambda r: r[1]):
        if v == 0:
            last[g] = o
        want.append((g, o, last.get(g)))
    assert rows(carry_last(sparse, ["o"], {"y": "x"}, ["g"]).select("g", "o", "y")) == sorted(want, key=repr)


def test_percentiles_of_a_hot_item(spark):
    few_rows_per_slice(spark)
    data, df = skewed(spark)
    got = {r.g: r for r in scores.score_summary(df.withColumn("score", F.col("v") / 7), ["g"]).collect()}
    for g in {r[0] for r in data}:
        values = sorted(v / 7 for h, _, v in data if h == g)
        rank = max(-(-len(values) // 100), 1)
        assert got[g].low_percentile == values[rank - 1]
        assert (got[g].min, got[g].frames) == (values[0], len(values))
        # Scores are summed in millionths of a point.
        assert got[g].mean == sum(round(v * 1e6) for v in values) / (len(values) * 1_000_000)


def test_duplicates_of_one_file_in_a_third_of_all_paths(spark):
    data, _ = skewed(spark)
    df = spark.createDataFrame([(f"h{g}" if g != 5 else None, 10 + g, f"p{o}") for g, o, _ in data], "blake3 string, size long, path string")
    df = df.union(spark.createDataFrame([("h0", 99, "other size"), ("e", 0, "e1"), ("e", 0, "e2")], df.schema))
    per: dict[int, list[str]] = {}
    for g, o, _ in data:
        per.setdefault(g, []).append(f"p{o}")
    want = [(f"h{g}", 10 + g, len(ps), min(ps), p) for g, ps in per.items() if g != 5 and len(ps) > 1 for p in ps]
    got = duplicates.members(df).select("blake3", "size", "copies", "first_path", "path")
    assert rows(got) == sorted(want, key=repr)
    total = duplicates.totals(df).first()
    assert total.unhashed == len(per[5])
    assert total.redundant_files == sum(len(ps) - 1 for g, ps in per.items() if g != 5)


def test_weighted_join_uses_both_ways(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    _, df = skewed(spark)
    keyed = df.groupBy("g").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    assert keyed.where("n > 750").count() == 1
    assert rows(skew.join_by_weight(df, keyed, ["g"], "n")) == rows(df.join(keyed, "g").select("g", "o", "v", "n", "first"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reference_digest(hashes, span):
    level = hashes
    for _ in range(3):
        parts = [level[i : i + span] for i in range(0, len(level), span)]
        level = [sha("\n".join(p)) for p in parts]
    assert len(level) == 1
    return level[0]


def test_long_sequences_are_digested_in_spans(spark, monkeypatch):
    few_rows_per_slice(spark)
    monkeypatch.setattr(digests, "SPAN", 16)
    data, df = skewed(spark)
    hashed = df.withColumn("h", F.sha2(F.col("v").cast("string"), 256))
    got = {r.g: (r.frames, r.digest) for r in digests.ordered_digest(hashed, ["g"], ["o"], "h").collect()}
    for g in {r[0] for r in data}:
        ordered = [sha(str(v)) for h, o, v in sorted(data, key=lambda r: r[1]) if h == g]
        assert got[g] == (len(ordered), reference_digest(ordered, 16))


def test_digest_sees_order_loss_and_repeats_but_not_numbering(spark):
    def digest(pairs):
        df = spark.createDataFrame([("x", o, h) for o, h in pairs], "i string, o long, h string")
        return digests.ordered_digest(df, ["i"], ["o"], "h").first().digest

    base = digest([(0, "a"), (1, "b"), (2, "c")])
    assert base == digest([(0, "a"), (512, "b"), (1024, "c")]) == sha(sha(sha("a\nb\nc")))
    for other in ([(0, "b"), (1, "a"), (2, "c")], [(0, "a"), (1, "b")], [(0, "a"), (1, "b"), (2, "b"), (3, "c")]):
        assert digest(other) != base


def test_progress_of_a_hot_job(spark):
    few_rows_per_slice(spark)
    lines = []
    for i in range(900):
        job = "hot" if i % 3 == 0 else f"j{i % 10}"
        text = ["out_time_us=%d" % i, "speed=1.5x", "out_time_us=N/A", "speed= 2x ", "progress=continue", "x"][i // 3 % 6]
        lines.append((job, i, text))
    want, state = [], {}
    for job, i, text in lines:
        t, s = state.get(job, (0, 0.0))
        if text == "out_time_us=%d" % i:
            t = i
        elif text.startswith("speed"):
            s = float(text.split("=")[1].strip().rstrip("x"))
        state[job] = (t, s)
        if text.startswith("progress"):
            want.append((job, i, t, s))
    df = spark.createDataFrame(lines, "job string, seq long, line string").repartition(5)
    assert rows(progress.progress_blocks(df)) == sorted(want, key=repr)


def test_a_long_walk_is_estimated_by_what_it_wrote(spark):
    hops = spark.range(700).selectExpr("id * 3 AS place", "id * 3 + 3 AS next").repartition(3)
    walk = follow(hops, 0)
    assert rows(walk) == sorted(((3 * i,) for i in range(701)), key=repr)
    # Ten rounds of joins multiplied their estimates to a number of some 1,200 bits.
    assert int(str(walk._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**40
