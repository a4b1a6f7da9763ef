"""Mixing against targets found by repeated resharing and running sums in Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from slimlake.llm import mixing
from tests.llm import shared


def reshare(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, goal = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total >= cap * sizes[s]} if total else set()
        if not above:
            return goal | {s: left * weight[s] / total for s in free}
        for s in above:
            goal[s] = cap * sizes[s]
            left -= goal[s]
        free -= above


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("source", ["table", "odd"])
def test_targets_and_totals(spark, source):
    docs = spark.read.parquet(f"{shared.SF}/documents.parquet") if source == "table" else shared.odd_documents(spark)
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += size(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    goal = reshare(sizes, (3, 1, 2), 1.5, 2.0)
    taken, rows = defaultdict(int), 0
    for r in mixing.mix(docs).collect():
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"] * r["rows"]
        rows += r["rows"]
    assert rows == docs.count()
    for name, total in taken.items():
        assert abs(total - goal[name]) <= largest[name]


def test_reruns_agree(spark):
    docs = shared.odd_documents(spark)
    first, again = mixing.mix(docs), mixing.mix(docs.repartition(5))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_no_rows(spark):
    assert mixing.mix(shared.no_documents(spark)).collect() == []


def test_only_empty_texts(spark):
    docs = shared.documents(spark, [(1, None, "en", "a"), (2, "", "en", None), (2, "", "en", None)])
    assert [(r["target"], r["taken"]) for r in mixing.mix(docs).collect()] == [(0.0, 0), (0.0, 0)]


def test_heavier_documents_come_first(spark):
    rows = [(i, " ".join(f"w{i}_{k}" + ("$$$$" if i % 2 else "") for k in range(20)), "en", "a") for i in range(400)]
    rows += [(1000 + i, "filler " * 50, "en", "b") for i in range(4)]
    from pyspark.sql import functions as F

    weight = F.when(F.col("text").contains("$"), 0.05).otherwise(1.0)
    picked = mixing.mix(shared.documents(spark, rows), weights=[1, 100], share=0.5, weight=weight)
    chosen = [r["doc_id"] for r in picked.where("source = 'a' AND copies > 0").collect()]
    assert len(chosen) > 100
    assert sum(i % 2 for i in chosen) < len(chosen) / 4


def test_documents_are_repeated_as_planned(spark):
    docs = shared.odd_documents(spark)
    plan = mixing.mix(docs)
    mixed = mixing.mixed_documents(docs, plan)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["rows"] * r["copies"] for r in plan.collect())


def test_equal_rows_meet_the_target(spark):
    rows = [(1, " ".join(["same"] * 10), "en", "a")] * 900 + [(2 + i, f"t{i} " * 10, "en", "a") for i in range(100)]
    rows += [(5000 + i, "other " * 10, "en", "b") for i in range(20)]
    docs = shared.documents(spark, rows).repartition(4)
    plan = mixing.mix(docs, weights=[1, 1], share=0.6)
    found = plan.collect()
    goal = next(r["target"] for r in found if r["source"] == "a")
    assert sum(r["rows"] for r in found if r["source"] == "a") == 1000
    assert abs(sum(r["rows"] * r["taken"] for r in found if r["source"] == "a") - goal) <= 5
    mixed = Counter((r["doc_id"], r["source"]) for r in mixing.mixed_documents(docs, plan).collect())
    expected = Counter()
    for r in found:
        expected[r["doc_id"], r["source"]] += r["rows"] * r["copies"]
    assert mixed == +expected
    assert 0 < mixed[1, "a"] < 900
