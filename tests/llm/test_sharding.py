"""Sharding: groups stay together, loads are even, slots have no gaps."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slimlake.llm import sharding
from tests.llm import shared


def check(rows, texts, shards):
    by_text, slots, loads = defaultdict(set), defaultdict(list), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        by_text[r["digest"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)
    expected = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == expected
    return loads


def longest_first(sizes, shards):
    """Loads by a heap that is asked once for each group."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_whole_table(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_rows(docs, shards).collect()
    texts = [r["text"] for r in docs.collect()]
    loads = check(rows, texts, shards)
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    assert [loads[s] for s in range(shards)] == longest_first(groups.values(), shards)


def test_odd_rows(spark):
    docs = shared.odd_documents(spark)
    check(sharding.shard_rows(docs, 4).collect(), [r["text"] for r in docs.collect()], 4)


def test_no_rows(spark):
    assert sharding.shard_rows(shared.no_documents(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 90), max_size=8), st.integers(1, 9), st.integers(0, 4000))
def test_runs_are_dealt_as_by_a_heap(runs, shards, hot):
    runs = runs | ({hot: 1} if hot > 60 else {})
    loads = [0] * shards
    for size, counts in sharding.deal(runs.items(), shards):
        assert sum(counts) == runs[size]
        loads = [load + size * n for load, n in zip(loads, counts, strict=True)]
    assert loads == longest_first([s for s, n in runs.items() for _ in range(n)], shards)


def test_one_size_for_most_groups(spark):
    rows = [(i, f"{i:06d}", "en", "a") for i in range(900)] + [(2000 + i, "x" * i, "en", "a") for i in range(60)]
    docs = shared.documents(spark, rows).repartition(4)
    loads = check(sharding.shard_rows(docs, 7).collect(), [r[1] for r in rows], 7)
    assert [loads[s] for s in range(7)] == longest_first([len(r[1]) + 1 for r in rows], 7)
