"""The Jaccard join against sets compared one by one."""

from __future__ import annotations

import random
import re
from collections import Counter

from slimlake.llm import near_duplicates as nd
from tests.llm import shared


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Per row (id, class, set, links, other sets)."""
    sets = [word_set(t) for _, t in rows]
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                near[i][j] = near[j][i] = True
    part = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near[i][j] and part[j] < part[i]:
                    part[i], changed = part[j], True
    found = []
    for i, (doc_id, _) in enumerate(rows):
        group = [rows[j][0] for j in range(n) if part[j] == part[i] and rows[j][0] is not None]
        copies = [rows[j][0] for j in range(n) if sets[j] == sets[i] and rows[j][0] is not None]
        if not sets[i]:
            group = copies = [doc_id]
        found.append(
            (
                doc_id, min(group, default=None), min(copies, default=None), sum(near[i]),
                len({sets[j] for j in range(n) if near[i][j]} - {sets[i]}),
            )
        )
    return Counter(found)


def ours(df):
    return Counter(tuple(r) for r in df.collect())


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{shared.SF}/documents.parquet")
    assert ours(nd.near_duplicates(docs)) == brute(pairs_of(docs))


def test_odd_rows(spark):
    docs = shared.odd_documents(spark)
    assert ours(nd.near_duplicates(docs)) == brute(pairs_of(docs))


def test_no_rows(spark):
    assert nd.near_duplicates(shared.no_documents(spark)).collect() == []


def near_group(members, words=120, edits=3):
    rng, base = random.Random(5), shared.prose(9, words)
    rows = []
    for i in range(members):
        text = list(base)
        for _ in range(edits):
            text[rng.randrange(words)] = f"edit{rng.randrange(10**9)}"
        rows.append((i, " ".join(text), "en", "a"))
    return rows


def test_group_dealt_to_blocks(spark, monkeypatch):
    docs = shared.documents(spark, near_group(90) + near_group(20))
    whole = ours(nd.near_duplicates(docs))
    assert whole == brute(pairs_of(docs))
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", 16)
    assert ours(nd.near_duplicates(docs)) == whole


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    labels = {r["v"]: r["label"] for r in nd.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_depth_is_shortened_to_the_recall():
    assert nd.forest_depth(24, 0.8, 0.99999) == 4
    assert nd.forest_depth(24, 0.8, 0.9) > 4
    assert nd.forest_depth(4, 0.5, 0.99) == 1


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = shared.odd_documents(spark)
    stay = nd.one_of_each(docs)
    assert stay.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:20]) for r in stay.collect())
    assert [i for null, i, _ in ids if not null] == [1, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 13]
    assert sum(null for null, _, _ in ids) == 2
    assert nd.one_of_each(shared.no_documents(spark)).collect() == []
