"""Repeated passages against every window compared."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from slimlake.llm import substring_dedup
from tests.llm import shared


def brute(rows, n):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        for k in range(len(words) - n + 1):
            w = tuple(words[k : k + n])
            if i is not None:
                first[w] = min(i, first.get(w, i))
    found = Counter()
    for i, words in texts:
        gone = set()
        for k in range(len(words) - n + 1):
            if i is not None and first[tuple(words[k : k + n])] < i:
                gone.update(range(k, k + n))
        found[(i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))] += 1
    return found


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ours(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect())


@pytest.mark.parametrize("table", ["sf", "odd", "none"])
def test_against_all_windows(spark, table):
    docs = {
        "sf": lambda: spark.read.parquet(f"{shared.SF}/documents.parquet"),
        "odd": lambda: shared.odd_documents(spark),
        "none": lambda: shared.no_documents(spark),
    }[table]()
    want = brute(pairs(docs), 50)
    assert ours(substring_dedup.remove_repeats(docs)) == want
    digests = Counter({(*k[:3], hashlib.sha256(k[3].encode()).hexdigest()): n for k, n in want.items()})
    assert ours(substring_dedup.remove_repeats(docs, form="sha256")) == digests


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    docs = shared.odd_documents(spark)
    monkeypatch.setattr(substring_dedup, "BLOCK", 1 << 10)
    # Far too few cells: nearly every window is estimated to repeat.
    crowded = substring_dedup.remove_repeats(docs, window=20, gram=4, max_cells=3 << 10, cell_bytes=1 << 20)
    assert ours(crowded) == brute(pairs(docs), 20)


def test_lines_repeated_within_one_document(spark):
    line = " ".join(shared.prose(8, 60))
    rows = [(1, "\n".join([line] * 40), "en", "a"), (2, "other words", "en", "a"), (3, f"head {line} tail", "en", "a")]
    docs = shared.documents(spark, rows)
    assert ours(substring_dedup.remove_repeats(docs)) == brute(pairs(docs), 50)
