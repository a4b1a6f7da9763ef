"""Winnowed overlaps against every window compared."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from slimlake.llm import decontaminate
from slimlake.llm.lanes import PLAIN, Words
from tests.llm import shared

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, n=10):
    found = Counter()
    for doc_id, text in rows:
        own, hit, names = words(text), set(), set()
        for item_id, other in items:
            theirs = words(other)
            size = min(n, len(theirs))
            windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
            at = [i for i in range(len(own) - size + 1) if size and tuple(own[i : i + size]) in windows]
            hit.update(i + k for i in at for k in range(size))
            if at and item_id is not None:
                names.add(str(item_id))
        found[(doc_id, len(own), len(hit), tuple(sorted(names)), bool(hit))] += 1
    return found


def ours(df):
    return Counter(
        (r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in df.collect()
    )


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{shared.SF}/documents.parquet")
    items = spark.read.parquet(f"{shared.SF}/benchmark.parquet")
    want = brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert any(k[2] for k in want)
    assert ours(decontaminate.contamination(docs, items)) == want


def odd_items(spark):
    base, passage = shared.prose(1, 400), shared.prose(2, 80)
    items = [
        (1, " ".join(base[50:60]).upper()), (2, " ".join(base[50:59])), (3, "two"), (4, None), (5, ""),
        (6, " ".join(passage)), (6, " ".join(passage[:30])), (None, " ".join(passage[20:40])),
        (7, "the only item that is nowhere"), (8, " ".join(base[395:] + ["unseen"] * 9)), (9, "漢字 été"),
        (10, "... !!!"),
    ]
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_odd_rows(spark):
    docs, items = shared.odd_documents(spark), odd_items(spark)
    assert ours(decontaminate.contamination(docs, items)) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_empty_sides(spark):
    docs, items = shared.odd_documents(spark), odd_items(spark)
    none = spark.createDataFrame([], items.schema)
    assert not any(k[4] for k in ours(decontaminate.contamination(docs, none)))
    assert decontaminate.contamination(shared.no_documents(spark), items).collect() == []


def test_clean_documents_stay_as_they_are(spark):
    docs, items = shared.odd_documents(spark), odd_items(spark)
    stay = decontaminate.keep_clean(docs, items)
    assert stay.columns == docs.columns
    bad = brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert stay.count() == sum(n for k, n in bad.items() if not k[4])


@pytest.mark.parametrize("window, gram", [(10, 5), (6, 2), (4, 4)])
def test_every_window_keeps_a_run(window, gram):
    text = " ".join(shared.prose(3, 500, 12)).encode()
    found = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), PLAIN)
    kept = set(decontaminate.winnowed(found, window, gram).tolist())
    assert all(any(i + k in kept for k in range(window - gram + 1)) for i in range(len(found) - window + 1))
    assert len(kept) <= len(found)
