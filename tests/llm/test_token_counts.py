"""Histograms of encoded lengths against encoding every text here."""

from __future__ import annotations

from collections import Counter

import pytest

from slimlake.llm import token_counts
from tests.llm import shared


def lengths(docs):
    with open(token_counts.VOCABULARY, "rb") as file:
        encode = token_counts.encoder(file.read()).encode_ordinary
    return [(r["lang"], len(encode(r["text"] or ""))) for r in docs.select("lang", "text").collect()]


@pytest.mark.parametrize("table", ["sf", "odd", "none"])
def test_against_brute_force(spark, table):
    docs = {
        "sf": lambda: spark.read.parquet(f"{shared.SF}/documents.parquet"),
        "odd": lambda: shared.odd_documents(spark),
        "none": lambda: shared.no_documents(spark),
    }[table]()
    every = lengths(docs)
    sizes = sorted(n for _, n in every)
    histogram = token_counts.length_histogram(docs)
    assert dict(tuple(r) for r in histogram.collect()) == Counter(sizes)
    whole = token_counts.context_table(histogram)
    for r in whole.collect():
        limit = r["n_tokens"]
        assert r["docs_within"] == sum(n <= limit for n in sizes)
        assert r["docs_longer"] == sum(n > limit for n in sizes)
        assert r["tokens_within"] == sum(n for n in sizes if n <= limit)
        assert r["truncated_total"] == sum(min(n, limit) for n in sizes)
        assert (r["total_docs"], r["total_tokens"]) == (len(sizes), sum(sizes))
    limits = [0, 1, 100, 777, 10**9]
    asked = {r["context"]: r for r in token_counts.at_limits(whole, limits).collect()}
    assert set(asked) == (set(limits) if sizes else set())
    for limit, r in asked.items():
        assert r["truncated_total"] == sum(min(n, limit) for n in sizes)
        assert r["docs_cut"] == sum(n > limit for n in sizes)
    for share, n in (tuple(r) for r in token_counts.quantiles(whole, [0.0, 0.5, 0.99, 1.0]).collect()):
        assert n == sizes[max(0, -(-int(share * 100) * len(sizes) // 100) - 1)]


def test_groups_and_null_group(spark):
    docs = shared.odd_documents(spark)
    histogram = token_counts.length_histogram(docs, ["lang"])
    assert {(r["lang"], r["n_tokens"]): r["n_docs"] for r in histogram.collect()} == Counter(lengths(docs))
    table = token_counts.context_table(histogram, ["lang"])
    longest = {r["lang"]: r["truncated_total"] for r in token_counts.at_limits(table, [10**9], ["lang"]).collect()}
    totals = Counter()
    for lang, n in lengths(docs):
        totals[lang] += n
    assert longest == dict(totals)


def test_every_hundredth_is_exact(spark):
    histogram = spark.range(1, 101).selectExpr("id AS n_tokens", "cast(1 AS bigint) AS n_docs")
    found = token_counts.quantiles(token_counts.context_table(histogram), [k / 100 for k in range(101)])
    got = {round(100 * r.share): r.n_tokens for r in found.collect()}
    assert got == {k: max(k, 1) for k in range(101)}
