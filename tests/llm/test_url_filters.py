"""URL filters against every rule tried on every url."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from slimlake.llm import url_filters

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("example.com", "/en/a", "allow"), ("net", "/es/", "block"), ("net", "/es/deep/er", "allow"),
    ("NET", "/fr/", "block"), ("com", "/", "block"), ("a-b.com", "", "block"), ("a.com", "/", "allow"),
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    tail = url.split("://", 1)[1]
    end = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
    path = tail[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in tail[:end]), path[:stop]


def judge(url, rules):
    host, path = parse(url)
    merged = {}
    for h, p, v in rules:
        key = (h.lower(), p)
        merged[key] = max(v, merged.get(key, ""))
    best = max(
        (
            (len(h) + len(p), len(h), h + p, v)
            for (h, p), v in merged.items()
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
        ),
        default=(0, 0, None, "allow"),
    )
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(3)
    hosts = ["com", "x.com", "example.com", "www.example.com", "a-b.com", "a.com", "b.a-b.com", "net", "y.net",
             "example.org", "EXAMPLE.com", "notexample.com", "com.", "a..com", "éa.com"]
    paths = ["", "/", "/en/", "/en/abc", "/en", "/es/deep/er/x", "/es/x", "/fr/?q=1", "?q", "#t", "/en/b#x"]
    made = [f"https://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    return made + made[:40] * 3 + [None, "", "no scheme", "://", "http://", "a://b://c.com/", "http://com/😀\n/x"]


@pytest.mark.parametrize("rules", [RULES, RULES[:1], [], [("", "/en/", "block")] + RULES])
def test_all_rules(spark, rules):
    data = urls()
    pages = spark.createDataFrame(
        [(i, u, "h", "p", "r", "v") for i, u in enumerate(data)],
        "page_id bigint, url string, host string, path string, rule string, verdict string",
    ).repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = url_filters.judge_urls(pages, table)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = Counter((i, u, *judge(u, rules)) for i, u in enumerate(data))
    assert Counter(tuple(r) for r in found.collect()) == want


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filters.judge_urls(pages, table).collect() == []
