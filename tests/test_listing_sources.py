"""The tree source and printed arrays read by their lines."""

from __future__ import annotations

import hashlib
import json
import os

import pytest

from slimlake.sources import listing
from tests.conftest import rows


@pytest.fixture
def tree(place):
    contents = {
        "top.bin": b"1", "a/one.txt": b"", "a/two words.txt": b"22", "a/b/c/d/deep.bin": b"x" * 3_000_000,
        "é/=x%20.txt": b"333", ".hidden/file": b"h", "a/_SUCCESS": b"", "b": b"file, not folder",
    }
    for name, content in contents.items():
        os.makedirs(os.path.dirname(f"{place}/{name}") or place, exist_ok=True)
        with open(f"{place}/{name}", "wb") as file:
            file.write(content)
    os.makedirs(f"{place}/empty/folder")
    return contents


def test_all_files_are_listed_with_their_digests(spark, place, tree):
    shown = {k: v for k, v in tree.items() if not any(p[0] in "._" for p in k.split("/"))}
    for depth in (0, 1, 2, 9):
        got = listing.list_tree(spark, place, with_hash=True, depth=depth).select("path", "size", "blake3")
        assert rows(got) == sorted((k, len(v), hashlib.sha256(v).hexdigest()) for k, v in shown.items())
    assert listing.list_tree(spark, place, depth=2).rdd.getNumPartitions() >= 5
    everything = listing.list_tree(spark, f"file://{place}/", hidden=True).select("path", "size", "blake3")
    assert rows(everything) == sorted((k, len(v), None) for k, v in tree.items())


def test_a_scope_of_the_tree(spark, place, tree):
    got = listing.list_tree(spark, place, scope="/a/b/").select("path", "size")
    assert rows(got) == [("a/b/c/d/deep.bin", 3_000_000)]
    assert listing.list_tree(spark, place, scope="empty").count() == 0
    with pytest.raises(Exception, match="nothing to list"):
        listing.list_tree(spark, place, scope="none").count()
    mod_time = listing.list_tree(spark, place, scope="a/b").first().mod_time
    assert mod_time == rows(listing.list_files(spark, place, scope="a/b").select("mod_time"))[0][0]


def entries(n):
    return [
        {"Path": f"d/{k}] ,.txt", "Size": k - 1, "ModTime": "t", "IsDir": k % 5 == 0, "Hashes": {"BLAKE3": f"h{k}"}}
        for k in range(n)
    ]


def write(place, name, text):
    with open(f"{place}/{name}", "w", encoding="utf-8") as file:
        file.write(text)


def printed(n):
    return "[\n" + ",\n".join(json.dumps(e) for e in entries(n)) + "\n]\n"


def test_lines_of_arrays_equal_the_whole_reader(spark, place):
    write(place, "one.json", printed(400))
    write(place, "two.json", "[" + ",\n".join(json.dumps(e) for e in entries(3)) + "]")
    write(place, "none.json", "[\n]\n")
    write(place, "single.json", " [ " + json.dumps({"Path": "x y", "Size": 1}, ensure_ascii=False) + " ] \n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = listing.read_listing_lines(spark, place, scope="s")
        assert found.rdd.getNumPartitions() > 8
        whole = listing.read_listing_json(spark, place, scope="s")
        assert rows(found) == rows(whole) and whole.rdd.getNumPartitions() <= 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "text",
    [
        printed(9)[:-3] + ",\n",  # cut off after an entry
        printed(9)[:-2],  # without its bracket
        printed(9)[2:],  # without the first one
        printed(9) + printed(2),  # two arrays
        printed(9)[:200],  # within an entry
        printed(9).replace('"Size": 3', '"Size": [3'),
        "[\nnoise\n]\n",
        '{"Path": "a", "Size": 1}\n',
    ],
)
def test_broken_arrays_are_errors(spark, place, text):
    write(place, "bad.json", text)
    with pytest.raises(Exception, match="array|entry|MALFORMED|Malformed"):
        listing.read_listing_lines(spark, place).collect()
