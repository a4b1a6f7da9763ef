"""Line rules and base counts against the same rules in Python."""

from __future__ import annotations

import re
from collections import Counter

from slimlake.llm import line_rules
from tests.llm import shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered), len(words) < 50 or 2 * len(covered) > len(words),
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(docs):
    texts = Counter((r["doc_id"], *base(r["text"])) for r in docs.select("doc_id", "text").collect())
    found = line_rules.clean_lines(docs)
    assert Counter(tuple(r) for r in found.select("doc_id", *COLUMNS).collect()) == texts
    return found


def test_base_counts(spark):
    check(spark.read.parquet(f"{shared.SF}/documents.parquet"))
    check(shared.odd_documents(spark))
    check(shared.no_documents(spark))


def faults(spark, *lines):
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    return [r[0] for r in df.select(line_rules.line_fault(df.line)).collect()]


def test_each_rule(spark):
    assert faults(
        spark,
        "A plain sentence that ends well.",
        "Home | News | Sport | Contact",
        "wor#d wi&th sym$bols in%side.",
        "ALL OF THIS IS LOUD.",
        "Please read our Privacy Policy.",
        "no end to this line",
        "   ",
        "",
        "Он сказал: «да»",
    ) == ["", "navigation", "symbols", "shouting", "boilerplate", "punctuation", "", "", ""]


def test_lines_are_removed_and_documents_rejected(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [
        (1, f"{good}\nHome | News | Sport | Contact\n\nA last line.", "en", "a"),
        (2, good + "\n" + " | ".join(f"menu{i}" for i in range(60)), "en", "a"),
        (3, None, "en", "a"),
        (4, "", "en", "a"),
    ]
    found = {r["doc_id"]: r for r in check(shared.documents(spark, rows)).collect()}
    assert found[1]["kept"] and found[1]["clean_text"] == f"{good}\n\nA last line."
    assert not found[2]["base_failed"] and not found[2]["kept"]
    assert found[3]["clean_text"] is None and not found[3]["kept"]
    assert found[4]["clean_text"] == "" and found[4]["n_lines"] == 0


def test_verdict_follows_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = line_rules.clean_lines(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id")
    rows = judged.where("n_words >= 50").select("kept", "quality").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) > 0.97 * len(rows)
