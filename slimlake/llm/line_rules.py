"""Quality rules, line first: drop bad lines, then documents that lose too much text.

Every line of a text is judged on its own. A line fails, in this order, as

* ``navigation``: menu-like, three or more separators and one for every six words;
* ``symbols``: more than one in twenty characters is a markup or filler symbol;
* ``shouting``: two or more words with more capital than small letters;
* ``boilerplate``: it holds one of ``BOILERPLATE``;
* ``punctuation``: it does not end a sentence, quotation or list item.

Lines without a word are neither good nor bad and stay. The text that stays is the
good lines in order. A document is rejected when the failed lines hold more than
``max_lost`` of the characters of its lines with words.

Before that, a base check on the whole text rejects short texts and those in which
more than half of the words are in 3-word windows that occur twice or more. Windows
are compared by a 64-bit hash within one text.

All of it is built-in expressions over one row: no shuffle, no Python. Memory for a row
is in proportion to its text.

Defined cases: a null text gives zero counts, no lines and fails the base check, and
its clean text is null; so does an empty text, whose clean text is empty. Repeated
rows each give a row. Input columns other than id and text are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import WORD
from slimlake.llm.mixing import SYMBOLS

SPACE = r"[\x20\x09-\x0D]+"
SEPARATORS = "[|»›•·→]"
CLOSED = r"[.!?…:;,)\]\"'”’»]\s*$"

BOILERPLATE = [
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
]


def line_fault(line: Column) -> Column:
    """Name of the first rule that a line fails; ``''`` for a good or wordless line."""
    words = F.regexp_count(line, F.lit(WORD))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    small = F.regexp_count(line, F.lit(r"\p{Ll}"))
    return (
        F.when(words == 0, "")
        .when((separators >= 3) & (separators * 6 >= words), "navigation")
        .when(F.regexp_count(line, F.lit(SYMBOLS)) * 20 > F.length(line), "symbols")
        .when((words >= 2) & (capitals > small), "shouting")
        .when(F.lower(line).rlike("|".join(BOILERPLATE)), "boilerplate")
        .when(~line.rlike(CLOSED), "punctuation")
        .otherwise("")
    )


def _repeated_words(marks: Column) -> Column:
    """Words in 3-word windows that start at the sorted positions ``marks``."""
    reach = F.transform(
        marks, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(marks, i + 1) - p, F.lit(3)))
    )
    return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, text, lines and the counts of the base check."""
    empty = F.array().cast("array<string>")
    split = documents.select(
        "doc_id",
        "text",
        F.coalesce(F.array_remove(F.split("text", SPACE), ""), empty).alias("words"),
        F.coalesce(F.split("text", "\n"), empty).alias("lines"),
    )
    windows = F.when(
        F.size("words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    worded = F.filter("lines", lambda x: x.rlike(WORD))
    counted = split.select(
        "doc_id",
        "text",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        worded.alias("worded"),
        windows.alias("windows"),
    )
    # Most texts repeat no window, which a set of hashes shows without sorting.
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("at")))),
    ).otherwise(F.array().cast("array<struct<w:bigint,at:int>>"))
    sorted_ = counted.select(
        "doc_id", "text", "lines", "n_words", "word_chars", "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        placed.alias("placed"),
    )
    twice = F.filter(
        "placed",
        lambda x, i: F.coalesce(F.get("placed", i - 1)["w"] == x["w"], F.lit(False))
        | F.coalesce(F.get("placed", i + 1)["w"] == x["w"], F.lit(False)),
    )
    marked = sorted_.withColumn("marks", F.sort_array(F.transform(twice, lambda x: x["at"])))
    return marked.select(
        "doc_id", "text", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _repeated_words(F.col("marks")).alias("n_repeat_words"),
    )


def clean_lines(
    documents: DataFrame, max_lost: float = 0.3, min_words: int = 50, max_repeated: int = 50
) -> DataFrame:
    """Counts, verdicts and the text of the good lines, one row per input row.

    Columns: doc_id, the counts, base_failed, n_lines (with words), n_bad_lines,
    bad_chars, line_chars, kept, faults (the rule per line, ``''`` for none), clean_text.
    """
    judged = base_counts(documents).withColumn("faults", F.transform("lines", line_fault))
    chars = F.transform("lines", lambda x: F.when(x.rlike(WORD), F.length(x)).otherwise(0))
    bad = F.transform(
        "lines", lambda x, i: F.when(F.get("faults", i) != "", F.length(x)).otherwise(0)
    )
    good = F.filter("lines", lambda x, i: F.get("faults", i) == "")

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    summed = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (
            (F.col("n_words") < min_words)
            | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
        ).alias("base_failed"),
        F.size(F.filter("lines", lambda x: x.rlike(WORD))).cast("long").alias("n_lines"),
        F.size(F.filter("faults", lambda x: x != "")).cast("long").alias("n_bad_lines"),
        total(bad).alias("bad_chars"),
        total(chars).alias("line_chars"),
        "faults",
        F.when(F.col("text").isNotNull(), F.array_join(good, "\n")).alias("clean_text"),
    )
    return summed.withColumn(
        "kept", ~F.col("base_failed") & (F.col("bad_chars") <= max_lost * F.col("line_chars"))
    )
