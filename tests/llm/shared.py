"""Small tables with the awkward cases that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for what they return.
        T.StructField("row", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("digest", T.StringType()),
    ]
)


def prose(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, repeated rows."""
    base = prose(1, 400)
    edited = list(base)
    edited[200] = "changed"
    passage = prose(2, 80)
    return [
        (1, " ".join(base) + ".", "en", "a"),
        (2, " ".join(base) + ".", "en", "a"),
        (3, " ".join(edited) + ".", "en", "b"),
        (4, None, "en", "b"),
        (5, "", "de", None),
        (6, " \n\t ", None, "c"),
        (7, "one two", "fr", "c"),
        (7, "one two", "fr", "c"),
        (7, "another text under the same id", "fr", "c"),
        (None, "no id here", "en", "a"),
        (None, None, None, None),
        (8, " ".join(prose(3, 60) + passage + prose(4, 60)), "en", "d"),
        (9, " ".join(prose(5, 30) + passage + prose(6, 90)), "en", "d"),
        (10, "été naïve 漢字 " * 40, "fr", "e"),
        (11, " ".join(prose(7, 60_000)), "en", "e"),
        (12, "x" * 300_000, "en", "e"),
        (13, "a\x00b | c\r\nd\x0be", "en", "e"),
    ]


def documents(spark, rows):
    extra = ("r", "i", "z", "s", "k", "h", "c", "g")
    return spark.createDataFrame(
        [(i, t, g, s, None if t is None else len(t), *extra) for i, t, g, s in rows], DOCUMENTS
    )


def odd_documents(spark):
    return documents(spark, odd_rows()).repartition(3)


def no_documents(spark):
    return documents(spark, [])
