"""What the operators of this package share: written tables, keys and name clashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimlake.session import scratch

#: One word between white space, as a Java and an RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it from there.

    Later reads agree with each other, and a lost executor costs no recomputation.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column = "text") -> Column:
    """Digest that stands for a text in joins and groups; null for null."""
    return F.md5(F.col(text) if isinstance(text, str) else text)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on ``keys`` in which nulls are equal."""
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def count_words(text: str | Column = "text") -> Column:
    """Number of words of the text; 0 for null."""
    value = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(value, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Limit what Spark sends to Python at once by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bit_table(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of ``2**bits`` bits in 64-bit words, set at the hashes in a BIGINT column.

    At most one row per word reaches the driver, whatever the input.
    """
    cell = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")
    filled = df.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[filled["word"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def in_bit_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the bit of an unsigned hash is set."""
    cell = hashes & np.uint64(len(table) * 64 - 1)
    word = table[(cell >> np.uint64(6)).astype(np.int64)]
    return (word >> (cell & np.uint64(63))) & np.uint64(1) == 1
