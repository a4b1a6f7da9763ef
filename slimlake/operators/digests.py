"""Digests of sequences and of whole tables, and exact table comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slimlake.operators.ordered import ranked
from slimlake.session import cut

# Hashes joined into one digest at each level; three levels reach 6.8e10 positions.
SPAN = 4_096
_LEVELS = 3


def ordered_digest(
    rows: DataFrame, item: list[str], order: list[str], hash_col: str, name: str = "digest"
) -> DataFrame:
    """Digest of each item's hashes in order: reordering, loss and repeats show.

    The sequence is cut into spans of ``SPAN`` by position, and each span is digested
    by sha256 over its hashes, one per line. The span digests are digested the same
    way, twice, at every length, so no group is larger than ``SPAN`` and the rule does
    not depend on how long an item is. ``frames`` is the length.
    """
    placed = ranked(rows.select(*item, *_names(order), hash_col), order, item, "_at", count="frames")
    level = placed.select(
        *item, "frames", (F.col("_at") - 1).alias("_at"), F.col(hash_col).alias("_h")
    )
    for _ in range(_LEVELS):
        span = F.floor(F.col("_at") / SPAN).cast("long")
        joined = F.array_join(
            F.transform(F.array_sort("_hs"), lambda s: s["_h"]), "\n"
        )
        folded = F.sha2(joined, 256)
        level = (
            level.withColumn("_span", span)
            .groupBy(*item, "frames", "_span")
            .agg(F.collect_list(F.struct("_at", "_h")).alias("_hs"))
            .select(*item, "frames", F.col("_span").alias("_at"), folded.alias("_h"))
        )
    return level.select(*item, "frames", F.col("_h").alias(name))


def _names(order: list[str]) -> list[str]:
    return [o.lstrip("-") for o in order]


def frame_counts(rows: DataFrame, item: list[str]) -> DataFrame:
    return rows.groupBy(*item).agg(F.count("*").alias("frames"))


def compare_frame_counts(before: DataFrame, after: DataFrame, item: list[str]) -> DataFrame:
    """Counts side by side; an item without a count on either side is a failure."""
    a = frame_counts(before, item).withColumnRenamed("frames", "frames_before")
    b = frame_counts(after, item).withColumnRenamed("frames", "frames_after")
    both = a.join(b, item, "full_outer")
    same = F.coalesce(F.col("frames_before") == F.col("frames_after"), F.lit(False))
    return both.withColumn("counts_match", same)


# -- whole tables ------------------------------------------------------------


_SIGNS = "_signs"


def _comparable(field: T.StructField) -> Column:
    """The value in a form that can be grouped: a map has no order of its own."""
    value = F.col(field.name)
    if isinstance(field.dataType, T.MapType):
        return F.array_sort(F.map_entries(value)).alias(field.name)
    return value


def _flags(tests: list[Column]) -> list[Column]:
    """Tests as bits of a few whole numbers."""
    bits = [F.when(test, F.lit(1 << (i % 62)).cast("long")).otherwise(F.lit(0).cast("long")) for i, test in enumerate(tests)]
    return [reduce(lambda a, b: a + b, bits[i : i + 62]) for i in range(0, len(bits), 62)]


def _keys(df: DataFrame) -> list[Column]:
    """Keys under which two rows are equal only if they are the same.

    Grouping and hashing take -0.0 for 0.0, so signs of zero are a key as well.
    """
    floating = [f for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    zeros = [(F.col(f.name) == 0) & (F.col(f.name).cast("string") == "-0.0") for f in floating]
    signs = [flag.alias(f"{_SIGNS}{i}") for i, flag in enumerate(_flags(zeros))]
    return [*[_comparable(f) for f in df.schema.fields], *signs]


def _encoded(field: T.StructField) -> Column:
    """Text of a value that no other value of its type has; null for null."""
    value = _comparable(field)
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(value)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(
            F.struct(value.alias("v")),
            {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
        )
    return value.cast("string")


#: Types whose text never holds a comma, so it needs no length before it.
_PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of the whole row: the values' texts between commas, or a mark for null.

    Texts that may hold a comma stand behind their length.
    """
    parts = []
    for field in df.schema.fields:
        text = _encoded(field)
        if not isinstance(field.dataType, _PLAIN):
            text = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(text, F.lit("n")))
    return F.unhex(F.sha2(F.concat_ws(",", *parts), 256))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether both sides have the same rows, equally often.

    A digest and a count per distinct row are all that is shuffled.
    """
    if left.columns != right.columns:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    one = left.select(row_digest(left).alias("_d"), F.lit(1).cast("long").alias("_n"))
    other = right.select(row_digest(right).alias("_d"), F.lit(-1).cast("long").alias("_n"))
    counted = one.union(other).groupBy("_d").agg(F.sum("_n").alias("surplus"))
    return counted.where("surplus <> 0").isEmpty()


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with ``surplus`` = left minus right count.

    Both sides are counted in one aggregation, which partial aggregation shrinks;
    no surplus row is repeated in the output.
    """
    left, right = left.select(*_keys(left)), right.select(*_keys(right))
    if left.columns != right.columns:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    both = left.withColumn("_n", F.lit(1).cast("long")).union(
        right.withColumn("_n", F.lit(-1).cast("long"))
    )
    counted = both.groupBy(*left.columns).agg(F.sum("_n").alias("surplus"))
    return counted.where(F.col("surplus") != 0).drop(
        *[c for c in left.columns if c.startswith(_SIGNS)]
    )


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with multiplicity in ``copies``."""
    return (
        multiset_difference(left, right)
        .withColumn("side", F.when(F.col("surplus") > 0, "left").otherwise("right"))
        .withColumn("copies", F.abs("surplus"))
        .drop("surplus")
    )


_WORD = 22
_HALF = (1 << 32) - 1
_SUMS = ["rows", *[f"sum{k}" for k in range(8)]]


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row that tells nulls and signed zeros apart."""
    return F.xxhash64(*_keys(df), *_flags([F.col(c).isNull() for c in df.columns]))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that does not depend on row order but does on multiplicity.

    The hash is summed in three 22-bit words, which stay within BIGINT for
    2^41 rows and need no decimals.
    """
    mask = (1 << _WORD) - 1
    hashed = df.select(row_hash(df).alias("_h"))
    words = [
        F.shiftrightunsigned("_h", _WORD * i).bitwiseAND(F.lit(mask).cast("long")) for i in range(3)
    ]
    return hashed.agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(w), F.lit(0)).alias(f"word{i}") for i, w in enumerate(words)],
    )


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def _bucket(df: DataFrame, buckets: int) -> Column:
    """The bucket of a row, from the plain hash of its values: no digest is needed to find it.

    Values that hold maps have no plain hash; such tables take their digest's.
    """
    if buckets == 1:
        return F.lit(0)
    inner = [f.dataType.valueType if isinstance(f.dataType, T.MapType) else f.dataType for f in df.schema.fields]
    mapped = any(_has_map(kind) for kind in inner)
    hashed = F.xxhash64(F.lit(0), row_digest(df)) if mapped else row_hash(df)
    # Never null, which a join would test by hashing again.
    return F.coalesce(F.pmod(hashed, F.lit(buckets)).cast("int"), F.lit(0))


def proof_tree(df: DataFrame, by: list[str] = (), buckets: int = 256) -> DataFrame:
    """Sums over the digests of all rows, per group of ``by`` and hash bucket.

    The SHA-256 of a row is spread over four 64-bit hashes, whose halves are summed, so
    trees are equal where both sides have the same rows, equally often. Sums add up:
    those of a group, or of the table, are the sums of its buckets (``merged``). Partial
    aggregation leaves ``buckets`` rows per group and task to shuffle.
    """
    hashes = [F.xxhash64(F.lit(k), "_d") for k in range(4)]
    digests = df.select(*by, _bucket(df, buckets).alias("bucket"), row_digest(df).alias("_d")).select(
        *by, "bucket", *[h.alias(f"_h{k}") for k, h in enumerate(hashes)]
    )
    halves = [half for k in range(4) for half in (F.shiftrightunsigned(f"_h{k}", 32), F.col(f"_h{k}").bitwiseAND(F.lit(_HALF)))]
    return digests.groupBy(*by, "bucket").agg(
        F.count("*").alias("rows"), *[F.sum(half).alias(f"sum{k}") for k, half in enumerate(halves)]
    )


def merged(tree: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sums of a tree per group of ``by``; of the whole table without one."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS]
    return tree.groupBy(*by).agg(*sums) if by else tree.agg(*sums)


def take_proof(df: DataFrame) -> dict[str, int]:
    """The sums over the whole table as values, to keep after the source is gone."""
    return merged(proof_tree(df, buckets=1)).first().asDict()


def differing_parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """The groups and buckets in which two trees differ."""
    keys = [c for c in left.columns if c not in _SUMS]
    sides = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(2)))
    spread = [F.min(c).alias(f"_l_{c}") for c in _SUMS], [F.max(c).alias(f"_m_{c}") for c in _SUMS]
    met = sides.groupBy(*keys).agg(F.count("*").alias("_n"), *spread[0], *spread[1])
    equal = reduce(lambda a, b: a & b, [F.col(f"_l_{c}") == F.col(f"_m_{c}") for c in _SUMS])
    return met.where(~((F.col("_n") == 2) & equal)).select(*keys)


def localised_difference(left: DataFrame, right: DataFrame, buckets: int = 256) -> DataFrame:
    """``multiset_difference`` that compares only rows of buckets that differ.

    Tables that agree are read once and no row of theirs is shuffled.
    """
    differ = differing_parts(proof_tree(left, buckets=buckets), proof_tree(right, buckets=buckets))
    # At most one row per bucket, written once: both sides ask for it.
    wanted = F.broadcast(cut(differ))

    def part(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", _bucket(df, buckets)).join(wanted, "bucket", "left_semi").select(*df.columns)

    return multiset_difference(part(left), part(right))


def take_fingerprint(df: DataFrame) -> dict[str, int]:
    """The fingerprint as values, to keep after the source is gone."""
    return fingerprint(df).first().asDict()


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    return [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]


