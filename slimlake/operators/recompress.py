"""Rewriting tables denser: rewrite, prove, keep only a real gain, swap, restore.

The subject is a Parquet table (``SnapshotTable``) or a payload column. The order
never changes: fingerprint, rewrite to the side, verify, gain gate, confirm, and
only then publish. The old version's data stays until it is purged on purpose.
"""

from __future__ import annotations

import bz2
import hashlib
import lzma
import time
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimlake import constants as K
from slimlake.functions import sizes
from slimlake.operators import digests
from slimlake.operators.ledger import is_reclaimable, newer_than
from slimlake.sources.snapshots import SnapshotTable


@dataclass(frozen=True)
class Setting:
    """How to write: a codec, its level where it has one, and a sort as effort."""

    codec: str = "zstd"
    sort_by: tuple[str, ...] = ()
    level: int | None = None

    @property
    def label(self) -> str:
        level = "" if self.level is None else f"-{self.level}"
        return f"{self.codec}{level}" + (f" by {','.join(self.sort_by)}" if self.sort_by else "")


@dataclass(frozen=True)
class Outcome:
    setting: str
    outcome: str
    fidelity: str | None
    input_bytes: int
    output_bytes: int
    elapsed_secs: float
    version: int | None = None


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the data files below ``path``, from the listing alone."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
    )
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns that a table's folders are named after, outermost first."""
    file = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).first()
    base = "/" + path.split(":", 1)[-1].strip("/") + "/"
    folders = file.f.split(base, 1)[-1].split("/")[:-1] if file and base in file.f else []
    return [name.split("=", 1)[0] for name in folders if "=" in name]


def folders_of(path: str, levels: int) -> Column:
    """The ``levels`` innermost folders of a file's path.

    Slashes are counted from the end. A pattern sought from the front would try the rest
    of the path from each of its characters, for every row of the file.
    """
    return F.substring_index(F.substring_index(path, "/", -(levels + 1)), "/", levels)


def rewrite(df: DataFrame, path: str, setting: Setting, partition_by: list[str] = ()) -> None:
    """Write ``df`` densely. Sorting stays inside partitions, so nothing shuffles.

    ``partition_by`` are the columns that the table's folders are named after; each
    task writes its rows of a folder to one file.
    """
    order = [*partition_by, *setting.sort_by]
    rows = df.sortWithinPartitions(*order) if setting.sort_by else df
    writer = rows.write.mode("overwrite").option("compression", setting.codec)
    if setting.level is not None:
        writer = writer.option(f"parquet.compression.codec.{setting.codec}.level", setting.level)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_rewritten(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rewritten table with the columns and types of ``like``."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def verify(
    before: DataFrame, after: DataFrame, known: dict[str, int] | None = None, strict: bool = True
) -> str | None:
    """The guarantee that holds between two tables; None when neither does.

    ``known`` is what was taken of ``before`` earlier: its proof if ``strict``, else its
    fingerprint. ``byte-exact`` means same schema and same multiset of rows, by sums over
    the SHA-256 of each; ``content-exact`` rests on the fingerprint. Each side is read
    once, and no row of it is shuffled. Tables of different length are told apart by
    their counts, before any row is digested.
    """
    if not digests.same_schema(before, after):
        return None
    take = digests.take_proof if strict else digests.take_fingerprint
    known = take(before) if known is None else known
    if known["rows"] != after.count() or known != take(after):
        return None
    return K.BYTE_EXACT if strict else K.CONTENT_EXACT


def is_gain(before: int, after: int, min_gain: float = K.MIN_GAIN) -> bool:
    return before > 0 and max(before - after, 0) / before >= min_gain


def recompress(
    table: SnapshotTable, setting: Setting, strict: bool = True, execute: bool = True,
    min_gain: float = K.MIN_GAIN,
) -> Outcome:
    """Rewrite the current version of ``table`` if that proves safe and worthwhile."""
    started = time.monotonic()
    spark, before = table.spark, table.read()
    current = table.current()
    held = stored_bytes(spark, f"{table.root}/{current.data}")
    known = digests.take_proof(before) if strict else digests.take_fingerprint(before)
    staged = table.staging_place()
    target = f"{table.root}/{staged}"
    rewrite(before, target, setting, partition_columns(spark, f"{table.root}/{current.data}"))
    after = spark.read.parquet(target)
    fidelity = verify(before, after, known, strict)
    size = stored_bytes(spark, target)

    def done(outcome: str, version: int | None = None) -> Outcome:
        elapsed = time.monotonic() - started
        return Outcome(setting.label, outcome, fidelity, held, size, elapsed, version)

    if fidelity is None:
        return done("failed")
    if not is_gain(held, size, min_gain):
        return done("no_gain")
    if not execute:
        return done("would_convert")
    # What was staged is measured again right before it becomes current.
    if stored_bytes(spark, target) != size:
        raise RuntimeError(f"{target} changed between verification and publishing")
    return done("converted", table.publish(staged, f"recompress {setting.label}"))


def restore(table: SnapshotTable, version: int, known: dict[str, int]) -> int:
    """Make a kept version current again if it still has the recorded fingerprint."""
    kept = table.read(version)
    if known != digests.take_fingerprint(kept):
        raise RuntimeError(f"version {version} is not what was recorded")
    return table.restore(version)


def compare_settings(df: DataFrame, root: str, settings: list[Setting]) -> DataFrame:
    """Rewrite ``df`` once per setting and report size, proof and time of each."""
    spark = df.sparkSession
    base = f"{root.rstrip('/')}/source"
    df.write.mode("errorifexists").parquet(base)
    source = spark.read.parquet(base)
    held = stored_bytes(spark, base)
    known = digests.take_fingerprint(source)
    rows = []
    for i, setting in enumerate(settings):
        started = time.monotonic()
        target = f"{root.rstrip('/')}/setting-{i}"
        rewrite(source, target, setting)
        fidelity = verify(source, spark.read.parquet(target), known, strict=False)
        size = stored_bytes(spark, target)
        outcome = "failed" if fidelity is None else "kept" if is_gain(held, size) else "no_gain"
        rows.append(
            Outcome(setting.label, outcome, fidelity, held, size, time.monotonic() - started)
        )
    return spark.createDataFrame(
        [{k: v for k, v in asdict(r).items() if k != "version"} for r in rows],
        "setting string, outcome string, fidelity string, input_bytes long, output_bytes long, "
        "elapsed_secs double",
    ).withColumn("saving_fraction", sizes.signed_saving_fraction("input_bytes", "output_bytes"))


def _bytes_by(spark: SparkSession, path: str, by: str) -> DataFrame:
    """Bytes of the data files in each of a table's folders, from the listing alone."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
    )
    # Folder names are escaped, but for the plus sign, which decoding would make a space.
    name = F.regexp_extract("path", f"/{by}=([^/]*)/", 1)
    value = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return files.select(value.alias(by), "length").groupBy(by).agg(F.sum("length").alias("bytes"))


def largest_inputs(df: DataFrame, by: str, n: int, size: Column) -> DataFrame:
    """The ``n`` inputs whose rows have the largest ``size`` in all, ties by name."""
    summed = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(size).alias("_size"))
    return summed.orderBy(F.desc("_size"), by).limit(n).select(by)


def bench_inputs(
    df: DataFrame, by: str, root: str, settings: list[Setting], n: int, size: Column
) -> DataFrame:
    """Rewrite the ``n`` largest inputs with every setting: one row per input and setting.

    ``by`` is a text column that names the input of a row, and ``size`` what makes an
    input large. A setting is one distributed
    write of all inputs, a folder each. Sizes come from the listings and proofs from sums
    per input, and what is kept is judged where these are joined.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    chosen = df.join(F.broadcast(largest_inputs(df, by, n, size)), by).select(*df.columns)
    base = f"{root}/source"
    chosen.write.mode("errorifexists").partitionBy(by).parquet(base)
    source = read_rewritten(spark, base, df)

    def measured(path: str) -> DataFrame:
        proof = digests.merged(digests.proof_tree(read_rewritten(spark, path, df), [by], buckets=1), [by])
        sums = F.struct(*[c for c in proof.columns if c != by]).alias("proof")
        return proof.select(by, "rows", sums).join(_bytes_by(spark, path, by), by)

    before = measured(base).withColumnsRenamed({"bytes": "input_bytes", "proof": "_known"})
    found = []
    for i, setting in enumerate(settings):
        target = f"{root}/setting-{i}"
        rewrite(source, target, setting, [by])
        after = measured(target).select(by, F.col("bytes").alias("output_bytes"), F.col("proof").alias("_proof"))
        found.append(before.join(after, by, "left").withColumn("setting", F.lit(setting.label)))
    proven = F.coalesce(F.col("_known") == F.col("_proof"), F.lit(False))
    gain = sizes.is_worthwhile("input_bytes", "output_bytes")
    return reduce(lambda a, b: a.unionByName(b), found).select(
        by, "setting", "rows", F.when(proven, K.BYTE_EXACT).alias("fidelity"),
        F.when(~proven, "failed").when(gain, "kept").otherwise("no_gain").alias("outcome"),
        "input_bytes", "output_bytes",
        sizes.signed_saving_fraction("input_bytes", "output_bytes").alias("saving_fraction"),
    )


# -- payload columns ---------------------------------------------------------

_PACK = {
    "zlib": lambda data: zlib.compress(data, 9),
    "bz2": lambda data: bz2.compress(data, 9),
    "lzma": lambda data: lzma.compress(data, preset=6),
}
_UNPACK = {"zlib": zlib.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}


def payload_trial(df: DataFrame, payload: str, by: list[str], codecs: list[str]) -> DataFrame:
    """Encode every payload with every codec and check that it decodes to itself.

    One row per payload and codec: the class columns, ``codec``, ``input_bytes``,
    ``output_bytes`` and ``verified``. Only the payload and the class columns go
    to Python, and no payload comes back.
    """
    codecs = list(codecs)

    def trial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for codec in codecs:
                packed_sizes, proofs = [], []
                for data in batch["_payload"]:
                    packed = _PACK[codec](data)
                    back = _UNPACK[codec](packed)
                    packed_sizes.append(len(packed))
                    proofs.append(hashlib.sha256(back).digest() == hashlib.sha256(data).digest())
                out = batch[by].copy()
                out["codec"] = codec
                out["input_bytes"] = batch["_payload"].map(len)
                out["output_bytes"] = packed_sizes
                out["verified"] = proofs
                yield out

    narrow = df.where(F.col(payload).isNotNull()).select(
        *by, F.col(payload).cast("binary").alias("_payload")
    )
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*by).schema)
    return narrow.mapInPandas(
        trial, f"{keys}, codec string, input_bytes long, output_bytes long, verified boolean"
    )


def trial_summary(trials: DataFrame, by: list[str]) -> DataFrame:
    """Counts and the measured ratio per class and codec."""
    return trials.groupBy(*by, "codec").agg(
        F.count("*").alias("payloads"),
        F.count(F.when(F.col("verified"), 1)).alias("verified"),
        F.sum("input_bytes").alias("input_bytes"),
        F.sum("output_bytes").alias("output_bytes"),
    ).withColumn(
        "ratio", F.try_divide(F.col("output_bytes").cast("double"), F.col("input_bytes").cast("double"))
    )


def best_ratios(summary: DataFrame, by: list[str]) -> DataFrame:
    """The densest codec of each class among those that verified every payload."""
    proven = summary.where(F.col("verified") == F.col("payloads"))
    return proven.groupBy(*by).agg(
        F.min_by("codec", F.struct("ratio", "codec")).alias("codec"), F.min("ratio").alias("ratio")
    )


def with_measured_saving(files: DataFrame, ratios: DataFrame, by: list[str]) -> DataFrame:
    """Projected saving from measured ratios; no measurement projects none."""
    saving = sizes.saturating_sub("size", sizes.shrunk("size", "ratio"))
    return files.join(ratios.select(*by, "ratio"), by, "left").withColumn(
        "measured_saving", F.coalesce(saving, F.lit(0)).cast("long")
    )


# -- retention ---------------------------------------------------------------


def purge_plan(ledger: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Rows whose kept originals may go: all that wait, or none at all.

    The decision is one number, read as a scalar subquery.
    """
    waiting = ledger.where(is_reclaimable())
    young = waiting.agg(F.count(F.when(newer_than(days, as_of), 1)))
    return waiting.where(young.scalar() == 0)
