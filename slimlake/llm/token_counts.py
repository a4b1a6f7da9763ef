"""Token counts from an exact histogram of encoded lengths.

Every whole text is encoded once; documents are then counted by length, which partial
aggregation shrinks before anything is shuffled. All else is read from the histogram:
its suffix sums give, for every context limit, how many documents are longer, the
tokens that fit and the total after truncation, and its running counts give exact
quantiles. A histogram has at most as many rows as the longest text has tokens,
however many documents there are.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter. It is
read on the driver and broadcast (about a megabyte, whatever the input), so executors
need no file.

Defined cases: null and empty texts have length 0 and count as documents. Repeated rows
count each. A null group is a group of its own. No input gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slimlake.llm.common import bounded_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how this vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The encoding of a rank file's content, built once per Python worker."""
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        lines = (line.split() for line in ranks.splitlines() if line)
        merges = {base64.b64decode(token): int(rank) for token, rank in lines}
        _ENCODERS[key] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}
        )
    return _ENCODERS[key]


def _lengths(ranks, pattern: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value, pattern).encode_ordinary
        for batch in batches:
            place = batch.schema.get_field_index("__text")
            lengths = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*(c for k, c in enumerate(batch.columns) if k != place), pa.array(lengths, type=pa.int64())],
                [*(n for k, n in enumerate(batch.schema.names) if k != place), "n_tokens"],
            )

    return measure


def token_lengths(
    documents: DataFrame, columns: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """``columns`` of each row, and n_tokens of its whole text."""
    spark = documents.sparkSession
    bounded_batches(spark)
    with open(vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    chosen = documents.select(
        *[F.col(f"`{c}`") for c in columns if c != "n_tokens"], F.col("text").alias("__text")
    )
    schema = chosen.drop("__text").schema.add("n_tokens", "long")
    return chosen.mapInArrow(_lengths(ranks, pattern), schema)


def length_histogram(documents: DataFrame, by: list[str] = (), **options) -> DataFrame:
    """Documents per encoded length, in each group of ``by``."""
    lengths = token_lengths(documents, list(by), **options)
    return lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame, by: list[str] = ()) -> DataFrame:
    """What every length means as a context limit.

    Adds docs_within and tokens_within (documents of at most that length), docs_longer,
    truncated_total (tokens when longer documents are cut there), total_docs,
    total_tokens and share_within, the quantile that the length stands for. A limit
    between two lengths is answered by ``at_limits``.
    """
    whole = Window.partitionBy(*by)
    longest_first = whole.orderBy(F.desc("n_tokens"))
    after = longest_first.rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_tokens") * F.col("n_docs")
    zero = F.lit(0).cast("long")
    summed = histogram.select(
        *by, "n_tokens", "n_docs",
        F.coalesce(F.sum("n_docs").over(after), zero).alias("docs_longer"),
        F.coalesce(F.sum(tokens).over(after), zero).alias("_tokens_longer"),
        F.sum("n_docs").over(whole).alias("total_docs"),
        F.sum(tokens).over(whole).alias("total_tokens"),
    )
    within = F.col("total_tokens") - F.col("_tokens_longer")
    return summed.select(
        *by, "n_tokens", "n_docs",
        (F.col("total_docs") - F.col("docs_longer")).alias("docs_within"),
        within.alias("tokens_within"),
        "docs_longer",
        (within + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("share_within"),
    )


def at_limits(table: DataFrame, limits: list[int], by: list[str] = ()) -> DataFrame:
    """Truncated totals and documents cut for any context limits."""
    limit = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context")
    asked = table.select(*by, "total_docs", "total_tokens").distinct().select("*", limit)
    rows = table.select(
        *by, "n_tokens", "docs_within", "tokens_within",
        F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context"),
    ).where("n_tokens <= context")
    last = rows.groupBy(*by, "context").agg(
        F.max_by(F.struct("docs_within", "tokens_within"), "n_tokens").alias("_last")
    )
    keys = [*by, "context"]
    left, right = asked.alias("a"), last.alias("b")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    joined = left.join(right, same, "left").select(*[f"a.{c}" for c in asked.columns], "b._last")
    docs = F.coalesce("_last.docs_within", F.lit(0).cast("long"))
    cut = F.col("total_docs") - docs
    return joined.select(
        *by, "context", cut.alias("docs_cut"),
        (F.coalesce("_last.tokens_within", F.lit(0).cast("long")) + F.col("context") * cut).alias("truncated_total"),
        "total_docs", "total_tokens",
    )


def _share(value: float | Decimal) -> Decimal:
    """The share as written, to 17 places."""
    return Decimal(str(value)).quantize(Decimal(1).scaleb(-17))


def quantiles(table: DataFrame, shares: list[float | Decimal], by: list[str] = ()) -> DataFrame:
    """Smallest length that at least each share of the documents does not exceed.

    Shares count as the decimal numbers they are written as, and are compared exactly.
    """
    asked = [
        F.struct(F.lit(float(x)).alias("share"), F.lit(_share(x)).cast("decimal(18,17)").alias("exact")) for x in shares
    ]
    reached = table.select(*by, "n_tokens", "docs_within", "total_docs", F.explode(F.array(*asked)).alias("_asked"))
    needed = F.col("_asked.exact") * F.col("total_docs").cast("decimal(19,0)")
    return (
        reached.where(F.col("docs_within").cast("decimal(19,0)") >= needed)
        .groupBy(*by, F.col("_asked.share").alias("share"))
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
