"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a share of the mix by its weight, at most ``cap`` times its own size;
what is above is shared again among the others by weight until none is above. Sorted
by ``cap * size / weight``, the sources that end at their cap come first, so the rate
of the rest follows from running sums and needs no loop.

Within a source, whole epochs come first. The rest of the target is filled in the
order of Efraimidis and Spirakis: ascending ``-ln(u) / weight`` with ``u`` drawn by a
digest of the document, so reruns agree and documents of higher quality weight come
earlier. A running sum over that order cuts it where the total is nearest the target.
The running sum works on range partitions (``operators.ordered``), so one source may
hold most of the rows.

Defined cases: a null text has size 0. A null source is a source of its own, last in
order. Rows equal in id, text and source are one item and have one key; the item at the
cut gives one more copy to as many of its rows as come nearest the target, so a source of
equal rows meets its target too. A source or a corpus of size 0 gets the target 0. No
input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import count_words, kept, text_key
from slimlake.operators.ordered import ranked, running
from slimlake.operators.skew import join_by_weight

SYMBOLS = r"[#*$%&|<>]"


def quality_weight(text: Column, size: Column) -> Column:
    """Weight from 0 to 1: falls as symbols become frequent among the words."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return (size + 1) / (size + 1 + symbols)


def targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Target per source, for rows (source, source_size) with one row per source."""
    known = sizes.withColumn("_last", F.col("source").isNull())
    at = (F.col("row_no") - 1) % len(weights)
    weighed = ranked(known, ["_last", "source"]).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (at + 1).cast("int"))
    )
    most = weighed.withColumn("_most", F.lit(cap) * F.col("source_size")).withColumn(
        "_ratio", F.col("_most") / F.col("_weight")
    )
    summed = running(
        most, ["_ratio", "row_no"], {"_sizes": "source_size", "_weights": "_weight"},
        totals={"_all_sizes": "source_size", "_all_weights": "_weight"},
    )
    # The rate of those from here on, if all before are at their cap.
    rate = (
        F.lit(share) * F.col("_all_sizes") - F.lit(cap) * (F.col("_sizes") - F.col("source_size"))
    ) / (F.col("_all_weights") - (F.col("_weights") - F.col("_weight")))
    rated = kept(summed.withColumn("_rate", rate), "mix-rates")
    free = F.col("_ratio") > F.col("_rate")
    level = rated.where(free).agg(F.max("_rate")).scalar()
    target = F.when(free, F.col("_weight") * level).otherwise(F.col("_most"))
    return rated.select("source", "source_size", target.alias("target"))


def draw(documents: DataFrame, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """One row per distinct item with its size, copies in the input and sampling key."""
    slim = documents.select("doc_id", "source", "text").select(
        "doc_id", "source", count_words().alias("size"), text_key().alias("digest"), "text"
    )
    weight = quality_weight(F.col("text"), F.col("size")) if weight is None else weight
    name = F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("digest", F.lit(""))
    )
    unit = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    drawn = slim.select(
        "doc_id", "source", "digest", "size", (-F.log(unit) / weight).alias("key")
    )
    return drawn.groupBy("doc_id", "source", "digest", "size", "key").agg(F.count("*").alias("rows"))


def mix(
    documents: DataFrame,
    weights: list[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    weight: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """How often the mix takes each item: one row per distinct (doc_id, source, text).

    The item at the cut has two, if only some of its equal rows are taken once more.
    Columns doc_id, source, digest (of the text), rows (equal rows of the input that this
    row stands for), size, source_size, target, copies, taken (size times copies).
    ``weight`` may use the columns text and size.
    """
    items = draw(documents, weight, seed).withColumn("_mass", F.col("size") * F.col("rows"))
    # A group name that is never null, as it is joined on.
    items = items.withColumn("_group", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    items = kept(items, "mix-items")
    sizes = items.groupBy("_group").agg(
        F.first("source").alias("source"), F.sum("_mass").alias("source_size"), F.count("*").alias("_items")
    )
    sizes = kept(sizes, "mix-sizes")
    goal = targets(sizes.select("source", "source_size"), list(weights), share, cap)
    goal = goal.withColumn("_group", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    goal = kept(
        goal.drop("source", "source_size").join(sizes.select("_group", "source_size", "_items"), "_group"),
        "mix-goals",
    )
    order = ["key", "doc_id", "digest"]
    summed = running(items, order, {"_sum": "_mass"}, ["_group"])
    full = join_by_weight(summed, goal, ["_group"], "_items")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    # Of an item's equal rows, as many are taken once more as come nearest the target.
    room = 2 * (rest - (F.col("_sum") - F.col("_mass"))) + F.col("size")
    more = F.least(F.greatest(F.floor(room / F.nullif(2 * F.col("size"), F.lit(0))), F.lit(0)), F.col("rows"))
    planned = full.withColumn("_epochs", epochs.cast("long")).withColumn(
        "_more", F.coalesce(more, F.lit(0)).cast("long")
    )
    parts = F.array(
        F.struct(F.col("_more").alias("rows"), (F.col("_epochs") + 1).alias("copies")),
        F.struct((F.col("rows") - F.col("_more")).alias("rows"), F.col("_epochs").alias("copies")),
    )
    return planned.withColumn("_part", F.explode(F.filter(parts, lambda p: p["rows"] > 0))).select(
        "doc_id", "source", "digest", "_part.rows", "size", "source_size", "target", "_part.copies",
        (F.col("size") * F.col("_part.copies")).alias("taken"),
    )


def mixed_documents(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as often as ``plan`` says.

    Which of the equal rows at a cut come once more is open where other columns differ.
    """
    columns = documents.columns
    chosen = plan.groupBy("doc_id", "source", "digest").agg(
        F.min("copies").alias("__low"), F.max("copies").alias("__high"), F.max_by("rows", "copies").alias("__more")
    )
    chosen = chosen.withColumnsRenamed({"doc_id": "__doc_id", "source": "__source", "digest": "__digest"})
    same_row = documents["doc_id"].eqNullSafe(F.col("__doc_id")) & documents["source"].eqNullSafe(F.col("__source"))
    same_text = text_key(documents["text"]).eqNullSafe(F.col("__digest"))
    # Every row of an item alike, but for the few items at a cut (at most one a source).
    alike = documents.join(chosen.where("__low = __high AND __high > 0"), same_row & same_text)
    split = documents.join(chosen.where("__low < __high"), same_row).where(same_text)
    item = F.md5(F.to_json(F.struct("__doc_id", "__source", "__digest")))
    split = split.withColumn("__item", item).withColumn("__tie", F.monotonically_increasing_id())
    numbered = ranked(split, ["__tie"], ["__item"], "__at")
    once_more = F.when(F.col("__at") <= F.col("__more"), F.col("__high")).otherwise(F.col("__low"))
    whole = [F.col(f"`{c}`") for c in columns]
    taken = alike.select(*whole, F.col("__high").alias("__copies")).unionByName(
        numbered.select(*whole, once_more.alias("__copies")).where("__copies > 0")
    )
    times = F.sequence(F.lit(1).cast("long"), F.col("__copies"))
    return taken.withColumn("__time", F.explode(times)).select(*whole)
