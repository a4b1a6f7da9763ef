"""Sharding by longest processing time: groups that stay together, largest first.

Rows with equal texts are a group. Groups, sorted by size, go to the least loaded
shard, which a heap gives. Groups of one size are interchangeable, so the heap is not
asked once for each: a run of ``n`` groups of one size is dealt at once, by taking all
shards within one size of the least loaded and letting them take turns until the next
shard is level with them. The loads are those of the heap asked ``n`` times. A run is
one row, and there are at most ``sqrt(2 * bytes)`` different sizes in all, so the driver
never sees the groups; they take their place in the run by rank, which Spark finds. A
group that is larger than a fair share has a shard to itself; it can't be split, as its
rows must stay together.

Defined cases: a null text has no bytes and is in one group with the empty text. A
row's size is its text's UTF-8 bytes plus 1, so empty texts count too. Repeated rows
each get a slot of their own. No input gives no rows; with fewer groups than shards
some shards stay empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import kept, text_key
from slimlake.operators.ordered import ranked
from slimlake.operators.skew import join_by_weight


def deal(runs: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """Of each run (size, groups), longest first: the size and how many each shard takes."""
    heap = [(0, s) for s in range(shards)]
    for size, left in sorted(runs, reverse=True):
        counts = [0] * shards
        while left:
            level = [heapq.heappop(heap)]
            while heap and heap[0][0] < level[0][0] + size:
                level.append(heapq.heappop(heap))
            turns = left // len(level)
            if heap:
                turns = min(turns, -(-(heap[0][0] - level[-1][0]) // size))
            for at, (load, shard) in enumerate(level):
                n = turns or int(at < left)
                counts[shard] += n
                heapq.heappush(heap, (load + n * size, shard))
            left -= turns * len(level) if turns else left
        yield size, counts


def shard_rows(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of each row: doc_id, size, text_crc32, digest, shard, slot."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        text_key(text).alias("digest"),
    )
    rows = kept(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    groups = kept(groups, "shard-groups")
    # One row per size.
    runs = groups.groupBy("_bytes").agg(F.count("*").alias("_groups")).toPandas()
    number = dict(zip(runs["_bytes"].tolist(), runs["_groups"].tolist(), strict=True))
    dealt = list(deal(number.items(), shards))
    places = spark.createDataFrame(
        pa.table(
            {
                "_bytes": pa.array([size for size, _ in dealt], pa.int64()),
                "_counts": pa.array([counts for _, counts in dealt], pa.list_(pa.int64())),
                "_groups": pa.array([number[size] for size, _ in dealt], pa.int64()),
            }
        )
    )
    in_run = ranked(groups, ["digest"], ["_bytes"], "_rank")
    # A shard takes the next of the run's ranks; the first whose last rank is reached.
    last = F.transform("_counts", lambda _, i: F.aggregate(F.slice("_counts", 1, i + 1), F.lit(0).cast("long"), lambda a, n: a + n))
    placed = join_by_weight(in_run, places.withColumn("_last", last), ["_bytes"], "_groups").select(
        "digest", "_rows", F.size(F.filter("_last", lambda n: n < F.col("_rank"))).alias("shard")
    )
    sharded = join_by_weight(rows, kept(placed, "shard-places"), ["digest"], "_rows").select(
        "doc_id", "size", "text_crc32", "digest", "shard"
    )
    numbered = ranked(sharded, ["digest", "doc_id"], ["shard"], "_at")
    return numbered.withColumn("slot", F.col("_at") - 1).drop("_at")
