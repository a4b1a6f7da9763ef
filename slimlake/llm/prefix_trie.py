"""Prefix trie of conversations from sorted longest common prefixes.

Conversations are sorted as sequences of turns, each turn a digest, so the members of a
node, all that begin with the same turns, stand side by side. The common prefix of each
conversation with the next one goes to a sparse table of range minima. Every prefix of
every conversation is a candidate: by powers of two it searches its interval's left and
right end on its own, for as long as the minimum reaches its depth. A second sparse
table gives the smallest member, whose candidate stands for the node.

Sorted conversations are worked on in pieces of at most ``PIECE`` rows that follow one
another. A node whose interval reaches an end of its piece is open: it gives one row per
piece, known by a digest of its prefix, and these are added up. No other node is met in
two pieces. A conversation stands in the sort once for every ``BAND`` turns: its key is
a digest of all turns before the band and the band's turns, so one of any length is
many short rows. Digests of whole bands add up, hence come from running sums.

What is summed over a subtree is summed over members instead. A conversation leads the
nodes whose smallest member it is, which are all on its path from some depth on; a node's
descendants are what its members lead, less what its own leader leads above it. A second
pass over the pieces sums, for each interval, what the members lead.

Conversations that end at a node are next to each other too, by rising id, so the digest
of their ids is made in the piece, or from the open node's parts in their order, which a
task reads one after another.

Defined cases: rows without a conv_id are left out. Null role or text is empty. Turns
come by rising number, null first, those of equal number by digest. Repeated rows are
turns of their own. Without conversations there are no nodes. 128-bit digests stand for
turns and prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import bounded_batches, kept
from slimlake.operators.ordered import ranked, running
from slimlake.operators.skew import join_by_weight

BAND = 32
PIECE = 1 << 16
UNIT = 16
#: Conversations shared from, and the largest number of shared turns.
FAMILY, MOST_SHARED = 5, 8
NO_IDS = hashlib.sha256(b"").hexdigest()


def rank_turns(conversations: DataFrame) -> DataFrame:
    """One slim row per turn: conv_id, position (from 1), digest, n_bytes, length (turns)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    placed = ranked(slim, ["turn", "digest"], ["conv_id"], "position", count="length")
    return placed.select("conv_id", "position", "digest", "n_bytes", "length")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: their turns, and one row for each."""
    return turns, turns.where("position = 1").select("conv_id", "length")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share a beginning: their turns, and one row for each.

    Conversation c begins with the first h turns of c - c % 5, with h from c's checksum,
    and goes on with its own turns after its first h.
    """
    own = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    each = turns.where("position = 1").select(
        "conv_id", F.col("length").alias("n"), own.alias("h"),
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
    )
    there = each.select(F.col("conv_id").alias("base"), F.col("n").alias("_there"))
    shared = F.least("h", F.coalesce("_there", F.lit(0)))
    plan = each.join(there, "base", "left").withColumn("shared", shared)
    length = F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    plan = kept(plan.select("conv_id", "base", "h", "shared", "n", length.alias("length")), "trie-plan")
    heads = turns.where(F.col("position") <= MOST_SHARED).select(
        F.col("conv_id").alias("base"), "position", "digest", "n_bytes"
    )
    begun = heads.join(plan.where("shared > 0"), "base").where("position <= shared")
    after = join_by_weight(turns.drop("length"), plan.drop("base"), ["conv_id"], "n").where("position > h")
    after = after.withColumn("position", F.col("position") - F.col("h") + F.col("shared"))
    columns = ["conv_id", "position", "digest", "n_bytes", "length"]
    return begun.select(*columns).unionByName(after.select(*columns)), plan.select("conv_id", "length")


def _sum_digest(band: int, key: bytes) -> list[int]:
    """Four whole numbers below 2**32 that stand for a full band; they add up over bands."""
    made = hashlib.md5(f"{band}:{key.hex().upper()}".encode()).digest()
    return [int.from_bytes(made[4 * k : 4 * k + 4], "big") for k in range(4)]


def _next_root(band: int, key: bytes) -> bytes:
    """Of a full band's key (its root and turns): the root of the band that follows."""
    root = [int.from_bytes(key[4 * k : 4 * k + 4], "big") for k in range(4)]
    added = [(a + b) % (1 << 32) for a, b in zip(root, _sum_digest(band, key[UNIT:]), strict=True)]
    return b"".join(x.to_bytes(4, "big") for x in added)


def sorted_bands(turns: DataFrame, width: int = BAND) -> DataFrame:
    """The bands of all conversations in sorted order, numbered by ``at``; written once."""
    band = F.floor((F.col("position") - 1) / width).cast("int")
    held = F.sort_array(F.collect_list(F.struct("position", "digest", "n_bytes")))
    # At most ``width`` rows meet in a group.
    bands = turns.groupBy("conv_id", band.alias("band")).agg(
        held.alias("held"), F.max("length").alias("length")
    )
    bands = bands.select(
        "conv_id", "band", "length", F.upper(F.array_join("held.digest", "")).alias("turns"),
        F.col("held.n_bytes").alias("sizes"),
    )
    bands = kept(bands, "trie-bands")
    several = bands.where(F.col("length") > width)
    name = F.md5(F.concat(F.col("band").cast("string"), F.lit(":"), "turns"))
    parts = {
        f"_p{k}": F.conv(F.substring(name, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)
    }
    summed = running(several.withColumns(parts), ["band"], {f"_s{p}": p for p in parts}, ["conv_id"])
    root = F.concat(
        *[F.lpad(F.hex((F.col(f"_s{p}") - F.col(p)) % (1 << 32)), 8, "0") for p in parts]
    )
    rooted = summed.withColumn("root", root).select(*bands.columns, "root")
    single = bands.where(F.col("length") <= width).withColumn("root", F.lit("0" * 2 * UNIT))
    order = ["band", "key", "conv_id"]
    rows = single.unionByName(rooted).select(
        "conv_id", "band", F.unhex(F.concat("root", "turns")).alias("key"), "sizes", "length"
    )
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(placed.withColumn("at", F.monotonically_increasing_id()), "trie-sorted")


class RangeMin:
    """Sparse table of range minima."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of each range, both ends included."""
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), dtype=self.levels[0].dtype)
        for k in np.unique(level):
            own, table = np.flatnonzero(level == k), self.levels[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << int(k)) + 1])
        return out

    def left_end(self, start: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The first place from which all values up to before ``start`` are at least ``need``."""
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            table, step = self.levels[k], 1 << k
            to = at - step
            own = np.flatnonzero(to >= 0)
            own = own[table[to[own]] >= need[own]]
            at[own] = to[own]
        return at

    def right_end(self, start: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The place behind the last of the values from ``start`` on that are at least ``need``."""
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            table, step = self.levels[k], 1 << k
            own = np.flatnonzero(at < len(table))
            own = own[table[at[own]] >= need[own]]
            at[own] += step
        return at


_NODES = pa.schema(
    [
        ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_bytes", pa.int64()),
        ("leaves", pa.int64()), ("saved", pa.int64()), ("is_open", pa.bool_()), ("id", pa.binary()),
        ("parent", pa.int64()), ("parent_id", pa.binary()), ("first", pa.int64()), ("ends", pa.binary()),
        ("ends_sha256", pa.string()),
    ]
)
_NODES_DDL = (
    "depth long, conv_id long, n_convs long, n_bytes long, leaves long, saved long, is_open boolean, "
    "id binary, parent long, parent_id binary, first long, ends binary, ends_sha256 string"
)
_INPUT = ["at", "band", "conv_id", "key", "sizes", "length", "leaves", "saved"]


def common_units(keys: list[bytes], bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each key, and how many of them each key begins with as the next one does."""
    units = np.array([len(key) // UNIT for key in keys], dtype=np.int64)
    flat = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    begin = np.cumsum(units) - units
    row = np.repeat(np.arange(len(keys)), units)
    table = np.zeros((len(keys), int(units.max()), 2), dtype=np.uint64)
    table[row, np.arange(len(flat)) - begin[row]] = flat
    equal = (table[1:] == table[:-1]).all(axis=2)
    equal &= np.arange(table.shape[1]) < np.minimum(units[1:], units[:-1])[:, None]
    common = np.minimum.accumulate(equal, axis=1).sum(axis=1)
    return units, np.where(bands[1:] == bands[:-1], common, 0)


def _piece(rows: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The nodes of a piece, each where its smallest member of the piece stands."""
    at, bands, convs, length, leaves, saved = (
        rows.column(_INPUT.index(c)).to_numpy(zero_copy_only=False)
        for c in ("at", "band", "conv_id", "length", "leaves", "saved")
    )
    keys, n = rows.column(3).to_pylist(), rows.num_rows
    sizes = rows.column(4).flatten().to_numpy(zero_copy_only=False)
    units, common = common_units(keys, bands)
    prefixes, members = RangeMin(common), RangeMin(convs)
    # Every prefix of every row, by row and depth; the first unit is the band's root.
    turns = units - 1
    row = np.repeat(np.arange(n), turns)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(turns) - turns, turns) + 1
    low, high = prefixes.left_end(row, inner + 1), prefixes.right_end(row, inner + 1)
    leader = members.least(low, high)
    is_open = (low == 0) | (high == n - 1)
    depth = bands[row].astype(np.int64) * width + inner
    # Rows that end a conversation, and how far rows with an equal key reach.
    ending = length == bands.astype(np.int64) * width + turns
    follows = np.append((common == units[:-1]) & (units[:-1] == units[1:]), False)
    last_equal = np.minimum.accumulate(np.where(follows, n, np.arange(n))[::-1])[::-1]

    def name(place: int) -> bytes:
        """What a node is known by in other pieces."""
        key, inside = keys[row[place]], int(inner[place])
        if inside == width:
            return _next_root(int(bands[row[place]]), key)
        return hashlib.md5(b"%d:" % depth[place] + key[: UNIT * (inside + 1)]).digest()

    chosen = np.flatnonzero(convs[row] == leader)
    ids, parents, parent_ids, ends, shas = [], [], [], [], []
    named = is_open | (inner == width)
    for place, shown, begins, inside in zip(
        chosen.tolist(), named[chosen].tolist(), low[chosen].tolist(), inner[chosen].tolist(), strict=True
    ):
        ids.append(name(place) if shown else None)
        parent = parent_id = None
        if inside > 1 and not is_open[place - 1]:
            parent = int(leader[place - 1])
        elif inside > 1:
            parent_id = name(place - 1)
        elif bands[row[place]]:
            parent_id = keys[row[place]][:UNIT]
        parents.append(parent)
        parent_ids.append(parent_id)
        joined = b""
        if turns[begins] == inside:
            equal = slice(begins, int(last_equal[begins]) + 1)
            joined = ",".join(map(str, convs[equal][ending[equal]].tolist())).encode()
        ends.append(joined if joined and is_open[place] else None)
        shas.append(None if is_open[place] else hashlib.sha256(joined).hexdigest() if joined else NO_IDS)
    sums = [np.concatenate([[0], np.cumsum(w)]) for w in (leaves, saved)]
    columns = [
        depth[chosen], convs[row[chosen]], (high - low + 1)[chosen], sizes[chosen],
        *((s[high + 1] - s[low])[chosen] for s in sums),
        is_open[chosen], ids, parents, parent_ids, at[low[chosen]], ends, shas,
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES
    )


def _pieces(width: int, most: int):
    """For runs of rows that follow one another, of at most ``most`` rows: their nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, expected = [], 0, None

        def close():
            return _piece(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)

        for batch in batches:
            begin, numbers = 0, batch.column(0).to_numpy()
            while begin < batch.num_rows:
                if held and (count == most or numbers[begin] != expected):
                    yield close()
                    held, count = [], 0
                room = numbers[begin : begin + most - count]
                gaps = np.flatnonzero(np.diff(room) != 1)
                size = int(gaps[0]) + 1 if len(gaps) else len(room)
                held.append(batch.slice(begin, size))
                begin, count, expected = begin + size, count + size, int(room[size - 1]) + 1
        if held:
            yield close()

    return work


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, whose parts arrive in their order."""
    current, state = None, None

    def row():
        values = [[current[0]], [current[1]], [state.hexdigest()]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, type=t) for v, t in zip(values, (pa.binary(), pa.int64(), pa.string()), strict=True)],
            ["id", "depth", "sha"],
        )

    for batch in batches:
        for name, depth, part in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (name, depth) == current:
                state.update(b"," + part)
                continue
            if current is not None:
                yield row()
            current, state = (name, depth), hashlib.sha256(part)
    if current is not None:
        yield row()


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the list of all ids, in their order."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        if ids:
            columns = [[b""], [0], [ids[0]], [",".join(map(str, ids)).encode()]]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["id", "depth", "first", "ends"]
            )


_PARTS = "id binary, depth long, first long, ends binary"


def digests_of(parts: DataFrame) -> DataFrame:
    """id, depth and the SHA-256 of the comma-joined ids, from parts of the list."""
    order = ["id", "depth", "first"]
    placed = parts.select(*order, "ends").repartition("id", "depth").sortWithinPartitions(*order)
    return placed.mapInArrow(_digests, "id binary, depth long, sha string")


def _merged(rows: DataFrame) -> DataFrame:
    """One row per node from the rows of the pieces."""
    columns = ["depth", "conv_id", "n_convs", "n_bytes", "leaves", "saved", "id", "parent", "parent_id", "ends_sha256"]
    several = rows.where("is_open")
    added = several.groupBy("id", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"), F.max("parent").alias("parent"),
        F.max("parent_id").alias("parent_id"), *[F.sum(c).alias(c) for c in ("n_convs", "leaves", "saved")],
    )
    ends = digests_of(several.where("ends IS NOT NULL"))
    found = added.join(ends, ["id", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_IDS)))
    return rows.where("NOT is_open").select(*columns).unionByName(found.select(*columns))


def _with_parents(nodes: DataFrame, smallest) -> DataFrame:
    """Adds parent_conv_id; parents in other pieces are looked up by what they are known by."""
    refs = nodes.where("parent_id IS NOT NULL").withColumn("_above", F.col("depth") - 1)
    asked = refs.groupBy("parent_id", "_above").agg(F.count("*").alias("_asked"))
    known = nodes.where("id IS NOT NULL").select(
        F.col("id").alias("parent_id"), F.col("depth").alias("_above"), F.col("conv_id").alias("_leader")
    )
    found = join_by_weight(refs, asked.join(known, ["parent_id", "_above"]), ["parent_id", "_above"], "_asked")
    above = F.when(F.col("depth") > 1, F.col("parent")).otherwise(smallest)
    rest = nodes.where("parent_id IS NULL").withColumn("parent_conv_id", above)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_bytes", "ends_sha256"]
    return rest.select(*columns).unionByName(found.withColumn("parent_conv_id", F.col("_leader")).select(*columns))


def trie(turns: DataFrame, conversations: DataFrame, width: int = BAND, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    ``turns`` has conv_id, position, digest, n_bytes and length, ``conversations``
    conv_id and length, those without turns too. ``width`` is the number of turns of a
    band, ``piece`` the number of rows of a piece; neither changes the result.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    bands, find = sorted_bands(turns, width), _pieces(width, piece)
    nothing = F.lit(0).cast("long")
    first = bands.withColumns({"leaves": nothing, "saved": nothing}).select(*_INPUT)
    rows = kept(first.mapInArrow(find, _NODES_DDL), "trie-pieces")
    merged = kept(_merged(rows).drop("leaves", "saved"), "trie-merged")
    smallest = conversations.agg(F.min("conv_id")).scalar()
    nodes = kept(_with_parents(merged, smallest), "trie-parents")
    below = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children")
    )
    value = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("value")
    children = F.coalesce("n_children", nothing).alias("n_children")
    nodes = nodes.join(below, ["conv_id", "depth"], "left").select(*nodes.columns, children, value)
    nodes = kept(nodes, "trie-nodes")

    led = nodes.groupBy("conv_id").agg(
        F.sum("value").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    weighed = bands.join(led, "conv_id", "left").na.fill(0, ["saved", "leaves"]).select(*_INPUT)
    second = weighed.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(find, _NODES_DDL)
    second = second.select("depth", "conv_id", "leaves", "saved", "is_open", "id")
    several = second.where("is_open").groupBy("id", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("_members")
    )
    sums = second.where("NOT is_open").select(
        "conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("_members")
    ).unionByName(several.drop("id"))
    # From the deepest up: what a conversation leads from each depth on.
    path = running(nodes, ["-depth"], {"_from_here": "value"}, ["conv_id"], {"_led": "value"})
    saved = F.col("_members") - F.col("_led") + F.col("_from_here")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = path.join(sums, ["conv_id", "depth"]).withColumn("saved_tokens", saved).select(*columns)
    return inner.unionByName(_root(nodes, conversations).select(*columns))


def _root(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    turnless = conversations.where("length = 0").select("conv_id")
    parts = turnless.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(_join_ids, _PARTS)
    ends = digests_of(parts)
    all_nodes = nodes.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"), F.count_if(F.col("n_children") == 0).alias("_leaves"),
        F.coalesce(F.sum("value"), F.lit(0).cast("long")).alias("saved_tokens"),
    )
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    return root.withColumns(
        {
            "depth": F.lit(0).cast("long"),
            "parent_conv_id": F.lit(None).cast("long"),
            "n_children": all_nodes.select("n_children").scalar(),
            "n_leaves": F.greatest(all_nodes.select("_leaves").scalar(), F.lit(1).cast("long")),
            "saved_tokens": all_nodes.select("saved_tokens").scalar(),
            "ends_sha256": F.coalesce(ends.select("sha").scalar(), F.lit(NO_IDS)),
        }
    )
