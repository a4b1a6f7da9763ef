"""N-gram Jaccard join: MinHash LSH of one depth proposes pairs, word sets decide.

Texts are compared by their sets of ``shingle`` consecutive words (A-Z lower-cased,
split at white space; a shorter text is one shingle). Rows with equal sets are one
class, so copies cost one row each and never meet as pairs.

Every class has ``trees`` signatures of ``depth`` min-hashes each. Classes with an equal
signature in a tree are in one node. The method's forest, in which prefixes are tries
and shortened from the data, is reduced to one fixed depth: ``forest_depth`` takes the
longest that meets pairs at the threshold with the target recall,
``1 - (1 - similarity ** depth) ** trees``, from the parameters alone. With 24 trees and
a recall of 0.99999 that is depth 4. Deeper levels would only be met earlier by pairs
that depth 4 finds as well, so no link depends on them; they could make large nodes
smaller.

Nodes are sorted runs of equal prefixes. A node is verified exactly, by intersecting
the word sets of its members with one matrix product; a pair counts only in the first
tree that holds it. Members of a large node are dealt to blocks of bounded size and
each two blocks meet in a task of their own, so no task gathers a whole node and pairs
are counted inside tasks, never written. A first look at the signatures alone picks the
members that have a pair to verify in a node; only their word sets go there. What leaves a task is one row per member: its
links and the root of its part. Parts are joined to components by the smallest label
with pointer jumping.

The number of exact comparisons in a node still grows with the square of its distinct
word sets, as the number of its links does.

Defined cases: null and empty texts have no shingles and link to nothing. Equal sets
have similarity 1, so repeated rows link to each other. Rows without id take part;
a component's id is the smallest id in it, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import bounded_batches, kept, text_key
from slimlake.llm.lanes import LOWER, SPACED, Words, mix, pieces, signed, text_bytes
from slimlake.operators.skew import join_by_weight

BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 1 << 18
_COLUMNS = 4096


def forest_depth(trees: int, similarity: float, recall: float, deepest: int = 8) -> int:
    """Longest prefix at which a forest of ``trees`` reaches the recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(piece: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """Distinct shingle hashes, sorted within each text, and the text of each."""
    data, offsets = text_bytes(piece.column("text"))
    words = Words(LOWER[data], offsets, SPACED)
    whole = np.flatnonzero(words.whole(shingle))
    hashes, at = [words.runs(shingle)[whole]], [whole]
    for length in range(1, shingle):
        first = words.bounds[:-1][words.counts == length]
        hashes.append(words.runs(length)[first])
        at.append(first)
    hashes, at = np.concatenate(hashes), np.concatenate(at)
    text = np.searchsorted(words.bounds, at, side="right") - 1
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new], words


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``values`` as binaries."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    buffers = [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers).cast(pa.binary())


def _signer(shingle: int, trees: int, depth: int):
    """Size, digest and signature of each text's set."""
    functions = trees * depth
    salts = mix(np.arange(functions, dtype=np.uint64), 11)
    factors = mix(np.arange(functions, dtype=np.uint64), 12) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                hashes, text, _ = shingle_sets(piece, shingle)
                n = np.bincount(text, minlength=piece.num_rows)
                some = np.flatnonzero(n)
                starts = np.concatenate([[0], np.cumsum(n[some])])[:-1].astype(np.int64)
                digests = np.zeros((2, piece.num_rows), dtype=np.uint64)
                least = np.zeros((piece.num_rows, functions), dtype=np.uint16)
                if len(some):
                    for lane in range(2):
                        digests[lane, some] = np.add.reduceat(mix(hashes, 21 + lane), starts)
                    for f in range(functions):
                        values = np.minimum.reduceat((hashes ^ salts[f]) * factors[f], starts)
                        least[some, f] = (mix(values) >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"), piece.column("digest"), pa.array(n, type=pa.int64()),
                        pa.array(signed(digests[0])), pa.array(signed(digests[1])),
                        _binary(least.reshape(-1), np.full(piece.num_rows, functions)),
                    ],
                    ["id", "digest", "n", "s1", "s2", "signature"],
                )

    return sign


def _packer(shingle: int):
    """The distinct shingle hashes of each class's text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, text, _ = shingle_sets(piece, shingle)
                n = np.bincount(text, minlength=piece.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("class"), _binary(hashes, n)], ["class", "members"]
                )

    return pack


def linked_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Matrix of pairs with a Jaccard similarity of at least ``similarity``."""
    ratio = Fraction(similarity).limit_denominator(1000)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A value that one set has alone is in no intersection.
    shared = counts > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    total = int(shared.sum())
    for low in range(0, total, _COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + _COLUMNS]))
        hot = np.zeros((len(sets), min(_COLUMNS, total - low)), dtype=np.float32)
        hot[owner[part], column[part] - low] = 1
        common += hot @ hot.T
    both = sizes[:, None] + sizes[None, :]
    linked = common * (ratio.numerator + ratio.denominator) >= ratio.numerator * both
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each member the smallest name that it reaches."""
    label = names.copy()
    largest = np.iinfo(names.dtype).max
    while True:
        near = np.where(linked, label[None, :], largest).min(axis=1, initial=largest)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def _new_pairs(rows: list[dict], depth: int) -> np.ndarray:
    """Pairs of a node, or of two of its blocks, that no earlier tree holds."""
    tree, one, two = rows[0]["tree"], rows[0]["one"], rows[0]["two"]
    block = np.array([r["block"] for r in rows])
    prefix = np.stack([np.frombuffer(r["signature"], dtype=np.uint16) for r in rows]).reshape(len(rows), -1, depth)
    new = (prefix[:, None, tree] == prefix[None, :, tree]).all(axis=2)
    np.fill_diagonal(new, False)
    for earlier in range(tree):
        new &= ~(prefix[:, None, earlier] == prefix[None, :, earlier]).all(axis=2)
    if one != two:
        new &= block[:, None] != block[None, :]
    return new


def _choose_node(rows: list[dict], depth: int) -> dict[str, list]:
    """The members that have a pair to verify here."""
    use = np.flatnonzero(_new_pairs(rows, depth).any(axis=1))
    return {c: [rows[i][c] for i in use] for c in _PLACES}


def _verify_node(rows: list[dict], depth: int, similarity: float) -> dict[str, list]:
    """Links within a node's block, or between two of its blocks."""
    names = np.array([r["class"] for r in rows], dtype=np.int64)
    weight = np.array([r["weight"] for r in rows], dtype=np.int64)
    sets = [np.frombuffer(r["members"], dtype=np.uint64) for r in rows]
    linked = linked_pairs(sets, similarity) & _new_pairs(rows, depth)
    has = linked.any(axis=1)
    return {
        "class": names[has].tolist(),
        "links": (linked @ weight)[has].tolist(),
        "texts": linked.sum(axis=1)[has].tolist(),
        "root": _roots(linked, names)[has].tolist(),
    }


_PLACES = ["class", "tree", "node", "block", "one", "two"]
_LINKS = "class bigint, links bigint, texts bigint, root bigint"


def _by_node(work, names: list[str], kinds: list[pa.DataType]):
    """Apply ``work`` to the rows of each node, which come sorted, one node at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, kinds)))
        at, rows = None, []
        out: dict[str, list] = {c: [] for c in names}

        def done():
            if len(rows) > 1:
                for name, values in work(rows).items():
                    out[name] += values

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["node"], row["one"], row["two"])
                if key != at:
                    done()
                    at, rows = key, []
                rows.append(row)
            if len(out[names[0]]) >= 5000:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out = {c: [] for c in names}
        done()
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _chooser(depth: int):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return _by_node(lambda rows: _choose_node(rows, depth), _PLACES, kinds)


def _verifier(depth: int, similarity: float):
    names = ["class", "links", "texts", "root"]
    return _by_node(lambda rows: _verify_node(rows, depth, similarity), names, [pa.int64()] * 4)


def _together(df: DataFrame) -> DataFrame:
    """The rows of a node, or of two of its blocks, next to each other in one task."""
    return df.repartition("node", "one", "two").sortWithinPartitions("node", "one", "two")


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex (label) of every vertex of ``edges`` (a, b)."""
    both = kept(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept(
        both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels"
    )
    total = None
    while True:
        # Labels only fall, so their sum stands still when nothing changes.
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["v"] == near["a"]).select("v", F.least("label", "near").alias("label"))
        hooked = kept(hooked, "hooked")
        above = hooked.select(F.col("v").alias("label"), F.col("label").alias("above"))
        labels = kept(hooked.join(above, "label").select("v", F.col("above").alias("label")), "labels")


def jaccard_links(
    documents: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    trees: int = 24,
    recall: float = 0.99999,
) -> tuple[DataFrame, DataFrame]:
    """Rows and classes of the join, both written.

    Rows: id, digest (of the text), n (shingles), s1, s2 (name of the class). Classes:
    s1, s2, class, n, weight (rows), first (smallest id and its digest), links (linked
    rows of other classes), texts (linked other classes), label (of the component).
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    depth = forest_depth(trees, similarity, recall)
    source = documents.select(
        F.col("doc_id").cast("long").alias("id"), text_key().alias("digest"), "text"
    )
    rows = kept(
        source.mapInArrow(
            _signer(shingle, trees, depth),
            "id bigint, digest string, n bigint, s1 bigint, s2 bigint, signature binary",
        ),
        "signatures",
    )
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(
        F.min(F.struct("id", "digest")).alias("first"), F.count("*").alias("weight"),
        F.first("n").alias("n"), F.first("signature").alias("signature"),
    )
    classes = kept(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    width = 2 * depth
    prefixes = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("signature", t * width + 1, F.lit(width))
    )
    members = classes.select("class", "n", F.posexplode(prefixes).alias("tree", "prefix")).select(
        "class", "n", "tree", F.xxhash64("tree", "prefix").alias("node")
    )
    nodes = members.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_MEMBERS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    nodes = kept(nodes.where("size > 1").select("node", blocks.alias("blocks")), "nodes")
    placed = members.join(nodes, "node").withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    )
    placed = kept(placed.select("class", "tree", "node", "block", "blocks"), "placed")

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meeting = placed.withColumn("_other", other).select(
        "class", "tree", "node", "block",
        F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("two"),
    )
    signed_ = meeting.join(classes.select("class", "signature"), "class")
    # Signatures are small: they tell who has a pair to verify before sets are moved.
    chosen = kept(
        _together(signed_).mapInArrow(
            _chooser(depth), "class bigint, tree int, node bigint, block int, one int, two int"
        ),
        "chosen",
    )
    wanted = chosen.select("class").distinct().join(classes, "class").select(
        "class", F.col("first.id").alias("_id"), F.col("first.digest").alias("_digest")
    )
    texts = source.join(wanted, source["id"].eqNullSafe(F.col("_id")) & (source["digest"] == F.col("_digest")))
    sets = texts.select("class", "text").dropDuplicates(["class"]).mapInArrow(
        _packer(shingle), "class bigint, members binary"
    )
    sets = kept(sets.join(classes.select("class", "weight", "signature"), "class"), "sets")
    meeting = _together(chosen.join(sets, "class"))
    found = kept(meeting.mapInArrow(_verifier(depth, similarity), _LINKS), "links")
    labels = components(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("class").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    summed = (
        classes.drop("signature")
        .join(counted, "class", "left")
        .join(labels.withColumnRenamed("v", "class"), "class", "left")
        .fillna(0, ["links", "texts"])
        .withColumn("label", F.coalesce("label", "class"))
    )
    return rows, kept(summed, "class-links")


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, class_id, set_id, n_links, n_text_links.

    ``class_id`` is the smallest id of the row's component, ``set_id`` the smallest id
    with the same word set. ``n_links`` counts the other rows at the threshold or above,
    ``n_text_links`` the other word sets.
    """
    rows, classes = jaccard_links(documents, **options)
    heads = classes.groupBy("label").agg(F.min("first.id").alias("class_id"))
    named = kept(
        classes.join(heads, "label").select(
            "s1", "s2", "weight", "class_id", F.col("first.id").alias("set_id"),
            (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("texts").alias("n_text_links"),
        ),
        "class-names",
    )
    columns = ["doc_id", "class_id", "set_id", "n_links", "n_text_links"]
    some = rows.where("n > 0").select(F.col("id").alias("doc_id"), "s1", "s2")
    none = rows.where("n = 0").select(
        F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.col("id").alias("set_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"),
    )
    return join_by_weight(some, named, ["s1", "s2"], "weight").select(*columns).unionByName(none)


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents with one row of each component: that of the smallest id.

    Rows without shingles all stay. Columns are those of the input.
    """
    columns = documents.columns
    rows, classes = jaccard_links(documents, **options)
    heads = classes.groupBy("label").agg(F.min("first").alias("first"))
    bare = rows.where("n = 0").select("id", "digest").distinct()
    stay = heads.select(F.col("first.id").alias("id"), F.col("first.digest").alias("digest"))
    stay = stay.withColumn("__one", F.lit(True)).unionByName(bare.withColumn("__one", F.lit(False)))
    stay = kept(stay.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "__one"), "survivors")
    joined = documents.withColumn("__key", text_key(documents["text"])).join(
        stay, documents["doc_id"].eqNullSafe(F.col("__id")) & F.col("__key").eqNullSafe(F.col("__digest"))
    )
    # Equal rows have equal keys: one of them stays, unless they are without words.
    once = joined.where("__one").dropDuplicates(["__id", "__digest"])
    return once.unionByName(joined.where("NOT __one")).select(*[F.col(f"`{c}`") for c in columns])
