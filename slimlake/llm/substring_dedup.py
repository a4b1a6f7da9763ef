"""Removal of repeated passages: a Count-min prefilter, then exact groups of windows.

A window is ``window`` consecutive words of one document. A word goes when a window
that covers it also starts in a document with a smaller id; windows are judged on the
input, not on what is left.

First pass: every task counts its windows in a sparse Count-min sketch, and the tasks'
sketches are merged block by block. A window is counted by its anchor, the smallest
hash among its runs of ``gram`` words; equal windows have equal anchors, and
neighbouring windows mostly share one, so a document adds an entry per dozen or more
windows and the sketch still never falls below the number of documents that hold a
window. Counters saturate at 2, which is all the second pass asks for.

Second pass: windows whose estimate is 2 or more are grouped exactly, by 96 bits of
two independent hashes of their words, to find the smallest id of each. A Count-min
sketch errs upwards only, so no repeated window is lost.

Equal texts are met before that: a bit table of the hashes of texts that occur twice
singles them out, only those of the smallest id go on, and the copies, if a window long
or longer, lose everything.

The sketch gets ``cell_bytes`` bytes of text per cell and row of hashes, up to
``max_cells`` bits in all, which bounds the broadcast; a larger corpus still gives the
same result, with more windows going to the exact groups.

Words are ``[^\x20\x09-\x0D]+``, unchanged. Defined cases: null and empty texts have no
words; texts shorter than a window lose nothing. A row without id neither removes nor
loses words. Rows with equal ids do not remove each other's words. Repeated rows each
give a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import bit_table, bounded_batches, in_bit_table, kept, text_key
from slimlake.llm.lanes import SPACED, Words, mix, pieces, signed, text_bytes

BLOCK = 1 << 20
COPY_BITS = 26
_SPARSE = "block int, once binary, twice binary"
_FOUND = (
    "row bigint, id bigint, digest string, n_words bigint, body string, clear string, "
    "h1 bigint, h2 int, at int, rest array<int>"
)
_FOUND_TYPES = [
    pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(),
    pa.int32(), pa.list_(pa.int32()),
]
_FOUND_NAMES = ["row", "id", "digest", "n_words", "body", "clear", "h1", "h2", "at", "rest"]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows, and the anchor of each."""
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = _sliding_min(words.runs(gram), window - gram + 1)
    starts = np.flatnonzero(words.whole(window))
    return starts, least[starts]


def _cells(values: np.ndarray, rows: int, width: int) -> list[np.ndarray]:
    return [mix(values, r + 1) % np.uint64(width) + np.uint64(r * width) for r in range(rows)]


def _counter(window: int, gram: int, rows: int, width: int):
    """The sketch of a task's documents: cells counted once, and more than once, per block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = []
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(*text_bytes(piece.column("text")), SPACED)
                starts, anchor = anchors(words, window, gram)
                text = np.searchsorted(words.bounds, starts, side="right") - 1
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                anchor, text = anchor[new], text[new]
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                new = np.ones(len(anchor), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                entries.append(anchor[new])
        if not entries:
            return
        cells, counts = np.unique(
            np.concatenate(_cells(np.concatenate(entries), rows, width)), return_counts=True
        )
        edges = np.searchsorted(cells, np.arange(0, rows * width + BLOCK, BLOCK, dtype=np.uint64))
        for block in np.flatnonzero(np.diff(edges)):
            part = slice(edges[block], edges[block + 1])
            offset = (cells[part] - np.uint64(block * BLOCK)).astype(np.uint32)
            many = counts[part] > 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], type=pa.int32()),
                    pa.array([offset[~many].tobytes()], type=pa.binary()),
                    pa.array([offset[many].tobytes()], type=pa.binary()),
                ],
                ["block", "once", "twice"],
            )

    return count


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the sorted sparse sketches block by block; a bit per cell counted twice."""
    at, sums = None, None

    def full(block, sums):
        return pa.RecordBatch.from_arrays(
            [pa.array([block], type=pa.int32()), pa.array([np.packbits(sums > 1).tobytes()], type=pa.binary())],
            ["block", "bits"],
        )

    for batch in batches:
        for block, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if block != at:
                if at is not None:
                    yield full(at, sums)
                at, sums = block, np.zeros(BLOCK, dtype=np.uint8)
            where = np.frombuffer(once, dtype=np.uint32)
            sums[where] = np.minimum(sums[where] + 1, 2)
            sums[np.frombuffer(twice, dtype=np.uint32)] = 2
    if at is not None:
        yield full(at, sums)


def repeated_bits(
    numbered: DataFrame, window: int, gram: int, rows: int, cell_bytes: int, max_cells: int
) -> tuple[np.ndarray, int]:
    """The merged sketch as packed bits (counted twice or more), and its row width."""
    total = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).scalar()
    size = numbered.sparkSession.range(1).select(total).first()[0]
    width = int(min(max(size // cell_bytes, BLOCK), max_cells // rows))
    sparse = numbered.select("text").mapInArrow(_counter(window, gram, rows, width), _SPARSE)
    merged = sparse.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    bits = np.zeros((rows * width + BLOCK) // 8 + 1, dtype=np.uint8)
    # One bit per cell, at most ``max_cells`` bits.
    for block, packed in merged.collect():
        part = np.frombuffer(packed, dtype=np.uint8)
        bits[block * BLOCK // 8 : block * BLOCK // 8 + len(part)] = part[: len(bits) - block * BLOCK // 8]
    return bits, width


def _finish(word_bytes: list[bytes], form: str) -> str:
    body = b" ".join(word_bytes)
    return hashlib.sha256(body).hexdigest() if form == "sha256" else body.decode()


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = []
    for name, kind in zip(_FOUND_NAMES, _FOUND_TYPES):
        value = columns.get(name)
        arrays.append(pa.nulls(n, kind) if value is None else value if isinstance(value, pa.Array) else pa.array(value, type=kind))
    return pa.RecordBatch.from_arrays(arrays, _FOUND_NAMES)


def _candidates(window: int, gram: int, rows: int, width: int, sketch, form: str, copies=None):
    """Per document a row, finished if no window may repeat; and the windows that may.

    A text of a window or more whose hash is in the bit table ``copies`` is passed on
    with its digest instead.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = text_bytes(piece.column("text"))
                words = Words(data, offsets, SPACED)
                starts, anchor = anchors(words, window, gram)
                text = np.searchsorted(words.bounds, starts, side="right") - 1
                new = np.ones(len(starts), dtype=bool)
                new[1:] = anchor[1:] != anchor[:-1]
                runs = np.flatnonzero(new)
                often = np.ones(len(runs), dtype=bool)
                for cell in _cells(anchor[runs], rows, width):
                    byte = bits[(cell >> np.uint64(3)).astype(np.int64)]
                    often &= (byte >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
                maybe = np.repeat(often, np.diff(np.append(runs, len(starts))))
                has_id = ~np.asarray(piece.column("id").is_null())
                maybe &= has_id[text]
                again = np.zeros(piece.num_rows, dtype=bool)
                if copies is not None:
                    hashes = np.asarray(piece.column("text_hash")).view(np.uint64)
                    again = in_bit_table(copies.value, hashes) & (words.counts >= window) & has_id
                    maybe &= ~again[text]
                starts, text = starts[maybe], text[maybe]
                open_ = np.zeros(piece.num_rows, dtype=bool)
                open_[text] = True
                open_ |= again
                raw = data.tobytes()
                bodies, clear = [], []
                for t in range(piece.num_rows):
                    body = raw[offsets[t] : offsets[t + 1]]
                    bodies.append(body.decode() if open_[t] else None)
                    clear.append(None if open_[t] else _finish(body.split(), form))
                named = [d if a else None for d, a in zip(piece.column("digest").to_pylist(), again)]
                yield _rows(
                    row=piece.column("row"), id=piece.column("id"), digest=named, n_words=words.counts,
                    body=bodies, clear=clear,
                )
                if not len(starts):
                    continue
                h1 = words.runs(window, 0)[starts]
                h2 = (words.runs(window, 1)[starts] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                order = np.lexsort((starts, h2, h1, text))
                h1, h2, text, starts = h1[order], h2[order], text[order], starts[order]
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                at = (starts - words.bounds[text]).astype(np.int32)
                # Mostly a window occurs once in its text; only the others need a list.
                others = np.diff(np.append(first, len(starts))) - 1
                rest = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(others)]).astype(np.int32)),
                    pa.array(at[~new]),
                    mask=pa.array(others == 0),
                )
                of = pa.array(text[first])
                yield _rows(
                    row=piece.column("row").take(of), id=piece.column("id").take(of),
                    h1=signed(h1[first]), h2=h2[first].view(np.int32), at=at[first], rest=rest,
                )

    return find


def _remover(window: int, form: str):
    """Take the covered words out of each text."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, bodies = [], []
            for body, starts in zip(batch.column("body"), batch.column("starts")):
                words = body.as_py().encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                if starts.is_valid:
                    at = np.asarray(starts.values)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                stay = np.cumsum(gone)[:-1] == 0
                removed.append(len(words) - int(stay.sum()))
                bodies.append(_finish([words[i] for i in np.flatnonzero(stay)], form))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("id"), batch.column("n_words"),
                    pa.array(removed, type=pa.int64()), pa.array(bodies, type=pa.string()),
                ],
                ["row", "id", "n_words", "n_removed", "kept"],
            )

    return remove


def remove_repeats(
    documents: DataFrame,
    window: int = 50,
    gram: int = 25,
    rows: int = 3,
    cell_bytes: int = 20,
    max_cells: int = 1 << 30,
    form: str = "text",
) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed and kept.

    ``kept`` has the words that stay, joined by one space, or with ``form="sha256"``
    their hexadecimal SHA-256, which spares moving the texts.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    numbered = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"),
        text_key().alias("digest"), F.xxhash64("text").alias("text_hash"), "text",
    )
    bits, width = repeated_bits(numbered, window, gram, rows, cell_bytes, max_cells)
    sketch = spark.sparkContext.broadcast(bits)
    twice = documents.select(F.xxhash64("text").alias("text_hash")).groupBy("text_hash").agg(F.count("*").alias("n"))
    copies = spark.sparkContext.broadcast(bit_table(twice.where("n > 1"), "text_hash", COPY_BITS))
    find = _candidates(window, gram, rows, width, sketch, form, copies)
    found = kept(numbered.mapInArrow(find, _FOUND), "windows")

    # Of equal texts only those of the smallest id are looked at; the others lose all.
    same = found.where("digest IS NOT NULL").select("row", "id", "digest", "n_words", "body")
    least = kept(same.groupBy("digest").agg(F.min("id").alias("first_id")), "first-copies")
    same = same.join(least, "digest")
    first = same.where("id = first_id").select(
        "row", "id", F.lit(None).cast("string").alias("digest"), F.col("body").alias("text")
    )
    more = kept(first.mapInArrow(_candidates(window, gram, rows, width, sketch, form), _FOUND), "first-windows")
    gone = same.where("id > first_id").select(
        F.col("id").alias("doc_id"), "n_words", F.col("n_words").alias("n_removed"),
        F.lit(_finish([], form)).alias("kept"),
    )

    both = found.where("digest IS NULL").unionByName(more)
    windows = both.where("h1 IS NOT NULL").select("row", "id", "h1", "h2", "at", "rest")
    firsts = windows.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    firsts = kept(firsts.where("first_id < last_id").drop("last_id"), "repeated-windows")
    later = windows.join(firsts, ["h1", "h2"]).where("id > first_id")
    starts = later.groupBy("row").agg(
        F.concat(F.collect_list("at"), F.flatten(F.collect_list("rest"))).alias("starts")
    )
    texts = both.where("h1 IS NULL")
    clear = texts.where("clear IS NOT NULL").select(
        F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("clear").alias("kept")
    )
    open_ = texts.where("body IS NOT NULL").select("row", "id", "n_words", "body").join(starts, "row", "left")
    cut = open_.mapInArrow(
        _remover(window, form), "row bigint, id bigint, n_words bigint, n_removed bigint, kept string"
    )
    cut = cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept")
    return clear.unionByName(cut).unionByName(gone)
