"""Benchmark decontamination by winnowing, joining fingerprints and extending hits.

A window is ``window`` consecutive words. Both sides hash every run of ``gram`` words
and keep, in each stretch of ``window - gram + 1`` runs, the smallest hash (the last of
equals). What is kept depends on the stretch alone, so any shared window keeps the
same run on both sides and is met by an equality join of fingerprints: none is missed.

A shared fingerprint is extended word by word to both sides, as far as a window that
holds it can reach; where the span comes to ``window`` words or more, its words are
hit. Longer overlaps are unions of such spans. An item with fewer words than a window
is one window by itself: its only fingerprint is its whole run, looked for at every
word of the documents. Fingerprints and words are compared as 64-bit hashes, of which
a hit needs ``window`` equal in a row.

Documents' fingerprints first pass a bit table of those of the items. It has
``2**filter_bits`` bits whatever the input, so broadcasting it is bounded; a false
positive only costs a row in the join.

Words: A-Z lower-cased, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. Defined cases: null
and empty texts have no words, and an item without words has no window. Repeated rows
each give a row; documents need no unique id. Items with equal ids count as one; an
item without id marks words as hit but is not counted. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import bit_table, bounded_batches, in_bit_table, kept, text_key
from slimlake.llm.lanes import LOWER, PLAIN, Words, pieces, signed, text_bytes

_FOUND = "row bigint, id bigint, digest string, n_words bigint, fp bigint, at bigint, near binary"


def winnowed(words: Words, window: int, gram: int) -> np.ndarray:
    """Word numbers at which a kept run of ``gram`` words starts."""
    width = window - gram + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    runs = words.runs(gram)
    least, at = runs[:n].copy(), np.zeros(n, dtype=np.int64)
    for step in range(1, width):
        other = runs[step : step + n]
        smaller = other <= least
        least[smaller] = other[smaller]
        at[smaller] = step
    keep = np.zeros(len(words), dtype=bool)
    keep[(np.arange(n) + at)[words.whole(window)]] = True
    return np.flatnonzero(keep)


def contexts(words: Words, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Hashes of the words around each kept run; 0 beyond the text's ends."""
    before, slots = window - gram, 2 * window - gram
    if not len(at):
        return np.zeros((0, slots), dtype=np.uint64)
    text = np.searchsorted(words.bounds, at, side="right") - 1
    where = at[:, None] + np.arange(-before, slots - before)[None, :]
    inside = (where >= words.bounds[text][:, None]) & (where < words.bounds[text + 1][:, None])
    near = words.hashes[np.clip(where, 0, len(words) - 1)] | np.uint64(1)
    return np.where(inside, near, np.uint64(0))


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    width = flat.shape[1] * 8 if flat.ndim == 2 else 8
    offsets = pa.py_buffer((np.arange(len(flat) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, offsets, pa.py_buffer(flat.tobytes())])


def _table(row, ident, n_words, fp, at, near, digest=None) -> pa.RecordBatch:
    digest = pa.nulls(len(row), pa.string()) if digest is None else digest
    columns = [row, ident, digest, n_words, fp, at, near]
    names = ["row", "id", "digest", "n_words", "fp", "at", "near"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(columns, kinds)], names
    )


def _finder(window: int, gram: int, short: list[int], bits):
    """Fingerprints of documents that pass the bit table, after one head row per document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = text_bytes(piece.column("text"))
                words = Words(LOWER[data], offsets, PLAIN)
                none = pa.nulls(piece.num_rows, pa.int64())
                yield _table(
                    piece.column("row"), piece.column("id"), words.counts, none, none,
                    pa.nulls(piece.num_rows, pa.binary()), piece.column("digest"),
                )
                starts = [winnowed(words, window, gram)]
                prints = [words.runs(gram)[starts[0]]]
                for length in short:
                    starts.append(np.flatnonzero(words.whole(length)))
                    prints.append(words.runs(length)[starts[-1]])
                at, fp = np.concatenate(starts), np.concatenate(prints)
                passes = in_bit_table(table, fp)
                at, fp = at[passes], fp[passes]
                if len(at):
                    text = np.searchsorted(words.bounds, at, side="right") - 1
                    yield _table(
                        piece.column("row").take(pa.array(text)), piece.column("id").take(pa.array(text)),
                        pa.nulls(len(at), pa.int64()), signed(fp), at - words.bounds[text],
                        _binary(contexts(words, at, window, gram)),
                    )

    return find


def _item_prints(window: int, gram: int):
    """Fingerprints of items; ``n_words`` is that of an item shorter than a window, else 0."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = text_bytes(piece.column("text"))
                words = Words(LOWER[data], offsets, PLAIN)
                found = [(0, winnowed(words, window, gram), gram)]
                first, counts = words.bounds[:-1], words.counts
                for length in range(1, window):
                    found.append((length, first[counts == length], length))
                for short, at, length in found:
                    if not len(at):
                        continue
                    text = np.searchsorted(words.bounds, at, side="right") - 1
                    yield _table(
                        np.zeros(len(at), dtype=np.int64), piece.column("id").take(pa.array(text)),
                        np.full(len(at), short), signed(words.runs(length)[at]), at - words.bounds[text],
                        _binary(contexts(words, at, window, gram)),
                    )

    return find


def _extender(window: int, gram: int):
    """Spans of words around joined fingerprints that come to a whole window."""
    before, slots = window - gram, 2 * window - gram

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("near", "item_near"):
                column = batch.column(name)
                raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64)
                sides.append(raw.reshape(-1, slots))
            equal = (sides[0] == sides[1]) & (sides[0] != 0)
            at = np.asarray(batch.column("at"))
            short = np.asarray(batch.column("short"))
            left = np.cumprod(equal[:, :before][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(equal[:, before:], axis=1).sum(axis=1)
            whole = (short == 0) & (right >= gram) & (left + right >= window)
            brief = (short > 0) & (right >= short)
            start = np.where(brief, at, at - left)
            stop = np.where(brief, at + short, at + right)
            hit = np.flatnonzero(whole | brief)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array(hit)),
                    batch.column("item").take(pa.array(hit)),
                    pa.array(start[hit], type=pa.int64()),
                    pa.array(stop[hit], type=pa.int64()),
                ],
                ["row", "item", "start", "stop"],
            )

    return extend


def _numbered(df: DataFrame, ident: str, keyed: bool = False) -> DataFrame:
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{ident}`").cast("long").alias("id"),
        (text_key() if keyed else F.lit(None).cast("string")).alias("digest"),
        "text",
    )


def find_overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    gram: int = 5,
    filter_bits: int = 26,
    keyed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Documents (row, id, digest, n_words) and their shared spans (row, item, start, stop).

    ``row`` numbers the input's rows; ``start`` and ``stop`` count words from 0. The
    digest of the text is there if ``keyed``, else null.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    items = _numbered(benchmark, "item_id").mapInArrow(_item_prints(window, gram), _FOUND)
    items = items.select(
        "fp", F.col("id").alias("item"), F.col("n_words").alias("short"), F.col("near").alias("item_near")
    ).distinct()
    items = kept(items, "benchmark-prints")
    short = sorted(r[0] for r in items.where("short > 0").select("short").distinct().collect())
    table = bit_table(items, "fp", filter_bits)
    bits = spark.sparkContext.broadcast(table)
    finder = _finder(window, gram, short, bits)
    found = kept(_numbered(documents, "doc_id", keyed).mapInArrow(finder, _FOUND), "document-prints")
    heads = found.where("fp IS NULL").select("row", "id", "digest", "n_words")
    joined = found.where("fp IS NOT NULL").select("row", "fp", "at", "near").join(items, "fp")
    spans = joined.select("row", "at", "near", "item", "short", "item_near").mapInArrow(
        _extender(window, gram), "row bigint, item bigint, start bigint, stop bigint"
    )
    return heads, spans


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (sorted strings), spans, contaminated.

    ``spans`` are the shared stretches (start, stop), sorted; they may overlap.
    """
    heads, spans = find_overlaps(documents, benchmark, window, gram)
    hits = spans.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("total")),
        lambda a, s: F.struct(
            F.greatest(a["reach"], s["stop"]).alias("reach"),
            (a["total"] + F.greatest(s["stop"] - F.greatest(a["reach"], s["start"]), F.lit(0))).alias("total"),
        ),
        lambda a: a["total"],
    )
    hits = hits.withColumn("n_hit", covered)
    return heads.join(hits, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The documents, columns as they are, without those that share a window."""
    heads, spans = find_overlaps(documents, benchmark, window, gram, keyed=True)
    hit = heads.join(spans.select("row").distinct(), "row").select(
        F.col("id").alias("__id"), F.col("digest").alias("__digest")
    )
    # A hit text is not null, so its digest is not.
    hit = kept(hit.distinct(), "contaminated")
    return documents.join(
        hit,
        (text_key(documents["text"]) == F.col("__digest")) & documents["doc_id"].eqNullSafe(F.col("__id")),
        "left_anti",
    )
