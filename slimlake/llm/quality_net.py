"""Quality classifier: a convolutional network over bytes, in numpy.

Input symbols are the text's bytes, twice 256 of them: the second set stands for the
bytes of a word that repeats the word before it, which a narrow filter could not see.
Filters of ``WIDTH`` symbols run over the whole text. The text is cut into overlapping
chunks of ``CHUNK`` symbols that cover all of it; every filter keeps its largest answer
in each chunk, and the mean and the maximum over the chunks go to a logistic unit. The
score depends on the text alone.

The net is fitted on the driver from at most ``per_class`` labelled texts of either
label, taken in the order of a digest of their ids; a sampled text longer than
``sample_bytes`` gives that many bytes in pieces spread over it, cut out by the tasks
before they reach the driver. Where one label is
sampled more thinly than the other, the last bias is moved back by the log ratio, so
that a score means the same whatever the sample's size. The weights are a few
hundred kilobytes and are broadcast. Scoring reads every whole text in bounded pieces
(one text is never split) and shuffles nothing.

Defined cases: null and empty texts have one chunk without symbols and get the score
that the net gives to no answer at all. Without labels of both kinds every score is the
share of label 1 (0 without labels). Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import bounded_batches
from slimlake.llm.lanes import SPACED, Words, pieces, spread, text_bytes
from slimlake.llm.toxicity import _Adagrad, sample_labelled, unsampled_bias

SYMBOLS = 512
NOTHING = SYMBOLS
DIMENSION = 8
FILTERS = 8
WIDTH = 5
BLOCK = 64
BLOCKS = 8
STRIDE = 7
CHUNK = BLOCK * BLOCKS


@dataclass
class ByteNet:
    """Weights: a row per symbol, filter taps, and the unit over mean and maximum."""

    rows: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    last: np.ndarray
    last_bias: float

    @classmethod
    def fresh(cls, seed: int, share: float) -> ByteNet:
        rng = np.random.default_rng(seed)
        rows = rng.normal(0, 0.5, (SYMBOLS + 1, DIMENSION)).astype(np.float32)
        rows[NOTHING] = 0
        return cls(
            rows,
            rng.normal(0, 0.3, (WIDTH, DIMENSION, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, dtype=np.float32),
            (rng.choice([-0.3, 0.3], 2 * FILTERS)).astype(np.float32),
            float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0,
        )

    def tables(self) -> np.ndarray:
        """Each tap's answer to each symbol."""
        return np.einsum("sd,wdf->wsf", self.rows, self.taps).astype(np.float32)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, each text filled up to whole blocks, and its bounds in blocks.

    A text takes at least one block, and at least ``WIDTH - 1`` empty symbols at its
    end, so that no filter reaches into the next one.
    """
    words = Words(data, offsets, SPACED)
    flags = np.zeros(len(data) + 1, dtype=np.int8)
    if len(words) > 1:
        of, hashes = words.text_of, words.hashes
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) + 1
        flags[words.starts[again]] = 1
        # Words do not touch within a text; at a border the next start overrides.
        np.add.at(flags, words.ends[again], -1)
    marked = np.cumsum(flags[:-1], dtype=np.int8) > 0
    lengths = np.diff(offsets)
    blocks = (lengths + WIDTH - 1 + BLOCK - 1) // BLOCK
    bounds = np.concatenate([[0], np.cumsum(blocks)])
    out = np.full(bounds[-1] * BLOCK, NOTHING, dtype=np.int64)
    place = np.repeat(bounds[:-1] * BLOCK, lengths) + spread(lengths)
    out[place] = data + 256 * marked.astype(np.int64)
    return out, bounds


def _answers(tables: np.ndarray, bias: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Answer of each filter at each symbol; none where a text has ended."""
    answer = np.take(tables[0], text, axis=0, mode="clip")
    answer += bias
    more = np.empty_like(answer)
    for step in range(1, WIDTH):
        np.take(tables[step], text[step:], axis=0, out=more[:-step], mode="clip")
        answer[:-step] += more[:-step]
    # Only a filter that starts beyond a text's end could reach into the next one.
    answer[text == NOTHING] = -np.inf
    return answer


def chunk_blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end block of each chunk, and the chunks' bounds by text."""
    blocks = np.diff(bounds)
    chunks = np.maximum(1, -(-(blocks - BLOCKS) // STRIDE) + 1)
    first = np.repeat(bounds[:-1], chunks) + STRIDE * spread(chunks)
    end = np.minimum(first + BLOCKS, np.repeat(bounds[1:], chunks))
    return first, end, np.concatenate([[0], np.cumsum(chunks)])


def _pool(best: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answers by chunk, 0 at least, and the chunks' bounds by text."""
    first, end, chunks = chunk_blocks(bounds)
    # One pair of borders per chunk; what lies between chunks is not used.
    edges = np.stack([first, end], axis=1).reshape(-1)
    padded = np.concatenate([best, np.full((1, best.shape[1]), -np.inf, dtype=best.dtype)])
    return np.maximum(np.maximum.reduceat(padded, edges, axis=0)[::2], 0), chunks


def _features(by_chunk: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(by_chunk, chunks[:-1], axis=0) / np.diff(chunks)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(by_chunk, chunks[:-1], axis=0)], axis=1)


def scores(net: ByteNet, data: np.ndarray, offsets: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0)
    text, bounds = symbols(data, offsets)
    answer = _answers(net.tables() if tables is None else tables, net.bias, text)
    best = answer.reshape(-1, BLOCK, FILTERS).max(axis=1)
    logit = (_features(*_pool(best, bounds)) @ net.last).astype(np.float64) + net.last_bias
    return 1 / (1 + np.exp(-logit))


def train(
    texts: list[bytes], labels: np.ndarray, visits: int = 16_000, batch: int = 32, seed: int = 11
) -> ByteNet:
    """Fit the net by gradient descent; in each chunk only largest answers get slopes.

    The texts are gone through until ``visits`` of them were seen, however few they are.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    net = ByteNet.fresh(seed, share)
    if not 0 < share < 1:
        net.last[:] = 0
        net.last_bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return net
    rng = np.random.default_rng(seed)
    step_rows, step_taps = _Adagrad(net.rows.shape, 0.05), _Adagrad(net.taps.shape, 0.05)
    step_bias, step_last = _Adagrad(net.bias.shape, 0.05), _Adagrad(net.last.shape, 0.05)
    for _ in range(-(-visits // len(labels))):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            own = [texts[c] for c in chosen]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
            text, bounds = symbols(np.frombuffer(b"".join(own), dtype=np.uint8), offsets)
            answer = _answers(net.tables(), net.bias, text).reshape(-1, BLOCK, FILTERS)
            spot = answer.argmax(axis=1)
            best = np.take_along_axis(answer, spot[:, None, :], axis=1)[:, 0]
            spot += (np.arange(len(spot)) * BLOCK)[:, None]
            by_chunk, chunks = _pool(best, bounds)
            features = _features(by_chunk, chunks)
            logit = features @ net.last + net.last_bias
            slope = ((1 / (1 + np.exp(-logit)) - labels[chosen]) / len(chosen)).astype(np.float32)
            step_last.dense(net.last, features.T @ slope)
            net.last_bias -= 0.05 * float(slope.sum())
            # Slope at each chunk's answers: its part of the mean, and the first maximum's.
            doc = np.repeat(np.arange(len(chosen)), np.diff(chunks))
            into = (slope / np.diff(chunks))[doc][:, None] * net.last[None, :FILTERS]
            top = (by_chunk == features[doc][:, FILTERS:]) & (by_chunk > 0)
            ties = np.add.reduceat(top, chunks[:-1], axis=0)[doc]
            into = into + top * slope[doc][:, None] * net.last[None, FILTERS:] / np.maximum(ties, 1)
            into *= by_chunk > 0
            chunk, which = np.nonzero(into)
            grad = into[chunk, which].astype(np.float32)
            first, end, _ = chunk_blocks(bounds)
            reach = np.minimum(first[chunk][:, None] + np.arange(BLOCKS)[None, :], end[chunk][:, None] - 1)
            block = reach[np.arange(len(chunk)), best[reach, which[:, None]].argmax(axis=1)]
            at = spot[block, which]
            change, touched, slopes = np.zeros_like(net.taps), [], []
            for step in range(WIDTH):
                inside = at + step < len(text)
                symbol, g, f = text[at[inside] + step].astype(np.int64), grad[inside], which[inside]
                np.add.at(change[step].T, f, net.rows[symbol] * g[:, None])
                real = symbol != NOTHING
                touched.append(symbol[real])
                slopes.append((net.taps[step][:, f].T * g[:, None])[real])
            step_taps.dense(net.taps, change)
            step_bias.dense(net.bias, np.bincount(which, weights=grad, minlength=FILTERS).astype(np.float32))
            if len(np.concatenate(touched)):
                step_rows.sparse(net.rows, np.concatenate(touched), np.concatenate(slopes))
    return net


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    label: str = "quality",
    per_class: int = 2000,
    sample_bytes: int = 1 << 14,
) -> ByteNet:
    """Fit on the labelled rows that ``learn`` allows."""
    sample = sample_labelled(documents, labels, label, learn, per_class, [], sample_bytes)
    texts = [bytes(t) for t in sample["text"]]
    marks = sample["label"].to_numpy(dtype=np.int64)
    net = train(texts, marks)
    net.last_bias += unsampled_bias(marks, sample["stands_for"].to_numpy())
    return net


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        tables = net.tables()
        for batch in batches:
            found = [np.zeros(0)]
            for piece in pieces(batch, "__text", 1 << 17):
                found.append(scores(net, *text_bytes(piece.column("__text")), tables))
            place = batch.schema.get_field_index("__text")
            yield pa.RecordBatch.from_arrays(
                [*(c for k, c in enumerate(batch.columns) if k != place), pa.array(np.concatenate(found))],
                [*(n for k, n in enumerate(batch.schema.names) if k != place), "score"],
            )

    return score


def score_texts(documents: DataFrame, net: ByteNet, columns: list[str]) -> DataFrame:
    """``columns`` of each row and the score of its whole text, without a shuffle."""
    spark = documents.sparkSession
    bounded_batches(spark)
    chosen = documents.select(
        *[F.col(f"`{c}`") for c in columns if c != "score"], F.col("text").alias("__text")
    )
    schema = chosen.drop("__text").schema.add("score", "double")
    return chosen.mapInArrow(_scorer(spark.sparkContext.broadcast(net)), schema)
