"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's vector is the sum of three rows of one hashed table: for the word and for its
first four and six bytes, so that inflected forms of a stem share most of it. Filters
of several widths run over neighbouring words, every filter keeps its largest answer in
the whole text, and a logistic unit combines these into the score. The score depends on
the text alone.

The model is fitted on the driver from at most ``per_class`` labelled texts of either
label, taken in the order of a digest of their ids; a sampled text longer than
``sample_bytes`` gives that many bytes in pieces spread over it, cut out by the tasks
before they reach the driver. Where one label is
sampled more thinly than the other, the last bias is moved back by the log ratio, so
that a score means the same whatever the sample's size. The weights, some
megabytes whatever the input, are broadcast. Scoring reads every whole text, each
text's answer is independent of the others, and nothing is shuffled.

Thresholds are calibrated by language on every labelled text that the net has not seen:
a sixth of the sample and all that was not sampled. They are scored whole, like any
other, and counted in ``BINS`` bins of the score. For each language the cut that
separates its labels best is taken, drawn towards the common one where labels are few.
They decide what is rejected and are no input of the score. Texts without a label are
passed over by a bit table of ids, so only labelled ones are scored twice.

Words: A-Z lower-cased, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. Defined cases: null
and empty texts have no words and get the score that the net gives to no answer at
all. A language without labels, or null, has the common threshold. Without labels of
both kinds every score is the share of label 1 (0 without labels). Repeated rows each
give a row. A column asked for under the name ``score`` gives way to the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import bounded_batches
from slimlake.llm.lanes import LOWER, PLAIN, Words, mix, pieces, text_bytes

TABLE = 1 << 16
DIMENSION = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
#: A power of two, so that borders of bins are exact.
BINS = 4096


@dataclass
class WordNet:
    """Weights: hashed rows, filters by width and tap, their biases, the last unit."""

    rows: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    last: np.ndarray
    last_bias: float

    @classmethod
    def fresh(cls, seed: int, share: float) -> WordNet:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.05, (TABLE, DIMENSION)).astype(np.float32),
            [rng.normal(0, 0.5, (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
            np.full(FILTERS * len(WIDTHS), 0.5, dtype=np.float32),
            float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0,
        )


def word_rows(words: Words) -> np.ndarray:
    """Rows of the hashed table for each word: itself and its prefixes."""
    found = [words.hashes % np.uint64(TABLE)]
    for length in PREFIXES:
        prefix = words.prefix_hashes(length)
        found.append(mix(prefix, length) % np.uint64(TABLE))
    return np.stack(found, axis=1).astype(np.int32)


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of the words of several texts, and the texts' bounds among them."""
    words = Words(LOWER[data], offsets, PLAIN)
    return word_rows(words), words.bounds


def sample_words(texts: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """``text_words`` of many texts, found a megabyte at a time."""
    found, counts, low, size = [np.zeros((0, 1 + len(PREFIXES)), dtype=np.int32)], [np.zeros(0, dtype=np.int64)], 0, 0
    for high, text in enumerate(texts, 1):
        size += len(text)
        if size >= limit or high == len(texts):
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[low:high]])]).astype(np.int64)
            rows, bounds = text_words(np.frombuffer(b"".join(texts[low:high]), dtype=np.uint8), offsets)
            found.append(rows)
            counts.append(np.diff(bounds))
            low, size = high, 0
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def select_texts(rows: np.ndarray, bounds: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bounds of some of the texts."""
    counts = np.diff(bounds)
    return rows[np.repeat(use, counts)], np.concatenate([[0], np.cumsum(counts[use])])


def _answers(net: WordNet, vectors: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """What each filter answers at each word; words beyond a text's end count as zero."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = []
    for taps, bias in zip(net.filters, net.biases):
        answer = vectors @ taps[0] + bias
        for step in range(1, len(taps)):
            same = (text[step:] == text[:-step])[:, None]
            answer[: len(vectors) - step] += (vectors[step:] @ taps[step]) * same
        found.append(answer)
    return found


def pooled(net: WordNet, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest answer of each filter in each text, 0 at least."""
    best = np.zeros((len(bounds) - 1, len(net.last)), dtype=np.float32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        vectors = net.rows[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            vectors += net.rows[rows[:, k]]
        answers = np.concatenate(_answers(net, vectors, bounds), axis=1)
        best[some] = np.maximum(np.maximum.reduceat(answers, bounds[some], axis=0), 0)
    return best


def scores(net: WordNet, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    logit = (pooled(net, rows, bounds) @ net.last).astype(np.float64) + net.last_bias
    return 1 / (1 + np.exp(-logit))


class _Adagrad:
    """Steps that shrink for weights that have moved much."""

    def __init__(self, shape, rate: float):
        self.sums, self.rate = np.full(shape, 1e-3, dtype=np.float32), rate

    def dense(self, weight: np.ndarray, slope: np.ndarray) -> None:
        self.sums += slope**2
        weight -= self.rate * slope / np.sqrt(self.sums)

    def sparse(self, weight: np.ndarray, at: np.ndarray, slope: np.ndarray) -> None:
        rows, inverse = np.unique(at, return_inverse=True)
        total = np.zeros((len(rows), slope.shape[1]), dtype=np.float32)
        np.add.at(total, inverse, slope)
        self.sums[rows] += total**2
        weight[rows] -= self.rate * total / np.sqrt(self.sums[rows])


def train(
    rows: np.ndarray, bounds: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 32, seed: int = 7
) -> WordNet:
    """Fit the net to labelled texts by gradient descent; only largest answers get slopes."""
    share = float(labels.mean()) if len(labels) else 0.0
    net = WordNet.fresh(seed, share)
    if not 0 < share < 1:
        net.rows[:] = 0
        net.last_bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return net
    rng = np.random.default_rng(seed)
    step_rows = _Adagrad(net.rows.shape, 0.1)
    step_filters = [_Adagrad(w.shape, 0.03) for w in net.filters]
    step_biases = [_Adagrad(b.shape, 0.03) for b in net.biases]
    step_last = _Adagrad(net.last.shape, 0.03)
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            counts = bounds[chosen + 1] - bounds[chosen]
            at = np.concatenate([np.arange(bounds[c], bounds[c + 1]) for c in chosen])
            own = np.concatenate([[0], np.cumsum(counts)])
            used = rows[at]
            vectors = net.rows[used].sum(axis=1)
            answers = np.concatenate(_answers(net, vectors, own), axis=1)
            best = np.zeros((len(chosen), len(net.last)), dtype=np.float32)
            where = np.zeros(best.shape, dtype=np.int64)
            for i in np.flatnonzero(counts):
                part = answers[own[i] : own[i + 1]]
                where[i] = part.argmax(axis=0)
                best[i] = part[where[i], np.arange(part.shape[1])]
                where[i] += own[i]
            alive = best > 0
            best = np.maximum(best, 0)
            logit = best @ net.last + net.last_bias
            slope = ((1 / (1 + np.exp(-logit)) - labels[chosen]) / len(chosen)).astype(np.float32)
            into = slope[:, None] * net.last[None, :] * alive
            step_last.dense(net.last, best.T @ slope)
            net.last_bias -= 0.05 * float(slope.sum())
            touched, slopes = [], []
            for k, (taps, bias) in enumerate(zip(net.filters, net.biases)):
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                doc, which = np.nonzero(into[:, mine])
                grad = into[:, mine][doc, which]
                spot = where[:, mine][doc, which]
                change = np.zeros_like(taps)
                for step in range(len(taps)):
                    inside = spot + step < own[doc + 1]
                    word, g, f = spot[inside] + step, grad[inside], which[inside]
                    np.add.at(change[step].T, f, vectors[word] * g[:, None])
                    touched.append(used[word])
                    slopes.append(taps[step][:, f].T * g[:, None])
                bias_slope = np.bincount(which, weights=grad, minlength=FILTERS).astype(np.float32)
                step_filters[k].dense(taps, change)
                step_biases[k].dense(bias, bias_slope)
            touched, slopes = np.concatenate(touched), np.concatenate(slopes)
            if len(touched):
                step_rows.sparse(net.rows, touched.reshape(-1), np.repeat(slopes, touched.shape[1], axis=0))
    return net


def best_threshold(score: np.ndarray, label: np.ndarray, stands_for: np.ndarray, width: float = 0.0) -> float:
    """The middle of the widest stretch of cuts with the best F1.

    Each score counts as often as it stands for; equal scores are never cut apart. A
    score may be the lower border of a bin of some ``width``.
    """
    score, place = np.unique(score, return_inverse=True)
    rows = np.bincount(place, weights=stands_for)
    positive = np.bincount(place, weights=stands_for * label)
    positives = positive.sum()
    kept_positives = positives - np.concatenate([[0], np.cumsum(positive)])
    chosen = rows.sum() - np.concatenate([[0], np.cumsum(rows)])
    f1 = 2 * kept_positives / np.maximum(chosen + positives, 1e-9)
    below, above = np.concatenate([[0.0], score + width]), np.concatenate([score, [1.0]])
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    widest = good[np.argmax((above - below)[good])]
    return float((below[widest] + above[widest]) / 2)


def calibrate(
    score: np.ndarray,
    label: np.ndarray,
    language: np.ndarray,
    weight: int = 20,
    texts: np.ndarray | None = None,
    stands_for: np.ndarray | None = None,
    width: float = 0.0,
) -> tuple[float, dict[str, float]]:
    """The common threshold and each language's, the latter shrunk to the former.

    Each row is so many ``texts``, which stand for so many labelled ones.
    """
    if not 0 < label.sum() < len(label):
        return 0.7, {}
    texts = np.ones(len(label), dtype=np.int64) if texts is None else texts
    stands_for = texts if stands_for is None else stands_for
    common = best_threshold(score, label, stands_for, width)
    by = {}
    for name in sorted({x for x in language if x is not None}):
        mine = language == name
        positives = int(texts[mine] @ label[mine])
        if 0 < positives < texts[mine].sum():
            own = best_threshold(score[mine], label[mine], stands_for[mine], width)
            by[name] = (positives * own + weight * common) / (positives + weight)
    return common, by


def spread_bytes(data: bytes, limit: int, parts: int = 16) -> bytes:
    """``limit`` bytes of a longer text, in pieces spread evenly over it."""
    if len(data) <= limit:
        return data
    size = limit // parts
    starts = np.linspace(0, len(data) - size, parts).astype(int)
    return b" ".join(data[s : s + size] for s in starts)


def labelled(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id and label of what may be used, one row per id.

    ``learn`` says, from the labels' doc_id, which may be used.
    """
    marks = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def _excerpts(limit: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = pa.array([spread_bytes(t.as_py().encode(), limit) for t in batch.column(place)], pa.binary())
            columns = [texts if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return cut


def sample_labelled(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    per_class: int,
    columns: list[str],
    sample_bytes: int,
) -> pd.DataFrame:
    """At most ``per_class`` texts of either label, in the order of a digest of their ids.

    ``text`` is the text's bytes, or ``sample_bytes`` of them and the seams in between.
    ``stands_for`` is how many labelled rows of its label each text stands for.
    """
    marks = labelled(labels, label, learn).withColumn("_order", F.md5(F.col("doc_id").cast("string")))
    found = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    parts = [
        marks.where(F.col("label") == value).orderBy("_order", "doc_id").limit(per_class) for value in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1])
    named = documents.select("doc_id", "text", *columns).where("doc_id IS NOT NULL AND text IS NOT NULL")
    # 2 * per_class ids at most.
    joined = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        *[F.min(F.struct("text", "label", *columns)).alias("_row")]
    )
    bounded_batches(documents.sparkSession)
    chosen = joined.select("doc_id", "_row.*")
    fields = [f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in chosen.schema]
    cut = chosen.mapInArrow(_excerpts(sample_bytes), ", ".join(fields))
    sample = cut.orderBy(F.md5(F.col("doc_id").cast("string"))).toPandas()
    stands_for = {value: max(1.0, count / per_class) for value, count in found.items()}
    return sample.assign(stands_for=sample["label"].map(stands_for).astype(float))


def unsampled_bias(label: np.ndarray, stands_for: np.ndarray) -> float:
    """What a logit learned from the sample lacks to hold for all labelled rows."""
    if not 0 < label.sum() < len(label):
        return 0.0
    return float(np.log(stands_for[label == 1][0] / stands_for[label == 0][0]))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    label: str = "toxic",
    per_class: int = 2500,
    sample_bytes: int = 1 << 15,
) -> tuple[WordNet, float, dict[str, float]]:
    """The net, the common threshold and those by language."""
    sample = sample_labelled(documents, labels, label, learn, per_class, ["lang"], sample_bytes)
    rows, bounds = sample_words([bytes(t) for t in sample["text"]])
    marks = sample["label"].to_numpy(dtype=np.int64)
    stands_for = sample["stands_for"].to_numpy()
    aside = np.arange(len(marks)) % 6 == 5
    own, used = select_texts(rows, bounds, ~aside)
    net = train(own, used, marks[~aside])
    net.last_bias += unsampled_bias(marks[~aside], stands_for[~aside])
    known = labelled(labels, label, learn)
    seen = documents.sparkSession.createDataFrame(
        [(i,) for i in sample["doc_id"][~aside].tolist()], known.select("doc_id").schema
    )
    # 2 * per_class ids at most.
    unseen = known.join(F.broadcast(seen), "doc_id", "left_anti")
    bins = score_bins(documents, unseen, net)
    mark, texts = bins["label"].to_numpy(dtype=np.int64), bins["texts"].to_numpy(dtype=np.int64)
    # The net has taken more of one label than of the other.
    left = np.bincount(mark, weights=texts, minlength=2)
    all_ = left + np.bincount(marks[~aside], minlength=2)
    each = all_ / np.maximum(left, 1)
    return net, *calibrate(
        bins["bin"].to_numpy() / BINS, mark, bins["lang"].to_numpy(dtype=object),
        texts=texts, stands_for=texts * each[mark], width=1 / BINS,
    )


def maybe_among(documents: DataFrame, ids: DataFrame, bits: int = 23) -> DataFrame:
    """The rows whose doc_id is in ``ids``, and few others, without a shuffle of texts."""
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    word = F.shiftright(hashed.bitwiseAND(F.lit((1 << bits) - 1)), 6)
    place = hashed.bitwiseAND(F.lit(63)).cast("int")
    table = ids.select(word.alias("__word"), place.alias("__place")).groupBy("__word").agg(
        F.bit_or(F.expr("shiftleft(1L, __place)")).alias("__bits")
    )
    # 2 ** (bits - 6) rows at most.
    hit = (word == F.col("__word")) & (F.getbit("__bits", place) == 1)
    return documents.join(F.broadcast(table), hit, "left_semi")


def score_bins(documents: DataFrame, marks: DataFrame, net: WordNet) -> pd.DataFrame:
    """lang, label, bin of the score, and the labelled whole texts there: ``BINS`` bins at most."""
    some = maybe_among(documents.where("doc_id IS NOT NULL AND text IS NOT NULL"), marks)
    place = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")
    scored = score_texts(some, net, ["doc_id", "lang"]).groupBy("doc_id", "lang", place).count()
    return scored.join(marks, "doc_id").groupBy("lang", "label", "bin").agg(F.sum("count").alias("texts")).toPandas()


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            found = [np.zeros(0)]
            for piece in pieces(batch, "__text", 1 << 20):
                found.append(scores(net, *text_words(*text_bytes(piece.column("__text")))))
            place = batch.schema.get_field_index("__text")
            yield pa.RecordBatch.from_arrays(
                [*(c for k, c in enumerate(batch.columns) if k != place), pa.array(np.concatenate(found))],
                [*(n for k, n in enumerate(batch.schema.names) if k != place), "score"],
            )

    return score


def score_texts(documents: DataFrame, net: WordNet, columns: list[str]) -> DataFrame:
    """``columns`` of each row and the score of its whole text, without a shuffle."""
    spark = documents.sparkSession
    bounded_batches(spark)
    chosen = documents.select(
        *[F.col(f"`{c}`") for c in columns if c != "score"], F.col("text").alias("__text")
    )
    schema = chosen.drop("__text").schema.add("score", "double")
    return chosen.mapInArrow(_scorer(spark.sparkContext.broadcast(net)), schema)


def threshold_of(language: Column, common: float, by: dict[str, float]) -> Column:
    found = F.lit(common)
    for name, value in by.items():
        found = F.when(language == name, F.lit(value)).otherwise(found)
    return found


def keep_clean(documents: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """The documents, columns as they are, without those at their language's threshold."""
    net, common, by = fit(documents, labels, learn)
    columns = documents.columns
    held = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), "text")
    scored = score_texts(held, net, ["__row"])
    keep = F.col("score") < threshold_of(F.col("__row.lang"), common, by)
    return scored.where(keep).select(*[F.col(f"__row.`{c}`") for c in columns])
