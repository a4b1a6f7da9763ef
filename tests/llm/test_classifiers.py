"""The two networks: held-out accuracy, whole texts, and awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from slimlake.llm import quality_net, queries, toxicity
from tests.llm import shared

FOLDER = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = query(spark, FOLDER).where("held_out").join(labels, "doc_id").toPandas()
    return rows["score"].to_numpy(), rows[label].to_numpy(), rows["predicted"].to_numpy()


def test_quality_is_learned(spark):
    score, label, predicted = held_out(spark, queries.op2_quality_classifier, "quality")
    assert auc(score, label) > 0.99 and (predicted == label).mean() > 0.97


def test_toxicity_is_learned(spark):
    score, label, predicted = held_out(spark, queries.op10_toxicity, "toxic")
    assert auc(score, label) > 0.94 and (predicted == label).mean() > 0.96


def fits(spark, docs, labels):
    learn = F.lit(True)
    yield quality_net.score_texts(docs, quality_net.fit(docs, labels, learn, label="mark"), ["doc_id", "score"])
    net, common, by = toxicity.fit(docs, labels, learn, label="mark")
    yield toxicity.score_texts(docs, net, ["doc_id", "score"])


@pytest.mark.parametrize("marks", [[(1, 1), (8, 0), (9, 0), (4, 1), (99, 1), (None, 1), (3, None)], [(1, 1)], []])
def test_odd_rows_and_labels(spark, marks):
    docs = shared.odd_documents(spark)
    labels = spark.createDataFrame(marks, "doc_id bigint, mark int")
    for scored in fits(spark, docs, labels):
        rows = [tuple(r) for r in scored.collect()]
        assert len(rows) == docs.count()
        # An input column called score gives way to the new one.
        assert all(len(r) == 2 and 0 <= r[1] <= 1 for r in rows)
    for scored in fits(spark, shared.no_documents(spark), labels):
        assert scored.collect() == []


def test_the_end_of_a_long_text_counts(spark):
    rows = [(i, " ".join(shared.prose(i, 40, 200)) + (" awful" if i % 2 else ""), "en", "a") for i in range(200)]
    long = " ".join(shared.prose(900, 40_000, 200))
    docs = shared.documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    net, _, _ = toxicity.fit(docs, labels, F.lit(True))
    ends = shared.documents(spark, [(1, long, "en", "a"), (2, long + " awful", "en", "a")])
    score = {r["doc_id"]: r["score"] for r in toxicity.score_texts(ends, net, ["doc_id"]).collect()}
    assert score[2] > score[1] + 0.5


def test_scores_do_not_depend_on_neighbours():
    texts = [b"one two two three", b"", "été | ### x".encode(), b"z" * 5000, b"w " * 700]
    net = quality_net.ByteNet.fresh(1, 0.5)
    words = toxicity.WordNet.fresh(1, 0.5)

    def both(chosen):
        data = np.frombuffer(b"".join(chosen), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in chosen])]).astype(np.int64)
        return quality_net.scores(net, data, offsets), toxicity.scores(words, *toxicity.text_words(data, offsets))

    together = both(texts)
    for i, text in enumerate(texts):
        for all_, one in zip(together, both([text])):
            assert all_[i] == pytest.approx(one[0], abs=1e-6)


def test_chunks_cover_the_text():
    for blocks in (1, 7, 8, 9, 15, 16, 100):
        first, end, _ = quality_net.chunk_blocks(np.array([0, blocks]))
        covered = {b for f, e in zip(first, end) for b in range(f, e)}
        assert covered == set(range(blocks)) and all(e - f <= quality_net.BLOCKS for f, e in zip(first, end))


def test_thresholds_by_language():
    score = np.array([0.1, 0.2, 0.8, 0.9] * 30)
    label = np.array([0, 0, 1, 1] * 30)
    language = np.array(["en"] * 60 + [None] * 60, dtype=object)
    common, by = toxicity.calibrate(score, label, language)
    assert 0.2 < common < 0.8 and list(by) == ["en"] and 0.2 < by["en"] < 0.8
    assert toxicity.calibrate(score, np.ones(120, dtype=int), language) == (0.7, {})


def test_keep_clean_drops_rejected_rows_only(spark):
    rows = [(i, " ".join(shared.prose(i, 30)) + (" awful" if i % 2 else ""), "en", "a") for i in range(200)]
    docs = shared.documents(spark, rows + [(500, None, None, None), (501, "", "de", None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    stay = toxicity.keep_clean(docs, labels, F.lit(True))
    assert stay.columns == docs.columns
    ids = {r["doc_id"] for r in stay.collect()}
    assert ids == {*range(0, 200, 2), 500, 501}


@pytest.mark.parametrize("per_class", [60, 1000])
def test_scores_keep_the_labels_shares_however_few_are_sampled(spark, per_class):
    # Nothing in the texts tells the labels apart: the score is the share of label 1.
    docs = shared.documents(spark, [(i, "all the same words", "en", "a") for i in range(600)])
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id bigint, mark int")
    net = quality_net.fit(docs, labels, F.lit(True), label="mark", per_class=per_class)
    words, _, _ = toxicity.fit(docs, labels, F.lit(True), label="mark", per_class=per_class)
    for scored in quality_net.score_texts(docs, net, []), toxicity.score_texts(docs, words, []):
        assert scored.first()["score"] == pytest.approx(1 / 6, abs=0.1)


def test_thresholds_count_what_a_text_stands_for():
    score, label = np.array([0.2, 0.4, 0.6, 0.6, 0.8]), np.array([0, 1, 0, 1, 1])
    even = toxicity.best_threshold(score, label, np.ones(5))
    thin = toxicity.best_threshold(score, label, np.where(label == 0, 9.0, 1.0))
    assert even == pytest.approx(0.3) and thin == pytest.approx(0.7)


def test_thresholds_come_from_every_text_the_net_has_not_seen(spark, monkeypatch):
    def text(i):
        return " ".join(shared.prose(i, 40, 200)) + (" awful" if i % 2 else "")

    docs = shared.documents(spark, [(i, text(i), "en" if i < 400 else "de", "a") for i in range(440)]).cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(440)], "doc_id bigint, toxic int")
    asked = []
    calibrate = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda *a, **b: asked.append((a, b)) or calibrate(*a, **b))
    net, common, by = toxicity.fit(docs, labels, F.lit(True), per_class=60)
    (_, label, language), more = asked[0]
    # 120 are sampled, 100 of which the net learns from.
    assert more["texts"].sum() == 340 and {"en", "de"} == set(language) == set(by)
    # Every label counts as often as it is given.
    assert np.bincount(label, weights=more["stands_for"]) == pytest.approx([220, 220])


def test_long_texts_are_calibrated_whole(spark):
    # 200 KB without a bad word but near the end, which an excerpt of the text leaves out.
    net = toxicity.WordNet.fresh(1, 0.5)
    body = " ".join(shared.prose(3, 30_000, 200))
    docs = shared.documents(spark, [(1, body, "en", "a"), (2, body + " awful", None, "a"), (3, "no label", "en", "a")])
    marks = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, label int")
    bins = toxicity.score_bins(docs, marks, net)
    whole = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, net, ["doc_id"]).collect()}
    found = {label: low for label, low in zip(bins["label"], bins["bin"])}
    assert bins["texts"].sum() == 2 and found == {k: int(whole[i] * toxicity.BINS) for k, i in ((0, 1), (1, 2))}


def test_bins_are_never_cut():
    score, label, texts = np.array([0.0, 0.25, 0.25, 0.75]), np.array([0, 0, 1, 1]), np.array([9, 5, 1, 7])
    assert toxicity.best_threshold(score, label, texts, 0.25) == pytest.approx(0.625)


def test_the_driver_gets_excerpts_of_long_texts(spark):
    texts = ["é" + " ".join(shared.prose(i, 20_000)) for i in range(4)] + ["short été", ""]
    docs = shared.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, mark int")
    sample = toxicity.sample_labelled(docs, labels, "mark", F.lit(True), 10, ["lang"], 1 << 12)
    found = {i: bytes(t) for i, t in zip(sample["doc_id"], sample["text"])}
    assert found == {i: toxicity.spread_bytes(t.encode(), 1 << 12) for i, t in enumerate(texts)}
    assert max(map(len, found.values())) < (1 << 12) + 16
