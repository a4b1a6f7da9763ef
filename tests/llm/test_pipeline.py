"""The pipeline's stages against what each may and must keep."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from slimlake.llm import queries
from tests.llm import shared
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_near_duplicates import brute as links
from tests.llm.test_sharding import check as check_shards

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage, over the whole small table."""
    docs = spark.read.parquet(f"{shared.SF}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, shared.SF).cache()
        found[name] = docs.collect(), after.collect(), docs.columns == after.columns
        docs = after
    return found


def keyed(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages_and_columns(steps):
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert [same for _, _, same in steps.values()] == [True, True, True, True, False]
    for before, after, _ in list(steps.values())[:3]:
        assert not keyed(after) - keyed(before)


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    before, after, _ = steps["toxicity"]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{shared.SF}/labels.parquet").collect()}
    stay = {r["doc_id"] for r in after}
    marked = [r["doc_id"] for r in before if r["doc_id"] in toxic]
    assert sum(toxic[i] == (i not in stay) for i in marked) > 0.97 * len(marked)


def test_one_of_each_group_stays(steps):
    before, after, _ = steps["near_duplicates"]
    classes = {row[1] for row in links([(r["doc_id"], r["text"]) for r in before])}
    assert sorted(r["doc_id"] for r in after) == sorted(classes)


def test_contaminated_documents_go(spark, steps):
    before, after, _ = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{shared.SF}/benchmark.parquet").collect()]
    hit = overlaps([(r["doc_id"], r["text"]) for r in before], items)
    assert sorted(r["doc_id"] for r in after) == sorted(k[0] for k in hit if not k[4])


def test_mixed_documents_come_whole_and_at_most_twice(steps):
    before, after, _ = steps["mixing"]
    once, mixed = keyed(before), keyed(after)
    assert set(mixed) <= set(once) and all(n <= 2 * once[k] for k, n in mixed.items())
    size = {True: 0, False: 0}
    for rows, done in ((before, False), (after, True)):
        size[done] = sum(len((r["text"] or "").split()) for r in rows)
    assert size[True] == pytest.approx(1.5 * size[False], rel=0.1)


def test_every_row_of_the_mix_has_a_place(steps):
    before, after, _ = steps["sharding"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
    rows = [r.asDict() | {"digest": texts[r["doc_id"]]} for r in after]
    check_shards(rows, [r["text"] for r in before], corpus_pipeline.SHARDS)


def test_run_gives_the_same(spark, steps):
    rows = corpus_pipeline.run(spark, shared.SF)
    assert sorted(map(str, rows.collect())) == sorted(map(str, steps["sharding"][1]))


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_and_no_rows(spark, name):
    docs = shared.odd_documents(spark)
    found = STAGES[name](spark, docs, shared.SF)
    assert found.count() > 0
    if name != "sharding":
        assert found.columns == docs.columns
    assert STAGES[name](spark, shared.no_documents(spark), shared.SF).collect() == []


def test_every_query_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
