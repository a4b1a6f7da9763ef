from __future__ import annotations

import math

import numpy as np
import pytest

from slimlake.llm import queries, whitening
from tests.llm import shared

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "n", "c", 0) for i, v in rows], SCHEMA)


def plain(rows):
    """n, sums, and by falling eigenvalue the components of the distinct whole vectors."""
    good = [v for _, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in good}))
    centred = (len(x) * x - x.sum(axis=0)) / len(x)
    values, components = np.linalg.eigh(centred.T @ centred / len(x))
    return len(x), x.sum(axis=0), values[::-1], components[:, ::-1]


def check(spark, rows, components=16):
    found = whitening.whole_vectors(vectors(spark, rows).repartition(3))
    fitted = whitening.fit(found, components)
    n, sums, values, vectors_ = plain(rows)
    count = min(components, int((values > 1e-20 * values[0]).sum()))
    assert fitted.n == n and fitted.sums.tolist() == sums.tolist()
    assert len(fitted.eigenvalues) == count
    np.testing.assert_allclose(fitted.eigenvalues, values[:count], rtol=1e-10)
    assert math.isclose(fitted.trace, values.sum(), rel_tol=1e-12) and fitted.identity_error < 1e-9
    got = {}
    for row in whitening.whiten(found, fitted, ["vec_id"]).collect():
        got.setdefault(row.vec_id, []).append(row)
    for i, v in rows:
        if v is None or not all(c is not None and math.isfinite(c) for c in v):
            assert i not in got or any(j == i and w is not v for j, w in rows)
            continue
        x = np.array([math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v])
        mine = got[i][:count]
        assert {r.component for r in got[i]} == set(range(1, count + 1))
        assert all(int(r.deviation) == int(((n * x.astype(object) - sums) ** 2).sum()) for r in mine)
    return fitted, values, vectors_, got


def test_components_are_those_of_the_covariance(spark):
    draw = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(0, [3, 2, 1, 0.5, 0.4, 0.3], (300, 6)))]
    fitted, values, components, got = check(spark, rows)
    for k in range(6):
        assert abs(abs(fitted.components[:, k] @ components[:, k]) - 1) < 1e-12
    n, sums = fitted.n, fitted.sums
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows])
    whole = (x - sums / n) @ fitted.components / np.sqrt(fitted.eigenvalues)
    for i, _ in rows:
        for r in got[i]:
            assert math.isclose(r.whitened, whole[i, r.component - 1], rel_tol=1e-8, abs_tol=1e-8)
            assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-10)


def test_awkward_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(0, 1, (40, 5)))]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [math.nan] * 5), (103, [1.0, 2.0, math.inf, 0.0, 0.0])]
    # A third of all rows are one vector; some are equal only as whole numbers.
    rows += [(200 + i, [0.5, -0.25, 0.0, 1e-3, -0.0]) for i in range(20)] + [(300, [0.5, -0.25, 0.0, 2e-3, 0.0])]
    rows += [(None, [3.0, 0.0, 0.0, 0.0, 0.0]), (400, rows[3][1]), (400, rows[3][1])]
    check(spark, rows)


def test_equal_eigenvalues_are_found_as_often_as_they_occur(spark):
    unit = np.eye(40)[:24]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([unit, -unit]))]
    fitted, *_ = check(spark, rows)
    assert len(fitted.eigenvalues) == 16
    np.testing.assert_allclose(fitted.components.T @ fitted.components, np.eye(16), atol=1e-12)


def test_steps_end_early_where_few_components_stand_out(spark):
    draw = np.random.default_rng(5)
    scale = np.array([50.0, 40.0, 30.0] + [0.5] * 57)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(0, scale, (500, 60)))]
    fitted, *_ = check(spark, rows, components=2)
    assert fitted.steps < 55


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_without_two_distinct_vectors_there_are_no_components(spark, rows):
    found = whitening.whole_vectors(vectors(spark, rows))
    assert whitening.whiten(found, whitening.fit(found), ["vec_id"]).count() == 0


def test_two_vectors_and_carried_columns(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (2, [1.0, 3.0, 0.0])]
    found = whitening.whole_vectors(vectors(spark, rows))
    got = whitening.whiten(found, whitening.fit(found), ["vec_id", "n", "label"]).orderBy("vec_id").collect()
    assert [(r.vec_id, r.label, r.component, r.n, r.deviation) for r in got] == [(1, 0, 1, 2, 4096), (2, 0, 1, 2, 4096)]
    assert sorted(r.whitened for r in got) == pytest.approx([-1, 1])


def test_deviations_beyond_64_bits_stay_exact():
    fitted = whitening.Whitening(3, np.array([4, 5]), np.zeros((2, 0)), np.zeros(0), 0.0, 0.0, 0)
    far = np.array([[1 << 40, -(1 << 41)], [1, 2]])
    want = [(3 * a - 4) ** 2 + (3 * b - 5) ** 2 for a, b in far.tolist()]
    assert [int(d) for d in whitening._deviations(far, fitted).to_pylist()] == want


def test_ragged_vectors_and_huge_entries_are_errors(spark):
    with pytest.raises(ValueError, match="entries"):
        whitening.fit(whitening.whole_vectors(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])])))
    with pytest.raises(Exception, match="too large"):
        whitening.fit(whitening.whole_vectors(vectors(spark, [(1, [1e30]), (2, [1.0])])))


def test_the_query_against_a_dense_solver(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{shared.SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, sums, values, components = plain(table)
    got = queries.op12_whitening(spark, shared.SF).toPandas()
    assert len(got) == 16 * len(table) and set(got["n"]) == {n}
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in table])
    centred = (n * x - sums) / n
    order = {i: k for k, (i, _) in enumerate(table)}
    for k in range(16):
        part = got[got["component"] == k + 1].sort_values("vec_id", key=lambda s: s.map(order))
        want = centred @ components[:, k] / np.sqrt(values[k])
        sign = np.sign(want @ part["whitened"].to_numpy())
        np.testing.assert_allclose(part["whitened"], sign * want, atol=1e-7)
        np.testing.assert_allclose(part["explained"], values[k] / values.sum(), rtol=1e-9)
    assert got["identity_error"].max() < 1e-9
    assert got["deviation"].max() == int(((n * x.astype(object) - sums) ** 2).sum(axis=1).max())
