"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

An entry c counts as the whole number floor(64 c) + 1,000,000, so equal vectors are
equal exactly. The fit list is each distinct vector once. With X its centred rows, the
bidiagonalisation alternates u = Xv and v = X'u, each made orthogonal to all before it,
and gives X V = U B with a bidiagonal B as small as the number of steps. The singular
values of B are the deviations (times the root of n) and V times its right vectors the
components.

The list stays in Spark as blocks of rows, and each step is one pass over it. A left
vector, as long as the list, is never kept: it is X p for a p as short as an embedding,
and every pass forms U = X P anew, block by block. Of a pass the tasks return the sums
U'u, u'u and X'u, which a groupBy adds up; the driver holds matrices of at most
dimensions x steps. A pass is repeated where orthogonalising took most of u.

Steps end when the wanted singular values stand (their residuals are at rounding level)
and a further chain, begun in a random direction orthogonal to V, has found none that
belongs among them: so values that occur more than once are found as often. A chain
that meets an invariant subspace is followed by a new one in the same way. At the latest
they end when V is full, and everything is exact then.

Defined cases: vectors that are null or have null or non-finite entries are left out.
Vectors of differing lengths, and entries of 2**40 or more, are errors. Components whose
deviation is below ``FLAT`` of the largest are not there; with fewer than two distinct
vectors there are none, and no rows. Repeated rows are one vector of the list and give a
row each. Carried columns give way to those of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimlake.llm.common import bounded_batches, kept

STEPS_IN_ONE = 64
SHIFT = 1_000_000
#: Entries in a block of rows: four megabytes.
BLOCK = 1 << 19
#: Relative to the largest singular value: what counts as converged, and as none.
STANDS = 32 * np.finfo(float).eps
FLAT = 1e-12


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is complete and finite, with ``x``, its whole numbers."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def whole(c):
        steps = F.floor(c.cast("double") * STEPS_IN_ONE) + SHIFT
        huge = F.raise_error(F.lit("an entry of a vector is too large")).cast("long")
        return F.when(F.abs(c) < float(1 << 40), steps).otherwise(huge)

    return rows.where(~bad).withColumn("x", F.transform(column, whole))


@dataclass
class Whitening:
    """The fit list's size and sums, and its components by falling deviation."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    steps: int

    @property
    def low(self) -> np.ndarray:
        """The mean, rounded down."""
        return self.sums // max(self.n, 1)

    @property
    def rest(self) -> np.ndarray:
        """What the mean has beyond ``low``, in n-ths."""
        return self.sums - self.n * self.low


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0))
        size = max(1, BLOCK // max(1, x.shape[1]))
        for at in range(0, len(x), size):
            part = np.ascontiguousarray(x[at : at + size])
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], type=pa.binary())], ["block"])


class _Blocks:
    """The fit list as written blocks, and sums over it."""

    def __init__(self, rows: DataFrame):
        bounded_batches(rows.sparkSession)
        sizes = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
        if sizes[0] != sizes[1]:
            raise ValueError(f"vectors have from {sizes[0]} to {sizes[1]} entries")
        self.dims = sizes[0] or 0
        self.table = None
        if self.dims:
            blocks = rows.select("x").distinct().mapInArrow(_block, "block binary")
            # In memory where there is room; a lost executor's part is read from the table.
            self.table = kept(blocks, "whitening-blocks").persist(StorageLevel.MEMORY_AND_DISK)

    def add_up(self, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
        """The sum of ``of`` over all blocks; a task returns one array, whatever it reads."""
        dims = self.dims

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for content in batch.column(0):
                    part = of(np.frombuffer(content.as_buffer(), dtype=np.int64).reshape(-1, dims))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["slot", "value"])

        parts = self.table.mapInArrow(work, f"slot long, value {kind}")
        found = parts.groupBy("slot").agg(F.sum("value").alias("value")).toPandas().sort_values("slot")
        return found["value"].to_numpy()

    def close(self) -> None:
        if self.table is not None:
            self.table.unpersist()


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]],
    dims: int,
    wanted: int,
    scale: float,
    seed: int = 0,
) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest singular values of X, their right vectors, and the steps taken.

    ``product(q, P)`` gives (XP)'Xq, the square of Xq's length and X'Xq. ``scale`` is of
    the size of X, below whose rounding nothing counts.
    """
    draw = np.random.default_rng(seed)
    none = scale * dims * np.finfo(float).eps
    fresh = draw.standard_normal(dims)
    right = (fresh / np.linalg.norm(fresh))[:, None]
    lefts, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    alphas, betas, begun = [], [], 0
    while True:
        # u = Xv - beta u_before, in terms of embeddings; orthogonal to all before it.
        q = right[:, -1] - (betas[-1] * lefts[:, -1] if betas else 0)
        for _ in range(3):
            along, square, image = product(q, lefts)
            left_over = square - along @ along
            q, image = q - lefts @ along, image - images @ along
            if left_over > square / 2 or left_over <= none**2:
                break
        alpha = np.sqrt(max(left_over, 0.0))
        if alpha <= none:
            alpha, q, image = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            q, image = q / alpha, image / alpha
        alphas.append(float(alpha))
        lefts, images = np.column_stack([lefts, q]), np.column_stack([images, image])
        steps = len(alphas)
        # v = X'u - alpha v_before, orthogonal to all before it.
        after = _orthogonal(image - alpha * right[:, -1], right)
        beta = float(np.linalg.norm(after))
        turn, values, _ = np.linalg.svd(_bidiagonal(alphas, betas))
        stands = STANDS * max(values[0], scale * np.finfo(float).eps)
        done = steps == dims
        if not done and (beta <= none or (beta * np.abs(turn[-1, :wanted]) <= stands).all()):
            # Nothing wanted changes any more in this chain; has it brought something?
            own, own_values, _ = np.linalg.svd(_bidiagonal(alphas[begun:], betas[begun:]))
            least = values[wanted - 1] if len(values) >= wanted else 0.0
            ended = beta <= none or beta * abs(own[-1, 0]) <= stands
            if begun and ended and own_values[0] < least * (1 - 1e-9):
                done = True
            elif ended or not begun:
                beta, begun = 0.0, steps
                after = _orthogonal(draw.standard_normal(dims), right)
        if done:
            break
        betas.append(beta)
        right = np.column_stack([right, after / np.linalg.norm(after)])
    _, values, rows = np.linalg.svd(_bidiagonal(alphas, betas))
    return values, right @ rows.T, steps


def fit(rows: DataFrame, components: int = 16, seed: int = 0) -> Whitening:
    """The whitening of the distinct vectors in ``x``."""
    blocks = _Blocks(rows)
    try:
        return _fit(blocks, components, seed)
    finally:
        blocks.close()


def _fit(blocks: _Blocks, components: int, seed: int) -> Whitening:
    dims = blocks.dims
    found = Whitening(0, np.zeros(dims, dtype=np.int64), np.zeros((dims, 0)), np.zeros(0), 0.0, 0.0, 0)
    if not dims:
        return found
    counted = blocks.add_up(lambda x: np.append(x.sum(axis=0), len(x)), "long")
    found.n, found.sums = int(counted[-1]), counted[:-1].astype(np.int64)
    low, rest = found.low, found.rest / found.n

    def centre(x: np.ndarray) -> np.ndarray:
        return (x - low).astype(float) - rest

    square = float(blocks.add_up(lambda x: np.array([np.square(centre(x)).sum()]))[0])
    found.trace = square / found.n
    if not square:
        return found

    def product(q: np.ndarray, lefts: np.ndarray):
        def of(x: np.ndarray) -> np.ndarray:
            x = centre(x)
            u = x @ q
            return np.concatenate([(x @ lefts).T @ u, [u @ u], x.T @ u])

        sums, k = blocks.add_up(of), lefts.shape[1]
        return sums[:k], float(sums[k]), sums[k + 1 :]

    values, vectors, found.steps = bidiagonalise(product, dims, min(components, dims), np.sqrt(square), seed)
    values = values[:components]
    values = values[values > FLAT * values[0]]
    found.eigenvalues = values**2 / found.n
    chosen = vectors[:, : len(values)]
    # Either sign will do; this one does not depend on the start.
    largest = np.abs(chosen).argmax(axis=0)
    found.components = chosen * np.sign(chosen[largest, np.arange(len(values))])
    projection = found.components / np.sqrt(found.eigenvalues)

    def moments(x: np.ndarray) -> np.ndarray:
        y = centre(x) @ projection
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    sums, k = blocks.add_up(moments) / found.n, len(values)
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    found.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return found


def _deviations(x: np.ndarray, fitted: Whitening) -> pa.Array:
    """Exact sums of (n x - S) ** 2."""
    far = x - fitted.low
    if fitted.n * (float(np.abs(far).max(initial=0)) + 1) * np.sqrt(x.shape[1] + 1) < 2.0**31:
        whole = (fitted.n * far - fitted.rest) ** 2
        return pa.array(whole.sum(axis=1)).cast(pa.decimal128(38))
    far = far.astype(object) * fitted.n - fitted.rest.astype(object)
    return pa.array([Decimal(int(v)) for v in (far * far).sum(axis=1)], type=pa.decimal128(38))


def whiten(rows: DataFrame, fitted: Whitening, columns: list[str]) -> DataFrame:
    """A row for each row and component: ``columns``, component (from 1), n, deviation,
    whitened, explained and identity_error."""
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    carried = [c for c in columns if c not in made]
    chosen = rows.select(*[F.col(f"`{c}`") for c in carried], F.col("x").alias("__x"))
    schema = chosen.drop("__x").schema
    for name, kind in zip(made, ("integer", "long", "decimal(38,0)", "double", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    count = len(fitted.eigenvalues)
    projection = fitted.components / np.sqrt(fitted.eigenvalues)
    explained = fitted.eigenvalues / (fitted.trace or 1.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = _matrix(batch.column(batch.num_columns - 1))
            centred = (x - fitted.low).astype(float) - fitted.rest / fitted.n
            n, each = len(x), np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    *(column.take(pa.array(each)) for column in batch.columns[:-1]),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)),
                    pa.array(np.full(len(each), fitted.n)),
                    _deviations(x, fitted).take(pa.array(each)),
                    pa.array((centred @ projection).ravel()),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(len(each), fitted.identity_error)),
                ],
                schema.names,
            )

    bounded_batches(rows.sparkSession)
    return chosen.mapInArrow(work, schema)
