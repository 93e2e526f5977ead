"""Whitening of embeddings by the leading components of their covariance, which FEAST finds.

Spark makes the vectors whole numbers, takes each distinct one once, and sums their products exactly (whole numbers have no
order of summing); what is left for the driver is a matrix of the vectors' dimension. FEAST projects on the eigenvectors of
an interval by a contour integral: a quadrature over the circle through the interval's ends, each node of which is a solve
with the complex shifted covariance. A Rayleigh-Ritz step in the projected space gives the eigenpairs, and the projection
is done again from these until they stand. How many an interval must have is known from the inertia of the covariance
shifted to its ends, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, discard, settle

#: Most components.
COMPONENTS = 16
#: Entries are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Most eigenvalues of an interval, where a gap can be found to cut at.
INTERVAL = 8
#: Quadrature nodes on the upper half of a contour.
NODES = 8
#: Most rows of a matrix product, so that its whole sums stay exact; entries beyond ``MOST`` are an error.
BLOCK, MOST = 1024, 1 << 40


def inertia(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: the positive pivots of a - shift by Sylvester's law, with complete
    (Bunch-Parlett) pivoting in blocks of one and two."""
    m, above = a - shift * np.eye(len(a)), 0
    while len(m):
        n = len(m)
        diagonal, off = np.abs(np.diag(m)), np.abs(np.triu(m, 1))
        i = int(diagonal.argmax())
        r, s = divmod(int(off.argmax()), n)
        if diagonal[i] == 0 and off[r, s] == 0:
            return above
        if diagonal[i] >= 0.6404 * off[r, s]:
            keep = np.delete(np.arange(n), i)
            above += m[i, i] > 0
            m = m[np.ix_(keep, keep)] - np.outer(m[keep, i], m[i, keep]) / m[i, i]
        else:  # such a block has one positive and one negative eigenvalue
            keep, pair = np.delete(np.arange(n), [r, s]), [r, s]
            above += 1
            m = m[np.ix_(keep, keep)] - m[np.ix_(keep, pair)] @ np.linalg.solve(m[np.ix_(pair, pair)], m[np.ix_(pair, keep)])
    return int(above)


def slices(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals, highest first, that hold the ``wanted`` largest eigenvalues: cut at gaps found by
    inertia counts, each with at most ``INTERVAL`` eigenvalues or too narrow to be cut. The last may hold more than are
    wanted, where eigenvalues are equal."""
    scale = float(np.abs(a).sum(axis=1).max()) or 1.0
    counts: dict[float, int] = {}

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = inertia(a, x)
        return counts[x]

    def cut(low: float, high: float) -> float:
        """A place about the middle, in the widest gap that a few tries find."""
        best = (-1, (low + high) / 2)
        for part in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
            x, wide = low + part * (high - low), 0
            for k in (64, 32, 16):
                if above(x - (high - low) / k) != above(x + (high - low) / k):
                    break
                wide += 1
            best = max(best, (wide, x), key=lambda b: b[0])
            if wide == 3:
                break
        return best[1]

    wanted, found, todo = min(wanted, len(a)), [], [(-scale * 1e-3, scale * 1.001)]
    while todo:
        low, high = todo.pop()
        n, ahead = above(low) - above(high), above(high)
        if not n or ahead >= wanted:
            continue
        # The interval that has the last one wanted is cut until nothing else is in it.
        if (n > INTERVAL or ahead + n > wanted) and high - low > 1e-11 * scale:
            x = cut(low, high)
            todo += [(low, x), (x, high)]
        else:
            found.append((low, high, n))
    return found


def contour(a: np.ndarray, low: float, high: float, count: int, tolerance: float = 1e-13, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) in an interval, ``count`` of them, by FEAST."""
    d = len(a)
    scale, middle, radius = float(np.abs(a).max()) or 1.0, (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * (np.pi / 2) * (1 - points))  # the upper half; the lower one is its mirror
    size = min(d, count + max(4, count // 2))
    space = np.random.default_rng(7).standard_normal((d, size))
    solved = [np.linalg.inv((middle + radius * t) * np.eye(d) - a) if d <= 512 else None for t in turn]
    last = np.inf
    for _ in range(most):
        projected = np.zeros_like(space)
        for t, w, inverse in zip(turn, weights, solved, strict=True):
            x = inverse @ space if inverse is not None else np.linalg.solve((middle + radius * t) * np.eye(d) - a, space.astype(complex))
            projected += (w / 2) * (radius * t * x).real
        basis = np.linalg.qr(projected)[0]
        values, small = np.linalg.eigh(basis.T @ a @ basis)
        space = basis @ small
        inside = (values > low) & (values <= high)
        error = np.abs(a @ space[:, inside] - space[:, inside] * values[inside]).max(initial=0.0)
        if int(inside.sum()) == count and error <= tolerance * scale * d and error >= last / 4:  # it gets no better
            return values[inside], space[:, inside]
        last = error if int(inside.sum()) == count else np.inf
    raise ValueError(f"{int(inside.sum())} of {count} eigenvalues between {low} and {high} found, with residual {error}")


def components(a: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, the ``wanted`` largest, falling. Those that are
    zero but for rounding are left out; each vector's largest entry is positive."""
    d = len(a)
    scale = float(np.abs(a).max()) if d else 0.0
    if not scale:
        return np.zeros(0), np.zeros((d, 0))
    a = a / scale
    found = [contour(a, *s) for s in slices(a, wanted)]
    basis = np.linalg.qr(np.hstack([v for _, v in found]))[0]
    values, small = np.linalg.eigh(basis.T @ a @ basis)  # one Rayleigh-Ritz step makes them orthogonal to each other too
    order = np.argsort(-values)[:wanted]
    order = order[values[order] > d * 1e-14 * values.max()]
    values, vectors = values[order], (basis @ small)[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    return values * scale, vectors * np.sign(vectors[largest, np.arange(len(order))])


def finite(vector: Column) -> Column:
    """Whether a vector has entries, none of them null, infinite or no number."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))


def whole(vector: Column) -> Column:
    """The entries as whole numbers. Those that doubles don't hold exactly are an error."""
    x = lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET)
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) < MOST / SCALE, x(c)).otherwise(F.raise_error(F.lit("an entry is too large to be whitened")).cast("long")))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The x vectors of a batch as rows."""
    column = batch.column("x")
    if not np.all(np.diff(column.offsets.to_numpy()) == d):
        raise ValueError(f"vectors differ in length: {d} entries are wanted")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch, d)
        for i in range(0, len(x), BLOCK):
            yield x[i : i + BLOCK]


def totals(rows: DataFrame, d: int, add: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], exact: bool) -> np.ndarray:
    """The sum of ``add(block)``, a matrix of ``shape``, over all blocks of vectors: each task has sums of its own, which
    Spark adds by their places; the driver gets one matrix. exact: of whole numbers, without rounding."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches, d):
            part = add(block).astype(object if exact else float)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array([repr(v) for v in total.ravel().tolist()])], ["place", "value"])

    parts = rows.select("x").mapInArrow(run, "place bigint, value string")
    out = np.zeros(shape[0] * shape[1], object if exact else float)
    for r in parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)" if exact else "double")).alias("value")).collect():
        out[r["place"]] = int(r["value"]) if exact else r["value"]
    return out.reshape(shape)


def whiten(rows: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component.

    rows: vec_id, embedding. Rows whose vector is null, empty or holds null or non-finite entries are dropped; rows of one
    id and repeated rows stay, and repeats count once among the n distinct vectors that are fitted. Vectors of different
    lengths, entries beyond 2^34, and a deviation beyond a bigint are errors. Components without variance have no rows: all equal vectors, or an empty table, give an empty
    result. Where eigenvalues are equal their components are any basis of their space. Extra columns are ignored.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    kind = dict(rows.dtypes)["vec_id"]
    good = rows.where(finite(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("x"))
    fit = settle(good.select("x").distinct(), "whitening-fit")
    n, d, other = fit.agg(F.count(F.lit(1)), F.max(F.size("x")), F.min(F.size("x"))).first()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n:
        discard(fit)
        return spark.createDataFrame([], schema)
    if d != other:
        raise ValueError(f"vectors have {other} to {d} entries; they must have as many as each other")
    sums = totals(fit, d, lambda x: x.sum(axis=0)[None, :], (1, d), exact=True)[0]
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the mean, rounded

    def products(x: np.ndarray) -> np.ndarray:
        y = x - near
        if len(y) * float(np.abs(y).max()) ** 2 < 2**53:
            return np.rint(y.T.astype(float) @ y.astype(float)).astype(np.int64)  # doubles hold each sum on the way
        return y.T.astype(object) @ y.astype(object)

    # The covariance, exactly until it is divided: products of deviations from the rounded mean, less what rounding left.
    gram, rest = totals(fit, d, products, (d, d), exact=True), sums - n * near.astype(object)
    covariance = np.array([[(n * gram[i, j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)], float)
    values, vectors = components(covariance, wanted)
    k, scaled, left = len(values), vectors / np.sqrt(values), np.array([float(r) / n for r in rest])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - near).astype(float) - left) @ scaled

    error = 0.0
    if k:
        found = totals(fit, d, lambda x: np.vstack([(w := project(x)).sum(axis=0), w.T @ w]), (k + 1, k), exact=False) / n
        error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())
    discard(fit)
    explained = values / covariance.trace() if k else values

    def deviation(x: np.ndarray) -> list[int]:
        y = x - near
        if float(d) * (n * float(np.abs(y).max(initial=0)) + n) ** 2 < 2**62:
            return ((n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return ((n * y.astype(object) - rest) ** 2).sum(axis=1).tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part, d)
                row = pa.array(np.repeat(np.arange(len(x)), k))
                columns = {
                    "vec_id": part.column("vec_id").take(row), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(len(row), n)), "deviation": pa.array(deviation(x), pa.int64()).take(row),
                    "whitened": pa.array(project(x).ravel()), "explained": pa.array(np.tile(explained, len(x))), "identity_error": pa.array(np.full(len(row), error)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return good.mapInArrow(run, schema)
