"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The vectors become integers x; every distinct x is one row of the matrix X that is fitted,
less the column means. The bidiagonalisation alternates products with X and its transpose:

    alpha_j u_j     = X v_j   - beta_(j-1) u_(j-1)
    beta_j  v_(j+1) = X'u_j   - alpha_j    v_j

Every left vector lies in the range of X, so it is kept as u_j = X a_j with a short a_j; its
long form exists only inside the tasks, block by block of the table. One Spark job a step
takes all a_j along, multiplies each block by them, and adds up the products of the new
vector with all earlier left vectors (full reorthogonalisation) and with the transpose. The
driver holds a few d x d matrices, whatever the number of rows. The singular values and right
vectors of the small bidiagonal matrix give the deviations and the components.

All d steps are taken: the basis is then complete, so equal or close eigenvalues and matrices
of low rank are found whole. Where a step breaks down (an invariant subspace), it goes on
with a new vector orthogonal to all before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, prepare

SCALE = 256
COMPONENTS = 4
LONG = 1 << 63
FAN_IN = 256  # tasks whose sums come to the driver by themselves; more are added up in Spark
_PASSES = 3  # most corrections of one left vector


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, x`` for the rows whose vector is not null and holds finite numbers only; ``x`` is
    floor(scale * c) of each entry c as long (numbers beyond a long become the nearest one)."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    return (rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where(v.isNotNull()).where(~bad).select("id", x.alias("x")))


def _padded(column: pa.Array, d: int) -> np.ndarray:
    """An array column as a matrix; shorter vectors end in zeros."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (size == d).all():
        return flat.reshape(n, d)
    out = np.zeros((n, d), flat.dtype if len(flat) else np.int64)
    out[np.arange(d) < size[:, None]] = flat
    return out


def _exact(x: np.ndarray, terms: int) -> np.ndarray:
    """``x`` as longs where sums of ``terms`` entries fit a long, else as Python integers."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x if top * max(terms, 1) < LONG else x.astype(object)


def _moments(d: int):
    """Rows, and per dimension the exact sum and sum of squares, as text (any size)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, [0] * d, [0] * d
        for b in batches:
            x = _padded(b.column("x"), d)
            top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
            squares = x if top * top * max(len(x), 1) < LONG else x.astype(object)
            n += len(x)
            s = [a + int(v) for a, v in zip(s, _exact(x, len(x)).sum(0), strict=True)]
            q = [a + int(v) for a, v in zip(q, (squares * squares).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([",".join(map(str, s))]), pa.array([",".join(map(str, q))])], ["n", "s", "q"])
    return run


def moments(fit: DataFrame, d: int) -> tuple[int, int, list[int], list[int]]:
    """(tasks, rows, sums, sums of squares) of the vectors ``x``, exact; a short row for each
    task comes to the driver."""
    rows = fit.select("x").mapInArrow(_moments(d), "n bigint, s string, q string").collect()
    add = lambda k: [sum(c) for c in zip(*[map(int, r[k].split(",")) for r in rows], strict=True)] or [0] * d
    return len(rows), sum(r["n"] for r in rows), add("s"), add("q")


class Centred:
    """The distributed matrix X: distinct vectors less their means, with the products that the
    bidiagonalisation takes."""

    def __init__(self, fit: DataFrame, d: int, mean: np.ndarray, tasks: int):
        self.fit, self.d, self.mean, self.tasks = fit.select("x"), d, mean, tasks

    def _sum(self, of, size: int) -> np.ndarray:
        """Sum of ``of(block)`` (``size`` numbers) over all blocks, in the order of the partitions."""
        d, mean = self.d, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                total += of(_padded(b.column("x"), d) - mean)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])
        parts = self.fit.mapInArrow(run, "v array<double>")
        if self.tasks > FAN_IN:  # add up FAN_IN tasks at a time, in their order
            pid = F.spark_partition_id()
            zero = F.array_repeat(F.lit(0.0), size)
            parts = (parts.groupBy(F.floor(pid / FAN_IN).alias("g")).agg(F.sort_array(F.collect_list(F.struct(pid.alias("p"), "v"))).alias("l"))
                     .orderBy("g").select(F.aggregate("l", zero, lambda t, r: F.zip_with(t, r["v"], lambda x, y: x + y)).alias("v")))
        return np.sum([r["v"] for r in parts.collect()] or [np.zeros(size)], axis=0)

    def step(self, left: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """For w = X a and the left vectors U = X ``left``: (U'w, w'w, X'w)."""
        k = left.shape[1]

        def of(block):
            w = block @ a
            return np.concatenate(((block @ left).T @ w, [w @ w], block.T @ w))
        got = self._sum(of, k + 1 + self.d)
        return got[:k], float(got[k]), got[k + 1:]

    def gram(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the rows of X m, (X m)'(X m))."""
        k = m.shape[1]

        def of(block):
            y = block @ m
            return np.concatenate((y.sum(0), (y.T @ y).ravel()))
        got = self._sum(of, k + k * k)
        return got[:k], got[k:].reshape(k, k)


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(x: Centred, norm: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): an orthonormal basis of all d right vectors, and the upper bidiagonal matrix
    with X V = U B. ``norm`` is the Frobenius norm of X."""
    d, rng = x.d, np.random.default_rng(seed)
    zero = 1e-14 * norm * d ** .5

    def fresh(basis):
        while True:
            v = _orthogonal(rng.standard_normal(d), basis)
            if np.linalg.norm(v) > 1e-3:
                return v / np.linalg.norm(v)

    v_all, left, left_t = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, the a_j, X'U
    b = np.zeros((d, d))
    v, beta = fresh(v_all), 0.0
    for j in range(d):
        a = v - beta * left[:, j - 1] if j and beta else v
        for _ in range(_PASSES):
            g, ww, xt = x.step(left, a)
            a, xt = a - left @ g, xt - left_t @ g
            rest = ww - g @ g
            if g @ g <= .01 * ww:  # else the subtraction cancelled: measure the corrected vector
                break
        alpha = max(rest, 0.0) ** .5
        v_all = np.column_stack((v_all, v))
        if alpha > zero:
            a, xt = a / alpha, xt / alpha
        else:
            alpha, a, xt = 0.0, np.zeros(d), np.zeros(d)
        b[j, j] = alpha
        left, left_t = np.column_stack((left, a)), np.column_stack((left_t, xt))
        if j + 1 == d:
            break
        p = _orthogonal(xt - alpha * v, v_all)
        beta = float(np.linalg.norm(p))
        if beta > zero:
            v = p / beta
            v = _orthogonal(v, v_all)
            v /= np.linalg.norm(v)
        else:
            beta, v = 0.0, fresh(v_all)
        b[j, j + 1] = beta
    return v_all, b


class Whitening:
    """What the fit yields: ``n``, ``sums``, ``components`` (columns), ``values`` (eigenvalues),
    ``trace`` of the covariance and ``identity_error``."""

    def __init__(self, fit: DataFrame, d: int, components: int = COMPONENTS):
        self.d = d
        tasks, self.n, self.sums, squares = moments(fit, d)
        k = min(components, d)
        # n * sum(x^2) - sum(x)^2 over n^2: exact until the last division
        spread = sum(self.n * q - s * s for q, s in zip(squares, self.sums, strict=True))
        self.trace = spread / self.n ** 2 if self.n else 0.0
        self.mean = np.array([s / self.n if self.n else 0.0 for s in self.sums])
        self.components, self.values, self.identity_error = np.zeros((d, k)), np.zeros(k), 0.0
        if not spread:
            return
        x = Centred(fit, d, self.mean, tasks)
        v, b = bidiagonalise(x, (spread / self.n) ** .5)
        _, sigma, right = np.linalg.svd(b)
        self.components = v @ right[:k].T
        self.components /= np.linalg.norm(self.components, axis=0)
        self.values = np.where(sigma[:k] > 1e-14 * sigma[0] * d, sigma[:k] ** 2 / self.n, 0.0)
        live = self.values > 0
        total, gram = x.gram(self.projection()[:, live])
        mean = total / self.n
        self.identity_error = float(np.abs(gram / self.n - np.outer(mean, mean) - np.eye(live.sum())).max())

    def projection(self) -> np.ndarray:
        """Centred vectors times this are whitened; a component without deviation gives 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.components / np.sqrt(self.values), 0.0)


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct ``x`` of ``vectors``; None where there is no entry at all."""
    prepare(vectors.sparkSession)
    fit = materialize(vectors.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    return Whitening(fit, d, components) if d else None


def _apply(w: Whitening):
    n, d, mean, m = w.n, w.d, w.mean, w.projection()
    k = m.shape[1]
    sums = np.array(w.sums, object)
    share = [float(e / w.trace) if w.trace else 0.0 for e in w.values]

    def deviation(x: np.ndarray) -> list:
        top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        small = (n * top + max(abs(int(s)) for s in sums)) ** 2 * d < LONG
        t = n * x - sums.astype(np.int64) if small else n * x.astype(object) - sums
        return [int(v) if int(v) < LONG else None for v in (t * t).sum(1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _padded(b.column("x"), d)
            rows = len(x)
            at = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n)),
                 pa.array(deviation(x), pa.int64()).take(pa.array(at)), pa.array(((x - mean) @ m).ravel()), pa.array(np.tile(share, rows)),
                 pa.array(np.full(rows * k, w.identity_error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each
    usable vector and each of the first ``components`` (the number of dimensions at most).

    Vectors that are null or hold null or non-finite entries are dropped. Vectors of unequal
    length count as followed by zeros up to the longest; of empty vectors alone nothing comes
    out. Repeated vectors are one row of the fit and each a row of the result; ids may be null
    or repeat; other columns are not read, whatever their names. A component without
    deviation (few distinct vectors) has ``whitened`` and ``explained`` 0 and is left out of
    ``identity_error``; of equal eigenvalues any orthonormal choice may come, the same for all
    rows. ``deviation`` is exact, and null where it exceeds a long. An empty table gives an
    empty result.
    """
    spark = rows.sparkSession
    src = integer_vectors(rows, id_col, vector_col)
    schema = (f"id {dict(src.dtypes)['id']}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    vectors = materialize(src, "vectors")
    w = fit_whitening(vectors, components)
    return vectors.mapInArrow(_apply(w), schema) if w else spark.createDataFrame([], schema)
