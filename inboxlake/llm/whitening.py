"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson, matrix-free over the rows.

The covariance is never formed.  The only access to it is a distributed product: every task centres its rows,
multiplies them with a few vectors and adds up, Spark sums the tasks' parts by position.  Around it, on matrices of
(dimensions x a few columns): the search space's Rayleigh-Ritz pairs, locking of the leading pairs whose residual has
reached double precision, and for the others the projected correction equations
(I - QQ')(V - e I)(I - QQ') t = -r, solved roughly by inner MINRES.  The equations of all wanted pairs advance in step,
so one pass over the rows serves them all.  Each step is a Spark job of its own over a stored table: a lost executor
costs its tasks, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import is_finite, matrix, scaled

#: Rows of a stored block, MINRES steps of a correction, search space kept after and allowed before a restart.
BLOCK_ROWS, INNER_STEPS, KEEP, LIMIT = 4096, 6, 12, 48
#: Pairs beyond the wanted ones that must be known roughly, so that no leading one was missed.
GUARD, GUARD_TOLERANCE = 2, 1e-3
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")
EPS = np.finfo(np.float64).eps


class FitList:
    """Distinct vectors, stored as blocks of a narrow integer type, with their exact count and sums."""

    def __init__(self, distinct: DataFrame):
        counted = common.stored(distinct, "fit")
        self.n, self.dims = counted.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        dims = self.dims

        def blocks(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    x = matrix(batch.column(0).slice(at, BLOCK_ROWS), dims)
                    kind = next(k for k in ("<i2", "<i4", "<i8") if not x.size or (np.iinfo(k).min <= x.min()
                                                                                   and x.max() <= np.iinfo(k).max))
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([x.astype(kind).tobytes()],
                                                                                 pa.binary())], ["kind", "data"])
        self.blocks = common.stored(counted.mapInArrow(blocks, "kind string, data binary"), "fit-blocks")

        def add(total, x):
            return (0 if total is None else total) + x.astype(object).sum(axis=0)
        self.sums = [int(v) for v in self._sum(add, dims, "decimal(38,0)")]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # correctly rounded quotients of whole numbers

    def _sum(self, add: Callable, size: int, kind: str) -> list:
        """Sums by position of what ``add`` gathers from the blocks of each task."""
        dims = self.dims

        def gather(batches):
            total = None
            for batch in batches:
                for kind_of, data in zip(*(c.to_pylist() for c in batch.columns)):
                    total = add(total, np.frombuffer(data, kind_of).reshape(-1, dims))
            if total is not None:
                values = [str(v) for v in total] if kind.startswith("decimal") else np.ravel(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(values)],
                                                 ["at", "value"])
        raw = "string" if kind.startswith("decimal") else kind
        parts = self.blocks.mapInArrow(gather, f"at int, value {raw}")
        out = [0] * size
        for at, value in parts.groupBy("at").agg(F.sum(F.col("value").cast(kind))).collect():  # ``size`` rows
            out[at] = value
        return out

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """Covariance times ``vectors`` (dims x k), rows centred before multiplying."""
        mean, vectors = self.mean, np.ascontiguousarray(vectors)

        def add(total, x):
            c = x - mean
            return (0 if total is None else total) + c.T @ (c @ vectors)
        return np.array(self._sum(add, vectors.size, "double")).reshape(vectors.shape) / self.n

    def trace(self) -> float:
        mean = self.mean

        def add(total, x):
            return (0 if total is None else total) + np.array([((x - mean) ** 2).sum()])
        return self._sum(add, 1, "double")[0] / self.n

    def covariance_of(self, project: Callable, k: int) -> np.ndarray:
        """Covariance (k x k) of the projected fit list, centred before multiplying."""
        def mean_of(total, x):
            return (0 if total is None else total) + project(x).sum(axis=0)
        centre = np.array(self._sum(mean_of, k, "double")) / self.n

        def add(total, x):
            c = project(x) - centre
            return (0 if total is None else total) + c.T @ c
        return np.array(self._sum(add, k * k, "double")).reshape(k, k) / self.n


def orthonormal(t: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that add ``t`` to ``basis``; columns already in its span are left out."""
    out = basis
    for column in t.T:
        size = np.linalg.norm(column)
        for _ in range(3):  # repeated Gram-Schmidt: orthogonal to rounding
            if size > 0:
                column = column / np.linalg.norm(column)
                column = column - out @ (out.T @ column)
                if np.linalg.norm(column) < 1e-8:
                    size = 0
        if size > 0:
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out[:, basis.shape[1]:]


def minres(operator: Callable, b: np.ndarray, steps: int, tolerance: float = 0.02) -> np.ndarray:
    """Approximate solutions of ``operator(x) = b`` for each column of ``b``, all columns in step.

    ``operator`` is symmetric, possibly indefinite, and has its own matrix for each column.  A column that has
    reached ``tolerance`` (relative residual), or whose Krylov space is exhausted, stays as it is.
    """
    norm = lambda m: np.sqrt((m * m).sum(axis=0))
    x, v_old, w_old, w = (np.zeros_like(b) for _ in range(4))
    gamma = norm(b)
    start, eta, v = gamma, gamma.copy(), b.copy()
    c_old = c = np.ones(b.shape[1])
    s_old = s = np.zeros(b.shape[1])
    live = gamma > 0
    for _ in range(steps):
        if not live.any():
            break
        v = v / np.where(gamma > 0, gamma, 1)
        image = operator(v)
        delta = (image * v).sum(axis=0)
        v_new = image - delta * v - gamma * v_old
        gamma_new = norm(v_new)
        a0 = c * delta - c_old * s * gamma
        a1 = np.hypot(a0, gamma_new)
        a2, a3 = s * delta + c_old * c * gamma, s_old * gamma
        live = live & (a1 > 0)
        a1 = np.where(a1 > 0, a1, 1)
        w_new = (v - a3 * w_old - a2 * w) / a1
        x = x + np.where(live, a0 / a1 * eta, 0) * w_new
        eta = -gamma_new / a1 * eta
        live = live & (np.abs(eta) > tolerance * start) & (gamma_new > 64 * EPS * np.abs(delta))
        v_old, v, gamma = v, v_new, gamma_new
        w_old, w, c_old, c, s_old, s = w, w_new, c, a0 / a1, s, gamma_new / a1
    return x


def leading_pairs(product: Callable, dims: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and unit eigenvectors (columns) of a symmetric positive operator.

    Pairs are locked from the largest on, when |product(u) - e u| is at rounding: 16 eps sqrt(dims) times the largest
    eigenvalue.  A pair that rounding keeps just above that is locked once its residual is below 1e-12 of it and no
    longer falls.  Before the end, the next GUARD pairs must be known roughly.
    """
    k = min(k, dims)
    wanted = min(dims, k + GUARD)
    space = orthonormal(np.random.default_rng(seed).standard_normal((dims, min(dims, wanted + 2))), np.zeros((dims, 0)))
    image = product(space)
    locked, locked_image, best, stalled = np.zeros((dims, 0)), np.zeros((dims, 0)), np.inf, 0
    while True:
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        m = min(wanted - locked.shape[1], space.shape[1])
        u, residual = space @ turn[:, :m], image @ turn[:, :m] - (space @ turn[:, :m]) * values[:m]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max(np.abs(values[0]) if len(values) else 0, np.linalg.norm(locked_image[:, 0]) if locked.size else 0)
        whole = locked.shape[1] + space.shape[1] >= dims  # nothing is left to add
        if m and size[0] >= best / 2:
            stalled += 1
        else:
            stalled = 0
        best = min(best, size[0]) if m else best
        done, left = 0, k - locked.shape[1]
        while done < min(left, m) and (size[done] <= 16 * EPS * np.sqrt(dims) * top or whole
                                       or (done == 0 and stalled >= 2 and size[0] <= 1e-12 * top)):
            done += 1
        if done == left and (whole or (size[done:m] <= GUARD_TOLERANCE * top).all()):
            locked, locked_image = (np.column_stack([a, b @ turn[:, :done]])
                                    for a, b in ((locked, space), (locked_image, image)))
            break
        if done and done < left:
            locked, locked_image = (np.column_stack([a, b @ turn[:, :done]])
                                    for a, b in ((locked, space), (locked_image, image)))
            space, image = space @ turn[:, done:], image @ turn[:, done:]
            best, stalled = np.inf, 0
            u, residual, values, m = u[:, done:], residual[:, done:], values[done:], m - done
            if not m:
                u = residual = np.zeros((dims, 0))
        elif space.shape[1] > LIMIT:
            space, image = space @ turn[:, :KEEP], image @ turn[:, :KEEP]
        q, shift = np.column_stack([locked, u]), values[:u.shape[1]]
        project = lambda t: t - q @ (q.T @ t)  # noqa: E731, B023
        t = minres(lambda t: project(product(project(t)) - project(t) * shift), -project(residual), INNER_STEPS)  # noqa: B023
        new = orthonormal(t, np.column_stack([locked, space]))
        if not new.shape[1]:  # nothing new: go on from a fresh direction
            fresh = np.random.default_rng(seed + space.shape[1]).standard_normal((dims, 1))
            new = orthonormal(fresh, np.column_stack([locked, space]))
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    # a last Rayleigh-Ritz step within the locked space, on a fresh product
    basis, _ = np.linalg.qr(locked)
    h = basis.T @ product(basis)
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], basis @ turn[:, ::-1]


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """Whitened coordinates of ``vectors`` (vec_id long, x array<long>): the columns of SCHEMA.

    The fit list is each distinct x once; components are the leading unit eigenvectors of its covariance.  Every row,
    repeated ones and those with a null vec_id too, gives a row per component.  Null vectors give none.  Components
    without variance (an eigenvalue at rounding, as where all vectors are equal) can't be whitened and are left out;
    an empty table, or one without any variance, gives no rows.  Vectors of different lengths are filled up with
    zeros.  ``deviation`` is null where it exceeds 64 bits.  Other columns are ignored.  The driver holds matrices of
    (dimensions x about 50 columns), nothing that grows with the rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("x").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fit = FitList(rows.select("x").distinct())
    trace = fit.trace() if fit.n and fit.dims else 0.0
    if not trace > 0:
        return spark.createDataFrame([], SCHEMA)
    values, basis = leading_pairs(fit.product, fit.dims, components)
    keep = values > 16 * EPS * fit.dims * trace
    values, basis = values[keep], basis[:, keep]
    n, sums, mean, dims, k = fit.n, fit.sums, fit.mean, fit.dims, len(values)
    weights = basis / np.sqrt(values)
    project = lambda x: (x - mean) @ weights
    error = float(np.abs(fit.covariance_of(project, k) - np.eye(k)).max())
    explained = values / trace

    def coordinates(batches):
        for batch in batches:
            x, count = matrix(batch.column("x"), dims), batch.num_rows
            w = project(x)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("vec_id").to_numpy(zero_copy_only=False), k), pa.int64(), from_pandas=True)
                if batch.column("vec_id").null_count else pa.array(np.repeat(batch.column("vec_id").to_numpy(), k)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, n)),
                pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()), pa.array(w.ravel()),
                pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error))],
                [c.split()[0] for c in SCHEMA.split(", ")])
    return rows.mapInArrow(coordinates, SCHEMA)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S)^2 over the dimensions; None beyond 64 bits."""
    if not x.size:
        return [0] * len(x)
    reach = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums)
    if reach * reach * x.shape[1] < 1 << 63:
        d = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings without null or non-finite components, components as floor(256 * c)."""
    rows = common.table(spark, sf_dir, "embeddings").where(is_finite(F.col("embedding")))
    return whiten(rows.select("vec_id", scaled(F.col("embedding"), 256).alias("x")))
