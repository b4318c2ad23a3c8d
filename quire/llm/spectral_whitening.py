"""Embedding whitening by incremental eigendecomposition.

A vector's entries c become whole numbers x = floor(256 * c). The fit list holds
each distinct x vector once; n, sums, covariance (divisor n, centred before
multiplying) and components are of the fit list.

1. Each task keeps a spectrum: count, exact sums, and the eigenvalues and
   eigenvectors of the centred scatter of the rows it has read. A block of rows
   comes as its mean and the R factor of its centred rows, at most one row a
   dimension with the same scatter. Each of these rows, and the distance of the
   means weighted by n * m / (n + m), is a rank-one update: the secular equation
   1 + sum z_i^2 / (d_i - t) = 0 is solved for all its roots at once, each from
   its nearer pole, after small z_i and close d_i are deflated; vectors follow
   from z worked out anew from the roots, so they stay orthogonal.
2. Spectra are combined by the same updates, one for each eigenpair of the other
   and one for the means, in a tree of FAN_IN children.
3. Rayleigh-Ritz: all tasks project the centred fit list on the basis found; its
   scatter there, combined in the same tree, gives the final pairs.
4. The whitened fit list's covariance is measured in another pass.

What travels is a d x d matrix a task, in a tree; the driver and the tasks get
one such matrix. A vector that fills a third of all rows is made one before the
shuffle.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are left out, so are those whose length is not the commonest (of equals
the greatest); a null id stays null and repeated rows are rows of their own; an
eigenvalue that is zero to double precision has a null `whitened` and no part in
`identity_error`, which is null if all are; `explained` is null if all vectors
are one; `deviation` is null where it passes a long; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, stored

COMPONENTS = 4
SCALE = 256
#: Rows of a block, and summaries combined in one step.
BLOCK_ROWS, FAN_IN = 4096, 16

_EPS = np.finfo(float).eps
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum z_i^2 / (d_i - t), ascending d and no z zero, and
    the matrix of d_i - root_j to full relative precision."""
    k = len(d)
    weight = rho * z * z
    poles = np.append(d, d[-1] + weight.sum())  # the last root lies below this
    gap = np.diff(poles)
    inner = np.arange(k)[:, None] <= np.arange(k)  # poles at or below a root
    middle = d[:, None] - (d + gap / 2)
    right = 1 + (weight[:, None] / middle).sum(0) < 0  # the root is nearer the upper pole
    right[-1] = False
    origin = np.where(right, poles[1:], d)
    delta = d[:, None] - origin
    p1, p2 = d - origin, poles[1:] - origin
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    t = (low + high) / 2
    for _ in range(80):
        away = delta - t
        part = weight[:, None] / away
        f = 1 + part.sum(0)
        slope = part / away
        done = (np.abs(f) <= 8 * _EPS * (1 + np.abs(part).sum(0))) | (high - low <= 2 * _EPS * np.abs(t))
        if done.all():
            break
        low, high = np.where(f < 0, t, low), np.where(f > 0, t, high)
        psi, phi = (slope * inner).sum(0), (slope * ~inner).sum(0)
        d1, d2 = p1 - t, p2 - t
        c = f - d1 * psi - d2 * phi
        a = (d1 + d2) * f - d1 * d2 * (psi + phi)
        b = d1 * d2 * f
        with np.errstate(all="ignore"):  # what does not fit is halved instead
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = t + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        t = np.where(done, t, new)
    return origin + t, delta - t


def rank_one(w: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of u diag(w) u^T + v v^T."""
    z = u.T @ v
    rho = float(z @ z)
    if rho <= 0:
        return w, u
    z = z / np.sqrt(rho)
    limit = 8 * _EPS * max(abs(w[-1]), rho)
    free = rho * np.abs(z) > limit
    live = np.flatnonzero(free)
    gaps = np.diff(w[live])
    if len(live) > 1 and (gaps * np.abs(z[live][1:] * z[live][:-1]) <= limit).any():  # close values: all of z goes to one of them
        w, u, z = w.copy(), u.copy(), z.copy()
        one = live[0]
        for other in live[1:]:
            size = np.hypot(z[one], z[other])
            c, s = z[other] / size, -z[one] / size
            if abs((w[other] - w[one]) * c * s) <= limit:
                z[one], z[other] = 0.0, size
                u[:, one], u[:, other] = c * u[:, one] + s * u[:, other], c * u[:, other] - s * u[:, one]
                w[one], w[other] = c * c * w[one] + s * s * w[other], s * s * w[one] + c * c * w[other]
                free[one] = False
            one = other
        live = np.flatnonzero(free)
        live = live[np.argsort(w[live], kind="stable")]
    if not len(live):
        return w, u
    d = w[live]
    roots, apart = secular_roots(d, z[live], rho)
    k = len(d)
    lower = np.tril(np.ones((k, k), bool), -1)
    next_d = np.append(d[1:], 0.0)
    below = np.where(lower, d - d[:, None], next_d - d[:, None])
    below[:, -1] = np.where(lower[:, -1], below[:, -1], 1.0)
    again = np.copysign(np.sqrt(np.prod(-apart / below, axis=1)), z[live])
    q = again[:, None] / apart
    q /= np.sqrt((q * q).sum(0))
    w, v = w.copy(), u.copy()
    w[live], v[:, live] = roots, u[:, live] @ q
    order = np.argsort(w, kind="stable")
    return w[order], v[:, order]


class Spectrum:
    """Count, exact sums, and the eigenpairs of the centred scatter of some rows."""

    def __init__(self, size: int) -> None:
        self.n, self.sums = 0, np.zeros(size, np.int64)
        self.w, self.u = np.zeros(size), np.eye(size)

    def _joined(self, n: int, sums: np.ndarray, factors: np.ndarray) -> None:
        if self.n and n:
            apart = self.sums / self.n - sums / n
            factors = np.vstack([factors, apart * np.sqrt(self.n / (self.n + n) * n)])
        for v in factors:
            self.w, self.u = rank_one(self.w, self.u, v)
        self.n += n
        self.sums = self.sums + sums

    def add(self, rows: np.ndarray) -> None:
        """Rows of whole numbers."""
        if len(rows):
            sums = rows.sum(0)
            self._joined(len(rows), sums, np.linalg.qr(rows - sums / len(rows), mode="r"))

    def merge(self, other: Spectrum) -> None:
        self._joined(other.n, other.sums, (other.u * np.sqrt(np.maximum(other.w, 0))).T[other.w > 0])


class Moments:
    """Count, mean and centred scatter of some rows of doubles."""

    def __init__(self, size: int) -> None:
        self.n, self.mean, self.scatter = 0, np.zeros(size), np.zeros((size, size))

    def _joined(self, n: int, mean: np.ndarray, scatter: np.ndarray) -> None:
        apart, both = mean - self.mean, self.n + n
        self.scatter = self.scatter + scatter + np.outer(apart, apart) * (self.n / both * n)
        self.mean = self.mean + apart * (n / both)
        self.n = both

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            mean = rows.mean(0)
            self._joined(len(rows), mean, (rows - mean).T @ (rows - mean))

    def merge(self, other: Moments) -> None:
        if other.n:
            self._joined(other.n, other.mean, other.scatter)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(fit: DataFrame, size: int, new: Callable, project: Callable[[np.ndarray], np.ndarray] | None, name: str):
    """One summary of all rows of the fit list: one a task, then a tree; None for no rows."""

    def of_task(batches):
        summary = new()
        for batch in batches:
            rows = _matrix(batch.column(0), size)
            for at in range(0, len(rows), BLOCK_ROWS):
                block = rows[at : at + BLOCK_ROWS]
                summary.add(project(block) if project else block)
        if summary.n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(summary)], pa.binary())], ["id", "summary"])

    def combined(batches):
        held, of = None, None
        for batch in batches:
            for at, summary in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and at // FAN_IN != of:
                    yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([pickle.dumps(held)], pa.binary())], ["id", "summary"])
                    held = None
                if held is None:
                    held, of = pickle.loads(summary), at // FAN_IN
                else:
                    held.merge(pickle.loads(summary))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([pickle.dumps(held)], pa.binary())], ["id", "summary"])

    level = stored(map_arrow(fit, of_task, "id long, summary binary"), name)
    top = level.agg(F.max("id")).first()[0]
    if top is None:
        return None
    while top > 0:  # children of one node are read by one task, in order
        top //= FAN_IN
        level = map_arrow(level.repartitionByRange(top + 1, F.floor(F.col("id") / FAN_IN)).sortWithinPartitions("id"), combined, "id long, summary binary")
    return pickle.loads(level.first().summary)


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that count, and their dimensions."""
    c = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = rows.where(c.isNotNull() & (F.size(c) > 0)).where(F.forall(c, lambda x: finite(x.cast("double"))))
    sizes = good.groupBy(F.size(c).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE))
    return good.where(F.size(c) == size).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")), size


def components(fit: DataFrame, size: int, keep: int = COMPONENTS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float] | None:
    """n, sums, unit eigenvectors (columns) and eigenvalues by falling eigenvalue,
    and the trace, of the covariance of a list of distinct x vectors."""
    spectrum = _summed(fit, size, lambda: Spectrum(size), None, "whitening-spectra")
    if spectrum is None:
        return None
    n, mean = spectrum.n, spectrum.sums / spectrum.n
    basis = np.linalg.qr(spectrum.u[:, ::-1])[0]
    ritz = _summed(fit, size, lambda: Moments(size), lambda rows: (rows - mean) @ basis, "whitening-ritz")
    e, turned = np.linalg.eigh(ritz.scatter / n)
    keep = min(keep, size)
    e, found = e[::-1][:keep], (basis @ turned[:, ::-1])[:, :keep]
    found = found * np.where(np.take_along_axis(found, np.abs(found).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
    return n, spectrum.sums, found, e, float(np.trace(ritz.scatter) / n)


def whitened(rows: DataFrame, keep: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """SCHEMA: `keep` rows for each vector, or as many as it has dimensions."""
    every, size = vectors(rows, id_col, vector_col)
    fit = stored(every.select("x").distinct(), "whitening-fit") if size else None
    found = components(fit, size, keep) if size else None
    if found is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    n, sums, basis, e, trace = found
    mean, keep = sums / n, len(e)
    real = e > size * _EPS * max(e[0], 0)
    scaled = basis / np.sqrt(np.where(real, e, np.inf))
    error = None
    if real.any():
        held = scaled[:, real]
        moments = _summed(fit, size, lambda: Moments(held.shape[1]), lambda block: (block - mean) @ held, "whitening-check")
        error = float(np.abs(moments.scatter / n - np.eye(held.shape[1])).max())

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), size)
            white = (x - mean) @ scaled
            span = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max())
            if span * span * size < 1 << 63:
                apart = n * x - sums
                deviation = pa.array((apart * apart).sum(1))
            else:
                exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            m = len(x)
            component = np.tile(np.arange(keep), m)
            back = pa.array(np.repeat(np.arange(m), keep))
            share = e / trace if trace > 0 else np.full(keep, np.nan)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(back),
                    pa.array(component + 1, pa.int32()),
                    pa.array(np.full(m * keep, n)),
                    deviation.take(back),
                    pa.array(white.reshape(-1), mask=~real[component]),
                    pa.array(share[component], mask=~np.isfinite(share[component])),
                    pa.array([error] * (m * keep), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(every, run, SCHEMA)
