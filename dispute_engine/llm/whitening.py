"""Embedding whitening: leading eigenvectors of the covariance by block Jacobi-Davidson, matrix-free.

Entries become integers (floor(64 c) + 1000000), so counts, sums and deviations
are exact. The covariance is never formed. All the solver asks of the
data is the product of the centred covariance with a few vectors: one pass over
the distinct vectors, centred before multiplying, in which every task returns
one d x k matrix (a compensated sum), merged by a second, smaller stage.

A subspace of trial vectors gives Ritz pairs. For each pair that has not
converged the projected correction equation
(I - QQ')(V - theta I)(I - QQ') t = -r, Q the locked vectors and the pair's own,
is solved by a few MINRES steps, all pairs sharing each product. The corrections extend the
subspace, which restarts from its best vectors when it has grown too large. Pairs are locked in falling order of
eigenvalue once their residual norm is at double precision (TOLERANCE, relative to the
largest eigenvalue); a last product over the locked vectors themselves must confirm it. One more pass
measures the covariance of the whitened vectors.

Driver: a few d x k matrices and vectors, whatever the number of rows.

Defined results: a NULL vector, or one with a NULL or non-finite entry or an entry whose
integer exceeds 62 bits, is left out; so is a vector whose dimension is not the
most common one (of equals the larger), because it has no place in the covariance.
Vectors equal as integers count once in the fit, but every row is returned, repeated and NULL
ids included. Only directions of positive variance are components (above NO_VARIANCE of the
largest eigenvalue), so fewer than k rows may come back for a vector; equal vectors alone, empty
vectors or an empty table give no rows. ``deviation`` is NULL where it exceeds 63
bits. Only the id and vector columns are read, other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
EPS = float(np.finfo(float).eps)
TOLERANCE = 16 * EPS        # residual norm over the largest eigenvalue, times sqrt(d)
NO_VARIANCE = 1e-11         # eigenvalues below this share of the largest are rounding
INNER = 5                   # MINRES steps of a correction at most
INNER_GAIN = 0.1            # or until its residual is this share of the first
GUARD = 8                   # trial vectors beyond the wanted ones
OUTER = 300


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole, finite and of the common dimension."""

    def fits(c: Column) -> Column:
        c = c.cast("double")
        return F.coalesce(F.abs(c * SCALE) < float(1 << 62), F.lit(False))  # false for NaN as well

    whole = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")) \
                   .where(F.col("v").isNotNull() & F.forall("v", fits))
    x = whole.select("vec_id", F.transform(
        "v", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    common = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")) \
              .orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return x.where(F.size("x") == (common[0]["d"] if common else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths as one int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


@dataclass
class Centre:
    """Exact count and sums; x - S/n is computed as (x - whole) - rest/n, without cancellation."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n for s in self.sums], dtype=object)
        self.fraction = np.array([(s % self.n) / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of every row, exact."""
        off = x - self.whole
        reach = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if len(self.whole) * reach * reach < 1 << 63:
            off = off * self.n - self.rest.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = ((off.astype(object) * self.n - self.rest) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _sums(fit: DataFrame) -> Centre | None:
    """Exact n and S: each task splits its integers into halves, whose sums cannot overflow."""

    def add(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & 0x7FFFFFFF).sum(axis=0)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)],
                ["dim", "n", "high", "low"])

    parts = fit.mapInArrow(add, "dim int, n long, high long, low long").groupBy("dim").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("dim").collect()
    if not parts:
        return None
    return Centre(int(parts[0]["n"]), [(int(r["high"]) << 31) + int(r["low"]) for r in parts])


class _Sum:
    """A compensated sum of equal-shaped arrays (two-term error-free addition)."""

    def __init__(self):
        self.high, self.low = None, None

    def add(self, value: np.ndarray, error: np.ndarray | float = 0.0):
        if self.high is None:
            self.high, self.low = value.copy(), np.zeros_like(value) + error
            return
        total = self.high + value
        part = total - self.high
        self.low += ((self.high - (total - part)) + (value - part)) + error
        self.high = total

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.float64()))
                                           for x in (self.high, self.low)], ["high", "low"])


def total(fit: DataFrame, of, groups: int = 1) -> np.ndarray | None:
    """The sum of ``of(x matrix)`` over all batches: one row a task, merged by ``groups`` tasks before the driver."""
    schema = "high array<double>, low array<double>"

    def add(batches):
        acc = _Sum()
        for batch in batches:
            if batch.num_rows:
                acc.add(of(_matrix(batch.column(0))))
        if acc.high is not None:
            yield acc.row()

    def merge(batches):
        acc = _Sum()
        for batch in batches:
            for high, low in zip(batch.column(0), batch.column(1)):
                acc.add(high.values.to_numpy(), low.values.to_numpy())
        if acc.high is not None:
            yield acc.row()

    acc = _Sum()
    for r in fit.mapInArrow(add, schema).repartition(groups).mapInArrow(merge, schema).collect():
        acc.add(np.array(r["high"]), np.array(r["low"]))
    return None if acc.high is None else acc.high + acc.low


def covariance_times(fit: DataFrame, centre: Centre, vectors: np.ndarray, groups: int = 1) -> np.ndarray:
    """V @ vectors by one pass over the fit list."""

    def of(x):
        y = centre.apply(x)
        return y.T @ (y @ vectors)

    return total(fit, of, groups).reshape(vectors.shape) / centre.n


def _orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The columns of ``t`` made orthonormal and orthogonal to ``against``; dependent ones are left out."""
    out: list[np.ndarray] = []
    for column in t.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        v = column / size
        for _ in range(3):
            v = v - against @ (against.T @ v)
            for w in out:
                v = v - w * (w @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            out.append(v)
    return np.array(out).T.reshape(t.shape[0], len(out))


def corrections(product, theta: np.ndarray, u: np.ndarray, r: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """MINRES on the projected correction equations of all pairs (theta, u) with residuals r; one product a step."""

    def project(v):
        v = v - locked @ (locked.T @ v)
        return v - u * (u * v).sum(axis=0)

    b = project(-r)
    beta = first = np.linalg.norm(b, axis=0)
    x, w, w2 = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    r1, r2, y = b, b, b
    m = b.shape[1]
    old_beta, dbar, epsilon, phibar = np.ones(m), np.zeros(m), np.zeros(m), beta.copy()
    cs, sn, live = -np.ones(m), np.zeros(m), beta > 0
    for step in range(INNER):
        if not live.any():
            break
        safe = np.where(live, beta, 1.0)
        v = np.where(live, y / safe, 0.0)
        y = np.zeros_like(v)
        y[:, live] = product(v[:, live])
        y = project(y - v * theta)
        if step:
            y = y - r1 * (beta / old_beta)
        alpha = (v * y).sum(axis=0)
        y = y - r2 * (alpha / safe)
        r1, r2, old_beta, beta = r2, y, safe, np.linalg.norm(y, axis=0)
        old_epsilon, delta = epsilon, cs * dbar + sn * alpha
        gbar, epsilon, dbar = sn * dbar - cs * alpha, sn * beta, -cs * beta
        gamma = np.hypot(gbar, beta)
        gamma = np.where(gamma > 0, gamma, 1.0)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = (v - w1 * old_epsilon - w2 * delta) / gamma
        x = x + np.where(live, w * phi, 0.0)
        live = live & (beta > EPS * first) & (phibar > INNER_GAIN * first)
    return x


def leading_pairs(product, d: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenpairs of the symmetric operator ``product`` and their largest relative residual.

    ``product`` maps a d x m matrix to V @ matrix."""
    k = min(k, d)
    most = max(3 * k, k + 2 * GUARD)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, k + GUARD))), np.zeros((d, 0)))
    image, locked = product(basis), np.zeros((d, 0))
    for _ in range(OUTER):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        want = k - locked.shape[1]
        r = image - basis * theta
        r = (r - locked @ (locked.T @ r))[:, :want]
        if not locked.shape[1]:
            largest = theta[0]
        limit = TOLERANCE * d ** 0.5 * max(largest, 0.0)
        good = np.linalg.norm(r, axis=0) <= limit
        done = want if good.all() else int(np.argmin(good))
        locked, basis, image = np.hstack([locked, basis[:, :done]]), basis[:, done:], image[:, done:]
        theta, r, good, want = theta[done:], r[:, done:], good[done:], want - done
        if not want:
            values, vectors, residual = _confirmed(product, locked)
            if residual <= TOLERANCE * d ** 0.5 or basis.shape[1] + k >= d:
                return values, vectors, residual
            basis, image, locked = _orthonormal(np.hstack([vectors, basis]), np.zeros((d, 0))), None, np.zeros((d, 0))
            image = product(basis)
            continue
        open_ = np.flatnonzero(~good)
        t = corrections(product, theta[open_], basis[:, open_], r[:, open_], locked)
        if basis.shape[1] + len(open_) > most:
            keep = want + GUARD
            basis, image = basis[:, :keep], image[:, :keep]
        t = _orthonormal(t, np.hstack([locked, basis]))
        if t.shape[1]:
            basis, image = np.hstack([basis, t]), np.hstack([image, product(t)])
        elif locked.shape[1] + basis.shape[1] < d:
            raise ArithmeticError("the corrections lie in the subspace but its residuals are above the tolerance")
        else:
            image = product(basis)  # the subspace is the whole space
            locked, basis, image = _whole_space(locked, basis, image, want)
    raise ArithmeticError(f"{OUTER} outer iterations did not reach the tolerance")


def _whole_space(locked, basis, image, want):
    """All of the space is spanned: its Ritz vectors are eigenvectors up to rounding, and are locked."""
    h = basis.T @ image
    _, y = np.linalg.eigh((h + h.T) / 2)
    y = y[:, ::-1]
    basis, image = basis @ y, image @ y
    keep = min(want, basis.shape[1]) - 1
    return np.hstack([locked, basis[:, :keep]]), basis[:, keep:], image[:, keep:]


def _confirmed(product, locked: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, vectors and the largest relative residual from one fresh product."""
    locked = _orthonormal(locked, np.zeros((locked.shape[0], 0)))
    image = product(locked)
    h = locked.T @ image
    theta, y = np.linalg.eigh((h + h.T) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    vectors, image = locked @ y, image @ y
    r = np.linalg.norm(image - vectors * theta, axis=0).max(initial=0.0)
    return theta, vectors, float(r / theta[0]) if len(theta) and theta[0] > 0 else 0.0


@dataclass
class Whitening:
    centre: Centre
    values: np.ndarray       # eigenvalues, falling
    vectors: np.ndarray      # d x k unit eigenvectors
    trace: float
    residual: float          # largest residual norm over the largest eigenvalue
    identity_error: float    # of the whitened covariance, measured
    passes: int              # over the fit list


def fit_whitening(x: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The transform learned from the distinct vectors of ``x``; None where nothing varies."""
    fit = stored(x.select("x").distinct(), "whitening-fit")
    centre = _sums(fit)
    if centre is None or not len(centre.sums):
        return None
    groups = max(1, int(fit.rdd.getNumPartitions() ** 0.5))  # as many merging tasks as each of them merges rows
    trace = float(total(fit, lambda v: np.array([(centre.apply(v) ** 2).sum()]), groups)[0]) / centre.n
    if not trace > 0:
        return None
    passes = [2]

    def product(vectors):
        passes[0] += 1
        return covariance_times(fit, centre, vectors, groups)

    values, vectors, residual = leading_pairs(product, len(centre.sums), k)
    real = values > NO_VARIANCE * values[0]
    values, vectors = values[real], vectors[:, real]
    scaled, m = vectors / np.sqrt(values), int(real.sum())

    def moments(v):
        z = centre.apply(v) @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    found = total(fit, moments, groups).reshape(m + 1, m) / centre.n
    error = np.abs(found[:m] - np.outer(found[m], found[m]) - np.eye(m)).max()
    return Whitening(centre, values, vectors, trace, residual, float(error), passes[0] + 1)


_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")


def apply_whitening(x: DataFrame, model: Whitening) -> DataFrame:
    """One row for every row of ``x`` and component."""
    scaled, m = model.vectors / np.sqrt(model.values), len(model.values)
    explained, centre, error = model.values / model.trace, model.centre, model.identity_error

    def transform(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, rows = _matrix(batch.column(1)), batch.num_rows
            z = centre.apply(v) @ scaled
            at = pa.array(np.repeat(np.arange(rows), m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * m, centre.n, dtype=np.int64)),
                 pa.array(centre.deviation(v), pa.int64()).take(at), pa.array(z.ravel()),
                 pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, error))],
                [f.split()[0] for f in _RESULT.split(", ")])

    return x.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(transform, _RESULT)


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable vector."""
    x = integers(vectors, id_col, vec_col)
    model = fit_whitening(x, k)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    return apply_whitening(x, model)
