"""Whitening of embeddings by incremental eigendecomposition and a distributed Rayleigh-Ritz refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import cut, ship

EPS = np.finfo(float).eps
FAN_IN = 8  # states that one task of a round merges
#: An entry c becomes floor(SCALE * c) + SHIFT, held within +-LARGEST.
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 53
#: An eigenvalue at or below this share of the trace is zero.
ZERO = 1e-13


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z', for rising, separate d, unit z without zeros and rho > 0, and the matrix d_j - root_i.

    Each root lies between two poles (the last one within rho beyond the last pole). It is sought as an offset from the
    nearer pole, so that its small distances to the poles keep their digits: a rational function with both poles is
    fitted to the secular function, and its root is taken where it lies in the bracket, the bracket's middle otherwise.
    """
    n = len(d)
    gap = np.append(np.diff(d), rho)
    at = np.arange(n)
    w = rho * z * z
    half = 1 + (w / ((d - d[:, None]) - gap[:, None] / 2)).sum(1) if n > 1 else np.array([1 + w[0] / (-gap[0] / 2)])
    near = np.where((half >= 0) | (at == n - 1), at, np.minimum(at + 1, n - 1))
    right = near != at
    delta = d[None, :] - d[near][:, None]
    lo = np.where(right, -gap / 2, 0.0)
    hi = np.where(right, 0.0, gap / 2)
    hi[-1] = rho if half[-1] < 0 else rho / 2
    lo[-1] = rho / 2 if half[-1] < 0 else 0.0
    mu = (lo + hi) / 2
    below = at[None, :] <= at[:, None]
    next_pole = np.minimum(at + 1, n - 1)
    last = at == n - 1
    for _ in range(rounds):
        g = delta - mu[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            f = w / g
            value, slope = 1 + f.sum(1), f / g
            done = np.abs(value) <= 4 * n * EPS * (1 + np.abs(f).sum(1))
            lo, hi = np.where(value < 0, mu, lo), np.where(value > 0, mu, hi)
            done |= hi - lo <= EPS * np.maximum(np.abs(lo), np.abs(hi))
            if done.all():
                break
            left, over = (slope * below).sum(1), (slope * ~below).sum(1)
            a, b = g[at, at], g[at, next_pole]
            c = np.where(last, value - left * a, value - left * a - over * b)
            q = (a + b) * value - a * b * (left + over)
            root = np.sqrt(np.maximum(q * q - 4 * c * a * b * value, 0))
            step = np.where(q <= 0, (q - root) / (2 * c), 2 * a * b * value / (q + root))
            step = np.where(last, a + left * a * a / c, step)
            new = mu + step
        ok = np.isfinite(new) & (new > lo) & (new < hi)
        mu = np.where(done, mu, np.where(ok, new, (lo + hi) / 2))
    return d[near] + mu, delta - mu[:, None]


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of q diag(d) q' + v v', of which the `most` largest are kept.

    The part of v outside the basis becomes a new direction of eigenvalue 0. Deflation: directions in which v has
    nothing stay as they are; directions of one eigenvalue are turned until v has something in one of them only. The rest
    comes from the secular equation, and its vectors from the update that has exactly these roots, so they are orthogonal.
    """
    z = q.T @ v
    rest = v - q @ z
    again = q.T @ rest
    z, rest = z + again, rest - q @ again
    length = np.sqrt(rest @ rest)
    if length > 16 * EPS * np.sqrt(v @ v) and q.shape[1] < len(v):
        d, q, z = np.append(0.0, d), np.column_stack([rest / length, q]), np.append(length, z)
    rho = z @ z
    if not rho > 0 or not len(d):
        return d, q
    z = z / np.sqrt(rho)
    tol = 8 * EPS * max(np.abs(d).max(), rho)
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order], q[:, order]
    live = rho * np.abs(z) > tol
    active = np.flatnonzero(live)
    runs = np.split(active, np.flatnonzero(np.diff(d[active]) > tol) + 1)
    if len(runs) < len(active):
        q, z = q.copy(), z.copy()
        for run in runs:
            if len(run) > 1:  # a reflection that leaves v's part in the run to its last direction
                u = z[run].copy()
                size = np.copysign(np.sqrt(u @ u), u[-1])
                u[-1] += size
                q[:, run] -= np.outer(q[:, run] @ u, u) * (2 / (u @ u))
                z[run], z[run[-1]] = 0.0, -size
                live[run[:-1]] = False
        active = np.flatnonzero(live)
    if not len(active):
        return d, q
    da, za = d[active], z[active]
    strength = rho * (za @ za)
    za = za / np.sqrt(za @ za)
    roots, g = secular_roots(da, za, strength)
    n = len(da)
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    den = np.where(i < j, da[:, None] - da, np.append(da[1:], 0)[:, None] - da)
    den[-1] = strength
    own = np.sqrt(np.maximum((-g / den).prod(0), 0)) * np.where(za < 0, -1, 1)
    turn = own / g
    turn /= np.sqrt((turn * turn).sum(1))[:, None]
    d, q = d.copy(), q.copy()
    d[active], q[:, active] = roots, q[:, active] @ turn.T
    order = np.argsort(d, kind="stable")[-most:]
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Number of vectors, their exact sums, and the eigenvalues and -vectors of their scatter around their mean."""

    n: int
    sums: list[int]
    d: np.ndarray
    q: np.ndarray

    @staticmethod
    def of_rows(row) -> Spectrum:
        d = np.array(row.d, float)
        return Spectrum(int(row.n), [int(s) for s in row.sums], d, np.array(row.q, float).reshape(len(row.sums), len(d)))

    def fields(self) -> tuple:
        return self.n, [str(s) for s in self.sums], self.d.tolist(), self.q.ravel().tolist()

    def merged(self, other: Spectrum, most: int) -> Spectrum:
        """Both together: one update for each direction of the other one, and one for the distance of the means."""
        d, q = self.d, self.q
        for k in range(len(other.d)):
            if other.d[k] > 0:
                d, q = rank_one(d, q, np.sqrt(other.d[k]) * other.q[:, k], most)
        apart = np.array([(other.n * a - self.n * b) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        d, q = rank_one(d, q, np.sqrt(self.n * other.n / (self.n + other.n)) * apart, most)
        return Spectrum(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums)], d, q)


def whole_numbers(column: pa.Array, dim: int) -> np.ndarray:
    """The x-vectors of a column of vectors, one a row."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def column_sums(x: np.ndarray) -> list[int]:
    safe = not x.size or float(np.abs(x).max()) * len(x) < 2**62
    return [int(s) for s in (x if safe else x.astype(object)).sum(axis=0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """(n x - S) / n: the difference is taken in whole numbers, so nothing cancels."""
    return _differences(x, n, sums).astype(float) / n


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    if x.size and float(np.abs(x).max()) * n + max(map(abs, sums)) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def exact_deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2 of each row."""
    e = _differences(x, n, sums)
    if e.dtype != object and e.size and float(np.abs(e).max()) ** 2 * e.shape[1] >= 2**62:
        e = e.astype(object)
    return [int(s) for s in (e * e).sum(axis=1)]


def _spectra(dim: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, base, mean = 0, [0] * dim, None, np.zeros(dim)
        d, q = np.zeros(0), np.zeros((dim, 0))
        for b in batches:
            x = whole_numbers(b.column(0), dim)
            if not len(x):
                continue
            base = x[0].copy() if base is None else base  # means are kept as distances from one vector
            sums = [a + s for a, s in zip(sums, column_sums(x))]
            for row in (x - base).astype(float):
                apart = row - mean
                if n:
                    d, q = rank_one(d, q, apart * np.sqrt(n / (n + 1)), most)
                n += 1
                mean += apart / n
        if n:
            fields = (TaskContext.get().partitionId(), *Spectrum(n, sums, d, q).fields())
            numbers = pa.list_(pa.float64())
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.string()), numbers, numbers)
            yield pa.RecordBatch.from_arrays([pa.array([f], k) for f, k in zip(fields, kinds)], names=["part", "n", "sums", "d", "q"])

    return run


def _sums_of(work: Callable[[np.ndarray], np.ndarray], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a task: its number and the sum over its batches of the arrays that work gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = work(whole_numbers(b.column(0), dim))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.ravel().tolist()])], names=["part", "v"])

    return run


def in_rounds(states: DataFrame, merge: Callable[[pd.DataFrame], tuple]) -> tuple | None:
    """The one state that is left of (part, ...) when FAN_IN neighbouring parts are merged in each round; none of none.

    A task never holds more than FAN_IN states. The driver gets the last one alone.
    """
    states = cut(states)
    left = (states.agg(F.max("part")).first()[0] or 0) + 1
    schema, names = states.schema, states.columns

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame([(rows["part"].iloc[0], *merge(rows))], columns=names)

    while left > 1:
        left = -(-left // FAN_IN)
        rows = states.withColumn("part", F.floor(F.col("part") / FAN_IN).cast(schema["part"].dataType))
        states = rows.repartition(min(left, 2000), "part").groupBy("part").applyInPandas(step, schema)
    got = states.collect()
    return got[0] if got else None


def _added(rows: pd.DataFrame) -> tuple:
    return (np.sum([np.array(v, float) for v in rows["v"]], axis=0).tolist(),)


@dataclass
class Whitening:
    """Fitted on n vectors: exact sums, and the leading components with their eigenvalues and shares of the trace."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of x-vectors; those of a zero eigenvalue are not numbers."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return centred(x, self.n, self.sums) @ self.vectors * scale


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that remain, and their dimension."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    usual = rows.groupBy(F.size("v").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("k")).first()
    dim = usual["k"] if usual else 0
    return rows.where(F.size("v") == dim), dim


def fit(rows: DataFrame, dim: int, components: int = 8, rank: int = 128) -> Whitening | None:
    """The components of all rows (vec_id, v), or none without rows.

    1. Each partition takes its vectors one by one: a centred rank-one update of its spectrum. Spectra meet in rounds,
       each merged by successive rank-one updates. At most `rank` directions are carried.
    2. Rayleigh-Ritz: the covariance times the basis is summed over all partitions, again in rounds, and the small
       projected problem gives the components. With a basis of all dimensions this is exact to rounding. With fewer it is
       repeated, with the residuals added to the basis, until the residuals are rounding alone or the basis is whole.
    """
    v = rows.select("v")
    most = min(dim, max(rank, components))
    state = "part int, n long, sums array<string>, d array<double>, q array<double>"

    def merge(parts: pd.DataFrame) -> tuple:
        out = None
        for row in parts.itertuples():
            s = Spectrum.of_rows(row)
            out = s if out is None else out.merged(s, most)
        return out.fields()

    got = in_rounds(v.mapInArrow(_spectra(dim, most), state), merge)
    if got is None:
        return None
    spectrum = Spectrum.of_rows(got)
    n, sums, k = spectrum.n, spectrum.sums, min(components, dim)
    basis = spectrum.q[:, ::-1]
    if basis.shape[1] < k:
        basis = np.column_stack([basis, np.eye(dim)])
    basis = np.linalg.qr(basis)[0][:, : max(k, spectrum.q.shape[1])]
    while True:

        def times(x: np.ndarray, q=basis) -> np.ndarray:
            c = centred(x, n, sums)
            return np.append(c.T @ (c @ q), (c * c).sum())

        y = np.array(in_rounds(v.mapInArrow(_sums_of(times, dim), "part int, v array<double>"), _added)["v"])
        trace, y = y[-1] / n, y[:-1].reshape(dim, -1) / n
        h = basis.T @ y
        e, w = np.linalg.eigh((h + h.T) / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        left = y @ w - (basis @ w) * e
        r = basis.shape[1]
        if r == dim or np.abs(left).max(initial=0) <= 64 * EPS * max(trace, 0):
            break
        basis = np.linalg.qr(np.column_stack([basis, left]))[0]
    e = np.where(e > ZERO * trace, e, 0.0)
    share = [float(x / trace) if trace > 0 else None for x in e]
    out = Whitening(dim, n, sums, e, basis @ w, share)
    live = np.flatnonzero(e > 0)
    if len(live):
        out.identity_error = _identity_error(v, out, live)
    return out


def _identity_error(v: DataFrame, model: Whitening, live: np.ndarray) -> float:
    """Largest absolute entry of the covariance of what `project` gives, minus the identity: centred in each partition,
    partitions joined with the distance of their means."""
    k = len(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                w = model.project(whole_numbers(b.column(0), model.dim))[:, live]
                mean = w.mean(0)
                now = len(w), mean, (w - mean).T @ (w - mean)
                total = now if total is None else joined(total, now)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([[float(total[0]), *total[1], *total[2].ravel()]])], names=["part", "v"])

    def joined(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    def merge(rows: pd.DataFrame) -> tuple:
        out = None
        for x in rows["v"]:
            x = np.array(x, float)
            now = x[0], x[1 : k + 1], x[k + 1 :].reshape(k, k)
            out = now if out is None else joined(out, now)
        return ([float(out[0]), *out[1], *out[2].ravel()],)

    x = in_rounds(v.mapInArrow(run, "part int, v array<double>"), merge)["v"]
    return float(np.abs(np.array(x[k + 1 :]).reshape(k, k) / x[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, rank: int = 128) -> DataFrame:
    """Whitened coordinates of every usable vector: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error, deviation_exact; one row a vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out. An entry c becomes the whole number
    x = floor(1024 c) + 100000. Components are eigenvectors of x's covariance (see `fit`), fitted on all vectors that
    are left; whitened is the centred vector's projection over the root of the eigenvalue. deviation is the exact sum of
    (n x - S)^2, null where a long cannot hold it (deviation_exact, a decimal of 38 digits, null beyond these).
    identity_error is how far the covariance of whitened, taken over all vectors, lies from the identity.

    Vectors whose length is not the most frequent one (of two equally frequent lengths the larger) are left out. An
    entry beyond 2^43 counts as 2^43. With fewer dimensions than `components` there are fewer components. A component whose
    eigenvalue is zero (vectors that lie in a smaller space, one vector, equal vectors) has null whitened and explained 0,
    or null if all vectors are equal. Equal eigenvalues: any base of their space. Repeated rows count as often as they
    occur; a null vec_id is kept. No usable vector: no rows. Other columns are ignored, whatever their names. A state
    holds dim * rank numbers; memory does not follow the rows.
    """
    ship(vectors.sparkSession)
    rows, dim = usable(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    model = fit(rows, dim, components, rank) if dim else None
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        k = len(model.values)
        for b in batches:
            x = whole_numbers(b.column(1), dim)
            m = len(x)
            exact = exact_deviations(x, model.n, model.sums) if m else []
            short = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()),
                    short.take(each),
                    pa.array(model.project(x).ravel(), pa.float64(), from_pandas=True),
                    pa.array(model.explained * m, pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                    pa.array([str(e) if e < 10**38 else None for e in exact], pa.string()).take(each),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return rows.mapInArrow(run, schema).withColumn("deviation_exact", F.col("deviation_exact").cast("decimal(38,0)"))
