"""Whitening of embeddings by their leading principal components, found by block Jacobi-Davidson.

Vectors are fixed to integers, ``floor(256 * c)``; the covariance is over the distinct ones.  It is
never formed.  All the solver asks for is its product with a few directions, one Spark job: every task
centres its blocks, multiplies them with the directions and their transpose with that, and the sums of
the tasks are added.  The driver holds a few vectors of one embedding's length.

Jacobi-Davidson: Rayleigh-Ritz in the search space gives approximate pairs.  For each one that is
wanted and not yet exact, a correction orthogonal to it, to the other approximations and to the locked
vectors is found by a few MINRES steps on the projected equation (the steps of all pairs share one job)
and joins the search space, which restarts from its best vectors when it is full.  A pair is locked
when its residual is at the rounding of the products; ``GUARD`` pairs more than wanted are locked, so
that none is passed over among close eigenvalues.

Scale.  The distinct vectors are shuffled once and written as packed blocks; every product reads the
blocks in place and sends length x directions sums per task, pre-added.  Copies are merged before the
shuffle, so a vector that is a third of all rows costs no more than another.

Defined cases.  Vectors that are null, empty or hold null or non-finite entries give no rows.  The
commonest length counts (of equally common ones the longest); vectors of other lengths give no rows.
Repeated rows and null ids keep their rows.  A component without variance (eigenvalue at rounding of
zero) has no whitened value: null, and ``identity_error`` leaves it out; without any variance
``explained`` and ``identity_error`` are null.  ``deviation`` is null beyond a long.  Fewer dimensions
than components give fewer rows.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_of, stage, table

SCALE = 256
COMPONENTS = 4
#: Pairs locked beyond those wanted, search space, vectors it restarts from, MINRES steps a round.
GUARD, SPACE, RESTART, INNER, ROUNDS = 2, 32, 10, 10, 200
BLOCK_ROWS = 4096
_EPS = float(np.finfo(np.float64).eps)


def fixed_point(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x): the usable vectors as arrays of longs."""
    good = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & good).select(F.col(id_col).alias("id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def packed(distinct: DataFrame, d: int) -> DataFrame:
    """(n, block): the vectors ``x`` in blocks of little-endian 64-bit integers, row by row."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                m = _matrix(b.slice(at, BLOCK_ROWS).column(0), d)
                yield pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int64()), pa.array([m.astype("<i8").tobytes()], pa.binary())],
                                                 names=["n", "block"])

    return distinct.select("x").mapInArrow(run, "n long, block binary")


#: Tasks that add the sums of all tasks; the driver adds theirs.
ADDERS = 8


def summed(blocks: DataFrame, d: int, size: int, kind: str, part) -> np.ndarray:
    """The sum over all blocks of ``part(block)``, ``size`` numbers of numpy type ``kind``: one row per
    task, added by :data:`ADDERS` tasks and the driver."""

    def run(batches):
        out = np.zeros(size, kind)
        for b in batches:
            for block in column_of(b, "block"):
                out += np.asarray(part(np.frombuffer(block, "<i8").reshape(-1, d)), kind).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])

    def add(batches):
        out = np.zeros(size, kind)
        for b in batches:
            for v in column_of(b, "v"):
                out += np.frombuffer(v, kind)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])

    rows = blocks.select("block").mapInArrow(run, "v binary").repartition(ADDERS).mapInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r.v, kind) for r in rows), np.zeros(size, kind))


def _exact_sums(m: np.ndarray) -> list[int]:
    """Rows, then the exact sum of every dimension in two halves, whose sums over any number of blocks
    are exact longs."""
    small = float(np.abs(m.astype(np.float64)).max()) * len(m) < 2**62
    total = [int(v) for v in (m.sum(0) if small else m.astype(object).sum(0))]
    return [len(m), *(v >> 31 for v in total), *(v & 0x7FFFFFFF for v in total)]


@dataclass
class FitList:
    """The distinct vectors in blocks: their number, exact sums, and products with their covariance."""

    blocks: DataFrame
    d: int
    n: int = 0
    sums: list[int] = None  # exact, per dimension
    jobs: int = 0

    def __post_init__(self):
        found = [int(v) for v in summed(self.blocks, self.d, 1 + 2 * self.d, "i8", _exact_sums)]
        self.n = found[0]
        self.sums = [(high << 31) + low for high, low in zip(found[1:1 + self.d], found[1 + self.d:])]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(self.d)

    def total(self, shape: tuple[int, ...], part) -> np.ndarray:
        """The sum over all blocks of ``part(centred block)``, an array of ``shape``, divided by n: one job."""
        mean = self.mean
        self.jobs += 1
        return summed(self.blocks, self.d, int(np.prod(shape)), "f8", lambda m: part(m - mean)).reshape(shape) / self.n

    def times(self, u: np.ndarray) -> np.ndarray:
        """Covariance times the columns of ``u``."""
        return self.total(u.shape, lambda m: m.T @ (m @ u))

    def variances(self) -> np.ndarray:
        return self.total((self.d,), lambda m: (m * m).sum(0))


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of ``new`` outside the given orthonormal columns; columns
    that those span already are left out."""
    out: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):
            for basis in (*against, *([np.stack(out, 1)] if out else [])):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-8:
                break
            v = v / left
        else:
            out.append(v)
    return np.stack(out, 1) if out else np.zeros((len(new), 0))


def minres(apply, right: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Minimal residual solutions of a symmetric operator for every column of ``right`` at once, from
    zero, by ``steps`` Lanczos steps at most; ``apply(columns, which)`` applies it to some columns."""
    d, m = right.shape
    basis = [[] for _ in range(m)]
    band = [np.zeros((steps + 1, steps)) for _ in range(m)]
    beta = np.linalg.norm(right, axis=0)
    out = np.zeros((d, m))
    live = [j for j in range(m) if beta[j] > 0]
    for j in live:
        basis[j].append(right[:, j] / beta[j])
    for k in range(steps):
        if not live:
            break
        w = apply(np.stack([basis[j][k] for j in live], 1), live)
        going = []
        for c, j in enumerate(live):
            v = w[:, c]
            q = np.stack(basis[j], 1)
            h = q.T @ v
            v = v - q @ h
            v -= q @ (q.T @ v)
            t = band[j]
            t[k, k] = h[k]
            if k:
                t[k - 1, k] = t[k, k - 1]
            t[k + 1, k] = size = np.linalg.norm(v)
            start = np.zeros(k + 2)
            start[0] = beta[j]
            y, *_ = np.linalg.lstsq(t[:k + 2, :k + 1], start, rcond=None)
            out[:, j] = q @ y
            if np.linalg.norm(t[:k + 2, :k + 1] @ y - start) > tol * beta[j] and size > 1e-12 * abs(t[:k + 2, :k + 1]).max():
                basis[j].append(v / size)
                going.append(j)
        live = going
    return out


def leading_pairs(times, d: int, wanted: int, largest: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns, of the
    symmetric positive operator ``times(columns)`` on ``d`` dimensions whose trace is ``largest``."""
    wanted = min(wanted, d)
    target = min(wanted + GUARD, d)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, RESTART))))
    image = times(space)
    best = np.full(target, np.inf)  # the smallest residual of the first open pair, to notice rounding
    stalled = 0
    for round_ in range(ROUNDS):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, ritz_image = space @ s, image @ s
        open_ = min(target - locked.shape[1], len(theta))
        residual = ritz_image[:, :open_] - ritz[:, :open_] * theta[:open_]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max([abs(theta[0]), *np.abs(values)])
        limit = 8 * _EPS * np.sqrt(d) * top
        stalled = 0 if size[0] < 0.5 * best[0] else stalled + 1
        best[0] = min(best[0], size[0])
        done = size <= limit
        if stalled >= 3 and size[0] <= 64 * limit:  # as small as the products' rounding lets it be
            done[0] = True
        if done.any():
            take = np.flatnonzero(done)
            locked = np.concatenate([locked, _orthonormal(ritz[:, take], locked)], 1)
            values = np.concatenate([values, theta[take]])[:locked.shape[1]]
            rest = np.setdiff1d(np.arange(len(theta)), take)
            space, image, theta = ritz[:, rest], ritz_image[:, rest], theta[rest]
            ritz, ritz_image = space, image
            residual, size = residual[:, ~done], size[~done]
            best[0], stalled = np.inf, 0
        # all are locked and what is left is smaller: finished
        if locked.shape[1] == d or locked.shape[1] >= target and (not len(theta) or theta[0] <= np.sort(values)[::-1][wanted - 1]):
            break
        if locked.shape[1] >= target:  # a larger one shows up: go on for it
            target = min(target + 1, d)
            continue
        if not space.shape[1]:  # the rest of the space has not been looked at
            space = _orthonormal(np.random.default_rng(seed + round_ + 1).standard_normal((d, RESTART)), locked)
            image = times(space)
            continue
        if space.shape[1] > SPACE:
            space, image = ritz[:, :RESTART], ritz_image[:, :RESTART]
        shifts, fixed = theta[:residual.shape[1]], np.concatenate([locked, ritz[:, :residual.shape[1]]], 1)
        fixed = _orthonormal(fixed)
        out_of = lambda v: v - fixed @ (fixed.T @ v)

        def projected(v, which):
            v = out_of(v)
            return out_of(times(v) - v * shifts[which])

        step = minres(projected, -out_of(residual), INNER, 1e-3)
        new = _orthonormal(np.concatenate([step, residual], 1), locked, space)[:, :residual.shape[1]]
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + round_ + 1).standard_normal((d, 2)), locked, space)
        if not new.shape[1]:  # the space is whole: the pairs are as exact as they get
            locked = np.concatenate([locked, ritz[:, :open_]], 1)
            values = np.concatenate([values, theta[:open_]])
            break
        space, image = np.concatenate([space, new], 1), np.concatenate([image, times(new)], 1)
    else:
        raise ArithmeticError("eigenvectors did not converge")
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], locked[:, order]


@dataclass
class Whitening:
    """A fitted transform; everything in it has the size of a few vectors."""

    d: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None
    jobs: int = 0

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(eigenvalue), not a number where there is no variance."""
        floor = self.d * _EPS * max(self.trace, 0.0)
        return np.array([1 / np.sqrt(e) if e > floor else np.nan for e in self.values])


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct ``x`` vectors; none if there is no vector."""
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    d = sizes.d
    fit_list = FitList(stage(packed(x.filter(F.size("x") == d).select("x").distinct(), d), "whitening-fit"), d)
    trace = float(fit_list.variances().sum())
    values, vectors = leading_pairs(fit_list.times, d, components, trace) if trace > 0 else (
        np.zeros(min(components, d)), np.eye(d)[:, :components])
    found = Whitening(d, fit_list.n, fit_list.sums, values, vectors, trace, jobs=fit_list.jobs)
    use = ~np.isnan(found.scale)
    if use.any():
        to = vectors[:, use] * found.scale[use]

        def moments(m):
            z = m @ to
            return np.concatenate([z.sum(0)[None], z.T @ z])

        k = int(use.sum())
        got = fit_list.total((k + 1, k), moments)
        found.identity_error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())
    return found


def _deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S)^2."""
    bound = n * float(np.abs(m.astype(np.float64)).max(initial=0)) + max(map(abs, sums))
    if bound * bound * m.shape[1] < 2**62:
        t = n * m - np.array(sums, np.int64)
        return (t * t).sum(1).tolist()
    t = n * m.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (t * t).sum(1).tolist()]


def whiten(x: DataFrame, w: Whitening) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row of ``x(id, x)``."""
    kind = x.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    mean = np.array([s / w.n for s in w.sums])
    share = [e / w.trace if w.trace > 0 else None for e in w.values]
    k, scale = len(w.values), w.scale

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(at, BLOCK_ROWS)
                m = _matrix(b.column(1), w.d)
                z = ((m - mean) @ w.vectors) * scale
                rows = np.repeat(np.arange(len(m)), k)
                number = np.tile(np.arange(1, k + 1), len(m))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(np.full(len(rows), w.n), pa.int64()),
                     pa.array(_deviations(m, w.n, w.sums), pa.int64()).take(pa.array(rows)),
                     pa.array(z.reshape(-1), mask=np.isnan(z.reshape(-1))), pa.array(share * len(m), pa.float64()),
                     pa.array([w.identity_error] * len(rows), pa.float64())],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.filter(F.size("x") == w.d).mapInArrow(run, schema)


def whitened(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on ``vectors`` and whiten all of them."""
    x = fixed_point(vectors, id_col, column)
    w = fit(x, components)
    if w is None:
        w, x = Whitening(1, 1, [0], np.zeros(1), np.ones((1, 1)), 0.0), x.limit(0)
    return whiten(x, w)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
