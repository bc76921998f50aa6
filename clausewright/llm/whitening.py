"""Whitening of embeddings by Chebyshev-filtered subspace iteration (Zhou and Saad, 2007).

The wanted eigenvectors of the covariance V are found without forming V. A block Q of a
few vectors more than wanted is multiplied by V in one distributed pass: every task
centres its rows X, returns the sum of X^T (X Q), and the sums are added up in a tree. A
polynomial in V, built from such passes by the three-term recurrence of Chebyshev, stays
within one on the unwanted part of the spectrum and grows fast above it; the filtered
block is orthogonalised by QR, and Rayleigh-Ritz gives values and vectors. The cut between
wanted and unwanted is the smallest Ritz value of the block, so it sharpens by itself.

It stops when it is certified: the residual |Vq - eq| of every wanted pair is below
``RESIDUAL`` of the largest value (or has stopped falling at the level of rounding), and
fresh random vectors, orthogonal to the block and filtered as it was, hold no value above
the least wanted one. If they do, they join the block and the iteration goes on.

Entries become integers before anything is summed, so sums, deviations and the fit list
(each distinct vector once) are exact. What a task or the driver holds is a block of rows
and matrices of dimension times block; neither grows with the number of rows.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are
dropped. Vectors whose dimension is not the commonest (of equals, the smallest) are
dropped too. Entries beyond 2^46 are held to it. A repeated row gives its own output rows
but counts once in the fit list. Components whose eigenvalue is rounding (below ``RANK`` of
the largest, or of the rounding of the sums) are not given, so one distinct vector gives no
rows; dimensions below the wanted number give fewer. A deviation that no long can hold is
null. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import written

DEGREE = 10
GUARD = 32
RESIDUAL = 1e-14
RANK = 1e-12
PASSES = 300
ROWS = 4096
PART, FEW = 16 << 20, 64
SEED = 23


@dataclass
class Whitening:
    """n distinct vectors with sums S; ``vectors`` has a component per column, ``values`` their eigenvalues."""

    n: int
    sums: list[int]
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    residual: float
    passes: int
    identity_error: float = 0.0


def _integers(vector: Column, scale: int, shift: int) -> Column:
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(2**46))), F.lit(-float(2**46)))
    return F.transform(vector, lambda x: F.floor(held(x)) + F.lit(shift).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: integers of 64 bits where they fit, else of any size."""
    most = max(int(np.abs(x).max(initial=0)), max(map(abs, sums)) // n + 1)
    if most * n * 2 < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors, each as one binary value."""
    for _, x in _blocks(batches, dim):
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary())], ["x"])


class Covariance:
    """V of distinct integer vectors, as something that is multiplied; they are kept in blocks, in as many parts as their size asks for."""

    def __init__(self, rows: DataFrame, dim: int) -> None:
        self.dim, self.passes = dim, 0
        fit = written(rows.select("x").distinct().mapInArrow(lambda b: _packed(b, dim), "x binary"))
        size = fit.agg(F.sum(F.length("x"))).head()[0] or 0
        parts = max(fit.sparkSession.sparkContext.defaultParallelism, -(-size // PART))
        self.fit = fit.coalesce(parts)
        self.parts = min(parts, self.fit.rdd.getNumPartitions())
        self.n, *self.sums = self._added(lambda x: [len(x), *(x.astype(object).sum(axis=0) if int(np.abs(x).max()) >= 2**49 else x.sum(axis=0).astype(object))], [0] * (dim + 1)) if size else [0] * (dim + 1)

    def _added(self, make, zero):
        """The sum of ``make`` over all blocks, by task, and over many tasks in a tree; what is sent has a fixed size."""
        dim, start = self.dim, np.array(zero, object if isinstance(zero, list) else float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = start.copy()
            for b in batches:
                for x in b.column("x"):
                    total = total + make(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["m"])

        sums = self.fit.mapInArrow(run, "m binary")
        if self.parts <= FEW:
            return sum((pickle.loads(r[0]) for r in sums.collect()), start)
        return sums.rdd.map(lambda r: pickle.loads(r[0])).treeReduce(np.add, 2)

    def _pass(self, make, shape: tuple[int, ...]) -> np.ndarray:
        n, sums = self.n, self.sums
        self.passes += 1
        return self._added(lambda x: make((_centred(x, n, sums) / n).astype(np.float64)), np.zeros(shape)) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        return self._pass(lambda x: x.T @ (x @ q), q.shape)

    def trace(self) -> float:
        return float(self._pass(lambda x: (x * x).sum(), ()))

    def identity_error(self, w: np.ndarray) -> float:
        """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
        if w.shape[1] == 0:
            return 0.0
        found = self._pass(lambda x: (x @ w).T @ (x @ w), (w.shape[1], w.shape[1]))
        return float(np.abs(found - np.eye(w.shape[1])).max())


def chebyshev(times, q: np.ndarray, cut: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """A polynomial of V times q that is at most one on [0, cut], scaled to one at ``top``."""
    half = cut / 2
    sigma = half / (top - half)
    first, s = sigma, sigma
    last, now = q, (times(q) - half * q) * (first / half)
    for _ in range(degree - 1):
        then = 1 / (2 / first - s)
        last, now = now, 2 * (then / half) * (times(now) - half * now) - s * then * last
        s = then
    return now


def _ritz(times, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in falling order, their vectors in the span of q, and the residual norms."""
    aq = times(q)
    h = q.T @ aq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(aq @ turn - vectors * values, axis=0)


def eigenpairs(times, dim: int, wanted: int, rng: np.random.Generator, guard: int = GUARD, most: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest ``wanted`` eigenvalues of the symmetric, non-negative V behind ``times``, their vectors, and the largest residual."""
    wanted, passes = min(wanted, dim), 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(q)

    q = np.linalg.qr(rng.standard_normal((dim, min(dim, wanted + guard))))[0]
    values, vectors, residual = _ritz(counted, q)
    before = np.inf
    while True:
        worst, top = residual[:wanted].max(), values[0]
        cut = max(values[-1], 1e-3 * max(values[wanted - 1], 0.0))
        settled = worst <= RESIDUAL * top or (worst <= 1e-11 * top and worst > before / 2)
        if top <= 0 or vectors.shape[1] == dim:
            return values[:wanted], vectors[:, :wanted], float(worst)
        if settled:
            fresh = rng.standard_normal((dim, min(4, dim - vectors.shape[1])))
            inside = vectors @ vectors.T
            probe = fresh - inside @ fresh
            probe = chebyshev(counted, np.linalg.qr(probe)[0], cut, top) if cut < top else probe
            probe = probe - inside @ probe
            probe = np.linalg.qr(probe - inside @ probe)[0]
            found, more, _ = _ritz(counted, probe)
            if found[0] <= values[wanted - 1] * (1 + 1e-10):
                return values[:wanted], vectors[:, :wanted], float(worst)
            vectors = np.hstack([vectors, more])
        elif passes >= most:
            raise RuntimeError(f"not certified after {passes} passes: residual {worst:.2e} of {top:.2e}")
        before = worst
        filtered = chebyshev(counted, vectors, cut, top) if cut < top else vectors
        values, vectors, residual = _ritz(counted, np.linalg.qr(filtered)[0])


def fit(rows: DataFrame, dim: int, components: int) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``rows``; None without rows."""
    v = Covariance(rows, dim)
    if v.n == 0:
        return None
    trace = v.trace()
    values, vectors, residual = eigenpairs(v.times, dim, components, np.random.Generator(np.random.PCG64([SEED, dim])))
    rounding = (np.finfo(float).eps * max(abs(s) for s in v.sums) / v.n) ** 2 * dim
    real = values > max(RANK * max(values[0], 0.0), rounding)
    found = Whitening(v.n, v.sums, trace, vectors[:, real], values[real], residual, v.passes)
    found.identity_error = v.identity_error(found.vectors / np.sqrt(found.values))
    return found


def _applied(model: Whitening, dim: int):
    n, sums, k = model.n, model.sums, len(model.values)
    w, share = model.vectors / np.sqrt(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim):
            c = _centred(x, n, sums)
            most = int(np.abs(c).max(initial=0))
            squares = c * c if most * most * dim < 2**63 else c.astype(object) ** 2
            deviation = [int(d) if d < 2**63 else None for d in squares.sum(axis=1).tolist()]
            white = (c / n).astype(np.float64) @ w
            ids = part.column("id")
            at = np.repeat(np.arange(len(x)), k)
            columns = [ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)), pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(white.ravel()), pa.array(np.tile(share, len(x)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), model.identity_error))], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every sound row and component."""
    spark, v = vectors.sparkSession, F.col(vector_col)
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), _integers(v, scale, shift).alias("x"))
    kind = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    model = fit(rows.where(F.size("x") == common["dim"]), common["dim"], components) if common else None
    if model is None or len(model.values) == 0:
        return spark.createDataFrame([], kind).withColumnRenamed("id", id_col)
    out = rows.where(F.size("x") == common["dim"]).mapInArrow(_applied(model, common["dim"]), kind)
    return out.withColumnRenamed("id", id_col)
