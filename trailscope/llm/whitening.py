"""Whitening of embeddings by shifted CholeskyQR.

Vectors are first put on an integer lattice (``lattice``), so that equality, sums, means and deviations are exact. The model is fitted on
the distinct lattice vectors, so a vector that is repeated over a third of all rows counts once; copies are folded before the shuffle.

*Passes.* The fit rows, less their mean, are the tall matrix A. Each pass solves its rows through the triangular factors found so far and
adds up their Gram matrix: one d x d matrix per task, folded once more in Spark, so the driver receives ``FOLDS`` of them at most. The first Gram matrix
is shifted before its Cholesky factorisation, which then exists whatever the condition number is; the second pass orthogonalises the rows
again, and the third one measures what is left to the identity and takes its root as the last factor. The product of the factors is R of A = QR, and the SVD of R gives the components
(right singular vectors) and eigenvalues (singular values squared over n). Squaring A once, as an eigenvalue
problem of its covariance does, would lose every direction below 1e-8 of the largest; here Q never is worse than orthonormal to rounding.

*Rank.* Directions in which A has no extent (below about 1e-12 of the largest) stay below ``RANK`` in the last Gram matrix and are left out: there are as many components as the rank, up to ``components``.

Results: a vector that is null, or holds nulls, NaN or infinities, has no result (null). Vectors of another length than the most frequent one (ties: the longer) lie in another
space and have none either, as do all when there are no components (empty table, one distinct vector, empty vectors). Entries beyond 2^62 / scale count as that
bound. A ``deviation`` that no long holds is null. Repeated rows get equal results. Memory: d x d doubles per task and factor.
An input column named like the output is replaced, other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trailscope.llm.common import store

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
FACTORS = 2
RANK = 1e-3
FOLDS = 8
_BLOCK_VALUES = 1 << 20
_EPS = float(np.finfo(float).eps)
_EXACT = float(1 << 62)


def is_finite(vector: Column) -> Column:
    """True where the vector and all its entries are numbers."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, entry), F.lit(False))


def lattice(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The finite vector's entries as longs: floor(scale * entry) + shift; null for others."""
    bound = F.lit(_EXACT)

    def entry(c: Column) -> Column:
        scaled = c.cast("double") * F.lit(float(scale))
        return F.floor(F.greatest(F.least(scaled, bound), -bound)) + F.lit(shift).cast("long")

    return F.when(is_finite(vector), F.transform(vector, entry))


def _blocks(batches, dim: int):
    """Lattice rows as int64 matrices of bounded size, from batches whose first column holds them."""
    rows = max(1, _BLOCK_VALUES // max(dim, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.column(0).slice(at, rows)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


@dataclass
class Whitening:
    """A fitted model. ``factors``: triangular, in the order of the solves; ``rotation``: what turns the solved rows into whitened ones."""

    n: int
    sums: list[int]
    factors: list[np.ndarray]
    rotation: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: int64 where it fits, Python integers otherwise."""
        return _offsets(x, self.n, self.sums)

    def project(self, offsets: np.ndarray) -> np.ndarray:
        rows = (offsets / self.n).astype(float)
        for factor in self.factors:
            rows = solve(rows, factor)
        return rows @ self.rotation


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    y = x - SHIFT
    low = np.array([s - n * SHIFT for s in sums], object)
    largest = n * max((abs(int(v)) for v in (y.min(initial=0), y.max(initial=0))), default=0) + max((abs(v) for v in low), default=0)
    if largest < 1 << 62:
        return n * y - low.astype(np.int64)
    return n * y.astype(object) - low


def deviations(offsets: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None where no long holds it."""
    if not offsets.size:
        return [0] * len(offsets)
    largest = max(abs(int(offsets.min())), abs(int(offsets.max())))
    if largest**2 * offsets.shape[1] < 1 << 63:
        small = offsets.astype(np.int64)
        return (small * small).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in offsets)]


def lattice_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension: a row per task and dimension, added up in Spark."""

    def run(batches):
        n, total = 0, [0] * dim
        for x in _blocks(batches, dim):
            n += len(x)
            y = x - SHIFT
            parts = y.sum(axis=0) if float(np.abs(y.astype(float)).sum()) < _EXACT else y.astype(object).sum(axis=0)
            total = [t + int(p) for t, p in zip(total, parts)]
        totals = [str(v) for v in [n, *[t + n * SHIFT for t in total]]]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array(totals)], ["at", "total"])

    parts = fit.select("x").mapInArrow(run, "at int, total string")
    rows = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # one row per dimension
    found = {r["at"]: int(r["total"]) for r in rows}
    return found[-1], [found[k] for k in range(dim)]


def gram(fit: DataFrame, model: Whitening, mean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and column sums of the fit rows after the model's solves and rotation, less ``mean``."""
    width, dim = model.rotation.shape[1], model.dim

    def run(batches):
        total = np.zeros((width + 1, width))
        for x in _blocks(batches, dim):
            rows = model.project(model.offsets(x))
            if mean is not None:
                rows = rows - mean
            total[:width] += rows.T @ rows
            total[width] += rows.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def fold(batches):
        total = np.zeros((width + 1, width))
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_buffer(), float).reshape(width + 1, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = fit.select("x").mapInArrow(run, "part binary").repartition(FOLDS).mapInArrow(fold, "part binary").collect()
    total = sum((np.frombuffer(r["part"], float).reshape(width + 1, width) for r in parts), np.zeros((width + 1, width)))
    return total[:width], total[width]


def _factor(g: np.ndarray, first: bool) -> np.ndarray:
    """Upper triangular Cholesky factor of a Gram matrix, shifted in the first pass and wherever a pivot is lost in rounding otherwise."""
    d, norm = len(g), float(np.linalg.norm(g, 2))
    shift = 0.0 if not first else 11 * d * (d + 1) * _EPS / 2 * norm
    while True:
        try:
            root = np.linalg.cholesky(g + shift * np.eye(d)).T
            if shift or np.diag(root).min() ** 2 > 16 * d * _EPS * norm:
                return root
        except np.linalg.LinAlgError:
            pass
        shift = max(100 * shift, 11 * d * (d + 1) * _EPS / 2 * norm)


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of ``vectors`` (x array<long>, see ``lattice``); None where there is no component."""
    fit = store(vectors.select("x").where("x IS NOT NULL").distinct(), "whiten-fit")
    length = fit.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if length is None or length["dim"] == 0:
        return None
    dim = length["dim"]
    fit = fit.where(F.size("x") == dim)
    n, sums = lattice_sums(fit, dim)
    model = Whitening(n, sums, [], np.eye(dim), np.zeros((0, dim)), np.zeros(0), np.zeros(0))
    g, total = gram(fit, model)
    if not np.trace(g) > 0:
        return None
    for k in range(FACTORS):
        model.factors.append(_factor(g, first=k == 0))
        g, total = gram(fit, model)
    # The last factor is the root of the measured Gram matrix, in the directions that have any extent.
    extent, turn = np.linalg.eigh(g)
    used = extent > RANK
    root, inverse = np.sqrt(extent[used])[:, None] * turn[:, used].T, turn[:, used] / np.sqrt(extent[used])
    r = root
    for factor in reversed(model.factors):
        r = r @ factor
    left, singular, right = np.linalg.svd(r, full_matrices=False)
    rank = int((singular > singular[0] * dim * 4 * _EPS).sum())
    kept = min(components, rank)
    model.rotation = inverse @ left[:, :kept] * np.sqrt(n)
    model.components = right[:kept]
    model.eigenvalues = singular[:kept] ** 2 / n
    model.explained = singular[:kept] ** 2 / float((singular**2).sum())
    mean = total @ inverse @ left[:, :kept] * np.sqrt(n) / n
    covariance = gram(fit, model, mean)[0] / n
    model.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return model


def whiten(df: DataFrame, model: Whitening | None, x_col: str = "x", out: str = "whitened") -> DataFrame:
    """Add ``out``: a struct of deviation (sum of (n * x - sums)^2) and whitened (one double per component); null where ``x_col`` has no result."""
    kind = "struct<deviation: bigint, whitened: array<double>>"
    if model is None:
        return df.withColumn(out, F.lit(None).cast(kind))

    @arrow_udf(kind)
    def project(x: pa.Array) -> pa.Array:
        rows = max(1, _BLOCK_VALUES // model.dim)
        deviation, whitened = [], []
        for at in range(0, len(x), rows):
            part = x.slice(at, rows)
            offsets = model.offsets(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), model.dim))
            deviation.extend(deviations(offsets))
            whitened.append(model.project(offsets))
        flat = np.concatenate(whitened) if whitened else np.zeros((0, len(model.components)))
        width = flat.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * (len(flat) + 1), width), pa.int32()), pa.array(flat.ravel()))
        return pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], ["deviation", "whitened"])

    fits = F.col(x_col).isNotNull() & (F.size(x_col) == model.dim)
    usable = F.when(fits, F.col(x_col)).otherwise(F.array_repeat(F.lit(SHIFT).cast("long"), model.dim))
    return df.withColumn(out, F.when(fits, project(usable)))
