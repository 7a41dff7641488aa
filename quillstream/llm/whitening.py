"""Embedding whitening by shifted CholeskyQR."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Half the distance of 1.0 to the next double.
_ROUNDING = 2.0**-53


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(rows: DataFrame, dim: int, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all batches of ``of(rows)``, an array of ``width`` numbers: added up per task, ``width`` rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.float64 if kind == "double" else np.int64)
        for batch in batches:
            total += of(_rows(batch, dim))
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(total)], names=["i", "v"])

    out = np.zeros(width, dtype=np.float64 if kind == "double" else np.int64)
    for row in rows.select("x").mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row["i"]] = row["v"]
    return out


def _lower_solve(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``lower^-1 @ right`` by forward substitution."""
    out = np.array(right, dtype=np.float64)
    for i in range(len(lower)):
        out[i] = (out[i] - lower[i, :i] @ out[:i]) / lower[i, i]
    return out


def triangular_factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram, plus a shift of the diagonal that outweighs rounding where ``shifted``."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * _ROUNDING * max(float(np.linalg.norm(gram, 2)), 1e-300) if shifted else 0.0
    return np.linalg.cholesky(gram + min(shift, float(np.trace(gram)) or 1.0) * np.eye(d)).T


def shifted_cholesky_qr(gram_after: Callable[[list[np.ndarray]], np.ndarray], n: int, most: int = 8, close: float = 1e-12) -> np.ndarray:
    """R (d x d) with X'X = R'R for the rows X of which ``gram_after(factors)`` gives the Gram matrix after triangular solves.

    Each pass factors the Gram matrix of what the factors so far leave of the rows: with a shift while these columns are far
    from orthogonal (the first pass, or a Cholesky that may break down), without one afterwards; R is the product of the
    factors.  The walk ends when the Gram matrix is the identity up to ``close``, or, where X has less than full rank, its eigenvalues
    lie at 1 or 0; what is left of it, its square root, is composed as the last factor.
    """
    factors: list[np.ndarray] = []
    for _ in range(most):
        gram = gram_after(factors)
        values, vectors = np.linalg.eigh(gram)
        if factors and np.all((np.abs(values - 1) < close) | (values < close)):
            break
        factors.append(triangular_factor(gram, n, not factors or values[0] < 0.1))
    else:
        gram = gram_after(factors)
        values, vectors = np.linalg.eigh(gram)
    r = np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T
    for factor in reversed(factors):
        r = r @ factor
    return r


@dataclass(frozen=True)
class Whitening:
    """Mean and leading components of the distinct vectors."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # one unit vector a row
    variances: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = x - self.sums.astype(np.float64) / max(1, self.n)
        return centred @ self.components.T / np.sqrt(self.variances)


def fit_whitening(fit: DataFrame, dim: int, most: int) -> Whitening:
    """Whitening of the vectors in column ``x`` (all of length ``dim``), each row counted once."""
    sums = _summed(fit, dim, dim + 1, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    n, sums = int(sums[-1]), sums[:-1]
    mean = sums.astype(np.float64) / max(1, n)
    upper = np.triu_indices(dim)

    def gram_after(factors: list[np.ndarray]) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            q = (x - mean).T
            for r in factors:
                q = _lower_solve(r.T, q)
            return (q @ q.T)[upper]

        gram = np.zeros((dim, dim))
        gram[upper] = _summed(fit, dim, len(upper[0]), of)
        return gram + np.triu(gram, 1).T

    r = shifted_cholesky_qr(gram_after, n)
    _, spread, directions = np.linalg.svd(r)
    variances = spread**2 / max(1, n)
    real = min(most, int((spread > dim * 8 * _ROUNDING * max(1.0, n**0.5) * (spread[0] if dim else 0.0)).sum()))
    return Whitening(n, sums, directions[:real], variances[:real], float(variances.sum()))


def identity_error(fit: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    k = len(model.variances)

    def of(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return (w.T @ w).ravel()

    return float(np.abs(_summed(fit, dim, k * k, of).reshape(k, k) / model.n - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Exact sums of (n * x - S)^2: integers modulo 2^64 are exact for every value that a long can hold; others are an error."""
    with np.errstate(over="ignore"):
        far = x * np.int64(n) - sums
        exact = (far * far).sum(axis=1)
    near = ((x * float(n) - sums.astype(np.float64)) ** 2).sum(axis=1)
    if len(near) and near.max() >= 2.0**63:
        raise OverflowError("a deviation is beyond 64 bits")
    return exact


def _projected(model: Whitening, dim: int):
    k = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, dim)
            out = model.whitened(x)
            ids = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch(
                [batch.column("vec_id").take(ids), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.repeat(_deviation(x, model.n, model.sums), k)), pa.array(out.ravel())],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return run


def whiten(vectors: DataFrame, *, components: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each vector on the leading whitening components: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries become integers, floor(scale * entry).  Mean, components and variances are those of the distinct integer vectors, which are
    put into a table once (equal vectors meet as partial groups, so copies are cheap) and read by every pass.  The covariance
    is never formed: passes of shifted CholeskyQR over the centred vectors give R, whose singular vectors and values are the components and spreads.
    A task gives one upper triangle of numbers, and the driver adds up one matrix.

    Vectors that are null or hold null or non-finite entries take no part.  Vectors of another length are whitened apart, among
    themselves.  Components without variance (all vectors equal, fewer vectors than components) have no rows, nor have empty
    vectors.  Null ids stay, repeated rows give rows each and are one vector of the fit, tied variances give some basis of their plane, the same for
    all rows.  Integers that leave 64 bits are an error.  An empty table gives no rows.  Other columns are ignored.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v_"))
    usable = raw.where(F.col("v_").isNotNull() & ~F.exists("v_", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = usable.select("vec_id", F.transform("v_", lambda c: F.floor(c * float(scale))).alias("x"))
    fit = written(rows.select("x").distinct(), "whitening-distinct")
    parts = []
    for dim in sorted(r["dim"] for r in fit.select(F.size("x").alias("dim")).distinct().where("dim > 0").collect()):
        own = fit.where(F.size("x") == dim)
        model = fit_whitening(own, dim, components)
        if not len(model.variances):
            continue
        error = identity_error(own, dim, model)
        explained = F.element_at(F.array(*[F.lit(float(v) / model.trace) for v in model.variances]), F.col("component"))
        out = rows.where(F.size("x") == dim).mapInArrow(_projected(model, dim), "vec_id long, component int, deviation long, whitened double")
        parts.append(out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` on their four leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))
