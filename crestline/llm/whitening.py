"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A of the fit list (each distinct vector once, rounded to whole numbers) are never
gathered. A round sends the triangular factor R found so far to the tasks; each solves its rows against it,
Q = A R^-1, and adds up Q^T Q, whose entries are summed per place. The Cholesky factor of that sum is
multiplied onto R. The first sum gets a shift of its diagonal, so it has a factor even where A is almost
singular; later rounds make Q orthogonal to rounding, usually two of them. Then A^T A = R^T R, and the
singular value decomposition of R gives the components: values squared over n are the eigenvalues of the
covariance, right vectors the eigenvectors. Centring is exact up to one rounding per entry: the whole part
of the mean is taken off whole numbers, then its fraction.

The driver holds matrices of dimension x dimension only; the shuffle has one number for each place of such a
matrix and task.

Defined results: vectors that are null, empty, hold null or non-finite entries, or have another length than
most vectors (ties: the longer) take no part; equal vectors count once for the fit and are all returned; a
null vec_id is kept; directions without variance (below about 1e-11 of the largest deviation) are no
components, so a single distinct vector gives no rows; an empty table gives no rows; the sign of a component
makes its largest entry positive; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import query, small_batches, table, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows of an Arrow batch.
ROWS = 4096
#: Rounds after which orthogonality must have been reached; three are usual.
ROUNDS = 8


@dataclass
class Whitening:
    """What a fit returns. ``vectors`` has a column for each component."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole_vectors(table_: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as whole numbers; only rows that take part."""
    c = F.col(column)
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE) + OFFSET)
    rows = table_.filter(c.isNotNull() & (F.size(c) > 0) & ~bad).select("vec_id", x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.filter(F.size("x") == (sizes[0]["size"] if sizes else 0))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([(s % n) / n for s in sums])


def _solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 for an upper triangular r, column by column."""
    q = np.empty_like(a, order="F")
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(fit: DataFrame, width: int, rows: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of m^T m over the matrices that ``rows`` makes of each batch."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                m = rows(batch)
                total += m.T @ m
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((width, width))
    for r in fit.mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of every place."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
                n, total = n + batch.num_rows, part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array([n] * len(total), pa.int64())],
                                             names=["i", "s", "n"])

    found = fit.mapInArrow(add, "i long, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: r["i"])
    return (found[0]["n"], [r["s"] for r in found]) if found else (0, [])


def triangular_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R with R^T R = A^T A for the centred rows A; rows of zeros for directions without variance."""
    d, unit = len(sums), np.finfo(float).eps / 2
    r = np.eye(d)
    for turn in range(ROUNDS):
        gram = _gram(fit, d, lambda batch, r=r: _solved(_centred(_matrix(batch, d), sums, n), r))
        if not gram.trace():
            return np.zeros((d, d))
        low, high = np.linalg.eigvalsh(gram)[[0, -1]]
        if turn and low > 0.5 and high - low < 1e-12 * d:
            return np.linalg.cholesky(gram).T @ r
        if turn > 1 and low < 1e-6:
            # what is still flat after two shifted rounds has no variance; the rest is orthogonal
            values, axes = np.linalg.eigh(gram)
            return np.where(values > 0.5, np.sqrt(np.abs(values)), 0)[:, None] * axes.T @ r
        if not turn or low < 1e-10:
            gram = gram + 11 * (n * d + d * (d + 1)) * unit * high * np.eye(d)
        r = np.linalg.cholesky(gram).T @ r
    raise ArithmeticError(f"rows are not orthogonal after {ROUNDS} rounds")


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance of the distinct vectors of ``x``."""
    small_batches(x.sparkSession, ROWS)
    rows = written(x.select("x").distinct(), "fit")
    n, sums = _sums(rows)
    d = len(sums)
    _, sigma, axes = np.linalg.svd(triangular_factor(rows, n, sums)) if d else (None, np.zeros(0), np.zeros((0, 0)))
    k = min(components, int((sigma > 1e-11 * sigma[0]).sum()) if d else 0)
    vectors = axes[:k].T * np.sign(axes[np.arange(k), np.abs(axes[:k]).argmax(axis=1)]) if k else np.zeros((d, 0))
    values = sigma[:k] ** 2 / max(n, 1)

    def with_ones(batch: pa.RecordBatch) -> np.ndarray:
        white = _centred(_matrix(batch, d), sums, n) @ vectors / np.sqrt(values)
        return np.column_stack([white, np.ones(len(white))])

    error = 0.0
    if k:
        gram = _gram(rows, k + 1, with_ones) / n
        error = float(np.abs(gram[:k, :k] - np.outer(gram[k, :k], gram[k, :k]) - np.eye(k)).max())
    return Whitening(n, sums, vectors, values, sigma[:k] ** 2 / (sigma ** 2).sum() if k else sigma, error)


def whiten(x: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    d, k = len(w.sums), len(w.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows or not k:
                continue
            whole = _matrix(batch, d)
            deviation = ((w.n * whole - np.array(w.sums, np.int64)) ** 2).sum(axis=1)
            white = _centred(whole, w.sums, w.n) @ w.vectors / np.sqrt(w.values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, w.n)),
                 pa.array(np.repeat(deviation, k)), pa.array(white.ravel()), pa.array(np.tile(w.explained, rows)),
                 pa.array(np.full(rows * k, w.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select(F.col("vec_id").cast("long"), "x").mapInArrow(
        project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whole_vectors(table(spark, sf_dir, "embeddings"))
    return whiten(x, fit(x))
