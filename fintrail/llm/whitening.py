"""Embedding whitening by shifted CholeskyQR: distributed Gram passes, triangular solves, and an SVD of the small factor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fintrail.llm.common import stored

SCALE, OFFSET = 64, 1_000_000  # lattice of the entries: floor(SCALE * entry) + OFFSET
REACH = float(1 << 40)         # lattice values are held within this distance of 0, so that sums stay exact
COMPONENTS = 16
ROUNDS = 8                     # greatest number of Gram passes; well-conditioned vectors take three
CALM = 1e-6                    # distance of a Gram matrix from the identity at which rounds may stop
FLAT = 1e-8                    # Gram eigenvalues under this belong to directions in which the vectors do not vary
NULL = 1e-13                   # singular values under this share of the greatest count as zero
ROWS = 1 << 22                 # vector entries that one step holds
UNIT = np.finfo(np.float64).eps / 2


@dataclass
class Whitening:
    """A fitted transform. `axes` has a row for each component; `identity_error` is None until it has been measured."""
    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    rounds: int
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus its mean: the whole part is taken off in integers, so that no digits go lost."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ (self.axes[:k] / np.sqrt(self.variances[:k, None])).T

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sums) squared, as exact integers of any size."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n for s in self.sums], np.int64)
        d = x - whole
        most = (int(np.abs(d).max(initial=0)) + 1) * self.n
        if most * most * max(1, self.dimension) < 1 << 63:
            return ((d * self.n - part) ** 2).sum(axis=1).tolist()
        return ((d.astype(object) * self.n - part.astype(object)) ** 2).sum(axis=1).tolist()


def usable(column: str) -> "F.Column":
    """Whether a vector has entries, all of them finite."""
    c = F.col(column)
    return (F.size(c) > 0) & F.coalesce(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))


def lattice(vectors: DataFrame, column: str, dimension: int | None = None) -> DataFrame:
    """Rows with a usable vector of the wanted dimension, `column` replaced by its lattice values."""
    cell = lambda e: (F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), e.cast("double") * SCALE))) + OFFSET).cast("long")
    v = vectors.where(usable(column))
    if dimension is not None:
        v = v.where(F.size(column) == dimension)
    return v.withColumn(column, F.transform(column, cell))


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of bounded size with their vectors as a matrix of integers."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            d = max(1, len(b.column(column)[at]))
            piece = b.slice(at, max(1, ROWS // d))
            flat = pc.list_flatten(piece.column(column)).to_numpy(zero_copy_only=False)
            yield piece, flat.reshape(piece.num_rows, -1)
            at += piece.num_rows


def _summed(fit: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of r r' for the rows r that `rows_of` makes of a matrix.

    Each task adds up its own rows; Spark adds up the tasks' cells. The driver gets width * (width + 1) / 2 cells.
    """
    i, j = np.triu_indices(width)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, "x"):
            r = rows_of(x)
            g = r.T @ r
            total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])
    cells = fit.mapInArrow(gram, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[cells["i"], cells["j"]] = cells["v"]
    out[cells["j"], cells["i"]] = cells["v"]
    return out


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches, "x"):
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([len(x)] * d, pa.int64()), pa.array(x.sum(axis=0))],
                                             names=["i", "n", "s"])
    total = (fit.mapInArrow(part, "i int, n long, s long").groupBy("i")
             .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect())
    return (int(total[0]["n"]), [int(r["s"]) for r in total]) if total else (0, [])


def _solve_right(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q times the inverse of the upper triangle r, by substitution."""
    out = np.array(q, order="F")
    for k in range(r.shape[0]):
        out[:, k] = (out[:, k] - out[:, :k] @ r[:k, k]) / r[k, k]
    return out


def fit_list(x: DataFrame, column: str) -> DataFrame:
    """Each different lattice vector once, stored: all passes of the fit read these rows."""
    return stored(x.select(F.col(column).alias("x")).distinct(), "whitening-fit")


def common_dimension(vectors: DataFrame, column: str) -> int | None:
    """The length that most usable vectors have (of equal counts the greater one); None without any."""
    sizes = vectors.where(usable(column)).groupBy(F.size(column).alias("d")).count().where("d > 0")
    top = sizes.agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()
    return top["d"]


def fit(fits: DataFrame) -> Whitening | None:
    """Fits the whitening transform to a stored list of different lattice vectors (column x). None for an empty list.

    With A the centred rows: a first pass takes the Gram matrix of A, adds a shift that makes its Cholesky factor exist,
    and replaces A by A R^-1 (not stored: each task solves for its rows again). Further passes do the same to what is
    left, until the rows are orthonormal in every direction in which they vary. The product of the R factors is then
    A's own R factor, and its SVD gives the components and their variances without A' A ever being squared up.
    """
    n, sums = _sums(fits)
    if n == 0:
        return None
    d = len(sums)
    start = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0, 0)
    factors: list[np.ndarray] = []
    total = np.eye(d)
    for round_no in range(ROUNDS):
        held = list(factors)

        def rows_of(x: np.ndarray) -> np.ndarray:
            q = start.centred(x)
            for r in held:
                q = _solve_right(q, r)
            return q
        g = _summed(fits, rows_of, d)
        size = float(np.trace(g))
        if size == 0:
            return replace(start, rounds=round_no + 1)
        spread = np.linalg.eigvalsh(g)
        shift = 11 * d * (d + 1) * UNIT * size * np.eye(d)
        try:
            r = np.linalg.cholesky(g + shift if round_no == 0 else g).T
        except np.linalg.LinAlgError:          # directions without variance are left
            r = np.linalg.cholesky(g + shift).T
        factors.append(r)
        total = r @ total
        calm = np.abs(spread - 1) <= CALM
        if round_no and calm.all() or round_no > 1 and (calm | (spread < FLAT)).all():
            break
    _, sigma, axes = np.linalg.svd(total)
    live = sigma > NULL * sigma[0]
    variances = sigma[live] ** 2 / n
    return replace(start, axes=axes[live], variances=variances, trace=float((sigma ** 2).sum() / n), rounds=len(factors))


def with_identity_error(fits: DataFrame, w: Whitening, k: int = COMPONENTS) -> Whitening:
    """Measures by one more pass how far the covariance of the whitened fit list is from the identity."""
    k = min(k, len(w.variances))
    if k == 0:
        return replace(w, identity_error=0.0)
    ones = lambda x: np.column_stack([w.whitened(x, k), np.ones(len(x))])
    g = _summed(fits, ones, k + 1) / w.n
    covariance = g[:k, :k] - np.outer(g[:k, k], g[:k, k])
    return replace(w, identity_error=float(np.abs(covariance - np.eye(k)).max()))


def whiten(vectors: DataFrame, w: Whitening, id_col: str, column: str, k: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: id_col, component (from 1), deviation (decimal), whitened, explained."""
    k = min(k, len(w.variances))
    x = lattice(vectors.select(vectors[id_col].alias("id"), vectors[column].alias("x")), "x", w.dimension)
    share = w.variances[:k] / w.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in _matrices(batches, "x"):
            if k:
                at = np.repeat(np.arange(b.num_rows), k)
                far = pa.array([str(v) for v in w.deviation(m)])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                     far.take(pa.array(at)), pa.array(w.whitened(m, k).ravel()), pa.array(np.tile(share, b.num_rows))],
                    names=["id", "component", "deviation", "whitened", "explained"])
    kind = x.schema["id"].dataType.simpleString()
    out = x.mapInArrow(run, f"id {kind}, component int, deviation string, whitened double, explained double")
    return out.select(F.col("id").alias(id_col), "component", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
                      "whitened", "explained")


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding",
                        k: int = COMPONENTS) -> DataFrame:
    """Fits on the different lattice vectors and whitens every row that has a usable one.

    Returns id_col, component, n, deviation, whitened, explained, identity_error. Rows whose vector is null, empty, or
    holds null or non-finite entries, and rows whose vector is not as long as most, give no row. Entries beyond
    2^40 / 64 count as that. Directions without variance are no components, so an empty table and vectors that are all
    alike give no row. Eigenvalues that are equal leave their components free within their space, which one SVD then
    fixes for all rows. Repeated rows and null ids each give their own rows and count once in the fit. Other columns
    are not read, so none can clash. `deviation` is null where it takes more than 38 digits.
    """
    v = vectors.select(vectors[id_col].alias(id_col), vectors[column].alias(column))
    fits = fit_list(lattice(v, column, common_dimension(v, column) or 0), column)
    w = fit(fits)
    if w is None:
        w = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    w = with_identity_error(fits, w, k)
    return whiten(v, w, id_col, column, k).select(
        id_col, "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(w.identity_error).alias("identity_error"))
