"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations.

The scatter M of the centred vectors is summed over all rows in Spark.  M = L L' by Cholesky with pivoting;
L is square in the dimension, whatever the number of rows.  Rotating pairs of L's columns until all are orthogonal gives
L V = U D: the columns' norms squared are M's eigenvalues, the columns over their norms its eigenvectors.  M is
never multiplied or reduced, so small eigenvalues keep their relative precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.stages import staged

# Numbers of this size and more count as not finite: their whole-number form would leave the range of exact doubles.
LARGEST = float(1 << 40)


def pivoted_cholesky(matrix: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """L (d x rank) with L L' = ``matrix``, symmetric and positive semidefinite; rows in the matrix's own order.

    Each step takes the largest diagonal entry left, and ends once none is above ``tolerance`` of the first."""
    rest = np.array(matrix, np.float64)
    d = len(rest)
    factor = np.zeros((d, d))
    left = np.ones(d, bool)
    first = rest.diagonal().max(initial=0.0)
    for step in range(d):
        diagonal = np.where(left, rest.diagonal(), -np.inf)
        pivot = int(diagonal.argmax())
        if not diagonal[pivot] > tolerance * first:
            return factor[:, :step]
        column = np.where(left, rest[:, pivot], 0.0) / np.sqrt(rest[pivot, pivot])
        factor[:, step] = column
        rest -= np.outer(column, column)
        left[pivot] = False
    return factor


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs, as in a round robin."""
    seats = np.arange(n + n % 2)
    rounds = []
    for _ in range(len(seats) - 1):
        i, j = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
        real = (i < n) & (j < n)
        rounds.append((i[real], j[real]))
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
    return rounds


def jacobi(factor: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of ``factor @ factor.T``.

    Pairs of columns are rotated until all are orthogonal to rounding; disjoint pairs are rotated at once."""
    u = np.array(factor, np.float64)
    rounds = _rounds(u.shape[1])
    for _ in range(sweeps):
        worst = 0.0
        for i, j in rounds:
            a, b = u[:, i], u[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            off = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > tolerance
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            u[:, i], u[:, j] = c * (a - t * b), c * (b + t * a)
        if worst <= tolerance * len(u):
            break
    norms = np.sqrt((u * u).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, u[:, order] / norms[order]


@dataclass(frozen=True)
class Whitening:
    """What a fit list gives: its size, sums, covariance trace, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray  # one column each


def _whole(x: Column) -> Column:
    return (F.floor(x.cast("double") * 1024) + 100_000).cast("long")


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): entries c as whole numbers floor(1024 c) + 100000.

    Rows go whose vector is null, empty, or holds an entry that is null, not finite, or 2**40 and more in size,
    and those of another length than most rows have (of two lengths as frequent the greater stays)."""
    v = F.col("v")
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, good))
    usual = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    rows = rows.where(F.size(v) == (usual[0]["d"] if usual else 0))
    return rows.select("vec_id", F.transform(v, _whole).alias("x"))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scatter(rows: DataFrame, column: str, mean: np.ndarray) -> np.ndarray:
    """Sum over all rows of (x - mean)(x - mean)': one partial matrix per task, added up by entry."""
    d = len(mean)
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            centred = _matrix(batch.column(0), np.float64) - mean if batch.num_rows else np.zeros((0, d))
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "s"]
        )

    parts = rows.select(column).mapInArrow(partial, "i int, j int, s double")
    out = np.zeros((d, d))
    for row in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d (d + 1) / 2 numbers
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["s"]
    return out


def _sums(rows: DataFrame, column: str, kind: str) -> tuple[int, list]:
    """Number of rows and sum of each place of a list column."""
    entries = rows.select(F.posexplode(column).alias("place", "x")).groupBy("place")
    found = entries.agg(F.count("*").alias("n"), F.sum(F.col("x").cast(kind)).alias("s")).collect()  # one row per dimension
    found.sort(key=lambda r: r["place"])
    return (found[0]["n"] if found else 0), [r["s"] for r in found]


def fit(rows: DataFrame) -> Whitening:
    """Components of the whole-number vectors ``rows.x``.  The driver holds d x d numbers, whatever the number of rows."""
    n, sums = _sums(rows, "x", "decimal(20,0)")
    if not n:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    sums = [int(s) for s in sums]
    total = scatter(rows, "x", np.array([_ratio(s, n) for s in sums]))
    values, components = jacobi(pivoted_cholesky(total))
    return Whitening(n, sums, float(np.trace(total)) / n, values / n, components)


def _ratio(s: int, n: int) -> float:
    """The whole number ``s`` over ``n``, rounded once."""
    return s / n


def whiten(rows: DataFrame, model: Whitening, keep: int = 8) -> DataFrame:
    """(vec_id, deviation decimal, whitened array) of each row, for the first ``keep`` components of positive variance.

    ``deviation`` is the sum over dimensions of (n x - S)**2, exact."""
    kept = min(keep, len(model.eigenvalues))
    n, sums = model.n, model.sums
    mean = np.array([_ratio(s, n) for s in sums]) if n else np.zeros(0)
    weights = model.components[:, :kept] / np.sqrt(model.eigenvalues[:kept]) if kept else np.zeros((len(mean), 0))
    exact_sums = np.array(sums, object)
    largest_sum = max(map(abs, sums), default=0)

    def deviations(x: np.ndarray) -> list[int]:
        # n x - S in 64 bits where it fits, and its squares where their sum does; whole numbers of any size otherwise.
        if n * int(np.abs(x).max(initial=0)) + largest_sum < 1 << 62:
            off = x * np.int64(n) - exact_sums.astype(np.int64)
            if int(np.abs(off).max(initial=0)) ** 2 * len(sums) < 1 << 62:
                return (off * off).sum(1).tolist()
            off = off.astype(object)
        else:
            off = x.astype(object) * n - exact_sums
        return (off * off).sum(1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), np.int64)
            white = ((x - mean) @ weights).ravel()
            ends = np.arange(len(x) + 1, dtype=np.int32) * kept
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(white))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([str(d) for d in deviations(x)], pa.string()), lists], ["vec_id", "deviation", "whitened"]
            )

    out = rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whitened(vectors: DataFrame, keep: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    The fit list is all rows that :func:`whole_vectors` leaves.  ``identity_error`` is measured on the whitened rows: the largest entry of
    their covariance less the identity.  Components without variance (equal rows, fewer rows than dimensions) are not given, so
    rows without any variance, and an empty table, give no rows.  Repeated rows and null ids are kept as they are; eigenvalues that are
    equal share their space, and any basis of it may come out."""
    rows = staged(whole_vectors(vectors, id_col, vector_col), "whole-vectors")
    model = fit(rows)
    white = staged(whiten(rows, model, keep), "whitened")
    kept = min(keep, len(model.eigenvalues))
    error = 0.0
    if kept:
        n, sums = _sums(white, "whitened", "double")
        covariance = scatter(white, "whitened", np.array(sums) / n) / n
        error = float(np.abs(covariance - np.eye(kept)).max())
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.eigenvalues[:kept]]).cast("array<double>")
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
