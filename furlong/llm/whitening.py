"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, SHIFT = 1024, 100_000


def pivoted_cholesky(a: np.ndarray, tolerance: float = 1e-14) -> np.ndarray:
    """L with L @ L.T = a for a positive semidefinite ``a``: rows in the order of ``a``, one column for each pivot. Pivots are
    the largest remaining diagonal entries, so the factor is triangular but for the order of its rows; it ends where
    the largest is below ``tolerance`` of the first."""
    rest = np.array(a, dtype=np.float64)
    left, columns = np.diag(rest).copy(), []
    stop = tolerance * len(rest) * left.max(initial=0.0)
    open_rows = np.ones(len(rest), bool)
    while open_rows.any():
        p = int(np.argmax(np.where(open_rows, left, -np.inf)))
        if left[p] <= stop or left[p] <= 0:
            break
        c = rest[:, p] / np.sqrt(left[p])
        c[~open_rows] = 0.0
        rest -= np.outer(c, c)
        columns.append(c)
        open_rows[p] = False
        left = np.diag(rest).copy()
    return np.array(columns).T if columns else np.zeros((len(rest), 0))


def tournament(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which each pair of 0..n-1 meets once."""
    seats = list(range(n + n % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < n]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of ``factor @ factor.T``. Pairs of columns are rotated until all
    are orthogonal: their squared norms are the eigenvalues, the normalised columns the eigenvectors. The pairs of a
    round are disjoint and turned at once."""
    m = np.array(factor, dtype=np.float64)
    rounds = tournament(m.shape[1])
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            x, y = m[:, p], m[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            skew = np.abs(c) > tolerance * np.sqrt(a * b)
            if not skew.any():
                continue
            turned = True
            p, q, a, b, c = p[skew], q[skew], a[skew], b[skew], c[skew]
            z = (b - a) / (2 * c)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
            cos = 1 / np.sqrt(1 + t * t)
            x, y = m[:, p], m[:, q]
            m[:, p], m[:, q] = cos * (x - t * y), cos * (y + t * x)
        if not turned:
            break
    norms = (m * m).sum(0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order], m[:, order] / np.sqrt(norms[order])


class Whitening(NamedTuple):
    """A fitted transform: counts and sums of the integer vectors, eigenvalues and unit components (columns)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


def finite_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is there and has only finite entries."""
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(ok)


def blocks(batches: Iterator[pa.RecordBatch], width: int | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of each batch, by length; only those of ``width`` where it is given."""
    for b in batches:
        v = b.column(1)
        size = np.diff(v.offsets.to_numpy())
        flat = v.values.to_numpy(zero_copy_only=False)
        for d in np.unique(size) if width is None else [width]:
            own = np.flatnonzero(size == d)
            if len(own):
                at = v.offsets.to_numpy()[own][:, None] + np.arange(d)
                x = np.floor(SCALE * flat[at])
                if np.abs(x).max() > 2**40:
                    raise ValueError("embedding entries beyond 2**30 are not supported")
                yield b.column(0).take(pa.array(own)), x.astype(np.int64) + SHIFT


def sums_by_length(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and sum in each dimension, by length: partial sums in tasks, added up by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, x in blocks(batches, None):
            t = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
            t[0] += len(x)
            t[1] += x.sum(0)
        rows = [(d, -1, n) for d, (n, _) in total.items()] + [(d, i, int(s)) for d, (_, sums) in total.items() for i, s in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, ["d", "i", "s"])

    out: dict[int, tuple[int, np.ndarray]] = {}
    found = vectors.mapInArrow(part, "d long, i long, s long").groupBy("d", "i").agg(F.sum("s").alias("s")).collect()
    for d in {r["d"] for r in found}:
        own = {r["i"]: r["s"] for r in found if r["d"] == d}
        out[d] = own[-1], np.array([own[i] for i in range(d)], np.int64)
    return out


def summed_products(vectors: DataFrame, width: int, n: int, sums: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Sum over all vectors of y @ y.T, y = onto.T @ (x - sums / n). Vectors are centred before they are multiplied: n * x - sums is exact."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((onto.shape[1], onto.shape[1]))
        for _, x in blocks(batches, width):
            y = ((n * x - sums) / n) @ onto
            total += y.T @ y
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((onto.shape[1], onto.shape[1]))
    for r in vectors.mapInArrow(part, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def fit_whitening(vectors: DataFrame, k: int) -> Whitening | None:
    """The transform fitted on all of ``vectors`` (id, v); None where there is no variance. The driver holds sums and
    covariance only: their size is that of one vector and its square, whatever the number of rows."""
    by_length = sums_by_length(vectors)
    if not by_length:
        return None
    width = max(by_length, key=lambda d: (by_length[d][0], -d))
    n, sums = by_length[width]
    covariance = summed_products(vectors, width, n, sums, np.eye(width)) / n
    values, components = one_sided_jacobi(pivoted_cholesky(covariance))
    if not len(values):
        return None
    return Whitening(n, sums, values[:k], components[:, :k], float(np.trace(covariance)))


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, falling eigenvalue), n, deviation, whitened, explained, identity_error of each vector and
    each of the first ``k`` components.

    Entries c become the integers floor(1024 c) + 100000. Rows whose vector is null, empty, or holds a null or non-finite
    entry are left out, and so are vectors of another length than the most frequent one (the shorter of two). Components
    of no variance have no whitened value: fewer than ``k`` come out where the rank is lower, and no rows at all for one
    vector, for equal vectors and for an empty table. Repeated rows and ids, and null ids, each have their rows; ties of
    eigenvalues keep the order of the factor; other columns are ignored. deviation is null beyond 63 bits; entries
    beyond 2**30 are refused.

    Three passes over the vectors add up sums, centred products, and the products of whitened values; no pass shuffles
    more than one small table for each task, and no key is hot. The fourth writes the values."""
    vectors = finite_vectors(rows, id_col, vec_col)
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(vectors.schema["id"].dataType.simpleString())
    fit = fit_whitening(vectors, k)
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    width, count = len(fit.sums), len(fit.values)
    onto = fit.components / np.sqrt(fit.values)
    error = float(np.abs(summed_products(vectors, width, fit.n, fit.sums, onto) / fit.n - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches, width):
            far = fit.n * x - fit.sums
            fits = (far.astype(np.float64) ** 2).sum(1) < 2**63 * (1 - 1e-9)
            deviation = pa.array(np.where(fits, (far * far).sum(1), 0), pa.int64(), mask=~fits)
            place = np.repeat(np.arange(len(x)), count)
            each = np.tile(np.arange(count), len(x))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(place)), pa.array(each + 1, pa.int32()), pa.array(np.full(len(place), fit.n)), deviation.take(pa.array(place)),
                 pa.array(((far / fit.n) @ onto).ravel()), pa.array(fit.values[each] / fit.trace), pa.array(np.full(len(place), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, schema)
