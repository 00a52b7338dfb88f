"""Operator 12: embedding whitening by cyclic Jacobi.

Vectors become whole numbers, floor(``scale`` * c) + ``shift``, so counts and sums
over the fit list (each distinct vector once) are exact. Passes over it:

1. its size n and the sums S of each dimension;
2. the centred scatter matrix: each task adds up its products of (n x - S) / n and
   sends d rows of d sums; Spark adds those by row;
3. the driver, which holds nothing but the d x d matrix, turns it by Jacobi
   rotations in cyclic rounds of disjoint pairs until every entry off the diagonal
   is below the rounding of its own two diagonal entries, which leaves small
   eigenvalues with full relative accuracy; eigenvectors are sorted by falling eigenvalue;
4. the whitening matrix (d x ``top``) goes to all tasks; a pass over the fit list
   measures the covariance of what it gives, and the rows are whitened where they lie.

Defined cases: rows whose vector is null, empty or holds null, NaN or infinite
entries are dropped; so are vectors with an entry that is no long after scaling, and
those of another length than the commonest (of equally common ones the shortest); an empty table gives no rows; repeated rows and
``vec_id`` values, null ones too, each give rows of their own; a component without
variance (eigenvalue under d * 2^-52 of the trace) has null ``whitened``; a
``deviation`` beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.scratch import Scratch

_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """n and the sums of the fit list, eigenvalues (falling), eigenvectors (columns), trace, and the measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None = None

    def matrix(self) -> np.ndarray:
        """Eigenvectors over the root of their eigenvalues; NaN where there is no variance."""
        sound = self.values > len(self.sums) * 2.0**-52 * self.trace
        return self.vectors / np.sqrt(np.where(sound, self.values, np.nan))


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns) of a symmetric positive semidefinite matrix."""
    d = len(matrix)
    size = d + d % 2
    a, v = np.zeros((size, size)), np.eye(size)
    a[:d, :d] = (matrix + matrix.T) / 2
    seats = np.arange(size)
    for _ in range(sweeps):
        turned = False
        for _ in range(size - 1):  # each round pairs all dimensions anew, each with one other
            p, q = seats[: size // 2], seats[: size // 2 - 1 : -1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            off, x, y = a[p, q], a[p, p], a[q, q]
            big = np.abs(off) > 2.0**-53 * np.sqrt(np.abs(x) * np.abs(y))
            if not big.any():
                continue
            turned = True
            p, q, off, x, y = p[big], q[big], off[big], x[big], y[big]
            with np.errstate(over="ignore", divide="ignore"):
                theta = (y - x) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.sqrt(1 + theta * theta))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            for m in (a.T, v.T):  # columns p and q, of both matrices
                m[p], m[q] = c[:, None] * m[p] - s[:, None] * m[q], s[:, None] * m[p] + c[:, None] * m[q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, p], a[q, q], a[p, q], a[q, p] = x - t * off, y + t * off, 0.0, 0.0
        if not turned:
            break
    values = np.diag(a)[:d]
    order = np.argsort(-values, kind="stable")
    return values[order], v[:d, :d][:, order]


def whole_vectors(rows: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x array<long>) of the rows with a sound vector, all of one length."""
    sound = rows.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("c")).where(f"size(c) > 0 AND forall(c, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < {2.0**62 / scale}D)")
    kind = sound.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = kind["d"] if kind else 0
    return sound.where(f"size(c) = {d}").select("vec_id", F.expr(f"transform(c, e -> CAST(floor(e * {scale}) AS BIGINT) + {shift})").alias("x"))


def _stack(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as longs, or as Python's integers where longs could overflow."""
    if n * max(int(x.max(initial=0)), -int(x.min(initial=0))) < 1 << 61 and all(abs(s) < 1 << 61 for s in sums):
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield _stack(batch.column(0).slice(i, _ROWS))


def _scattered(fit: DataFrame, d: int, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of y y' with y = (n x - S) / n, or with that times ``project``."""
    k = d if project is None else project.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for x in _matrices(batches, d):
            y = (_apart(x, n, sums) / n).astype(float)
            if project is not None:
                y = y @ project
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k)), pa.array(np.tile(np.arange(k), k)), pa.array(total.ravel())], ["i", "j", "s"])

    out = np.zeros((k, k))
    for i, j, s in fit.select("x").mapInArrow(add, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s")).collect():  # k x k rows
        out[i, j] = s
    return out


def fit_whitening(vectors: DataFrame, scratch: Scratch, top: int = 16) -> Whitening | None:
    """The whitening of ``vectors`` (x), each distinct one once; None if there are none. Its covariance is measured on its ``top`` components."""
    fit = scratch.table("fit", vectors.select("x").distinct())
    first = fit.select(F.size("x")).first()
    if first is None:
        return None
    d = first[0]
    got = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k].cast("decimal(19,0)")) for k in range(d)]).first()
    n, sums = got[0], [int(s) for s in got[1:]]
    covariance = _scattered(fit, d, n, sums) / n
    values, basis = jacobi(covariance)
    found = Whitening(n, sums, values, basis, float(np.trace(covariance)))
    matrix = found.matrix()[:, :top]
    sound = matrix[:, ~np.isnan(matrix).any(axis=0)]
    error = float(np.abs(_scattered(fit, d, n, sums, sound) / n - np.eye(sound.shape[1])).max()) if sound.shape[1] else None
    return Whitening(n, sums, values, basis, found.trace, error)


def whiten(vectors: DataFrame, by: Whitening, top: int = 16) -> DataFrame:
    """``vectors`` (vec_id, x) by component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    n, sums, matrix = by.n, by.sums, by.matrix()[:, :top]
    k, d = matrix.shape[1], len(sums)
    explained = (by.values / by.trace if by.trace else by.values)[:k]
    error = by.error

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                apart = _apart(_stack(part.column(1)), n, sums)
                if apart.dtype != object and d * float(np.abs(apart).max(initial=0)) ** 2 < 2.0**62:
                    deviation = pa.array((apart * apart).sum(axis=1))
                else:
                    wide = [sum(e * e for e in row) for row in apart.tolist()]
                    deviation = pa.array([w if w < 1 << 63 else None for w in wide], pa.int64())
                each = np.repeat(np.arange(len(part)), k)
                whitened = ((apart / n).astype(float) @ matrix).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(each), n)),
                        deviation.take(pa.array(each)), pa.array(whitened, mask=np.isnan(whitened)), pa.array(np.tile(explained, len(part))), pa.array([error] * len(each), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(work, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened_rows(rows: DataFrame, top: int = 16) -> DataFrame:
    """Whitening of ``rows`` (vec_id, embedding) fitted on their distinct vectors, applied to every sound row."""
    scratch = Scratch(rows.sparkSession, "whitening")
    vectors = whole_vectors(rows)
    by = fit_whitening(vectors, scratch, top)
    if by is None:
        return whiten(vectors.where("false"), Whitening(1, [0], np.zeros(1), np.eye(1), 0.0), top)
    return whiten(vectors, by, top)
