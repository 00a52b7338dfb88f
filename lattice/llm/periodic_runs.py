"""Operator 11: runs of periodic text, by harmonic grid probing.

A run is a stretch of consecutive words whose smallest period is q (words q apart
are equal), of at least max(``least``, 3 q) words, that no neighbouring word
extends. Such a stretch holds three neighbouring points of the grid 0, p, 2p, ...
for p = q, so for each period p only grid points are probed: are the words at jp,
(j+1)p and (j+2)p equal? That is n ln n probes for n words. What survives is extended to
both sides by comparing chunks of doubling length. Grid points within a stretch
that was found, of this period or of a smaller one, are skipped: three
points within a run of a smaller period q can only lie in a stretch of period p that
is the same run again, as two periods of a stretch that long have a common divisor.

Each document is worked on whole, where it lies: nothing is shuffled, and memory
follows the longest document of a batch.

Defined cases: null and blank texts have no words and no runs; a null ``doc_id`` is kept;
rows with equal ``doc_id`` are rows of their own; an empty table gives no rows; other
columns are ignored by the query and kept by ``periodic_runs``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Words of documents whose grids are probed in one step from a stored list of points.
_LISTED = 2048
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


@lru_cache(maxsize=1)
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points jp with period p, ordered by (j+2)p, and how many of them have (j+2)p < n for each n."""
    last = [np.arange(2 * p, _LISTED, p) for p in range(1, _LISTED // 2)]
    period = np.repeat(np.arange(1, len(last) + 1), [len(x) for x in last]).astype(np.int32)
    last = np.concatenate(last).astype(np.int32)
    order = np.lexsort((period, last))
    period, last = period[order], last[order]
    return last - 2 * period, period, np.searchsorted(last, np.arange(_LISTED + 1))


def _survivors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each period in rising order, the grid points whose next two points hold the same word."""
    n = len(words)
    if n <= _LISTED:
        at, period, upto = _grid()
        at, period = at[: upto[n]], period[: upto[n]]
        here = words[at]
        hit = np.flatnonzero(here == words[at + period])
        hit = hit[here[hit] == words[at[hit] + 2 * period[hit]]]
        hit = hit[3 * period[hit] <= n]
        order = np.lexsort((at[hit], period[hit]))
        at, period = at[hit[order]], period[hit[order]]
        cuts = np.flatnonzero(period[1:] != period[:-1]) + 1
        if len(at):
            yield from zip(period[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts))
        return
    for p in range(1, n // 3 + 1):
        grid = words[::p]
        equal = grid[1:] == grid[:-1]
        hit = np.flatnonzero(equal[1:] & equal[:-1])
        if len(hit):
            yield p, hit * p


def _reach(words: np.ndarray, i: int, p: int, step: int) -> int:
    """The last i' from ``i`` on, going by ``step`` (1 or -1), up to which words i' and i' + p are equal without a gap."""
    chunk, n = 32, len(words)
    while True:
        if step > 0:
            to = min(i + 1 + chunk, n - p)
            differ = np.flatnonzero(words[i + 1 : to] != words[i + 1 + p : to + p])
            if len(differ):
                return i + int(differ[0])
            if to >= n - p:
                return max(i, n - p - 1)
            i = to - 1
        else:
            to = max(i - chunk, 0)
            differ = np.flatnonzero(words[to:i] != words[to + p : i + p])
            if len(differ):
                return to + int(differ[-1]) + 1
            if not to:
                return 0
            i = to
        chunk *= 2


def runs_of(words: np.ndarray, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` (numbers that stand for words), ordered by start, then period."""
    found = []
    far = np.zeros(len(words), np.int64)  # the end of the found run that reaches farthest, of those that hold a word
    for p, points in _survivors(words) if len(words) >= least else ():
        end = 0
        for i in points[far[points] <= points + 2 * p].tolist():
            if i + 2 * p < end:
                continue  # within the stretch of this period that was looked at last
            start, end = _reach(words, i, p, -1), _reach(words, i, p, 1) + p + 1
            if end - start >= max(least, 3 * p) and far[start] < end:
                found.append((start, end - start, p))
                far[start:end] = np.maximum(far[start:end], end)
    return sorted(found, key=lambda run: (run[0], run[2]))


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """``words`` with the tail of every tenth document, by the checksum of its id, made periodic."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * -(-(n - a) // p))[: n - a]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """``words`` without those that a run holds after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = 24, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period of each run, in words) and ``collapsed``, the text with one period of each.

    ``change`` may alter the words of a document, given its id, beforehand. Columns of these two names are replaced.
    """
    docs = docs.drop("runs", "collapsed").withColumn("text", F.col("text").cast("string"))
    ids, texts = docs.columns.index("doc_id"), docs.columns.index("text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        for batch in batches:
            runs, collapsed = [], []
            for doc, text in zip(batch.column(ids).to_pylist(), batch.column(texts).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()  # at bytes 9 to 13 and 32
                if change:
                    words = change(doc, words)
                if len(codes) > 300_000:
                    codes.clear()
                known = list(map(codes.get, words))
                if None in known:
                    known = [codes.setdefault(w, len(codes)) for w in words]
                got = runs_of(np.array(known, np.int32), least)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                collapsed.append(_collapsed(words, got))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], [*batch.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(find, StructType([*docs.schema, *StructType.fromDDL(f"runs {_RUNS}"), StructField("collapsed", StringType())]))


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document: its number of runs, the one of the greatest exponent, and digests of runs and collapsed text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = periodic_runs(rows, change=plant).select("doc_id", "runs", "collapsed")
    # runs come by start, then period, so the first of equal exponents is the one asked for
    better = "r.length * b.period > b.length * r.period"
    best = F.expr(f"CASE WHEN size(runs) > 0 THEN aggregate(runs, runs[0], (b, r) -> IF({better}, r, b)) END")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return done.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
