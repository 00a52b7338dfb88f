"""Operator 5: repeated byte strings by threshold-bounded interval expansion.

A string of ``LENGTH`` = 400 bytes is repeated if it starts anywhere else in the
corpus. Building one suffix array over the corpus would pass it through one
place, so suffixes are sorted only where repeats can be:

1. Every 400-byte window has an anchor, its least-hashed 100-byte string (the
   leftmost of equals). The choice depends on the window's bytes alone, so equal
   windows have equal anchors at equal distances. Consecutive windows with one
   anchor form a context of at most 700 bytes.
2. Contexts are grouped by anchor. Contexts that occur twice or more are
   repeated from end to end. Anchors whose contexts all occur once and alone
   are out.
3. For an anchor with several different contexts, its occurrences are sorted by
   what follows (the rows of a Burrows-Wheeler matrix that begin with the
   anchor) with the common prefixes of neighbours. All start in one interval;
   it is extended backward, breadth first, byte by byte: intervals split by the
   preceding byte, the common prefixes of neighbours grow by one, and where one
   reaches 400 the windows that start there are repeated. Expansion ends at the
   window's greatest distance from its anchor, intervals of one row leave.
   One task takes an interval of ``MOST`` contexts at most. Of a larger one, equal
   windows agree on half of the 300 bytes beside the anchor either before it or
   after it, so its contexts are dealt into an interval for each different
   stretch before the anchor and one for each after it; these are narrowed on
   until they are small or have whole windows in common.

Defined cases: null and empty texts have no bytes; texts under 400 bytes lose
nothing; a text may repeat itself; repeated rows count as occurrences of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.bytesops import CODES, mix, powers, prefix_sums, slices, sliding_min, span_hashes
from lattice.llm.scratch import Scratch

LENGTH, GRAM, MOST = 400, 100, 20_000
_OTHER = mix(CODES)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["d", "x", "anchor", "c1", "c2", "lo", "hi", "at"]
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(2)):
            if len(data) < LENGTH:
                continue
            sums = prefix_sums(data, CODES)
            at = np.arange(len(data) - GRAM + 1)
            grams = span_hashes(sums, at, at + GRAM)
            anchor = sliding_min(grams, LENGTH - GRAM + 1) + 0
            anchor = anchor[: len(data) - LENGTH + 1]
            start = np.arange(len(anchor))
            row = np.searchsorted(offsets, start, "right") - 1
            whole = start + LENGTH <= offsets[row + 1]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            lo = np.flatnonzero(new & whole)
            stop = np.flatnonzero(np.concatenate([new[1:] | ~whole[1:], [True]]) & whole)
            if not len(lo):
                continue
            second = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_OTHER[data] * powers(len(data) + 1)[0][: len(data)], out=second[1:])
            own = row[lo]
            base = offsets[own]
            keys = [batch.column(k).slice(first, end - first).take(pa.array(own)) for k in (0, 1)]
            a, b = lo, stop + LENGTH
            yield pa.RecordBatch.from_arrays(
                [
                    *keys, pa.array(grams[anchor[lo]].view(np.int64)), pa.array(span_hashes(sums, a, b).view(np.int64)), pa.array(span_hashes(second, a, b).view(np.int64)),
                    pa.array((lo - base).astype(np.int32)), pa.array((stop - base).astype(np.int32)), pa.array((anchor[lo] - base).astype(np.int32)),
                ],
                names,
            )


def expand(anchors: np.ndarray, texts: list[bytes], ats: np.ndarray) -> list[list[int]]:
    """Distances t to the left of the anchor at which each context has a repeated window.

    ``anchors`` numbers the group of each context; its anchor stands at byte
    ``ats``. A window that starts t bytes before the anchor ends LENGTH - t after.
    """
    n = len(texts)
    sizes = np.array([len(x) for x in texts])
    right = np.full((n, LENGTH), 255, np.uint8)
    left = np.full((n, LENGTH - GRAM + 1), 255, np.uint8)
    for i, (text, at) in enumerate(zip(texts, ats.tolist())):
        tail = np.frombuffer(text, np.uint8, offset=at)[:LENGTH]
        right[i, : len(tail)] = tail
        left[i, :at] = np.frombuffer(text, np.uint8, count=at)[::-1]
    least_t = np.maximum(0, LENGTH - (sizes - ats))
    # rows of each group by what follows the anchor, with the common prefix of neighbours
    order = np.lexsort((np.argsort(np.argsort(right.view(f"S{LENGTH}").ravel(), kind="stable"), kind="stable"), anchors))
    interval = anchors[order].copy()
    common = np.zeros(n, np.int64)
    differ = right[order[1:]] != right[order[:-1]]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common[1:][interval[1:] != interval[:-1]] = -1
    common[0] = -1
    marks: list[tuple[np.ndarray, int]] = []
    for t in range(LENGTH - GRAM + 1):
        hit = common >= LENGTH - t
        both = hit.copy()
        both[:-1] |= hit[1:]
        rows = order[both]
        rows = rows[(t >= least_t[rows]) & (t <= ats[rows])]
        if len(rows):
            marks.append((rows, t))
        # extend all intervals backward by one byte
        key = interval * 256 + left[order, t]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        lcp = np.full(len(moved), -1, np.int64)
        pairs = np.flatnonzero(same)
        if len(pairs):
            cuts = np.stack([moved[pairs - 1] + 1, moved[pairs] + 1], axis=1).ravel()
            lcp[pairs] = np.minimum.reduceat(np.concatenate([common, [LENGTH]]), cuts)[::2]
        keep = same.copy()
        keep[:-1] |= same[1:]
        keep &= ats[order[moved]] > t
        # a row that leaves takes its neighbours' link with it: the next one's common prefix is then with the row before
        if not keep.all():
            gone = ~keep & same
            lcp = _bridge(lcp, keep, same, gone)
        order, interval, common = order[moved][keep], np.cumsum(~same)[keep], lcp[keep]
        if not len(order):
            break
    found: list[list[int]] = [[] for _ in range(n)]
    for rows, t in marks:
        for r in rows.tolist():
            found[r].append(t)
    return found


def _bridge(lcp: np.ndarray, keep: np.ndarray, same: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Common prefixes of kept neighbours: the least over the rows that left between them."""
    if not gone.any() and not (same & keep)[np.flatnonzero(~keep)[np.flatnonzero(~keep) + 1 < len(keep)] + 1].any():
        return lcp
    out, least = lcp.copy(), LENGTH
    for i in range(len(lcp)):
        least = min(least, lcp[i]) if same[i] else -1
        if keep[i]:
            out[i] = least
            least = LENGTH
    return out


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows; rows come sorted by anchor, whole groups are worked on together."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        number = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        out = []
        for row, ts in zip(rows, expand(number, [r[4] for r in rows], np.array([r[5] for r in rows], np.int64))):
            if not row[6]:
                continue
            at, last = row[3] + row[5], None
            for t in sorted(ts, reverse=True):
                if t + 1 == last:  # of the same context: another one of this text may end where this one begins
                    out[-1][3] = at - t + LENGTH
                else:
                    out.append([row[1], row[2], at - t, at - t + LENGTH])
                last = t
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["d", "x", "a", "b"])

    rows: list[tuple] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if len(rows) >= 4000 and row[0] != rows[-1][0]:
                yield done(rows)
                rows = []
            rows.append(row)
    if rows:
        yield done(rows)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = (text or "").encode()
            left, end, removed, runs = [], 0, 0, 0
            last = -1
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > last:
                    left.append(data[max(0, last) : a])
                    runs += 1
                    removed += b - a
                    last = b
                elif b > last:
                    removed += b - last
                    last = b
            left.append(data[max(0, last) :])
            out.append((len(data), removed, runs, hashlib.sha256(b"".join(left)).hexdigest()))
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _narrowed(big: DataFrame, step: int) -> DataFrame:
    """The contexts of ``big`` in two groups each: by ``step`` bytes more before, and by ``step`` bytes more after what their group has in common."""
    own = [c for c in big.columns if c not in ("anchor", "before", "after")]
    left = F.expr(f"substring(context, cast(at - before - {step} + 1 as int), {step})")
    right = F.expr(f"substring(context, cast(at + {GRAM} + after + 1 as int), {step})")
    sides = [
        big.where(f"at >= before + {step}").select(F.xxhash64("anchor", F.lit("before"), left).alias("anchor"), (F.col("before") + step).alias("before"), "after", *own),
        big.where(f"octet_length(context) >= at + {GRAM} + after + {step}").select(F.xxhash64("anchor", F.lit("after"), right).alias("anchor"), "before", (F.col("after") + step).alias("after"), *own),
    ]
    return sides[0].unionByName(sides[1])


def _counted(texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``texts`` with the size k of their groups; groups of one are left out."""
    sizes = scratch.table(f"{name}-sizes", texts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"))
    return scratch.table(name, texts.join(sizes, "anchor"))


def repeated_spans(rows: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(d, x, a, b): byte spans of rows (d, x, text), keyed by (d, x), that repeated windows cover; they may overlap."""
    found = scratch.table("found", rows.select("d", "x", "text").mapInArrow(_contexts, "d long, x long, anchor long, c1 long, c2 long, lo int, hi int, at int"))
    often = scratch.table("often", found.groupBy("anchor").count().where("count > 1").select("anchor"))
    again = scratch.table("again", found.join(often, "anchor"))
    scratch.drop("found", "often")
    kinds = again.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("d", "x", "lo", "hi", "at")).alias("r"))
    kinds = scratch.table("kinds", kinds)
    full = again.join(kinds.where("n > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"], "left_semi")
    spans = full.select("d", "x", F.col("lo").cast("long").alias("a"), (F.col("hi") + LENGTH).cast("long").alias("b"))

    several = scratch.table("several", kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"))
    reps = kinds.join(several, "anchor").select("anchor", "r.*", (F.col("n") == 1).alias("single"), "k")
    cut = F.expr(f"substring(cast(text as binary), lo + 1, hi - lo + {LENGTH})").alias("context")
    texts = rows.dropDuplicates(["d", "x"]).join(reps, ["d", "x"]).select("anchor", "d", "x", F.col("lo").cast("long"), cut, (F.col("at") - F.col("lo")).cast("long").alias("at"), "single", "k")
    texts = scratch.table("contexts", texts.withColumns({"before": F.lit(0), "after": F.lit(0)}))
    rest = LENGTH - GRAM
    while True:
        usual = texts.where(F.col("k") <= most).select("anchor", "d", "x", "lo", "context", "at", "single")
        usual = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_expanded, "d long, x long, a long, b long")
        spans = spans.unionByName(usual)
        big = texts.where(F.col("k") > most).drop("k")
        if big.isEmpty():
            return spans
        step = (rest + 1) // 2
        rest -= step
        texts = _counted(_narrowed(big, step), scratch, f"narrowed-{rest}")
        if not rest:  # what a group has in common is a whole window
            same = F.col("lo") + F.col("at")
            return spans.unionByName(texts.where("single").select("d", "x", (same - F.col("before")).alias("a"), (same + GRAM + F.col("after")).alias("b")))


def remove_repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats) of each of ``docs`` (doc_id, text); repeats: whether anything was removed."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumns({"d": F.coalesce("doc_id", F.lit(-1)), "x": F.xxhash64("text")})
    spans = repeated_spans(keyed, scratch, most).groupBy("d", "x").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(spans, ["d", "x"], "left").select("doc_id", "text", "spans")
    done = joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumn("repeats", F.col("n_removed") > 0)
