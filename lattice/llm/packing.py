"""Operator 2: best-two-fit packing of token sequences.

A bin is filled greedily with the largest pieces that still fit; then its
smallest piece gives way to two unpacked ones if they fill the widened gap more
tightly. Packing decisions depend on lengths alone, so the packer works on the
histogram of lengths, which has at most ``capacity`` entries however large the
corpus is, and makes a plan of bin patterns with repeat counts. Pieces then
find their places by their rank among pieces of the same length: one shuffle
and one broadcast of the plan (bounded by ``capacity``).

Defined cases: null or empty text is one piece holding the end id; a document
longer than ``capacity`` is cut into full pieces and a shorter last one; an empty
table gives no rows; rows with equal ``doc_id`` are packed as documents of their
own; a null ``doc_id`` is kept; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.llm.scratch import Scratch
from lattice.llm.tokens import encoder

_ROWS = 256


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file, end_id)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                tokens, bounds = encode.encode(part.column(1).to_pylist())
                rows = []
                for doc, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    for k, at in enumerate(range(a, b, capacity)):
                        ids = tokens[at : min(b, at + capacity)]
                        rows.append((doc, k, at - a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(count: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths, repeats) that use up ``count[length]`` pieces of each length."""
    left = count.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    plan = []

    def largest_upto() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    while left.any():
        upto = largest_upto()
        gap, bin_ = capacity, []
        while (one := int(upto[gap])) > 0:
            fits = min(int(left[one]), gap // one)
            bin_ += [one] * fits
            left[one] -= fits
            gap -= fits * one
            if not left[one]:
                upto = largest_upto()
        if gap:
            least = bin_[-1]
            wide = gap + least
            first = np.flatnonzero(left[: wide + 1] > 0)
            if len(first):
                second = upto[np.minimum(wide - first, first)]
                alone = (second == first) & (left[first] < 2)
                second = np.where(alone, upto[first - 1], second)
                total = np.where(second > 0, first + second, 0)
                best = int(total.argmax())
                if total[best] > least:
                    bin_[-1:] = [int(first[best]), int(second[best])]
                    left[least] += 1
                    left[first[best]] -= 1
                    left[second[best]] -= 1
        kinds, uses = np.unique(bin_, return_counts=True)
        again = int((left[kinds] // uses).min())
        left[kinds] -= again * uses
        plan.append((sorted(bin_, reverse=True), again + 1))
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> list[tuple]:
    """Rows (length, from_rank, to_rank, first sequence, pieces of it in each, offsets)."""
    rows, sequence, taken = [], 0, {}
    for bin_, repeats in plan:
        offsets, at = {}, 0
        for length in bin_:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            start = taken.get(length, 0)
            taken[length] = end = start + repeats * len(places)
            rows.append((length, start, end, sequence, len(places), places))
        sequence += repeats
    return rows


def pack(pieces: DataFrame, capacity: int, parts: int = 64) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, ...), a stored table."""
    spark = pieces.sparkSession
    sized = pieces.groupBy("length").count().where("length between 1 and %d" % capacity)
    count = np.zeros(capacity + 1, np.int64)
    for x in sized.collect():  # at most ``capacity`` rows
        count[x["length"]] = x["count"]
    rows = _slots(best_two_fit(count, capacity))
    plan = spark.createDataFrame(rows, "length long, from_rank long, to_rank long, first_sequence long, uses long, offsets array<long>")

    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = (
        parted.groupBy("length", "part").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
        .select("length", "part", "before")
    )
    ranked = parted.withColumn("here", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "part"]).withColumn("rank", F.col("before") + F.col("here"))
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= from_rank AND rank < to_rank")
    return placed.select(
        *pieces.columns,
        F.expr("first_sequence + (rank - from_rank) div uses").alias("sequence_id"),
        F.expr("offsets[cast((rank - from_rank) % uses as int)]").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text).

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.table("pieces", token_pieces(docs, tokenizer_file, end_id, capacity)), capacity)
