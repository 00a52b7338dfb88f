"""Operator 3: near-duplicate documents by MinHash bands and odd sketches.

Each distinct shingle set gets 128 MinHash samples. 32 bands of 4 samples name
candidates: a pair of similarity 0.75 shares no band with probability 5e-6. The
samples are also folded into a 512-bit parity bitmap (odd sketch); the
population count of two bitmaps' XOR estimates their similarity and lets far
pairs go before any text moves (the cut-off lies 4.5 standard deviations beyond
a pair of exactly 0.75). What is left is confirmed on the full shingle sets.

Copies are folded into one class before banding, buckets are joined up by a
number of links in proportion to their size, and each document first confirms
its most similar candidates only. A second pass then takes every pair of one
bucket that the first left in different components, so no link that joins
components is lost however large the group. There, a shingle that only one
member has can't be in an intersection: where x has c common shingles of n and
the bucket's smallest set has m, no similarity of x exceeds c / (n + m - c), which
settles most of a large family's outliers without comparing them to anyone. The
pairs left are held against odd sketches of the whole sets, which count their
difference almost exactly while it is small.

Defined cases: null, empty and wordless texts have no shingles and are linked
with nothing; under five words the whole sequence is the one shingle; an empty
table gives no rows; rows with equal ``doc_id`` are one document, linked wherever one
of its texts is; rows without ``doc_id`` stay unlinked and are kept; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.llm.bytesops import mix, shingles, slices
from lattice.llm.graph import bucket_links, connected_components, open_buckets, shared_buckets
from lattice.llm.scratch import Scratch

SAMPLES, BANDS, BITS, WORDS = 128, 32, 512, 5
#: Bits of the odd sketch of a whole set, which the last pass reads.
WHOLE = 1024
_random = np.random.default_rng(3)
_A = _random.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def farthest(similarity: float, sigmas: float = 4.5) -> int:
    """XOR population count beyond which a pair of at least ``similarity`` is out of reach."""
    odd = 2 * SAMPLES * (1 - similarity)
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** odd)
    slope = (1 - 2 / BITS) ** odd
    spread = 4 * SAMPLES * similarity * (1 - similarity) * slope**2 + BITS * (mean / BITS) * (1 - mean / BITS)
    return math.ceil(mean + sigmas * math.sqrt(spread))


def samples(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples (rows without values excluded): one row for each non-empty set."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), SAMPLES), np.uint64)
    at = 0
    while at < len(starts):  # a few hundred thousand values at a time stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 100_000)))
        a, b = starts[at], starts[to] if to < len(starts) else len(values)
        part, cuts = values[a:b], starts[at:to] - a
        for k in range(SAMPLES):
            out[at:to, k] = np.minimum.reduceat(part * _A[k] + _B[k], cuts)
        at = to
    return out


def odd_sketches(sample: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as rows of 64-bit words."""
    bit = (mix(sample + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)).astype(np.int64)
    count = np.bincount((np.arange(len(sample))[:, None] * BITS + bit).ravel(), minlength=len(sample) * BITS)
    return np.packbits((count & 1).astype(np.uint8).reshape(len(sample), BITS), axis=1).view(np.int64)


def whole_sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity bitmaps of all values of each non-empty set."""
    size = np.diff(bounds)
    size = size[size > 0]
    bit = (mix(values ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(WHOLE)).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(len(size)) * WHOLE, size) + bit, minlength=len(size) * WHOLE)
    return np.packbits((count & 1).astype(np.uint8).reshape(len(size), WHOLE), axis=1).view(np.int64)


def within_reach(percent: int) -> str:
    """SQL: the whole-set sketches u, v of sets of np and nq shingles allow a similarity of ``percent``, to 6 standard deviations."""
    pop = " + ".join(f"bit_count(u[{i}] ^ v[{i}])" for i in range(WHOLE // 64))
    most = f"((np + nq) * {(100 - percent) / (100 + percent)!r}D)"
    one, two = f"pow({1 - 2 / WHOLE!r}D, {most})", f"pow({1 - 4 / WHOLE!r}D, {most})"
    mean = f"({WHOLE / 2}D * (1 - {one}))"
    return f"{pop} <= {mean} + 1 + 6 * sqrt(greatest(0D, {mean} + {WHOLE * (WHOLE - 1) / 4}D * (1 - 2 * {one} + {two}) - {mean} * {mean}))"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch", "whole"]
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1)):
            values, bounds = shingles(data, offsets, WORDS)
            size = np.diff(bounds)
            some = size > 0
            sample = samples(values, bounds)
            bands = np.zeros((len(sample), BANDS), np.uint64)
            for k in range(SAMPLES // BANDS):
                bands = mix(bands + sample[:, k::4] * np.uint64(2 * k + 1)) + np.arange(BANDS, dtype=np.uint64)
            bands = mix(bands).view(np.int64)
            sketch = odd_sketches(sample)
            whole = np.zeros((2, len(size)), np.uint64)
            if some.any():
                starts = bounds[:-1][some]
                whole[0, some] = np.add.reduceat(mix(values), starts)
                whole[1, some] = np.bitwise_xor.reduceat(mix(values * np.uint64(3) + np.uint64(7)), starts)

            def lists(rows: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))

            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array(size), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), lists(bands), lists(sketch), lists(whole_sketches(values, bounds))], names
            )


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = []
                for column in (2, 3):
                    found = []
                    for _, _, data, offsets in slices(part.column(column)):
                        values, bounds = shingles(data, offsets, WORDS)
                        found += np.split(values, bounds[1:-1])
                    sets.append(found)
                keep = []
                for x, y in zip(*sets):
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1)):
            values, bounds = shingles(data, offsets, WORDS)
            ids = batch.column(0).slice(first, end - first).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(bounds))), pa.array(values.view(np.int64))], ["id", "shingle"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts has (id, text)."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long")


def _star(label: DataFrame) -> DataFrame:
    return label.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union|.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = rows.mapInArrow(_signatures, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>, whole array<long>")
    signed = scratch.table("signed", signed)

    # one class for each distinct set, named by its least doc_id
    key = ["set_a", "set_b", "n_shingles"]
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.table("classes", some.groupBy(*key).agg(F.min("doc_id").alias("id")))
    reps = some.join(classes, key).where("doc_id = id").dropDuplicates(["id", *key])
    shared = scratch.table("shared", shared_buckets(reps.select(F.explode("bands").alias("bucket"), "id")))
    sketches = scratch.table("sketches", reps.select("id", "sketch", "whole", F.col("n_shingles").alias("n")))
    scratch.drop()
    near = " + ".join(f"bit_count(x[{i}] ^ y[{i}])" for i in range(BITS // 64))
    limit = farthest(percent / 100)

    def estimated(pairs: DataFrame) -> DataFrame:
        with_x = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
        return with_x.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", F.expr(near).alias("far")).where(F.col("far") <= limit)

    # first pass: each document's closest candidates
    linked = scratch.table("candidates", estimated(bucket_links(shared)))
    ends = linked.select("a", "b", "far", F.explode(F.array("a", "b")).alias("end"))
    best = ends.withColumn("k", F.row_number().over(Window.partitionBy("end").orderBy("far", F.xxhash64("a", "b")))).where("k <= 4").select("a", "b").distinct()
    best = scratch.table("best", best)
    paired = linked.select(F.explode(F.array("a", "b")).alias("id")).unionByName(shared.where("n > 3").select("id")).distinct()
    texts = scratch.table("texts", rows.withColumnRenamed("doc_id", "id").join(paired, "id").dropDuplicates(["id", "text"]).select("id", "text"))
    several = some.join(classes, key).select("doc_id", "id").distinct()  # a doc_id of several rows may have several sets
    least = several.groupBy("doc_id").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1")
    same = several.join(least, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = scratch.table("links-1", confirmed(best, texts, percent).unionByName(same))
    scratch.drop()
    label = connected_components(links, scratch, "first")

    # second pass: every id outside its bucket's main component against the bucket's most typical member
    members = scratch.table("members", open_buckets(shared, label))
    ids = members.select("id").distinct()
    alone = texts.join(ids, "id").select("id", "text").mapInArrow(_exploded, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    common = (
        ids.join(sketches, "id").join(alone.where("k = 1").groupBy("id").agg(F.count("*").alias("own")), "id", "left")
        .select("id", "sketch", "whole", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"))
    )
    common = scratch.table("common", common)
    known = members.join(common, "id")
    typical = known.groupBy("bucket").agg(F.min("n").alias("m"), F.min_by(F.struct("id", "component"), F.struct(F.col("n") - F.col("c"), "id")).alias("hub"))
    minor = known.where("minor").join(typical, "bucket").where(f"100 * c >= {percent} * (n + m - c) AND component <> hub.component")
    to_hub = scratch.table("to-hub", minor.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct().join(best, ["a", "b"], "left_anti"))
    links = scratch.table("links-2", confirmed(to_hub, texts, percent)).unionByName(_star(label))
    label = connected_components(links, scratch, "second")

    # third pass: all that may still join components, each pair in the first bucket that it shares
    opened = scratch.table("opened", open_buckets(members.withColumn("n", F.lit(4)), label))
    own = opened.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("own"))  # at most BANDS
    known = opened.join(common.join(own, "id"), "id")
    least = known.groupBy("bucket").agg(F.min("n").alias("m"))
    minor = known.where("minor").join(least, "bucket").where(f"100 * c >= {percent} * (n + m - c)")
    minor = minor.select(F.col("bucket").alias("k"), F.col("id").alias("p"), F.col("component").alias("cp"), F.col("sketch").alias("x"), F.col("whole").alias("u"), F.col("n").alias("np"), F.col("c").alias("sp"), F.col("own").alias("kp"))
    other = known.select("bucket", F.col("minor").alias("also"), F.col("id").alias("q"), F.col("component").alias("cq"), F.col("sketch").alias("y"), F.col("whole").alias("v"), F.col("n").alias("nq"), F.col("c").alias("sq"), F.col("own").alias("kq"))
    reach = f"100 * least(sp, sq) >= {percent} * (np + nq - least(sp, sq))"
    wide = minor.join(other, F.expr(f"k = bucket AND cp <> cq AND (p < q OR NOT also) AND {reach} AND {near} <= {limit} AND {within_reach(percent)} AND k = array_intersect(kp, kq)[0]"))
    wide = wide.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    sides = linked.select("a", "b")
    for end, mark, bits in (("a", "p", "u"), ("b", "q", "v")):
        sides = sides.join(label.select(F.col("id").alias(end), F.col("component").alias(f"c{mark}")), end, "left")
        sides = sides.join(common.select(F.col("id").alias(end), F.col("n").alias(f"n{mark}"), F.col("c").alias(f"s{mark}"), F.col("whole").alias(bits)), end, "left")
    sides = sides.where(f"coalesce(cp, a) <> coalesce(cq, b) AND coalesce({reach} AND {within_reach(percent)}, true)").select("a", "b")
    rest = sides.unionByName(wide).distinct().join(best.unionByName(to_hub), ["a", "b"], "left_anti")
    rest = scratch.table("rest", rest)
    links = scratch.table("links-3", confirmed(rest, texts, percent)).unionByName(_star(label))
    label = connected_components(links, scratch, "final")
    scratch.drop("shared", "candidates", "members", "opened", "texts", "sketches", "common")

    named = classes.join(label, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    joined = signed.select("doc_id", *key).join(named, key, "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
