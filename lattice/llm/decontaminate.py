"""Operator 8: benchmark decontamination, in DataFrame functions only.

A document contaminates an item if it holds at least ``percent`` % of the
item's distinct five-word shingles. Whole-document MinHash can't see a short
item in a long document. Items of up to 16 shingles are joined with the
documents on the hashes of all their shingles, which misses none. Longer ones are
partitioned by size into classes of up to 32, 64, ... shingles, and for each class that occurs every document is cut
into blocks of that many shingles. An item of the class then touches few blocks,
in one of which at least it is a large part: of two blocks that share an item
at 75 % containment, 32 samples miss both with probability 5e-5. Samples that
agree name candidates, and these are verified on the exact shingles (as text).

Blocks are aggregated where the documents lie: one shuffle of the texts serves
all classes, and the samples of wider blocks are the least of the narrow ones'. The item side is broadcast only if it has at most
``broadcast_items`` rows, counted first; otherwise the join shuffles.

Defined cases: a null or wordless text or item matches nothing; under five
words, the whole sequence is the one shingle; an empty table gives no rows; rows
with equal ids count as one document (item); rows without an id are ignored;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm.scratch import Scratch

SAMPLES, WORDS, LEAST = 32, 5, 16
_SPACE, _LETTER = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def split_words(text: Column) -> Column:
    """The lower-case words of a text; null if it has none."""
    trimmed = F.regexp_replace(F.lower(text.cast("string")), rf"^{_SPACE}|{_SPACE}$", "")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, _SPACE))


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, w) of the documents with words, dealt by doc_id. The blank ones go by a plain match, so that no text is split only to be filtered before its shuffle."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("text").rlike(_LETTER)).repartition("doc_id").select("doc_id", split_words(F.col("text")).alias("w"))


def _positions(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, h): the hash of each shingle of rows with words ``w``."""
    at = rows.select(*keys, "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0)))).alias("i"))
    return at.select(*keys, "i", F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(WORDS)]).alias("h"))


def _least(shingles: DataFrame, *keys: str) -> DataFrame:
    """(keys, m0, m1, ...): the MinHash samples of each group."""
    return shingles.groupBy(*keys).agg(*[F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(SAMPLES)])


def _samples(least: DataFrame, *keys: str) -> DataFrame:
    """(keys, v): the samples as rows. The number of a sample is part of its hash, so equal values are equal samples."""
    return least.select(*keys, F.explode(F.array(*[F.col(f"m{k}") for k in range(SAMPLES)])).alias("v"))


def _shingle_texts() -> Column:
    return F.expr(f"array_distinct(transform(sequence(0, greatest(size(w) - {WORDS}, 0)), i -> array_join(slice(w, i + 1, {WORDS}), ' ')))")


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75, broadcast_items: int = 200_000) -> DataFrame:
    """(doc_id, item_id, n_shingles of the item, n_shared) of each document that holds an item."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    tests = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), split_words(F.col("text")).alias("w")).where("w IS NOT NULL")
    sizes = _positions(tests, "item_id").groupBy("item_id").agg(F.countDistinct("h").alias("q"))
    sized = F.greatest(F.lit(LEAST), F.pow(F.lit(2), F.ceil(F.log2("q"))).cast("int"))
    sizes = scratch.table("sizes", sizes.select("item_id", "q", sized.alias("class")))
    short = _positions(tests.join(sizes.where(f"class = {LEAST}"), "item_id"), "item_id", "q").select("item_id", "q", "h").distinct()
    short = scratch.table("short", short)
    sizes = sizes.where(f"class > {LEAST}").drop("q")
    wanted = _samples(
        _least(_positions(tests, "item_id").join(sizes, "item_id"), "class", "item_id"), "class", "item_id"
    )
    wanted = scratch.table("wanted", wanted.withColumnRenamed("class", "of"))
    small = wanted.count() <= broadcast_items * SAMPLES
    few = short.count() <= broadcast_items * LEAST

    words = document_words(docs)
    classes = sorted(x["class"] for x in sizes.select("class").distinct().collect()) or [2 * LEAST]  # powers of two, 64 at most
    fine = _least(_positions(words, "doc_id").withColumn("block", F.expr(f"i div {classes[0]}")), "doc_id", "block")
    wider = [F.struct(F.lit(c).alias("class"), F.expr(f"block div {c // classes[0]}").alias("part")) for c in classes]
    spread = fine.withColumn("in", F.explode(F.array(*wider))).withColumns({"class": F.col("in.class"), "part": F.col("in.part")})
    blocks = spread.groupBy("doc_id", "class", "part").agg(*[F.min(f"m{k}").alias(f"m{k}") for k in range(SAMPLES)])
    found = _samples(blocks, "doc_id", "class").join(F.broadcast(wanted) if small else wanted, "v").where(F.col("class") == F.col("of"))
    held = _positions(words, "doc_id").select("doc_id", "h").join(F.broadcast(short) if few else short, "h")
    held = held.groupBy("doc_id", "item_id", "q").agg(F.countDistinct("h").alias("n")).where(f"100 * n >= {percent} * q")
    candidates = scratch.table("candidates", found.select("doc_id", "item_id").unionByName(held.select("doc_id", "item_id")).distinct())

    suspects = words.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", _shingle_texts().alias("held"))
    needed = tests.select("item_id", _shingle_texts().alias("asked"))
    checked = candidates.join(suspects, "doc_id").join(needed, "item_id").select("doc_id", "item_id", F.size("asked").cast("long").alias("n_shingles"), F.size(F.array_intersect("held", "asked")).cast("long").alias("n_shared"))
    return checked.where(f"100 * n_shared >= {percent} * n_shingles").groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))


#: The same pairs by an exact join, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM d, LATERAL (SELECT unnest(range(greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
     qs AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM q, LATERAL (SELECT unnest(range(greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
     n AS (SELECT item_id, count(*) AS n_shingles FROM qs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
FROM ds JOIN qs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 75 * n_shingles
"""
