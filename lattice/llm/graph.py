"""Candidate pairs from buckets and connected components, as DataFrame jobs.

Both are linear in their input: no bucket is expanded into all of its pairs,
and no component is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.llm.scratch import Scratch


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """Rows (bucket, id, n, lo, hi, x) of the buckets of several ids, by one shuffle: size, least and greatest id, XOR of the ids."""
    dealt = buckets.repartition("bucket")
    sums = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.expr("bit_xor(id)").alias("x")).where("n > 1")
    return dealt.join(sums.hint("shuffle_hash"), "bucket")


def bucket_links(shared: DataFrame, salts: int = 32, spread: bool = True) -> DataFrame:
    """Links (a, b), a < b, that join up each of the ``shared_buckets`` of distinct (bucket, id): long columns.

    Buckets of two or three ids give all their pairs, straight from the sums.
    Larger ones give every id's pairs with the bucket's least and greatest id
    and with its neighbour in hashed order within one of ``salts`` parts, so a
    hot bucket is spread over tasks. Without ``spread`` they give those with the
    least id and with the neighbour in one order for all buckets: ids that share
    many buckets then get few links.
    """
    small = shared.where("n <= 3 AND id = lo").select(
        F.inline(F.expr("""CASE WHEN n = 2 THEN array(struct(lo AS a, hi AS b))
            ELSE array(struct(lo AS a, hi AS b), struct(lo AS a, x ^ lo ^ hi AS b), struct(x ^ lo ^ hi AS a, hi AS b)) END"""))
    )
    order = Window.partitionBy("bucket", "part").orderBy(F.xxhash64("id", "bucket") if spread else F.xxhash64("id"), "id")
    near = (
        shared.where("n > 3").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .withColumn("near", F.lag("id").over(order))
        .select(F.explode(F.array("lo", "hi", "near") if spread else F.array("lo", "near")).alias("other"), "id")
        .where("other IS NOT NULL AND other <> id")
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    )
    return small.unionByName(near).where("a < b").distinct()


def open_buckets(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Members (bucket, id, component, minor) of the buckets of over three ids that still hold several components.

    ``minor`` marks ids outside the bucket's largest component: any link still
    missing has one of them at one end at least.
    """
    members = shared.where("n > 3").select("bucket", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counted = members.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = counted.groupBy("bucket").agg(F.count("*").alias("k"), F.expr("max_by(component, c)").alias("main")).where("k > 1")
    return members.join(main.select("bucket", "main"), "bucket").select("bucket", "id", "component", (F.col("component") != F.col("main")).alias("minor"))


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links (a, b): the least id reachable.

    Alternates large-star and small-star rounds, each written to the shared
    folder. Ids without a link don't appear.
    """
    edges = scratch.table(f"{name}-0", links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for k in range(1, most_rounds):
        edges = scratch.table(f"{name}-{k}", _small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.max("a")).first()
        scratch.drop(f"{name}-{k - 1}")
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
