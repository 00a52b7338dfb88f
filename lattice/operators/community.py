"""Texts of communities and the layered index over entities and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.operators.vectors import nearest


def community_texts(membership: DataFrame, texts: DataFrame, block: int = 30, summary: int = 5) -> DataFrame:
    """(community, n_members, block, summary): the first member texts as a list of lines, and the fewest joined by bars.

    membership (id, community), texts (id, text). Only the ``block`` first members (by id) are collected.
    """
    rows = membership.join(texts, "id")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where(F.col("k") <= block)
    counts = rows.groupBy("community").agg(F.count("*").alias("n_members"))
    lists = ranked.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("all"))
    named = lists.select("community", F.transform("all", lambda x: x["text"]).alias("t"))
    out = named.select("community", F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x)), "\n").alias("block"), F.array_join(F.slice("t", 1, summary), " | ").alias("summary"))
    return counts.join(out, "community")


def index_nodes(entities: DataFrame, communities: DataFrame) -> DataFrame:
    """(layer, id, label, v): layer 0 from entities (id, name, v), layer level + 1 from communities (id, level, summary, v)."""
    zero = entities.select(F.lit(0).alias("layer"), "id", F.col("name").alias("label"), "v")
    upper = communities.select((F.col("level") + 1).cast("int").alias("layer"), "id", F.left("summary", F.lit(80)).alias("label"), "v")
    return zero.unionByName(upper)


def intra_links(nodes: DataFrame, m: int = 32) -> DataFrame:
    """(layer, src, rank, dst, distance): each node's m nearest in its own layer."""
    found = nearest(nodes.withColumnRenamed("id", "query_id"), nodes, m, skip_self=True)
    return found.select("layer", F.col("query_id").alias("src"), "rank", F.col("id").alias("dst"), "distance")


def inter_links(nodes: DataFrame) -> DataFrame:
    """(layer, src, dst, distance): each upper node's nearest one in the layer below."""
    found = nearest(nodes.where("layer > 0").select((F.col("layer") - 1).cast("int").alias("layer"), F.col("id").alias("query_id"), "v"), nodes, 1)
    return found.select((F.col("layer") + 1).cast("int").alias("layer"), F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance")
