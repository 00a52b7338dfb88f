"""Operators on a graph of nodes (id, ...) and edges (source_id, target_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.functions.text import cosine


def relations_for(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, edge columns): the edges that touch each of ``nodes`` (id); a self-loop once. Two hash joins instead of one on OR."""
    wanted = nodes.select(F.col("id").alias("node_id"))
    out = edges.join(wanted, edges["source_id"] == wanted["node_id"])
    back = edges.where("source_id <> target_id").join(wanted, F.col("target_id") == F.col("node_id"))
    return out.unionByName(back).select("node_id", *edges.columns)


def neighbours(edges: DataFrame, nodes: DataFrame, bag: bool = False) -> DataFrame:
    """(id, neighbour_id): opposite ends that exist; distinct unless ``bag``. A self-loop gives the node itself."""
    one = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour_id"))
    two = edges.where("source_id <> target_id").select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour_id"))
    both = one.unionByName(two)
    return (both if bag else both.distinct()).join(nodes.select(F.col("id").alias("neighbour_id")), "neighbour_id", "left_semi").select("id", "neighbour_id")


def edge_weights(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges (source_id, target_id) with weight = max(cosine of the ends, 0); edges without both vectors go, parallel ones stay."""
    a, b = vectors.select(F.col("id").alias("source_id"), F.col("v").alias("a")), vectors.select(F.col("id").alias("target_id"), F.col("v").alias("b"))
    return edges.join(a, "source_id").join(b, "target_id").select("source_id", "target_id", F.greatest(cosine("a", "b"), F.lit(0.0)).alias("weight"))


def average_degree_k(n_nodes: int, n_edges: int) -> int:
    """How many neighbours a node may gain: the average degree, 2 at least."""
    return max(2, max(1, 2 * n_edges // max(1, n_nodes)))


def lift_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges between communities: ends mapped by membership (member_id, community_id), inner ones dropped, one for each pair."""
    a = membership.select(F.col("member_id").alias("source_id"), F.col("community_id").alias("ca"))
    b = membership.select(F.col("member_id").alias("target_id"), F.col("community_id").alias("cb"))
    lifted = edges.join(a, "source_id").join(b, "target_id").where("ca <> cb")
    return lifted.select(F.least("ca", "cb").alias("source_id"), F.greatest("ca", "cb").alias("target_id")).distinct()


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of a partition of weighted undirected edges (source_id, target_id, weight)."""
    a = membership.select(F.col("member_id").alias("source_id"), F.col("community_id").alias("ca"))
    b = membership.select(F.col("member_id").alias("target_id"), F.col("community_id").alias("cb"))
    both = edges.where("source_id <> target_id").join(a, "source_id").join(b, "target_id")
    ends = both.select(F.explode(F.array("ca", "cb")).alias("c"), "weight", (F.col("ca") == F.col("cb")).alias("inside"))
    sums = ends.groupBy("c").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("inner"))
    total = sums.agg(F.sum("degree").alias("m2"))
    return sums.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inner") / F.col("m2") - resolution * F.pow(F.col("degree") / F.col("m2"), 2)).alias("modularity"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` (id), and edges without any that touch them."""
    gone = gone.select("id").distinct()
    left = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def lookup(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is among those of ``wanted`` (key): the batch form of a point lookup. Missing keys give no row."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi").select(*rows.columns)


def one(rows: DataFrame, value, key: str = "id") -> DataFrame:
    """The row of this key, or none; the condition reaches the Parquet scan."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def delete(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` without those whose key is among ``gone`` (key); missing keys change nothing."""
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)
