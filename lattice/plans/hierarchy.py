"""Level by level: similar nodes are joined, weighted, grouped, described, and lifted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.lineage import cut
from lattice.operators.cluster import label_propagation
from lattice.operators.community import community_texts
from lattice.operators.embedding import hashed
from lattice.operators.graph import average_degree_k, edge_weights, lift_edges
from lattice.operators.vectors import augment_similar, new_pairs, similar_pairs

Strategy = Callable[[DataFrame, DataFrame], DataFrame]
#: From new pairs (a, b, sim) and a number of neighbours to the edges gained (a, b).
Augment = Callable[[DataFrame, int], DataFrame]
#: From communities (community, n_members, block, summary) to the same with other summaries.
Summarise = Callable[[DataFrame], DataFrame]
#: From rows and the name of a text column to the rows with its vectors as ``v``.
Embed = Callable[[DataFrame, str], DataFrame]


def _offline(rows: DataFrame, text: str) -> DataFrame:
    return hashed().embed(rows, F.col(text))[0]


def build_hierarchy(nodes: DataFrame, edges: DataFrame, max_levels: int = 5, threshold: float = 0.7, min_nodes: int = 3, cluster: Strategy = label_propagation, embed: Embed = _offline, summarise: Summarise | None = None, augment: Augment | None = None) -> tuple[DataFrame, DataFrame]:
    """(communities, membership) of nodes (id long, text, v) and edges (source_id, target_id).

    communities (level, id, summary, n_members, v), membership (level, community_id, member_id).
    Stops before a level of fewer than ``min_nodes`` nodes, after ``max_levels``,
    when a level above the first is one community, or when grouping no longer
    shrinks the level. Community ids are their least member's, so they are stable. Without ``summarise`` a summary
    is that of ``community_texts``; ``embed`` makes the vectors of every level, as those of ``nodes`` were made.
    ``augment`` chooses the edges gained by similarity: without it ``augment_similar`` in order of ids; or ``vectors.augment``, each end's most similar
    ones, which gains a part of the same edges in one pass.
    """
    spark = nodes.sparkSession
    communities = spark.createDataFrame([], "level int, id long, summary string, n_members long, v array<double>")
    membership = spark.createDataFrame([], "level int, community_id long, member_id long")
    for level in range(max_levels):
        n = nodes.count()
        if n < min_nodes:
            break
        k = average_degree_k(n, edges.count())
        alike = nodes.select("id", "v")
        gained = augment_similar(alike, edges, threshold, k) if augment is None else augment(new_pairs(similar_pairs(alike, threshold), edges), k)
        all_edges = cut(edges.select("source_id", "target_id").unionByName(gained.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))))
        labels = cluster(nodes.select("id"), edge_weights(all_edges, nodes.select("id", "v")))
        m = labels.select("community").distinct().count()
        if m <= 1 and level > 0:
            break
        own = community_texts(labels, nodes.select("id", "text"))
        told = own if summarise is None else summarise(own)
        made = cut(embed(told.select(F.lit(level).alias("level"), F.col("community").alias("id"), "summary", "n_members"), "summary").select("level", "id", "summary", "n_members", "v"))
        communities = communities.unionByName(made)
        of = labels.select(F.lit(level).alias("level"), F.col("community").alias("community_id"), F.col("id").alias("member_id"))
        membership = membership.unionByName(of)
        nodes, edges = made.select("id", F.col("summary").alias("text"), "v"), cut(lift_edges(all_edges, of))
        if m == n:
            break
    return communities, membership
