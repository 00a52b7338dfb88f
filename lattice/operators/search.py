"""Retrieval: exact layered search, enrichment with relations, substring search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.functions.text import contains_literally, shortened
from lattice.operators.graph import relations_for
from lattice.operators.vectors import nearest


def hierarchical_search(queries: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, layer, rank, id, distance, label) of queries (query_id, v): the k nearest nodes of every layer."""
    layers = nodes.select("layer").distinct()
    asked = queries.join(F.broadcast(layers))  # a row for each layer of the index, a handful
    return nearest(asked, nodes, k).join(nodes.select("layer", "id", "label"), ["layer", "id"]).select("query_id", "layer", "rank", "id", "distance", "label")


def candidates_only(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    return rows.join(candidates.select("id"), "id", "left_semi")


def enrich_hits(hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text, n_relations): each hit's ``text``, followed by its relations as "source -> target: description" lines, if it has any.

    hits (id, text), edges (id, source_id, target_id, description), nodes (id, name); an end without a name shows its id.
    """
    touching = relations_for(edges.withColumnRenamed("id", "edge_id"), hits.select("id").distinct())
    named = touching.join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id", "left").join(nodes.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id", "left")
    line = F.concat(F.coalesce("s", F.col("source_id").cast("string")), F.lit(" -> "), F.coalesce("t", F.col("target_id").cast("string")), F.lit(": "), F.col("description"))
    lines = named.groupBy(F.col("node_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("edge_id", line.alias("line")))).alias("all"))
    text = F.concat(F.col("text"), F.when(F.col("all").isNotNull(), F.concat(F.lit("\nRelationships:\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))).otherwise(F.lit("")))
    return hits.join(lines, "id", "left").select("id", text.alias("text"), F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_relations"))


def search_entities(entities: DataFrame, wanted: str) -> DataFrame:
    return entities.where(contains_literally(F.col("name"), wanted))


def search_chunks(chunks: DataFrame, wanted: str, size: int = 200) -> DataFrame:
    """(chunk_id, doc_id, text): chunks that hold ``wanted``, shortened."""
    return chunks.where(contains_literally(F.col("text"), wanted)).select("chunk_id", "doc_id", shortened(F.col("text"), size).alias("text"))


def search_all(entities: DataFrame, chunks: DataFrame, wanted: str) -> DataFrame:
    """(kind, id, text): entities (id, name, description) and chunks together, shortened for display."""
    one = search_entities(entities, wanted).select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("id"), F.left("description", F.lit(120)).alias("text"))
    two = chunks.where(contains_literally(F.col("text"), wanted)).select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), shortened(F.col("text"), 120, always=True).alias("text"))
    return one.unionByName(two)
