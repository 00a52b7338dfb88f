"""From search results to a report: context blocks, ranked points, report text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.functions import prompts
from lattice.functions.text import json_object
from lattice.operators.model import Complete, generate


def context_block(results: DataFrame) -> DataFrame:
    """(query_id, layer, block): a layer's items, numbered by rank, with layer and distance. results (query_id, layer, rank, distance, text); at most k rows a group."""
    item = F.concat(F.lit("### Item "), F.col("rank").cast("string"), F.lit(" (layer "), F.col("layer").cast("string"), F.lit(", distance "), F.format_string("%.4f", F.col("distance").cast("double")), F.lit(")\n"), F.col("text"))
    lists = results.groupBy("query_id", "layer").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("all"))
    return lists.select("query_id", "layer", F.array_join(F.transform("all", lambda x: x["item"]), "\n\n").alias("block"))


def layer_points(results: DataFrame) -> DataFrame:
    """(query_id, layer, pos, description, score): one point for each hit, its score 100 at distance 0 and 0 from 1 on, whole numbers."""
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.floor(100 * (1 - F.col("distance")) + 0.5).cast("double")))
    return results.select("query_id", "layer", F.col("rank").alias("pos"), F.col("text").alias("description"), score.alias("score"))


def model_points(reports: DataFrame, schema: str = "points array<struct<description: string, score: string>>") -> DataFrame:
    """(query_id, layer, pos, description, score) from model output (query_id, layer, output, fallback).

    The points of the JSON object in ``output``; if there is none, or a score is
    no number, the layer is one point: the first 2000 characters of ``fallback``, score 50.
    """
    parsed = reports.withColumn("points", json_object(F.col("output"), schema)["points"])
    fine = F.expr("points IS NOT NULL AND forall(points, p -> p.score IS NULL OR try_cast(p.score AS double) IS NOT NULL)")
    whole = F.array(F.struct(F.left("fallback", F.lit(2000)).alias("description"), F.lit(50.0).alias("score")))
    read = F.expr("transform(points, p -> named_struct('description', coalesce(p.description, ''), 'score', coalesce(try_cast(p.score AS double), 0D)))")
    rows = parsed.select("query_id", "layer", F.posexplode(F.when(fine, read).otherwise(whole)).alias("pos", "p"))
    return rows.select("query_id", "layer", (F.col("pos") + 1).alias("pos"), "p.description", "p.score")


def ranked_by_model(results: DataFrame, questions: DataFrame, complete: Complete) -> DataFrame:
    """Points of each layer as a model ranks them, by ``model_points``; questions (query_id, question). A layer whose answer can't be read is one point."""
    blocks = context_block(results).join(questions.select("query_id", "question"), "query_id")
    asked = blocks.select("query_id", "layer", F.col("block").alias("fallback"), prompts.filled(prompts.RANK, F.col("question"), F.col("block")).alias("prompt"))
    return model_points(generate(asked, complete).select("query_id", "layer", "output", "fallback"))


def answered_by_model(points: DataFrame, questions: DataFrame, complete: Complete) -> DataFrame:
    """(query_id, report): the model's answer from all points; the plain report where it fails."""
    plain = report_text(points).join(questions.select("query_id", "question"), "query_id")
    asked = plain.select("query_id", "report", prompts.filled(prompts.ANSWER, F.col("question"), F.col("report")).alias("prompt"))
    return generate(asked, complete).select("query_id", F.coalesce("output", "report").alias("report"))


def report_text(points: DataFrame) -> DataFrame:
    """(query_id, report): all points, highest score first, ties in order of layer and place."""
    line = F.concat(F.lit("- [Score "), F.col("score").cast("string"), F.lit("] "), F.col("description"))
    lists = points.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "layer", "pos", line.alias("line")))).alias("all"))
    return lists.select("query_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("report"))
