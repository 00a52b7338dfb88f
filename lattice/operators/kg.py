"""From documents to a graph: chunks, mentions, merged entities, resolved relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.functions.text import json_object, name_key, stable_id, stripped

MENTION = "[A-Z][a-z]{3,}"


def chunk_documents(docs: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(chunk_id, doc_id, chunk_no, start, text) of docs (doc_id, text): overlapping slices of ``size`` characters."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    some = docs.where(F.length("text") > 0)
    starts = some.select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("chunk_no", "start"))
    return starts.select(
        stable_id(F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "doc_id", "chunk_no", "start",
        F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"),
    )


def extract_mentions(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, pos, chunk_id, name, entity_type, description): capitalised words; each is described by the next one."""
    found = chunks.withColumn("names", F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)))
    rows = found.select("doc_id", "chunk_no", "chunk_id", "names", F.posexplode("names").alias("pos", "name"))
    return rows.select("doc_id", "chunk_no", "pos", "chunk_id", "name", F.lit("Term").alias("entity_type"), F.coalesce(F.get("names", F.col("pos") + 1), F.lit("")).alias("description"))


def _order() -> Column:
    return F.struct("doc_id", "chunk_no", "pos")


def merge_entities(mentions: DataFrame, descriptions: int | None = None) -> DataFrame:
    """One entity for each name, letter case and outer white space aside.

    The first mention gives spelling, type and first description; later
    non-empty descriptions follow, one blank between. ``source_chunk_ids`` has
    a chunk for each mention. ``descriptions`` bounds both lists to the first
    mentions, found by a ranked window before anything is collected; None keeps
    all, as a merged row then holds them anyway.
    """
    named = mentions.withColumn("name", stripped(F.col("name"))).where("name <> ''").withColumn("key", name_key(F.col("name")))
    counted = named.groupBy("key").agg(F.count("*").alias("n_mentions"), F.min(_order()).alias("first"), F.min_by(F.struct("name", "entity_type"), _order()).alias("of"))
    if descriptions is not None:
        named = named.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "chunk_no", "pos"))).where(F.col("k") <= descriptions)
    lists = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("doc_id", "chunk_no", "pos", "description", "chunk_id"))).alias("all"))
    later = F.expr("filter(slice(all, 2, greatest(size(all) - 1, 0)), x -> x.description <> '')")
    text = F.concat(F.col("all")[0]["description"], F.array_join(F.transform(later, lambda x: F.concat(F.lit(" "), x["description"])), ""))
    return counted.join(lists, "key").select(
        stable_id(F.col("key")).alias("id"), "key", F.col("of.name").alias("name"), F.col("of.entity_type").alias("entity_type"), text.alias("description"),
        "n_mentions", F.col("first.doc_id").alias("first_doc"), F.col("first.chunk_no").alias("first_chunk"), F.col("first.pos").alias("first_pos"),
        F.transform("all", lambda x: x["chunk_id"]).alias("source_chunk_ids"),
    )


def entity_keys(mentions: DataFrame) -> DataFrame:
    """(id, key, name, n_mentions, first_doc, first_chunk, first_pos): the merge without its lists, map-side combined."""
    named = mentions.withColumn("name", stripped(F.col("name"))).where("name <> ''")
    merged = named.groupBy(name_key(F.col("name")).alias("key")).agg(F.count("*").alias("n_mentions"), F.min(F.struct("doc_id", "chunk_no", "pos", "name")).alias("first"))
    return merged.select(stable_id(F.col("key")).alias("id"), "key", F.col("first.name").alias("name"), "n_mentions", F.col("first.doc_id").alias("first_doc"), F.col("first.chunk_no").alias("first_chunk"), F.col("first.pos").alias("first_pos"))


#: What the extraction prompt asks for; numbers and other scalars are read as text.
EXTRACTED = "entities array<struct<name: string, type: string, description: string>>, relations array<struct<source: string, target: string, description: string>>"


def parse_extraction(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and relations of a model's answers (doc_id, chunk_no, chunk_id, output), in the order in which it named them.

    mentions as of ``extract_mentions``; relations (doc_id, chunk_no, pos, source, target, description). An answer without a
    JSON object, or with other types in its place, gives neither; names without a visible character give no mention.
    """
    read = answers.withColumn("found", json_object(F.col("output"), EXTRACTED)).where("found IS NOT NULL")
    at = ["doc_id", "chunk_no", "chunk_id"]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = read.select(*at, F.posexplode("found.entities").alias("pos", "e")).where("e IS NOT NULL")
    mentions = named.select("doc_id", "chunk_no", "pos", "chunk_id", stripped(F.col("e.name")).alias("name"), text("e.type").alias("entity_type"), text("e.description").alias("description")).where("name <> ''")
    linked = read.select(*at, F.posexplode("found.relations").alias("pos", "r")).where("r IS NOT NULL")
    relations = linked.select("doc_id", "chunk_no", "pos", text("r.source").alias("source"), text("r.target").alias("target"), text("r.description").alias("description"))
    return mentions, relations


def partial_entities(mentions: DataFrame) -> DataFrame:
    """(key, name, entity_type, description, opened, source_chunk_ids, n_mentions, first_batch, first_doc, first_chunk, last_batch) of mentions with ``batch``.

    A mergeable ordered aggregate: mentions are ordered by batch, document, chunk and place, so those of later batches follow
    all earlier ones, and ``merge_partials`` of the partials of two batches is the partial of both together. ``opened`` says
    whether the first mention has a description; each later one that has comes after a blank.
    """
    named = mentions.withColumn("name", stripped(F.col("name"))).where("name <> ''").withColumn("key", name_key(F.col("name")))
    order = [F.col(c) for c in ("batch", "doc_id", "chunk_no", "pos")]
    lists = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*order, "name", "entity_type", "description", "chunk_id"))).alias("all"))
    later = F.expr("filter(slice(all, 2, greatest(size(all) - 1, 0)), x -> x.description <> '')")
    first = F.col("all")[0]
    return lists.select(
        "key", first["name"].alias("name"), first["entity_type"].alias("entity_type"),
        F.concat(first["description"], F.array_join(F.transform(later, lambda x: F.concat(F.lit(" "), x["description"])), "")).alias("description"), (first["description"] != "").alias("opened"),
        F.transform("all", lambda x: x["chunk_id"]).alias("source_chunk_ids"), F.size("all").cast("long").alias("n_mentions"),
        first["batch"].alias("first_batch"), first["doc_id"].alias("first_doc"), first["chunk_no"].alias("first_chunk"), F.element_at("all", -1)["batch"].alias("last_batch"),
    )


def merge_partials(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partials ``old`` and ``new`` as one, where every mention of ``new`` is of a later batch than those of ``old``."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.key") == F.col("n.key"), "full_outer")
    first = lambda c: F.when(F.col("o.key").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    joined = F.concat("o.description", F.when(F.col("n.opened"), " ").otherwise(""), F.coalesce("n.description", F.lit("")))
    none = F.array().cast("array<string>")
    return both.select(
        first("key"), first("name"), first("entity_type"), F.when(F.col("o.key").isNotNull(), joined).otherwise(F.col("n.description")).alias("description"), first("opened"),
        F.concat(F.coalesce("o.source_chunk_ids", none), F.coalesce("n.source_chunk_ids", none)).alias("source_chunk_ids"),
        (F.coalesce("o.n_mentions", F.lit(0)) + F.coalesce("n.n_mentions", F.lit(0))).cast("long").alias("n_mentions"),
        first("first_batch"), first("first_doc"), first("first_chunk"), F.greatest("o.last_batch", "n.last_batch").alias("last_batch"),
    )


def outlived(rows: DataFrame, gone: DataFrame, key: str | Column, batch: str = "batch") -> DataFrame:
    """``rows`` without those that a tombstone of ``gone`` (key, batch) covers: the same key, written in its batch or an earlier one."""
    last = gone.groupBy(F.col("key").alias("gone_key")).agg(F.max("batch").alias("gone_batch"))
    match = (key if isinstance(key, Column) else F.col(key)).cast("string") == F.col("gone_key")
    return rows.join(last, match & (F.col(batch) <= F.col("gone_batch")), "left_anti")


def extract_relations(mentions: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, pos, source, target): each mention and the next one of its chunk."""
    return mentions.where("description <> ''").select("doc_id", "chunk_no", "pos", F.col("name").alias("source"), F.col("description").alias("target"))


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, source_id, target_id, doc_id, chunk_no, pos): endpoints found by name among the entities seen up to the relation's chunk; others are dropped.

    Relations with a ``batch`` are held against ``first_batch`` of the entities first.
    """
    places = {"first_batch": "batch"} if "batch" in relations.columns else {}
    places |= {"first_doc": "doc_id", "first_chunk": "chunk_no"}

    def end(mark: str) -> DataFrame:
        return entities.select(F.col("key").alias(f"{mark}_key"), F.col("id").alias(f"{mark}_id"), F.struct(*places).alias(f"{mark}_seen"))

    keyed = relations.withColumns({"source_key": name_key(F.col("source")), "target_key": name_key(F.col("target"))}).withColumn("at", F.struct(*[F.col(c).alias(k) for k, c in places.items()]))
    both = keyed.join(end("source"), "source_key").where("source_seen <= at").join(end("target"), "target_key").where("target_seen <= at")
    return both.select(stable_id(*[F.col(c).cast("string") for c in ("doc_id", "chunk_no", "pos")]).alias("id"), "source_id", "target_id", "doc_id", "chunk_no", "pos", *[c for c in ("batch", "description") if c in relations.columns])
