"""The library's front: index, query, add, remove, search and stats over a snapshot store.

Documents, chunks, mentions and relations are only ever added to; each row holds the ``batch`` that brought it, the
number of the version it was made for. Removal adds a tombstone (kind, key, batch), which hides the rows of its key of its
batch and before, so it lasts, and what later documents say anew comes back by itself. Entities are mergeable
aggregates of mentions: ``add`` extracts new chunks alone and merges their partial aggregates into the stored ones.
Communities and the index are made anew from the merged graph, with vectors taken from those kept by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions import prompts
from lattice.functions.text import label, name_key
from lattice.lineage import cut
from lattice.operators import answer, graph, kg, search
from lattice.operators.community import index_nodes
from lattice.operators.embedding import Embedding, hashed
from lattice.operators.model import AnswerCache, Complete
from lattice.plans.hierarchy import build_hierarchy
from lattice.schemas import META, TOMBSTONE
from lattice.sources.corpus import read_corpus, resolve_fields
from lattice.sources.store import Append, SnapshotStore, Tables

DEFAULTS = {"chunk_size": 1200, "chunk_overlap": 100, "max_levels": 5, "similarity_threshold": 0.7, "k_per_layer": 5}
#: Tables whose rows carry their batch, with the column that names their document.
_LOGS = {"documents": "doc_id", "chunks": "doc_id", "mentions": "doc_id", "relations": "doc_id"}
#: Folders of a table that is only added to, before it is rewritten as one.
_MOST_PARTS = 64


class Engine:
    """Keeps its tables under ``root``; every change publishes a new version."""

    def __init__(self, spark: SparkSession, root: str, embed: Embedding | Callable[[Column], Column] | None = None, complete: Complete | None = None, model: str = "", **settings):
        """``embed`` makes vectors of texts: an ``Embedding``, or a function from a text column to a vector column.

        ``complete`` is a language model, named ``model``: if given, it extracts entities and relations, words the summaries of
        communities, and ranks and words answers. Its answers while indexing are kept under ``root``.
        """
        unknown = set(settings) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        if embed is not None and not isinstance(embed, Embedding):
            embed = Embedding(0, column=embed)
        self.spark, self.store, self.settings, self.embedding, self.complete = spark, SnapshotStore(spark, root), DEFAULTS | settings, embed or hashed(), complete
        self.answers = None if complete is None else AnswerCache(f"{self.store.root}/answers", complete, model)

    # changes ---------------------------------------------------------------

    def index(self, corpus: str | DataFrame) -> int:
        """Build a new version from a corpus path or documents (id, title, context, text); notes stay, all else goes."""
        docs = cut(self._documents(corpus))

        def change(base: Tables) -> dict:
            kept = {n: None for n in base.entries if n not in ("meta", "vectors")}
            return kept | self._merged(base, {}, docs, base.version + 1)

        return self._update(change)

    def add(self, corpus: str | DataFrame) -> int:
        """Add documents. Those that are there already, word for word, change nothing; others of a known id take its place."""
        docs = cut(self._documents(corpus))

        def change(base: Tables) -> dict | None:
            live = self._live(base)
            new = docs
            if live:
                same = live["documents"].select("doc_id", F.col("title").alias("t"), F.col("text").alias("x"))
                new = cut(docs.join(same, "doc_id", "left").where("x IS NULL OR NOT (t <=> title AND x <=> text)").select(*docs.columns))
                if new.isEmpty():
                    return None
            return self._merged(base, live, new, base.version + 1)

        version = self._update(change)
        self.store.compact(_LOGS, _MOST_PARTS)
        return self.store.current() if version is None else version

    def remove(self, name: str) -> bool:
        """Remove the entity of this name with its relations and vector; False if there is none."""

        def change(base: Tables) -> dict | None:
            live = self._live(base)
            found = live["entities"].where(F.col("key") == name_key(F.lit(name))).select("key").limit(1).collect() if live else []
            return {"tombstones": self._tombstones([("entity", r["key"], base.version) for r in found])} if found else None

        return self._update(change) is not None

    def remove_chunk(self, chunk_id: str) -> bool:
        """Remove one chunk; False if there is none."""

        def change(base: Tables) -> dict | None:
            live = self._live(base)
            if not live or graph.one(live["chunks"], chunk_id, "chunk_id").isEmpty():
                return None
            return {"tombstones": self._tombstones([("chunk", chunk_id, base.version)])}

        return self._update(change) is not None

    def clear(self) -> int:
        """Publish a version without rows; earlier versions stay readable."""
        return self._update(lambda base: {name: base[name].limit(0) for name in base.entries})

    def compact(self) -> int | None:
        """Write the rows that count as one folder a table, and drop the tombstones, which then hide nothing."""

        def change(base: Tables) -> dict | None:
            live = self._live(base)
            return live | {"tombstones": None} if live else None

        return self._update(change)

    def put_meta(self, key: str, value) -> None:
        """Keep a note under a key, as text; no other table is written."""
        new = self.spark.createDataFrame([(key, str(value))], META)
        self._update(lambda base: {"meta": graph.upsert(base["meta"], new, "key") if "meta" in base else new})

    # reading ---------------------------------------------------------------

    def get(self, table: str, value, **where) -> dict | None:
        """The row of ``table`` (entities, chunks, communities, relations, documents, nodes) with this id, or None; ``where`` gives other columns, as layer for nodes."""
        key = {"chunks": "chunk_id", "documents": "doc_id"}.get(table, "id")
        tables = self.tables()
        if table not in tables:
            return None
        rows = tables[table]
        for column, wanted in where.items():
            rows = rows.where(F.col(column) == F.lit(wanted))
        found = graph.one(rows, value, key).first()
        return found.asDict() if found else None

    def get_meta(self, key: str) -> str | None:
        tables = self.store.read()
        found = graph.one(tables["meta"], key, "key").first() if "meta" in tables else None
        return found["value"] if found else None

    def search_entities(self, wanted: str) -> DataFrame:
        return search.search_entities(self.tables()["entities"], wanted).select("id", "name", "entity_type", "description")

    def search_chunks(self, wanted: str) -> DataFrame:
        return search.search_chunks(self.tables()["chunks"], wanted)

    def stats(self) -> dict[str, int]:
        tables = self.tables()
        if "entities" not in tables:
            return {"entities": 0, "relations": 0, "chunks": 0, "height": 0}
        height = tables["communities"].agg((F.max("level") + 1).alias("h")).first()["h"] or 0
        return {n: tables[n].count() for n in ("entities", "relations", "chunks")} | {"height": height}

    def results(self, question: str) -> DataFrame:
        """(query_id, layer, rank, id, distance, text) for one question, entities with their relations."""
        tables = self.tables()
        asked = self.embedding.embed(self.spark.createDataFrame([(0, question)], "query_id long, question string"), F.col("question"))[0].select("query_id", "v")
        one = tables["nodes"].select(F.size("v")).first()
        if one and one[0] != (own := asked.select(F.size("v")).first()[0]):
            raise ValueError(f"the index holds vectors of {one[0]} dimensions, this engine makes {own}")
        hits = search.hierarchical_search(asked, tables["nodes"].select("layer", "id", "label", "v"), self.settings["k_per_layer"])
        texts = tables["entities"].select("id", label(F.col("name"), F.col("description")).alias("text"))
        zero = hits.where("layer = 0").select("id").join(texts, "id")
        rich = search.enrich_hits(zero, tables["relations"].select("id", "source_id", "target_id", "description"), tables["entities"]).select("id", F.lit(0).alias("layer"), "text")
        upper = tables["communities"].select("id", (F.col("level") + 1).cast("int").alias("layer"), F.col("summary").alias("text"))
        return hits.join(rich.unionByName(upper), ["id", "layer"], "left").select("query_id", "layer", "rank", "id", "distance", F.coalesce("text", "label", F.lit("")).alias("text"))

    def query(self, question: str) -> str:
        """The report for a question: a bounded number of hits for each layer, highest score first."""
        results = cut(self.results(question))
        if self.complete is None:
            found = answer.report_text(answer.layer_points(results)).first()
        else:
            asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
            found = answer.answered_by_model(answer.ranked_by_model(results, asked, self.complete), asked, self.complete).first()
        return found["report"] if found else f"Nothing is indexed for: {question}"

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version (the current one by default) as readers see them, without what was removed."""
        return self._live(self.store.read(version))

    # making ----------------------------------------------------------------

    def _live(self, base: Tables) -> dict[str, DataFrame]:
        names = [n for n in base.entries if n not in ("tombstones", "vectors", "meta")]
        live = {n: base[n] for n in names}
        if not live or "tombstones" not in base:
            return live
        gone = {kind: base["tombstones"].where(F.col("kind") == kind) for kind in ("document", "chunk", "entity")}
        by_id = gone["entity"].select(F.xxhash64("key").cast("string").alias("key"), "batch")
        for name, doc in _LOGS.items():
            live[name] = kg.outlived(live[name], gone["document"], doc)
        live["chunks"] = kg.outlived(live["chunks"], gone["chunk"], "chunk_id")
        live["mentions"] = kg.outlived(live["mentions"], gone["entity"], name_key(F.col("name")))
        live["entities"] = kg.outlived(live["entities"], gone["entity"], "key", "last_batch")
        for end in ("source_id", "target_id"):
            live["relations"] = kg.outlived(live["relations"], by_id, end)
        live["nodes"] = kg.outlived(live["nodes"].where("layer = 0"), by_id, "id").unionByName(live["nodes"].where("layer > 0"))
        return live

    def _tombstones(self, rows: list[tuple[str, str, int]]) -> Append:
        return Append(self.spark.createDataFrame(rows, TOMBSTONE))

    def _documents(self, corpus: str | DataFrame) -> DataFrame:
        docs = resolve_fields(read_corpus(self.spark, corpus) if isinstance(corpus, str) else corpus)
        key = F.when(F.length("id") > 0, F.col("id")).otherwise(F.concat_ws("\x1f", "title", "body"))
        return docs.select(F.xxhash64(key).alias("doc_id"), "title", F.col("body").alias("text")).dropDuplicates(["doc_id"])

    def _extracted(self, chunks: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """Mentions and relations of new chunks, with their batch."""
        if self.answers is None:
            mentions = kg.extract_mentions(chunks)
            relations = kg.extract_relations(mentions).withColumn("description", F.lit("next to"))
        else:
            asked = chunks.select("doc_id", "chunk_no", "chunk_id", prompts.filled(prompts.EXTRACT, F.col("text")).alias("prompt"))
            mentions, relations = kg.parse_extraction(cut(self.answers.ask(asked).select("doc_id", "chunk_no", "chunk_id", "output")))
        held = F.lit(batch).cast("long").alias("batch")
        return cut(mentions.select("*", held)), cut(relations.select("*", held))

    def _summarised(self, communities: DataFrame) -> DataFrame:
        """Communities (community, n_members, block, summary) as the model words them; the plain summary where it fails."""
        told = self.answers.ask(communities.withColumn("prompt", prompts.filled(prompts.SUMMARISE, F.col("block"))))
        return told.withColumn("summary", F.coalesce("output", "summary")).drop("output")

    def _merged(self, base: Tables, live: dict[str, DataFrame], docs: DataFrame, batch: int) -> dict[str, DataFrame | Append]:
        """All tables after ``docs`` (doc_id, title, text) have joined the ``live`` ones as batch ``batch``."""
        s, log = self.settings, Append if live else (lambda rows: rows)
        docs = docs.select("*", F.lit(batch).cast("long").alias("batch"))
        chunks = cut(kg.chunk_documents(docs, s["chunk_size"], s["chunk_overlap"]).select("*", F.lit(batch).cast("long").alias("batch")))
        mentions, named = self._extracted(chunks.drop("batch"), batch)
        partials = kg.partial_entities(mentions)
        buried = None
        if live:
            stored = live["entities"].select(*partials.columns)
            again = cut(live["documents"].join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id"))
            if not again.isEmpty():  # names of documents that are replaced are aggregated anew, from the mentions that are left
                keyed = live["mentions"].withColumn("key", name_key(F.col("name")))
                touched = cut(keyed.join(again, "doc_id", "left_semi").select("key").distinct())
                rest = keyed.join(again, "doc_id", "left_anti").join(touched, "key", "left_semi").drop("key")
                anew = cut(kg.partial_entities(rest))
                stored = stored.join(touched, "key", "left_anti").unionByName(anew)
                held = F.lit(batch - 1).cast("long").alias("batch")
                buried = again.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("key"), held)
                buried = cut(buried.unionByName(touched.join(anew, "key", "left_anti").select(F.lit("entity").alias("kind"), "key", held)))
            partials = kg.merge_partials(stored, partials)

        known, fresh = (base["vectors"] if "vectors" in base and self.embedding.column is None else None), []

        def embed(rows: DataFrame, text: Column) -> DataFrame:
            nonlocal known
            out, made = self.embedding.embed(rows, text, known)
            if made is not None:
                fresh.append(made)
                known = made if known is None else known.unionByName(made)
            return out

        entities = cut(embed(partials.select(F.xxhash64("key").alias("id"), *partials.columns), label(F.col("name"), F.col("description"))))
        relations = cut(kg.resolve_relations(named, entities).select("id", "source_id", "target_id", "description", "doc_id", "batch"))
        every = relations
        if live:
            old = live["relations"]
            if buried is not None:
                gone = {k: buried.where(F.col("kind") == k) for k in ("document", "entity")}
                by_id = gone["entity"].select(F.xxhash64("key").cast("string").alias("key"), "batch")
                old = kg.outlived(kg.outlived(kg.outlived(old, gone["document"], "doc_id"), by_id, "source_id"), by_id, "target_id")
            every = old.unionByName(relations)
        nodes = entities.select("id", label(F.col("name"), F.col("description")).alias("text"), "v")
        communities, membership = build_hierarchy(
            nodes, cut(every.select("source_id", "target_id")), s["max_levels"], s["similarity_threshold"],
            embed=lambda rows, text: embed(rows, F.col(text)), summarise=None if self.answers is None else self._summarised,
        )
        index = index_nodes(entities, communities).withColumn("batch", F.lit(batch).cast("long"))
        out = {"documents": log(docs), "chunks": log(chunks), "mentions": log(mentions), "relations": log(relations), "entities": entities, "communities": communities, "membership": membership, "nodes": index}
        if fresh:
            made = fresh[0]
            for more in fresh[1:]:
                made = made.unionByName(more)
            out["vectors"] = Append(made)
        if buried is not None:
            out["tombstones"] = Append(buried)
        return out

    def _update(self, change: Callable[[Tables], dict | None]) -> int | None:
        """Publish; the index is partitioned by layer, so that a search of one layer reads that alone."""
        return self.store.update(change, {"nodes": "layer"})
