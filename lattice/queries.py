"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.functions import text as fn
from lattice.lineage import cut, shared_folder
from lattice.operators import answer, cluster, community, graph, kg, search, vectors

THRESHOLD = 0.35


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# inputs made of the tables -------------------------------------------------


def _chunks(spark, sf):
    return kg.chunk_documents(_t(spark, sf, "documents").select("doc_id", "text"))


def _mentions(spark, sf):
    return kg.extract_mentions(_chunks(spark, sf))


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("layer"))


def _ring(spark, sf):
    """Two edges from each vector, to ids made from its own."""
    e = _t(spark, sf, "embeddings")
    n = e.count()
    return e.select(F.col("vec_id").alias("source_id"), F.explode(F.array((F.col("vec_id") * 7 + 3) % n, (F.col("vec_id") * 3 + 1) % n)).alias("target_id"))


def _star(spark, sf):
    """Customers, suppliers, nations and regions as nodes (id, name), keys as edges."""
    c, s, n, r = (_t(spark, sf, x) for x in ("customer", "supplier", "nation", "region"))
    key = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    nodes = (
        c.select(key("C", "c_custkey").alias("id"), F.col("c_name").alias("name"))
        .unionByName(s.select(key("S", "s_suppkey").alias("id"), F.col("s_name").alias("name")))
        .unionByName(n.select(key("N", "n_nationkey").alias("id"), F.col("n_name").alias("name")))
        .unionByName(r.select(key("R", "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    )
    edges = (
        c.select(key("C", "c_custkey").alias("source_id"), key("N", "c_nationkey").alias("target_id"), F.lit("lives in").alias("description"))
        .unionByName(s.select(key("S", "s_suppkey").alias("source_id"), key("N", "s_nationkey").alias("target_id"), F.lit("is based in").alias("description")))
        .unionByName(n.select(key("N", "n_nationkey").alias("source_id"), key("R", "n_regionkey").alias("target_id"), F.lit("is part of").alias("description")))
    )
    return nodes, edges.withColumn("id", F.concat("source_id", F.lit(">"), "target_id"))


def _asked(spark, sf):
    """The vectors that are queries: every id divisible by 100."""
    return _vectors(spark, sf).where("id % 100 = 0").select(F.col("id").alias("query_id"), "v", "layer")


def _hits(spark, sf, k=5):
    nodes = _vectors(spark, sf).withColumn("label", F.concat(F.lit("vector "), F.col("id").cast("string")))
    return search.hierarchical_search(_asked(spark, sf).drop("layer"), nodes.select("layer", "id", "label", "v"), k)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


_V = "list_transform(embedding, lambda x: x::DOUBLE)"
SQL_CHUNKS = """chunks AS (SELECT substr(sha256(doc_id::VARCHAR || chr(31) || k::VARCHAR), 1, 12) AS chunk_id, doc_id, k::INT AS chunk_no, (k * 1100)::INT AS start, substring(text, k * 1100 + 1, 1200) AS text
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1099) // 1100)) AS k FROM documents WHERE length(text) > 0))"""
SQL_MENTIONS = (
    SQL_CHUNKS
    + """, named AS (SELECT doc_id, chunk_no, chunk_id, regexp_extract_all(text, '[A-Z][a-z]{3,}') AS names FROM chunks),
  mentions AS (SELECT doc_id, chunk_no, chunk_id, pos::INT AS pos, names[pos + 1] AS name, lower(names[pos + 1]) AS key, coalesce(names[pos + 2], '') AS description
    FROM (SELECT *, unnest(range(len(names))) AS pos FROM named)),
  entities AS (SELECT substr(sha256(key), 1, 12) AS id, key, count(*) AS n_mentions, min({d: doc_id, c: chunk_no, p: pos}) AS f, arg_min(name, {d: doc_id, c: chunk_no, p: pos}) AS name FROM mentions GROUP BY key)"""
)
SQL_VECTORS = f"v AS (SELECT vec_id AS id, {_V} AS v, label AS layer, sqrt(list_dot_product({_V}, {_V})) AS n FROM embeddings)"
SQL_RING = "ring AS (SELECT vec_id AS source_id, unnest([(vec_id * 7 + 3) % (SELECT count(*) FROM embeddings), (vec_id * 3 + 1) % (SELECT count(*) FROM embeddings)]) AS target_id FROM embeddings)"
SQL_STAR = """nodes AS (SELECT 'C' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region),
  edges AS (SELECT *, source_id || '>' || target_id AS id FROM (SELECT 'C' || c_custkey AS source_id, 'N' || c_nationkey AS target_id, 'lives in' AS description FROM customer
    UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'is based in' FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'is part of' FROM nation))"""
SQL_DIST = "1 - list_dot_product(a.v, b.v) / ((a.n + 1e-10) * (b.n + 1e-10))"
SQL_COS = "list_dot_product(a.v, b.v) / (a.n * b.n + 1e-10)"
SQL_HITS = (
    SQL_VECTORS
    + f""", hits AS (SELECT * FROM (SELECT a.id AS query_id, b.layer, row_number() OVER (PARTITION BY a.id, b.layer ORDER BY {SQL_DIST}, b.id)::INT AS rank, b.id, {SQL_DIST} AS distance, 'vector ' || b.id AS label
  FROM v a JOIN v b ON a.id % 100 = 0) WHERE rank <= 5)"""
)
SQL_PAIRS = SQL_VECTORS + f", pairs AS (SELECT a.id AS a, b.id AS b, {SQL_COS} AS sim FROM v a JOIN v b ON a.id < b.id WHERE {SQL_COS} >= {THRESHOLD})"
SQL_NEW = SQL_PAIRS + f", {SQL_RING}, fresh AS (SELECT * FROM pairs WHERE NOT EXISTS (SELECT 1 FROM ring WHERE least(source_id, target_id) = a AND greatest(source_id, target_id) = b))"

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# chunks, entities, relations ------------------------------------------------


@_query("SELECT doc_id::VARCHAR AS id, source AS title, coalesce(text, '') AS body FROM documents")
def doc_fields(spark, sf):
    from lattice.sources.corpus import resolve_fields

    d = _t(spark, sf, "documents")
    return resolve_fields(d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("context"), "text"))


@_query(f"WITH {SQL_CHUNKS} SELECT chunk_id, doc_id, chunk_no, start, text FROM chunks")
def chunk_documents(spark, sf):
    return _chunks(spark, sf)


@_query(f"""WITH {SQL_MENTIONS}, later AS (SELECT m.key, string_agg(' ' || m.description, '' ORDER BY m.doc_id, m.chunk_no, m.pos) AS t FROM mentions m JOIN entities e USING (key)
  WHERE m.description <> '' AND {{d: m.doc_id, c: m.chunk_no, p: m.pos}} > e.f GROUP BY m.key)
  SELECT e.id, e.key, e.name, 'Term' AS entity_type, md5(m.description || coalesce(l.t, '')) AS description_md5, e.n_mentions, e.f.d AS first_doc, e.f.c AS first_chunk, e.f.p AS first_pos
  FROM entities e JOIN mentions m ON m.key = e.key AND m.doc_id = e.f.d AND m.chunk_no = e.f.c AND m.pos = e.f.p LEFT JOIN later l ON l.key = e.key""")
def merge_entities(spark, sf):
    return kg.merge_entities(_mentions(spark, sf)).withColumn("description_md5", F.md5("description")).drop("source_chunk_ids", "description")


@_query(f"""WITH {SQL_MENTIONS} SELECT substr(sha256(m.doc_id::VARCHAR || chr(31) || m.chunk_no::VARCHAR || chr(31) || m.pos::VARCHAR), 1, 12) AS id, s.id AS source_id, t.id AS target_id, m.doc_id, m.chunk_no, m.pos
  FROM mentions m JOIN entities s ON s.key = m.key JOIN entities t ON t.key = lower(m.description) WHERE m.description <> '' AND {{d: s.f.d, c: s.f.c}} <= {{d: m.doc_id, c: m.chunk_no}} AND {{d: t.f.d, c: t.f.c}} <= {{d: m.doc_id, c: m.chunk_no}}""")
def resolve_relations(spark, sf):
    mentions = _mentions(spark, sf)
    return kg.resolve_relations(kg.extract_relations(mentions), kg.entity_keys(mentions))


@_query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042')")
def entity_by_name(spark, sf):
    return _t(spark, sf, "customer").where(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000042"))).select("c_custkey", "c_name")


@_query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def search_entities(spark, sf):
    return search.search_entities(_t(spark, sf, "part").withColumnRenamed("p_name", "name"), "RING").select("p_partkey", F.col("name").alias("p_name"))


@_query(f"WITH {SQL_CHUNKS} SELECT chunk_id, doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text FROM chunks WHERE contains(lower(text), 'license')")
def search_chunks(spark, sf):
    return search.search_chunks(_chunks(spark, sf), "License")


@_query(f"""WITH {SQL_CHUNKS} SELECT 'entity' AS kind, p_partkey::VARCHAR AS id, left(p_type, 120) AS text FROM part WHERE contains(lower(p_name), 'the')
  UNION ALL SELECT 'chunk', chunk_id, left(text, 120) || '...' FROM chunks WHERE contains(lower(text), 'the')""")
def search_all(spark, sf):
    parts = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return search.search_all(parts, _chunks(spark, sf), "the")


# graph -----------------------------------------------------------------------


@_query(f"WITH {SQL_STAR} SELECT n.id AS node_id, e.id, e.source_id, e.target_id, e.description FROM edges e JOIN nodes n ON e.source_id = n.id OR e.target_id = n.id WHERE n.id[1] IN ('N', 'R')")
def relations_for(spark, sf):
    nodes, edges = _star(spark, sf)
    return graph.relations_for(edges, nodes.where("substring(id, 1, 1) IN ('N', 'R')"))


@_query(f"WITH {SQL_STAR} SELECT DISTINCT id, neighbour_id FROM (SELECT source_id AS id, target_id AS neighbour_id FROM edges UNION ALL SELECT target_id, source_id FROM edges) WHERE neighbour_id IN (SELECT id FROM nodes)")
def neighbours(spark, sf):
    nodes, edges = _star(spark, sf)
    return graph.neighbours(edges, nodes)


@_query(f"WITH {SQL_STAR} SELECT id, neighbour_id FROM (SELECT source_id AS id, target_id AS neighbour_id FROM edges UNION ALL SELECT target_id, source_id FROM edges)")
def neighbours_bag(spark, sf):
    nodes, edges = _star(spark, sf)
    return graph.neighbours(edges, nodes, bag=True)


@_query(f"""WITH {SQL_CHUNKS} SELECT (SELECT count(*) FROM customer) AS entities, (SELECT count(*) FROM orders) AS relations, (SELECT count(*) FROM chunks) AS chunks, (SELECT max(label) + 1 FROM embeddings)::INT AS height""")
def stats(spark, sf):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(_t(spark, sf, "customer"), "entities"), one(_t(spark, sf, "orders"), "relations"), one(_chunks(spark, sf), "chunks"), _t(spark, sf, "embeddings").agg((F.max("label") + 1).cast("int").alias("height"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


@_query("SELECT greatest(2, greatest(1, (2 * (SELECT count(*) FROM lineitem)) // greatest(1, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier))))::BIGINT AS k")
def knn_k(spark, sf):
    n = _t(spark, sf, "part").count() + _t(spark, sf, "supplier").count()
    return spark.createDataFrame([(graph.average_degree_k(n, _t(spark, sf, "lineitem").count()),)], "k long")


@_query(f"WITH {SQL_VECTORS}, {SQL_RING} SELECT source_id, target_id, round(greatest({SQL_COS}, 0), 4) AS weight FROM ring JOIN v a ON a.id = source_id JOIN v b ON b.id = target_id")
def edge_weights(spark, sf):
    return _rounded(graph.edge_weights(_ring(spark, sf), _vectors(spark, sf)), "weight")


@_query(f"WITH {SQL_NEW} SELECT a, b, round(sim, 4) AS sim FROM fresh")
def knn_candidates(spark, sf):
    return _rounded(vectors.new_pairs(vectors.similar_pairs(_vectors(spark, sf), THRESHOLD), _ring(spark, sf)), "sim")


@_query(f"""WITH {SQL_NEW}, ends AS (SELECT a, b, sim, unnest([a, b]) AS node FROM fresh)
  SELECT DISTINCT a, b, round(sim, 4) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY sim DESC, a, b) AS k FROM ends) WHERE k <= 4""")
def knn_augment(spark, sf):
    ring = _ring(spark, sf)
    k = graph.average_degree_k(_t(spark, sf, "embeddings").count(), ring.count())
    return _rounded(vectors.augment_nearest(_vectors(spark, sf).select("id", "v"), ring, THRESHOLD, k), "sim")


@_query(f"""WITH RECURSIVE {SQL_NEW}, ends AS (SELECT a, b, sim, unnest([a, b]) AS node FROM fresh),
  lists AS (SELECT row_number() OVER (ORDER BY node) AS i, l FROM (SELECT node, list({{'a': a, 'b': b}} ORDER BY sim DESC, a + b - node) AS l FROM ends GROUP BY node)),
  walk AS (SELECT 0::BIGINT AS i, []::STRUCT(a BIGINT, b BIGINT)[] AS added UNION ALL
    SELECT lists.i, list_concat(added, list_slice(list_filter(l, lambda p: NOT list_contains(added, p)), 1, 4)) FROM walk JOIN lists ON lists.i = walk.i + 1)
  SELECT p.a AS a, p.b AS b FROM (SELECT unnest(added) AS p FROM walk WHERE i = (SELECT max(i) FROM walk))""")
def knn_greedy(spark, sf):
    ring = _ring(spark, sf)
    k = graph.average_degree_k(_t(spark, sf, "embeddings").count(), ring.count())
    return vectors.augment_similar(_vectors(spark, sf).select("id", "v"), ring, THRESHOLD, k).select("a", "b")


@_query(f"""WITH RECURSIVE {SQL_PAIRS}, sym AS (SELECT a AS s, b AS t FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT id, id AS r FROM v UNION SELECT reach.id, t FROM reach JOIN sym ON s = r)
  SELECT id, min(r) AS community FROM reach GROUP BY id""")
def components(spark, sf):
    of = cut(vectors.copies(_vectors(spark, sf)))
    return cluster.components_of_copies(of, cut(vectors.class_pairs(of, THRESHOLD)))


def _lpa_sql() -> str:
    sql = f"WITH {SQL_PAIRS}, sym AS (SELECT a AS s, b AS t, sim AS w FROM pairs UNION ALL SELECT b, a, sim FROM pairs), l0 AS (SELECT id, id AS community FROM v)"
    for k in range(3):
        sql += f""", l{k + 1} AS (SELECT id, community FROM (SELECT id, community, row_number() OVER (PARTITION BY id ORDER BY round(sum(w), 9) DESC, community) AS k
          FROM (SELECT s AS id, community, w FROM sym JOIN l{k} ON l{k}.id = t UNION ALL SELECT id, community, 1.0 FROM l{k}) GROUP BY id, community) WHERE k = 1)"""
    return sql


@_query(_lpa_sql() + " SELECT id, community FROM l3")
def label_propagation(spark, sf):
    of = cut(vectors.copies(_vectors(spark, sf)))
    return cluster.label_propagation_of_vectors(of, THRESHOLD)


@_query("""WITH e AS (SELECT c_nationkey AS s, n_regionkey AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), w AS (SELECT a.n_nationkey AS s, b.n_nationkey AS t, 1.0 AS w, a.n_regionkey AS ca, b.n_regionkey AS cb FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 3 + 1) % 25 WHERE a.n_nationkey <> b.n_nationkey),
  ends AS (SELECT unnest([ca, cb]) AS c, w, ca = cb AS inside FROM w), sums AS (SELECT c, sum(w) AS degree, sum(CASE WHEN inside THEN w ELSE 0 END) AS inner_ FROM ends GROUP BY c)
  SELECT round(sum(inner_ / m2 - pow(degree / m2, 2)), 9) AS modularity FROM sums, (SELECT sum(degree) AS m2 FROM sums)""")
def modularity(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("c"))
    edges = n.select(F.col("id").alias("source_id"), ((F.col("id") * 3 + 1) % 25).alias("target_id"), F.lit(1.0).alias("weight"))
    return graph.modularity(edges, n.select(F.col("id").alias("member_id"), F.col("c").alias("community_id"))).select(F.round("modularity", 9).alias("modularity"))


@_query("""SELECT DISTINCT least(ca, cb) AS source_id, greatest(ca, cb) AS target_id FROM (SELECT c_nationkey AS ca, s_nationkey AS cb FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) WHERE ca <> cb""")
def lift_edges(spark, sf):
    pairs = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = pairs.select(F.concat(F.lit("C"), "o_custkey").alias("source_id"), F.concat(F.lit("S"), "l_suppkey").alias("target_id"))
    membership = _t(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("member_id"), F.col("c_nationkey").alias("community_id"))
    membership = membership.unionByName(_t(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("member_id"), F.col("s_nationkey").alias("community_id")))
    return graph.lift_edges(edges, membership)


# communities and index -----------------------------------------------------------


def _community(spark, sf):
    c = _t(spark, sf, "customer")
    return community.community_texts(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community")), c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(": "), "c_mktsegment").alias("text")))


SQL_COMMUNITY = """ranked AS (SELECT c_nationkey AS community, c_name || ': ' || c_mktsegment AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)"""


@_query(f"WITH {SQL_COMMUNITY} SELECT community, count(*) AS n_members, string_agg('- ' || t, chr(10) ORDER BY k) FILTER (k <= 30) AS block FROM ranked GROUP BY community")
def community_block(spark, sf):
    return _community(spark, sf).select("community", "n_members", "block")


@_query(f"WITH {SQL_COMMUNITY} SELECT community, string_agg(t, ' | ' ORDER BY k) FILTER (k <= 5) AS summary FROM ranked GROUP BY community")
def community_summary(spark, sf):
    return _community(spark, sf).select("community", "summary")


@_query("SELECT vec_id, label AS level FROM embeddings WHERE label = 3")
def communities_at_level(spark, sf):
    return _t(spark, sf, "embeddings").where("label = 3").select("vec_id", F.col("label").alias("level"))


@_query("SELECT n_regionkey AS level, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS pos, n_nationkey AS id, n_name AS name FROM nation")
def hierarchy_load(spark, sf):
    n = _t(spark, sf, "nation")
    listed = n.groupBy(F.col("n_regionkey").alias("level")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("ids"))
    rows = listed.select("level", F.posexplode("ids").alias("pos", "id"))
    return rows.join(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "id").select("level", (F.col("pos") + 1).alias("pos"), "id", "name")


@_query("SELECT 0 AS layer, p_partkey AS id, p_name AS label FROM part UNION ALL SELECT n_regionkey + 1, n_nationkey::BIGINT, left(n_name, 80) FROM nation")
def index_nodes(spark, sf):
    empty = F.array().cast("array<double>")
    parts = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), empty.alias("v"))
    nations = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("level"), F.col("n_name").alias("summary"), empty.alias("v"))
    return community.index_nodes(parts, nations).drop("v")


@_query(f"""WITH {SQL_VECTORS} SELECT * FROM (SELECT a.layer, a.id AS src, row_number() OVER (PARTITION BY a.id ORDER BY {SQL_DIST}, b.id)::INT AS rank, b.id AS dst, round({SQL_DIST}, 4) AS distance FROM v a JOIN v b ON a.layer = b.layer AND a.id <> b.id) WHERE rank <= 4""")
def intra_links(spark, sf):
    return _rounded(community.intra_links(_vectors(spark, sf), 4), "distance")


@_query(f"""WITH {SQL_VECTORS} SELECT layer, src, dst, round(distance, 4) AS distance FROM (SELECT a.layer, a.id AS src, b.id AS dst, {SQL_DIST} AS distance, row_number() OVER (PARTITION BY a.id ORDER BY {SQL_DIST}, b.id) AS k FROM v a JOIN v b ON b.layer = a.layer - 1) WHERE k = 1""")
def inter_links(spark, sf):
    return _rounded(community.inter_links(_vectors(spark, sf)), "distance")


@_query("SELECT label AS layer, count(*) AS n FROM embeddings GROUP BY label")
def layer_counts(spark, sf):
    return _t(spark, sf, "embeddings").groupBy(F.col("label").alias("layer")).agg(F.count("*").alias("n"))


# search and answers ----------------------------------------------------------------


@_query(f"""WITH {SQL_VECTORS} SELECT layer, query_id, rank, id, round(distance, 4) AS distance FROM (SELECT a.layer, a.id AS query_id, b.id, {SQL_DIST} AS distance, row_number() OVER (PARTITION BY a.id ORDER BY {SQL_DIST}, b.id)::INT AS rank FROM v a JOIN v b ON a.layer = b.layer WHERE a.id % 100 = 0) WHERE rank <= 5""")
def vector_search(spark, sf):
    return _rounded(vectors.nearest(_asked(spark, sf), _vectors(spark, sf), 5), "distance")


@_query(f"""WITH {SQL_VECTORS} SELECT layer, query_id, rank, id, round(distance, 4) AS distance FROM (SELECT a.layer, a.id AS query_id, b.id, {SQL_DIST} AS distance, row_number() OVER (PARTITION BY a.id ORDER BY {SQL_DIST}, b.id)::INT AS rank FROM v a JOIN v b ON a.layer = b.layer WHERE a.id % 100 = 0 AND b.id IN (SELECT s_suppkey FROM supplier)) WHERE rank <= 5""")
def vector_search_candidates(spark, sf):
    rows = search.candidates_only(_vectors(spark, sf), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))
    return _rounded(vectors.nearest(_asked(spark, sf), rows, 5), "distance")


@_query(f"WITH {SQL_HITS} SELECT query_id, layer, rank, id, round(distance, 4) AS distance, label FROM hits")
def hierarchical_search(spark, sf):
    return _rounded(_hits(spark, sf), "distance")


@_query(f"""WITH {SQL_STAR}, touching AS (SELECT n.id, string_agg(coalesce(s.name, e.source_id) || ' -> ' || coalesce(t.name, e.target_id) || ': ' || e.description, chr(10) ORDER BY e.id COLLATE C) AS l, count(*) AS k FROM nodes n JOIN edges e ON e.source_id = n.id OR e.target_id = n.id LEFT JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.id = e.target_id GROUP BY n.id)
  SELECT n.id, md5(n.name || coalesce(chr(10) || 'Relationships:' || chr(10) || l, '')) AS text_md5, coalesce(k, 0) AS n_relations FROM nodes n LEFT JOIN touching USING (id)""".replace(" COLLATE C", ""))
def enrich_hits(spark, sf):
    nodes, edges = _star(spark, sf)
    return search.enrich_hits(nodes.select("id", F.col("name").alias("text")), edges, nodes).select("id", F.md5("text").alias("text_md5"), "n_relations")


@_query(f"""WITH {SQL_HITS} SELECT query_id, layer, string_agg('### Item ' || rank || ' (layer ' || layer || ', distance ' || printf('%.4f', distance) || ')' || chr(10) || label, chr(10) || chr(10) ORDER BY rank) AS block FROM hits GROUP BY query_id, layer""")
def context_block(spark, sf):
    return answer.context_block(_hits(spark, sf).withColumnRenamed("label", "text"))


SQL_POINTS = SQL_HITS + ", points AS (SELECT query_id, layer, rank AS pos, label AS description, least(100.0, greatest(0.0, floor(100 * (1 - distance) + 0.5)))::DOUBLE AS score FROM hits)"


@_query(f"WITH {SQL_POINTS} SELECT query_id, layer, pos, description, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, layer, pos)::INT AS place FROM points")
def ranked_points(spark, sf):
    points = answer.layer_points(_hits(spark, sf).withColumnRenamed("label", "text"))
    return points.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "layer", "pos")))


@_query(f"WITH {SQL_POINTS} SELECT query_id, string_agg('- [Score ' || score::VARCHAR || '] ' || description, chr(10) ORDER BY score DESC, layer, pos) AS report FROM points GROUP BY query_id")
def report_text(spark, sf):
    return answer.report_text(answer.layer_points(_hits(spark, sf).withColumnRenamed("label", "text")))


@_query("SELECT event_id, json_extract_string(regexp_extract('noise ' || props || ' noise', '\\{.*\\}'), '$.k') AS k FROM events")
def extract_json(spark, sf):
    return _t(spark, sf, "events").select("event_id", fn.json_object(F.concat(F.lit("noise "), "props", F.lit(" noise")), "k string")["k"].alias("k"))


# mutations ---------------------------------------------------------------------------


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer UNION ALL SELECT -s_suppkey, s_name FROM supplier")
def upsert_entities(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = c.where("id % 2 = 0").select("id", F.upper("name").alias("name")).unionByName(_t(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name")))
    return graph.upsert(c, new)


@_query(f"WITH {SQL_STAR} SELECT source_id, target_id FROM edges WHERE NOT (source_id IN ('N3', 'R1', 'C7') OR target_id IN ('N3', 'R1', 'C7'))")
def remove_entity(spark, sf):
    nodes, edges = _star(spark, sf)
    gone = spark.createDataFrame([("N3",), ("R1",), ("C7",)], "id string")
    return graph.remove_nodes(nodes, edges, gone)[1].select("source_id", "target_id")


@_query("SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + item_id, text FROM benchmark")
def add_documents(spark, sf):
    old = _t(spark, sf, "documents").select("doc_id", "text")
    return graph.upsert(old, _t(spark, sf, "benchmark").select((F.lit(1000000000) + F.col("item_id")).alias("doc_id"), "text"), "doc_id")


@_query("SELECT item_id::VARCHAR AS id, text AS body FROM benchmark")
def corpus_jsonl(spark, sf):
    import uuid

    from lattice.sources.corpus import read_corpus, resolve_fields

    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    _t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text").write.json(path)
    return resolve_fields(read_corpus(spark, path)).select("id", "body")


@_query("SELECT conv_id, turn, text FROM conversations")
def stream_ingest(spark, sf):
    import uuid

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _t(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text").write.json(f"{root}/landing")

    from lattice.streaming.ingest import ingest

    ingest(spark, f"{root}/landing", f"{root}/checkpoint", lambda batch, k: batch.write.mode("overwrite").parquet(f"{root}/out/batch={k}"), every=None).awaitTermination()
    parts = F.split("id", "-")
    return spark.read.parquet(f"{root}/out").select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), "text")


@_query(f"WITH {SQL_CHUNKS} SELECT chunk_id, doc_id, text FROM chunks WHERE chunk_no = 0 AND doc_id % 100 = 0")
def chunk_lookup(spark, sf):
    wanted = _t(spark, sf, "documents").where("doc_id % 100 = 0").select(fn.stable_id(F.col("doc_id").cast("string"), F.lit("0")).alias("chunk_id"))
    return graph.lookup(_chunks(spark, sf), wanted, "chunk_id").select("chunk_id", "doc_id", "text")


@_query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf):
    return graph.one(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), 42)


@_query(f"WITH {SQL_CHUNKS} SELECT chunk_id, doc_id, chunk_no FROM chunks WHERE NOT (chunk_no = 0 AND doc_id % 100 = 0)")
def delete_chunks(spark, sf):
    gone = _t(spark, sf, "documents").where("doc_id % 100 = 0").select(fn.stable_id(F.col("doc_id").cast("string"), F.lit("0")).alias("chunk_id"))
    return graph.delete(_chunks(spark, sf), gone, "chunk_id").select("chunk_id", "doc_id", "chunk_no")


@_query("""SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'changed' ELSE n_regionkey::VARCHAR END AS value FROM nation
  UNION ALL SELECT r_name, 'changed' FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)""")
def upsert_meta(spark, sf):
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    old = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    new = n.where("n_regionkey = 1").select("n_name").unionByName(r.select(F.col("r_name").alias("n_name"))).distinct()
    return graph.upsert(old, new.select(F.col("n_name").alias("key"), F.lit("changed").alias("value")), "key")


@_query("""SELECT item_id AS id, md5('Question: ' || text || chr(10) || chr(10) || 'Answer it from the scored points below, the highest scores first. Say so if they don''t answer it.'
  || chr(10) || chr(10) || 'Points:' || chr(10) || item_id::VARCHAR) AS prompt_md5 FROM benchmark""")
def prompt_text(spark, sf):
    from lattice.functions import prompts

    b = _t(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.md5(prompts.filled(prompts.ANSWER, F.col("text"), F.col("item_id"))).alias("prompt_md5"))


@_query("""SELECT doc_id AS query_id, 0 AS layer, 1 AS pos, CASE WHEN quality = 1 THEN 'q' ELSE 'toxic ' || toxic::VARCHAR END AS description, CASE WHEN quality = 1 THEN 10.5 + toxic ELSE 50.0 END::DOUBLE AS score FROM labels""")
def model_points(spark, sf):
    good, bad = F.format_string('Here: {"points": [{"description": "q", "score": "%s"}]} as asked', F.lit(10.5) + F.col("toxic")), F.lit('{"points": [{"description": "q", "score": "high"}]}')
    output = F.when(F.col("quality") == 1, good).otherwise(bad)
    rows = _t(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), F.lit(0).alias("layer"), output.alias("output"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("fallback"))
    return answer.model_points(rows)


@_query("SELECT item_id AS id, CASE WHEN item_id % 7 = 0 THEN NULL ELSE 'length ' || length(text) END AS output FROM benchmark")
def generate_rows(spark, sf):
    from lattice.operators.model import generate

    def complete(prompts):  # fails on some prompts, and so on the batches that hold them
        if any(p.startswith("bad") for p in prompts):
            raise RuntimeError
        return [f"length {len(p)}" for p in prompts]

    b = _t(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 7 == 0, "bad").otherwise(F.col("text")).alias("prompt"))
    return generate(b, complete).select("id", "output")


# growing stores, models and embeddings ------------------------------------------------

SQL_BATCHES = """docs AS (SELECT doc_id, text, 1 AS batch FROM documents UNION ALL SELECT 1000000000 + item_id, text, 2 FROM benchmark),
  chunks AS (SELECT substr(sha256(doc_id::VARCHAR || chr(31) || k::VARCHAR), 1, 12) AS chunk_id, batch, doc_id, k::INT AS chunk_no, substring(text, k * 1100 + 1, 1200) AS text
    FROM (SELECT batch, doc_id, text, unnest(range(0, (length(text) + 1099) // 1100)) AS k FROM docs WHERE length(text) > 0)),
  named AS (SELECT batch, doc_id, chunk_no, chunk_id, regexp_extract_all(text, '[A-Z][a-z]{3,}') AS names FROM chunks),
  mentions AS (SELECT batch, doc_id, chunk_no, chunk_id, pos, names[pos + 1] AS name, lower(names[pos + 1]) AS key, coalesce(names[pos + 2], '') AS description FROM (SELECT *, unnest(range(len(names))) AS pos FROM named)),
  live AS (SELECT * FROM mentions WHERE NOT (batch = 1 AND md5(key)[1] = '0')),
  placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY batch, doc_id, chunk_no, pos) AS k FROM live)"""


@_query(f"""WITH {SQL_BATCHES} SELECT key, min(name) FILTER (k = 1) AS name, count(*) AS n_mentions, md5(string_agg(CASE WHEN k = 1 THEN description WHEN description <> '' THEN ' ' || description ELSE '' END, '' ORDER BY k)) AS description_md5,
  md5(string_agg(chunk_id, ',' ORDER BY k)) AS chunks_md5, min(batch) AS first_batch, min(doc_id) FILTER (k = 1) AS first_doc, max(batch) AS last_batch FROM placed GROUP BY key""")
def incremental_entities(spark, sf):
    """Documents as one batch, some of whose names are removed; then the benchmark joins as a second batch, by merging partials."""
    items = _t(spark, sf, "benchmark").select((F.lit(1000000000) + F.col("item_id")).alias("doc_id"), "text")
    old = kg.partial_entities(_mentions(spark, sf).withColumn("batch", F.lit(1).cast("long")))
    gone = old.where("substring(md5(key), 1, 1) = '0'").select("key", F.lit(1).cast("long").alias("batch"))
    new = kg.partial_entities(kg.extract_mentions(kg.chunk_documents(items)).withColumn("batch", F.lit(2).cast("long")))
    merged = kg.merge_partials(kg.outlived(old, gone, "key", "last_batch"), new)
    return merged.select("key", "name", "n_mentions", F.md5("description").alias("description_md5"), F.md5(F.array_join("source_chunk_ids", ",")).alias("chunks_md5"), "first_batch", "first_doc", "last_batch")


@_query(f"""WITH {SQL_MENTIONS}, told AS (SELECT m.* FROM mentions m JOIN chunks USING (chunk_id) WHERE length(text) % 7 <> 0)
  SELECT 'entity' AS kind, doc_id, chunk_no, pos, name AS a, description AS b FROM told
  UNION ALL SELECT 'relation', doc_id, chunk_no, pos, name, description FROM told WHERE description <> ''""")
def model_extraction(spark, sf):
    """A scripted model lists what each chunk names, in JSON with words around it, and says nothing of use about every seventh length."""
    import re
    import uuid

    from lattice.functions import prompts
    from lattice.operators.model import AnswerCache

    def complete(asked):
        import json

        out = []
        for prompt in asked:
            text = prompt.partition("Text:\n")[2]
            names = re.findall("[A-Z][a-z]{3,}", text)
            pairs = list(zip(names, [*names[1:], ""]))
            found = {"entities": [{"name": a, "type": "Term", "description": b} for a, b in pairs], "relations": [{"source": a, "target": b, "description": "next to"} for a, b in pairs if b]}
            out.append("no idea" if len(text) % 7 == 0 else f"Here it is: {json.dumps(found)} as asked")
        return out

    chunks = _chunks(spark, sf)
    cache = AnswerCache(f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}", complete, "scripted", batch=256)
    asked = chunks.select("doc_id", "chunk_no", "chunk_id", prompts.filled(prompts.EXTRACT, F.col("text")).alias("prompt"))
    mentions, relations = kg.parse_extraction(cache.ask(asked))
    one = mentions.select(F.lit("entity").alias("kind"), "doc_id", "chunk_no", "pos", F.col("name").alias("a"), F.col("description").alias("b"))
    return one.unionByName(relations.select(F.lit("relation").alias("kind"), "doc_id", "chunk_no", "pos", F.col("source").alias("a"), F.col("target").alias("b")))


@_query("""SELECT doc_id, d[1] AS d1, d[2] AS d2, d[3] AS d3 FROM (SELECT doc_id, [length(t)::DOUBLE, (length(t) - length(replace(t, 'e', '')))::DOUBLE, (length(t) - length(replace(t, ' ', '')))::DOUBLE] AS d FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def batch_embedding(spark, sf):
    """A scripted embedding of three dimensions, asked once for each distinct text; half of the sources have theirs from a run before."""
    from lattice.operators.embedding import Embedding

    counts = Embedding(3, batch=lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts], name="counts")
    docs = _t(spark, sf, "documents").select("doc_id", "source", "text")
    _, known = counts.embed(docs.where("xxhash64(source) % 2 = 0"), F.col("text"))
    rows, _ = counts.embed(docs, F.col("text"), known)
    return rows.select("doc_id", *[F.col("v")[k].alias(f"d{k + 1}") for k in range(3)])


@_query("""SELECT doc_id, upper(source) AS mark FROM documents UNION ALL SELECT 1000000000 + item_id, 'BENCHMARK' FROM benchmark""")
def conflicting_writers(spark, sf):
    """A writer marks every document with its source while another one adds the benchmark: its commit is refused, and made anew on what is there then."""
    import uuid

    from lattice.sources.store import Append, SnapshotStore

    store = SnapshotStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.write({"rows": _t(spark, sf, "documents").select("doc_id", "source")})
    tries = []

    def mark(tables):
        if not tries:
            store.commit({"rows": Append(_t(spark, sf, "benchmark").select((F.lit(1000000000) + F.col("item_id")).alias("doc_id"), F.lit("benchmark").alias("source")))})
        tries.append(tables.version)
        return {"marks": tables["rows"].select("doc_id", F.upper("source").alias("mark"))}

    store.update(mark)
    return store.read()["marks"]


@_query(None)
def hierarchy(spark, sf):
    from lattice.plans.hierarchy import build_hierarchy

    nodes = _vectors(spark, sf).select("id", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("text"), F.col("v").cast("array<double>").alias("v"))
    communities, _ = build_hierarchy(nodes, _ring(spark, sf), max_levels=3, threshold=THRESHOLD)
    return communities.select("level", "id", "summary", "n_members")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
