import pytest
from pyspark.sql import functions as F

from lattice.functions import text as fn
from lattice.operators import answer, cluster, graph, kg, search, vectors
from lattice.plans.hierarchy import build_hierarchy
from lattice.sources.corpus import read_corpus, resolve_fields


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_chunks_of_a_long_document(spark):
    found = kg.chunk_documents(docs(spark, "A" * 100, "", None), 20, 5).orderBy("start").collect()
    assert [r.start for r in found] == [0, 15, 30, 45, 60, 75, 90]
    assert found[-1].text == "A" * 10
    assert kg.chunk_documents(docs(spark, "x" * 1200)).count() == 2


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 11), (10, -1)])
def test_overlap_must_be_less_than_size(spark, size, overlap):
    with pytest.raises(ValueError):
        kg.chunk_documents(docs(spark, "x"), size, overlap)


def test_names_that_differ_by_case_are_one_entity(spark):
    found = spark.createDataFrame(
        [(1, 0, 0, "c", "Ann", "Term", ""), (1, 0, 1, "c", " ann ", "Term", "d"), (2, 0, 0, "e", "ANN", "Term", "f"), (3, 0, 0, "e", "  ", "Term", "g")],
        "doc_id long, chunk_no int, pos int, chunk_id string, name string, entity_type string, description string",
    )
    (one,) = kg.merge_entities(found).collect()
    assert (one.name, one.n_mentions, one.description, one.source_chunk_ids) == ("Ann", 3, " d f", ["c", "c", "e"])
    assert kg.merge_entities(found, descriptions=2).first().description == " d"


def test_relations_need_both_ends_seen_before(spark):
    chunks = spark.createDataFrame([(0, 0, "a", "Anna Berta"), (0, 1, "b", "Clara Anna"), (1, 0, "c", "")], "doc_id long, chunk_no int, chunk_id string, text string")
    mentions = kg.extract_mentions(chunks)
    early = kg.extract_relations(mentions).unionByName(spark.createDataFrame([(0, 0, 9, "Anna", "Clara")], "doc_id long, chunk_no int, pos int, source string, target string"))
    found = kg.resolve_relations(early, kg.entity_keys(mentions))
    assert rows(found.select("chunk_no", "pos")) == [(0, 0), (1, 0)]


def test_graph_with_self_loops_and_parallel_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("b", "gone")], "source_id string, target_id string")
    assert rows(graph.neighbours(edges, nodes)) == [("a", "a"), ("a", "b"), ("b", "a"), ("gone", "b")]  # an end that isn't a node is no neighbour, but has some
    assert graph.neighbours(edges, nodes, bag=True).count() == 6
    assert graph.relations_for(edges, nodes.where("id = 'a'")).count() == 3
    left, kept = graph.remove_nodes(nodes, edges, spark.createDataFrame([("b",)], "id string"))
    assert rows(left) == [("a",), ("c",)] and rows(kept) == [("a", "a")]
    assert graph.average_degree_k(3, 4) == 2 and graph.average_degree_k(0, 0) == 2 and graph.average_degree_k(2, 10) == 10


def test_lifted_edges_are_distinct_and_between_communities(spark):
    edges = spark.createDataFrame([(1, 3), (3, 1), (2, 3), (1, 2)], "source_id long, target_id long")
    of = spark.createDataFrame([(1, 10), (2, 10), (3, 30)], "member_id long, community_id long")
    assert rows(graph.lift_edges(edges, of)) == [(10, 30)]


def test_zero_vectors_and_ties(spark):
    v = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0]), (4, 1, [1.0, 0.0])], "id long, layer int, v array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, v array<double>").crossJoin(F.broadcast(v.select("layer").distinct()))
    found = vectors.nearest(asked, v, 10).orderBy("layer", "rank").collect()
    assert [(r.layer, r.id) for r in found] == [(0, 2), (0, 3), (0, 1), (1, 4)]
    assert found[2].distance == pytest.approx(1.0)


def test_nearest_of_several_blocks_loses_no_layer(spark):
    import random

    rng = random.Random(1)
    rows_of = [(i, i % 7, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    v = spark.createDataFrame(rows_of, "id long, layer int, v array<double>").repartition(8)
    asked = v.select(F.col("id").alias("query_id"), "layer", "v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # partitions stay apart, as those of large tables do
    try:
        whole, parts = (rows(vectors.nearest(asked, v, 3, block=b).select("layer", "query_id", "rank", "id")) for b in (1000, 50))
        one = rows(vectors.nearest(asked.where("query_id < 10"), v, 3, block=50).select("layer", "query_id", "rank", "id"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(whole) == 900 and parts == whole
    assert one == [r for r in whole if r[1] < 10]


def test_copies_of_a_vector_are_ties(spark):
    import random

    rng = random.Random(2)
    some = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(111)]
    v = spark.createDataFrame([(i, 0, some[i % 111]) for i in range(333)], "id long, layer int, v array<double>")
    found = vectors.nearest(v.where("id < 5").select(F.col("id").alias("query_id"), "layer", "v"), v, 333)
    near = {}
    for r in found.orderBy("query_id", "rank").collect():
        near.setdefault((r.query_id, r.id % 111), []).append((r.id, r.distance))
    assert all([i for i, _ in x] == sorted(i for i, _ in x) and len({d for _, d in x}) == 1 for x in near.values())
    sims = {}
    for r in vectors.similar_pairs(v.select("id", "v"), -2.0).collect():
        sims.setdefault((min(r.a % 111, r.b % 111), max(r.a % 111, r.b % 111)), set()).add(r.sim)
    assert all(len(x) == 1 for x in sims.values())


@pytest.mark.parametrize("k", [1, 3])
def test_greedy_edges_are_those_of_one_pass_in_order(spark, k):
    import random

    rng = random.Random(k)
    pairs = [(a, b, rng.choice([0.5, 0.6, 0.7, rng.random()])) for a in range(24) for b in range(a + 1, 24) if rng.random() < 0.3 or a == 7 or b == 20]
    pairs += [(100 + i, 101 + i, 0.9 - 0.01 * i) for i in range(6)]  # a chain, where each node waits for the one before
    near, added = {}, set()
    for a, b, sim in pairs:
        near.setdefault(a, []).append((-sim, b))
        near.setdefault(b, []).append((-sim, a))
    for node in sorted(near):
        left = k
        for _, other in sorted(near[node]):
            pair = (min(node, other), max(node, other))
            if left and pair not in added:
                added.add(pair)
                left -= 1
    found = vectors.augment_greedily(spark.createDataFrame(pairs, "a long, b long, sim double"), k)
    assert rows(found.select("a", "b")) == sorted(added)
    assert set(rows(vectors.augment(spark.createDataFrame(pairs, "a long, b long, sim double"), k).select("a", "b"))) <= added
    assert vectors.augment_greedily(spark.createDataFrame([], "a long, b long, sim double"), k).count() == 0


def few_vectors(spark, n=150, different=40):
    import random

    rng = random.Random(3)
    some = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(different - 1)] + [[0.0] * 5]
    rows_of = [(i, some[rng.randrange(different)] if i % 3 else [rng.gauss(0, 1) for _ in range(5)]) for i in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(60)]
    return spark.createDataFrame(rows_of, "id long, v array<double>"), spark.createDataFrame(edges, "source_id long, target_id long")


@pytest.mark.parametrize("k,first", [(2, 1), (3, None)])
def test_greedy_edges_from_heads_of_lists(spark, k, first):
    nodes, edges = few_vectors(spark)
    pairs = vectors.new_pairs(vectors.similar_pairs(nodes, 0.6), edges).collect()
    near, added = {}, set()
    for a, b, sim in pairs:
        near.setdefault(a, []).append((-sim, b))
        near.setdefault(b, []).append((-sim, a))
    for node in sorted(near):
        left = k
        for _, other in sorted(near[node]):
            pair = (min(node, other), max(node, other))
            if left and pair not in added:
                added.add(pair)
                left -= 1
    found = vectors.augment_similar(nodes, edges, 0.6, k, first=first)
    assert rows(found.select("a", "b")) == sorted(added)


def test_groups_of_copies_are_those_of_all_pairs(spark):
    nodes, _ = few_vectors(spark)
    of = vectors.copies(nodes).cache()
    near = vectors.class_pairs(of, 0.75).cache()
    assert near.count() < vectors.similar_pairs(nodes, 0.75).count()
    edges = vectors.similar_pairs(nodes, 0.75).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("sim").alias("weight"))
    assert rows(cluster.components_of_copies(of, near)) == rows(cluster.components(nodes.select("id"), edges))
    assert rows(cluster.label_propagation_of_copies(of, near)) == rows(cluster.label_propagation(nodes.select("id"), edges))


@pytest.mark.parametrize("numbers", [None, 250])  # one stripe of vectors, and three
def test_vectors_are_compared_by_stripes(spark, monkeypatch, numbers):
    monkeypatch.setattr(vectors, "STRIPE", numbers or vectors.STRIPE)
    nodes, edges = few_vectors(spark)
    v = {r.id: r.v for r in nodes.collect()}

    def cos(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(v[a], v[b]) / ((dot(v[a], v[a]) * dot(v[b], v[b])) ** 0.5 + 1e-10)

    every = sorted((a, b) for a in v for b in v if a < b and cos(a, b) >= 0.6)
    assert rows(vectors.similar_pairs(nodes, 0.6).select("a", "b")) == every
    new = vectors.new_pairs(vectors.similar_pairs(nodes, 0.6), edges)
    for first in (1, None):
        assert rows(vectors.augment_nearest(nodes, edges, 0.6, 3, first=first)) == rows(vectors.augment(new, 3))
    assert rows(vectors.augment_similar(nodes, edges, 0.6, 3).select("a", "b")) == rows(vectors.augment_greedily(new, 3).select("a", "b"))
    weighted = vectors.similar_pairs(nodes, 0.6).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("sim").alias("weight"))
    assert rows(cluster.label_propagation_of_vectors(vectors.copies(nodes), 0.6)) == rows(cluster.label_propagation(nodes.select("id"), weighted))
    none = nodes.where("id < 0")
    assert vectors.similar_pairs(none, 0.6).count() == vectors.augment_nearest(none, edges, 0.6, 3).count() == 0
    assert cluster.label_propagation_of_vectors(vectors.copies(none), 0.6).count() == 0


def test_stripes_shuffle_no_pairs(spark, tmp_path):
    """1,200 similar vectors have 719,400 pairs; what the joins write is in proportion to the vectors."""
    import random

    rng = random.Random(4)
    nodes = spark.createDataFrame([(i, [1.0, rng.random(), rng.random()]) for i in range(1200)], "id long, v array<double>")
    edges = spark.createDataFrame([(0, 1)], "source_id long, target_id long")
    tables = vectors.Tables(spark, "counted")
    near = vectors.nearest_classes(nodes, nodes, 0.1, 5, tables, "near")
    assert near.count() == 5 * 1200 and vectors.augment_nearest(nodes, edges, 0.1, 2).count() <= 2 * 1200
    kept = vectors.votes_of_labels(nodes.select("id", "v", F.expr("array(struct(id % 3 AS community, 1L AS n)) AS labels")), 0.1, lambda votes: votes, tables, "votes")
    assert kept.count() == 3 * 1200
    assert "Exchange" not in vectors.distinct_pairs(nodes, 0.1)._jdf.queryExecution().executedPlan().toString()


def test_connected_components_of_a_long_path(spark):
    nodes = spark.range(60).select("id")
    edges = spark.range(40).select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    found = dict(rows(cluster.components(nodes, edges)))
    assert all(found[k] == (0 if k <= 40 else k) for k in range(60))


def test_hierarchy_of_fewer_than_three_nodes_is_empty(spark):
    nodes = spark.createDataFrame([(1, "x", [1.0]), (2, "y", [1.0])], "id long, text string, v array<double>")
    edges = spark.createDataFrame([], "source_id long, target_id long")
    communities, members = build_hierarchy(nodes, edges)
    assert communities.count() == 0 and members.count() == 0


def test_search_is_literal(spark):
    e = spark.createDataFrame([(1, "a_b"), (2, "axb"), (3, "50%"), (4, "back\\slash"), (5, None)], "id long, name string")
    for wanted, ids in (("A_B", [1]), ("%", [3]), ("\\", [4]), ("zz", [])):
        assert [r.id for r in search.search_entities(e, wanted).orderBy("id").collect()] == ids


def test_scores_are_ranked_and_bad_ones_fall_back(spark):
    hits = spark.createDataFrame([(0, 0, 1, "a", 0.1, "x"), (0, 1, 1, "b", 0.1, "y")], "query_id long, layer int, rank int, id string, distance double, text string")
    report = answer.report_text(answer.layer_points(hits)).first()["report"]
    assert report == "- [Score 90.0] x\n- [Score 90.0] y"


def test_hashed_embedding_is_stable_and_defined_for_null(spark):
    found = spark.createDataFrame([("some text",), ("some text",), ("",), (None,)], "t string").select(fn.hashed_embedding(F.col("t")).alias("v")).collect()
    assert found[0].v == found[1].v and len(found[0].v) == 64


def test_hashed_embedding_hashes_each_word_once(spark):
    long = " ".join(f"word{i}" for i in range(2000))
    made = spark.createDataFrame([(long,)], "t string").select(fn.hashed_embedding(F.col("t")).alias("v"))
    # once for the slot and once for the sign, in a value that is named and not repeated for each dimension
    assert made._jdf.queryExecution().analyzed().toString().count("md5(") == 2
    v = made.first().v
    assert sum(x * x for x in v) == pytest.approx(1.0)


def test_corpus_forms(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"text": "a", "id": "1"}\nnot json\n\n{"context": "", "text": "x", "id": "2"}\n')
    found = {r.id: r.body for r in resolve_fields(read_corpus(spark, str(tmp_path / "lines.jsonl"))).collect()}
    assert found == {"1": "a", "2": ""}
    (tmp_path / "pretty.json").write_text('[\n {"text": "a"},\n {"text": "b"}\n]\n')
    assert {r.text for r in read_corpus(spark, str(tmp_path / "pretty.json")).collect()} == {"a", "b"}
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(tmp_path / "missing"))
    (tmp_path / "none.json").write_text("nothing here\n")
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path / "none.json"))
