import pytest

import __spark_entry__
from lattice import queries
from oracle import duckdb_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duckdb_rows(queries.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", ["hierarchical_search", "ranked_points", "report_text", "vector_search", "vector_search_candidates", "inter_links"])
def test_searches_of_several_blocks_give_the_rows_of_their_sql(spark, sf_dir, monkeypatch, name):
    from lattice.operators import vectors

    monkeypatch.setattr(vectors, "_blocks", lambda rows, block: 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # partitions stay apart, as those of large tables do
    try:
        found = spark_rows(queries.queries()[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found == duckdb_rows(queries.oracle_sql()[name], sf_dir)


def test_entry_points(spark, sf_dir):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.queries()) <= set(__spark_entry__.queries())
    first = __spark_entry__.entry(spark)
    assert first.count() > 0 and first.schema == __spark_entry__.entry(spark).schema


def test_hierarchy_covers_every_node_once_a_level(spark, sf_dir):
    rows = queries.hierarchy(spark, sf_dir).collect()
    nodes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for level in sorted({r.level for r in rows}):
        own = [r for r in rows if r.level == level]
        assert sum(r.n_members for r in own) == nodes
        assert len({r.id for r in own}) == len(own)
        nodes = len(own)


def test_nearest_block_by_block_is_exact(spark, sf_dir):
    import numpy as np

    from lattice.operators.vectors import nearest

    v = queries._vectors(spark, sf_dir)
    found = {(r.query_id, r.layer, r.rank): r.id for r in nearest(queries._asked(spark, sf_dir), v, 3, block=37).collect()}
    rows = v.collect()
    for q in (r for r in rows if r.id % 100 == 0):
        own = [r for r in rows if r.layer == q.layer]
        x, y = np.array([r.v for r in own], float), np.array(q.v, float)
        far = 1 - x @ y / (np.linalg.norm(x, axis=1) * np.linalg.norm(y))
        order = sorted(range(len(own)), key=lambda i: (round(far[i], 9), own[i].id))[:3]
        assert [found[q.id, q.layer, k + 1] for k in range(len(order))] == [own[i].id for i in order]
