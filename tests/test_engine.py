import json

import pytest

from lattice.config import load_config
from lattice.plans.engine import Engine
from lattice.sources.store import SnapshotStore
from lattice.streaming.ingest import enqueue, ingest, pending, shutdown, status

TEXTS = ["Ada Lovelace wrote to Charles Babbage.", "Charles Babbage built the Analytical Engine.", "Grace Hopper worked with Howard Aiken in Cambridge."]


def corpus(path, texts):
    path.write_text("".join(json.dumps({"id": str(k), "title": "t", "text": t}) + "\n" for k, t in enumerate(texts)))
    return str(path)


def test_index_query_add_remove(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", chunk_size=500, chunk_overlap=50, max_levels=2, k_per_layer=3)
    assert engine.stats() == {"entities": 0, "relations": 0, "chunks": 0, "height": 0}
    engine.index(corpus(tmp_path / "a.jsonl", TEXTS[:2]))
    first = engine.stats()
    assert first["chunks"] == 2 and first["entities"] >= 4 and first["relations"] >= 3
    assert "Babbage" in engine.query("Charles Babbage")
    assert engine.search_entities("babbage").count() == 1 and engine.search_chunks("ANALYTICAL").count() == 1

    engine.add(corpus(tmp_path / "b.jsonl", TEXTS[:2]))
    assert engine.stats() == first
    engine.add(corpus(tmp_path / "c.jsonl", TEXTS))
    assert engine.stats()["chunks"] == 3

    assert engine.remove("babbage") and not engine.remove("nobody")
    assert engine.search_entities("babbage").count() == 0


def test_lookups_notes_and_clearing(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", chunk_size=500, chunk_overlap=50, max_levels=1, k_per_layer=3)
    assert engine.get("chunks", "x") is None and engine.get_meta("note") is None and not engine.remove_chunk("x")
    engine.index(corpus(tmp_path / "a.jsonl", TEXTS[:2]))
    engine.put_meta("note", 1)
    engine.put_meta("note", 2)
    engine.put_meta("other", "x")
    assert engine.get_meta("note") == "2" and engine.get_meta("nothing") is None
    chunk = engine.search_chunks("analytical").first()["chunk_id"]
    assert engine.get("chunks", chunk)["chunk_id"] == chunk and engine.get("entities", -1) is None
    entity = engine.store.read()["entities"].first()
    assert engine.get("entities", entity["id"])["name"] == entity["name"] and engine.get("nodes", entity["id"], layer=0)["layer"] == 0
    assert engine.remove_chunk(chunk) and not engine.remove_chunk(chunk) and engine.stats()["chunks"] == 1
    assert engine.get_meta("other") == "x"
    engine.clear()
    assert engine.stats() == {"entities": 0, "relations": 0, "chunks": 0, "height": 0} and engine.get_meta("note") is None


def test_a_model_words_the_answer(spark, tmp_path):
    def complete(prompts):
        if len(prompts) > 1:
            raise RuntimeError("one at a time")
        if "JSON" in prompts[0]:
            return ['{"points": [{"description": "seen by the model", "score": 99}]}']
        return ["worded: " + prompts[0].split("Points:")[1].strip()]

    path = corpus(tmp_path / "a.jsonl", TEXTS)
    Engine(spark, f"file://{tmp_path}/store", chunk_size=500, chunk_overlap=50, max_levels=1, k_per_layer=3).index(path)
    engine = Engine(spark, f"file://{tmp_path}/store", complete=complete, k_per_layer=3)
    assert engine.query("Charles Babbage").startswith("worded: - [Score 99.0] seen by the model")
    broken = Engine(spark, f"file://{tmp_path}/store", complete=lambda prompts: 1 / 0, k_per_layer=3)
    assert broken.query("Charles Babbage").startswith("- [Score 50.0]")


def test_an_entity_keeps_all_of_its_mentions(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", chunk_size=500, chunk_overlap=50, max_levels=1, k_per_layer=3)
    engine.index(corpus(tmp_path / "a.jsonl", [f"Babbage {c}{d}xyz." for c in "ABCDEFGHIJKL" for d in "abcdefghij"]))
    one = engine.search_entities("babbage").collect()[0]
    entity = engine.store.read()["entities"].where("key = 'babbage'").first()
    assert len(entity["source_chunk_ids"]) == 120 and len(entity["description"].split(" ")) == 120
    assert one["name"] == "Babbage"


def test_readers_keep_their_version(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.current() is None and store.read() == {}
    assert store.write({"t": spark.range(3).toDF("id")}) == 1
    old = store.read()
    assert store.write({"t": spark.range(5).toDF("id")}) == 2
    assert old["t"].count() == 3 and store.read()["t"].count() == 5 and store.read(1)["t"].count() == 3


def test_stream_adds_each_file_once(spark, tmp_path):
    landing, seen = tmp_path / "landing", []
    landing.mkdir()
    corpus(landing / "1.json", TEXTS[:2])

    def drain():
        query = ingest(spark, str(landing), f"file://{tmp_path}/checkpoint", lambda batch, k: seen.extend(r.text for r in batch.collect()), every=None)
        query.awaitTermination()
        return status(query)

    assert drain() == "done" and sorted(seen) == sorted(TEXTS[:2])
    corpus(landing / "2.json", TEXTS[2:])
    drain()
    assert sorted(seen) == sorted(TEXTS)


def test_what_is_enqueued_is_pending_until_added(spark, tmp_path):
    landing, checkpoint, seen = f"file://{tmp_path}/landing", f"file://{tmp_path}/checkpoint", []
    assert pending(spark, landing, checkpoint) == 0
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "id string, text string")
    enqueue(rows, landing)
    assert pending(spark, landing, checkpoint) == 3
    query = ingest(spark, landing, checkpoint, lambda batch, k: seen.extend(r.text for r in batch.collect()), every="0 seconds")
    shutdown(query)
    assert not query.isActive and sorted(seen) == sorted(TEXTS) and pending(spark, landing, checkpoint) == 0
    enqueue(rows.limit(1), landing)
    assert pending(spark, landing, checkpoint) == 1


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"indexing": {"chunk_size": 7, "other": 1}, "k_per_layer": 2}))
    assert load_config(str(tmp_path / "c.json")) == {"chunk_size": 7, "k_per_layer": 2}
    with pytest.raises(ValueError):
        Engine(spark, "x", chunk=1)


def names(engine):
    return {r["key"]: r for r in engine.tables()["entities"].collect()}


def test_what_is_removed_stays_removed_until_new_documents_name_it(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", chunk_size=500, chunk_overlap=50, max_levels=1, k_per_layer=3)
    engine.index(corpus(tmp_path / "a.jsonl", TEXTS))
    chunk = engine.search_chunks("analytical").first()["chunk_id"]
    assert engine.remove(" Grace ") and engine.remove_chunk(chunk)
    tables = engine.tables()
    assert "grace" not in names(engine) and "hopper" in names(engine)
    gone = tables["nodes"].where("layer = 0 AND label = 'Grace'")
    assert gone.isEmpty() and tables["relations"].where("source_id = xxhash64('grace') OR target_id = xxhash64('grace')").isEmpty()

    version = engine.store.current()
    assert engine.add(corpus(tmp_path / "b.jsonl", TEXTS)) == version  # nothing new, so no version either
    more = [*TEXTS, "Kurt Goedel met Oskar Morgenstern."]
    engine.add(corpus(tmp_path / "c.jsonl", more))
    assert "grace" not in names(engine) and "goedel" in names(engine) and engine.get("chunks", chunk) is None
    assert engine.stats()["chunks"] == 3

    engine.add(corpus(tmp_path / "d.jsonl", [*more, "Grace Kelly acted."]))
    grace = names(engine)["grace"]
    assert (grace["n_mentions"], grace["description"]) == (1, "Kelly") and len(grace["source_chunk_ids"]) == 1
    before = {n: t.count() for n, t in engine.tables().items()}
    engine.compact()
    assert {n: t.count() for n, t in engine.tables().items()} == before and "tombstones" not in engine.store.read()


def test_adding_in_parts_gives_the_graph_of_the_whole(spark, tmp_path):
    settings = dict(chunk_size=60, chunk_overlap=10, max_levels=2, k_per_layer=3)
    texts = ["Ada wrote Babbage. Babbage built Engines. Ada knew Somerville.", "Babbage left Cambridge.", "Engines of Cambridge, Babbage.", "Somerville taught Lovelace"]
    whole, parts = (Engine(spark, f"file://{tmp_path}/{n}", **settings) for n in ("whole", "parts"))
    whole.index(corpus(tmp_path / "w.jsonl", texts))
    for k in range(1, len(texts) + 1):
        parts.add(corpus(tmp_path / f"p{k}.jsonl", texts[:k]))
    assert parts.store.read().entries["chunks"]["paths"].__len__() == 4
    graph = lambda e: {k: (r["n_mentions"], sorted(r["source_chunk_ids"]), sorted(r["description"].split())) for k, r in names(e).items()}
    assert graph(parts) == graph(whole)

    changed = ["Ada wrote Babbage.", texts[1], texts[2], texts[3]]
    parts.add(corpus(tmp_path / "x.jsonl", changed))
    whole.index(corpus(tmp_path / "y.jsonl", changed))
    assert graph(parts) == graph(whole)
    ids = {r["id"] for r in names(parts).values()}
    assert all(r["source_id"] in ids and r["target_id"] in ids for r in parts.tables()["relations"].collect())
    assert parts.stats()["chunks"] == whole.stats()["chunks"]


def scripted(folder, dead=False):
    """A model that notes each prompt in a folder, so that calls on executors are counted."""
    folder = str(folder)

    def complete(prompts):
        import os
        import re
        import uuid

        if dead:
            raise RuntimeError("out of service")
        out = []
        for p in prompts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as note:
                note.write(p)
            if p.startswith("List the entities"):
                found = re.findall("[A-Z][a-z]+", p.partition("Text:\n")[2])
                out.append("Sure: " + json.dumps({"entities": [{"name": n, "type": "Person", "description": f"the one called {n}"} for n in found], "relations": [{"source": a, "target": b, "description": "knows"} for a, b in zip(found, found[1:])]}))
            else:
                out.append("told: " + str(len(p)))
        return out

    return complete


def test_a_model_extracts_and_summarises_once(spark, tmp_path):
    import os

    (tmp_path / "asked").mkdir()
    model = scripted(tmp_path / "asked")
    make = lambda name: Engine(spark, f"file://{tmp_path}/store", complete=model, model=name, chunk_size=500, chunk_overlap=50, max_levels=2, k_per_layer=3)
    engine = make("one")
    engine.index(corpus(tmp_path / "a.jsonl", TEXTS))
    ada = names(engine)["ada"]
    assert ada["entity_type"] == "Person" and ada["description"] == "the one called Ada"
    assert {r["description"] for r in engine.tables()["relations"].collect()} == {"knows"}
    assert all(r["summary"].startswith("told: ") for r in engine.tables()["communities"].collect())
    asked = len(os.listdir(tmp_path / "asked"))
    assert asked == 3 + engine.tables()["communities"].count()
    engine.index(corpus(tmp_path / "a.jsonl", TEXTS))
    assert len(os.listdir(tmp_path / "asked")) == asked  # every answer was kept
    engine.add(corpus(tmp_path / "b.jsonl", [*TEXTS, "Kurt Goedel met Oskar Morgenstern."]))
    prompts = [(tmp_path / "asked" / f).read_text() for f in os.listdir(tmp_path / "asked")]
    assert sum(p.startswith("List the entities") for p in prompts) == 4  # the new chunk alone
    make("another").index(corpus(tmp_path / "a.jsonl", TEXTS))
    assert len(os.listdir(tmp_path / "asked")) > len(prompts)


def test_a_dead_model_is_an_error_while_indexing(spark, tmp_path):
    from lattice.operators.model import AnswerCache, ModelError

    engine = Engine(spark, f"file://{tmp_path}/store", complete=scripted(tmp_path, dead=True), chunk_size=500, chunk_overlap=50)
    with pytest.raises(ModelError):
        engine.index(corpus(tmp_path / "a.jsonl", TEXTS))
    assert engine.store.current() is None
    rows = spark.createDataFrame([(k, None if k == 3 else f"p{k % 7}") for k in range(40)], "id long, prompt string").repartition(4)
    some = AnswerCache(f"file://{tmp_path}/some", lambda ps: [None if p == "p5" else p.upper() for p in ps], batch=2, parts=3)
    found = {r["id"]: r["output"] for r in some.ask(rows, most_failed=0.2).collect()}
    assert found == {k: None if k == 3 or k % 7 == 5 else f"P{k % 7}" for k in range(40)}


def test_answers_of_a_repeated_task_are_not_asked_for_again(spark, tmp_path):
    """A task that dies after its first batches finds them when it comes again."""
    import os

    from lattice.operators.model import AnswerCache

    (tmp_path / "asked").mkdir()
    folder = str(tmp_path / "asked")

    def complete(prompts):
        open(os.path.join(folder, prompts[0].replace("/", "_")), "a").write("x")
        if len(os.listdir(folder)) == 3 and not os.path.exists(folder + "-died"):
            open(folder + "-died", "w").close()
            os._exit(1)  # the worker goes, as with a lost executor
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(f"prompt {k}",) for k in range(12)], "prompt string")
    cache = AnswerCache(f"file://{tmp_path}/cache", complete, batch=2, parts=1)
    try:
        cache.ask(rows)
    except Exception:
        pass  # one local task has no second attempt
    assert sorted(r["output"] for r in cache.ask(rows).collect()) == sorted(f"PROMPT {k}" for k in range(12))
    times = sorted(len((tmp_path / "asked" / f).read_text()) for f in os.listdir(folder))
    assert times == [1, 1, 1, 1, 1, 2]  # only the batch that was lost


def test_any_embedding_answers_queries(spark, tmp_path):
    from lattice.operators.embedding import Embedding

    def vectors(texts):
        return [[1.0, *(float(t.lower().count(c)) for c in "abcdefg")] for t in texts]

    make = lambda e: Engine(spark, f"file://{tmp_path}/store", embed=e, chunk_size=500, chunk_overlap=50, max_levels=2, k_per_layer=3)
    eight = make(Embedding(8, batch=vectors, name="letters", size=2))
    eight.index(corpus(tmp_path / "a.jsonl", TEXTS))
    assert {len(r["v"]) for r in eight.tables()["nodes"].collect()} == {8} and eight.tables()["nodes"].where("layer > 0").count() > 0
    assert "Babbage" in eight.query("Babbage: Babbage")
    kept = eight.store.read()["vectors"].count()
    eight.index(corpus(tmp_path / "a.jsonl", TEXTS))
    assert eight.store.read()["vectors"].count() == kept
    with pytest.raises(ValueError, match="8 dimensions"):
        make(None).query("Babbage")
    with pytest.raises(Exception, match="declared are 9"):
        make(Embedding(9, batch=vectors)).index(corpus(tmp_path / "a.jsonl", TEXTS))
    with pytest.raises(ValueError):
        Embedding(3)


def test_two_writers_and_shared_tables(spark, tmp_path):
    from lattice.sources.store import Append, Conflict

    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = lambda n: spark.range(n).toDF("id")
    store.write({"a": rows(3), "b": rows(4)})
    one, two = store.read(), store.read()
    store.commit({"a": rows(5)}, one)
    folder = store.manifest(1)["b"]
    assert store.commit({"b": rows(6)}, two) == 3 and store.read()["a"].count() == 5  # on top of the other's version
    assert store.manifest(2)["b"] == folder and store.manifest(3)["a"] == store.manifest(2)["a"]
    one, two = store.read(), store.read()
    one["a"]
    store.commit({"a": Append(rows(2))}, two)
    with pytest.raises(Conflict):
        store.commit({"c": rows(1)}, one)
    assert "c" not in store.read() and store.read()["a"].count() == 7
    tries = []

    def change(tables):
        tries.append(tables.version)
        n = tables["a"].count()
        if len(tries) == 1:
            store.commit({"a": Append(rows(1))})
        return {"n": spark.range(n).toDF("id")}

    store.update(change)
    assert len(tries) == 2 and store.read()["n"].count() == 8
    with pytest.raises(ValueError):
        store.commit({"a": Append(rows(1).toDF("other"))})
    assert store.vacuum(keep=1, older_than=0) > 0 and store.versions() == [store.current()] and store.read()["a"].count() == 8


def test_threads_that_commit_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from lattice.sources.store import Append

    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.write({"a": spark.range(1).toDF("id")})
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(lambda k: store.commit({"a": Append(spark.range(k, k + 1).toDF("id"))}), range(1, 13)))
    assert sorted(made) == list(range(2, 14)) and sorted(r.id for r in store.read()["a"].collect()) == list(range(13))


def test_one_reindex_at_a_time(spark, tmp_path):
    import threading

    from lattice.sources.store import Lease
    from lattice.streaming.ingest import reindex, reindex_state

    engine = Engine(spark, f"file://{tmp_path}/store", chunk_size=500, chunk_overlap=50, max_levels=1)
    landing, checkpoint = f"file://{tmp_path}/landing", f"file://{tmp_path}/checkpoint"
    assert reindex_state(engine)["state"] == "idle"
    enqueue(spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "id string, text string"), landing)
    other = Lease(engine.store, "reindex")
    assert other.start() and reindex_state(engine)["state"] == "running" and not reindex(engine, landing, checkpoint)
    other.finish("done")
    assert reindex(engine, landing, checkpoint)
    for t in threading.enumerate():
        if t.name == "reindex":
            t.join()
    state = reindex_state(engine)
    assert state["state"] == "done" and state["message"].startswith("3 documents") and engine.stats()["chunks"] == 3
    lost = Lease(engine.store, "reindex", seconds=0.0)
    assert lost.start() and lost.state()["state"] == "lost" and Lease(engine.store, "reindex", seconds=0.0).start()
