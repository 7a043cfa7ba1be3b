"""Graph and corpus that follow their documents, against plain models."""

import itertools
import random
from collections import Counter

import pytest

from lodestone.operators.live import LiveCorpus, LiveGraph, LiveRows


def ids(spark, documents):
    return spark.createDataFrame([(d,) for d in documents], "document_id long")


def mentions(spark, state):
    return spark.createDataFrame([(d, c, e) for d, chunks in state.items() for c, names in chunks.items() for e in names], "document_id long, chunk_id long, entity string")


def model(state):
    """Mentions of each entity and chunks of each pair."""
    chunks = [names for own in state.values() for names in own.values()]
    return Counter(e for c in chunks for e in c), Counter(p for c in chunks for p in itertools.combinations(sorted(c), 2))


def some_document(r, d):
    return {d * 10 + c: {f"e{r.randrange(8)}" for _ in range(r.randrange(5))} for c in range(r.randrange(3))}


def held(graph):
    return {r["entity"]: r["mentions"] for r in graph.entities().collect()}, {(r["source"], r["target"]): r["weight"] for r in graph.edges(1).collect()}


def test_live_graph_against_a_plain_model(spark, tmp_path):
    r = random.Random(4)
    graph = LiveGraph(spark, str(tmp_path / "g"), parts=4)
    assert held(graph) == ({}, {})
    state, batch = {}, 0
    for step in range(4):
        touched = r.sample(range(12), 8 if step == 0 else 4)
        state = {d: c for d, c in state.items() if d not in touched} | {d: some_document(r, d) for d in touched if r.random() < 0.7}
        # Rows of documents that aren't named change nothing, nor do repeated rows or a batch delivered again.
        extra = mentions(spark, {99: {990: {"stranger"}}})
        now = mentions(spark, {d: c for d, c in state.items() if d in touched})
        for _ in range(2):
            graph.change(batch, ids(spark, [*touched, touched[0], None]), now.unionByName(now).unionByName(extra))
        assert held(graph) == model(state)
        if step == 1:
            batch += 1
            graph.compact(batch)
            graph.compact(batch)
            assert held(graph) == model(state)
        batch += 1
    graph.change(batch, ids(spark, range(12)))
    assert held(graph) == ({}, {}) and graph.rows().count() == 0
    with pytest.raises(ValueError):
        graph.change(-1, ids(spark, [1]))


def test_edges_of_a_live_graph_round_as_those_of_a_batch(spark, tmp_path):
    graph = LiveGraph(spark, str(tmp_path / "g"), parts=2)
    graph.change(0, ids(spark, [1]), mentions(spark, {1: {i: {"b", "a"} for i in range(3)} | {9: {"a", "c"}}}))
    assert [tuple(e) for e in graph.edges().collect()] == [("a", "b", 3, 0.3)]


def test_a_change_reads_only_the_parts_of_its_documents(spark, tmp_path, monkeypatch):
    table = LiveRows(spark, str(tmp_path / "t"), "document_id long, chunk_id long", parts=8)
    table.change(0, spark.range(100).withColumnRenamed("id", "document_id"), spark.range(100).selectExpr("id AS document_id", "id AS chunk_id"))
    plans, put = [], LiveRows._put
    monkeypatch.setattr(LiveRows, "_put", lambda self, df, what, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if what == "lost" else None, put(self, df, what, *a, **k))[1])
    table.change(1, ids(spark, [7]))
    part = ids(spark, [7]).select(table._part()).first()[0]
    assert any(f"= {part})" in line for line in plans[0].splitlines() if "PartitionFilters" in line)
    assert table.rows().count() == 99 and [tuple(x) for x in table.lost(1).collect()] == [(7, 7)]


def test_texts_of_a_change_go_through_one_exchange(spark, tmp_path, monkeypatch):
    """They are dealt to their parts; neither a join with the documents nor what goes takes them along again."""
    table = LiveRows(spark, str(tmp_path / "t"), "document_id long, content string", parts=2)
    plans, put = {}, LiveRows._put
    monkeypatch.setattr(LiveRows, "_put", lambda self, df, what, *a, **k: (plans.setdefault(what, []).append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())), put(self, df, what, *a, **k))[1])
    rows = spark.range(20).selectExpr("id AS document_id", "concat('text ', id) AS content")
    table.change(0, rows.select("document_id"), rows)
    table.change(1, ids(spark, [3, 4]))
    assert all(columns == ["document_id"] for columns, _ in plans["lost"])
    assert not any("Join" in plan for _, plan in plans["rows"])
    assert sorted(map(tuple, table.lost(1).collect())) == [(3, "text 3"), (4, "text 4")] and table.rows().count() == 18
    # Rows of other documents, or without one, are still left out.
    more = spark.createDataFrame([(3, "new"), (5, "not told"), (None, "nobody's")], "document_id long, content string")
    table.change(2, ids(spark, [3, 6]), more)
    assert sorted(x.content for x in table.rows().where("document_id < 7").collect()) == ["new", "text 0", "text 1", "text 2", "text 5"]
    assert [tuple(x) for x in table.lost(2).collect()] == [(6, "text 6")] and table.lost(1).count() == 2
    table.compact(3)
    table.change(4, ids(spark, [3]))
    assert [tuple(x) for x in table.lost(4).collect()] == [(3, "new")] and table.rows().count() == 17


def test_a_graph_change_that_failed_halfway_is_written_over(spark, tmp_path, monkeypatch):
    graph = LiveGraph(spark, str(tmp_path / "g"), parts=2)
    first, second = {1: {10: {"a", "b"}}}, {1: {10: {"a", "c"}}, 2: {20: {"b"}}}
    graph.change(0, ids(spark, [1]), mentions(spark, first))
    monkeypatch.setattr(LiveGraph, "_derive", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        graph.change(1, ids(spark, [1, 2]), mentions(spark, second))
    assert held(graph) == model(first)
    monkeypatch.undo()
    graph.change(1, ids(spark, [1, 2]), mentions(spark, second))
    assert held(graph) == model(second)


def test_a_graph_follows_a_stream(spark, tmp_path):
    steps = [{1: {10: {"a", "b"}}, 2: {20: {"a", "b"}}}, {2: {20: {"b", "c"}}}]
    folder = tmp_path / "in"
    for n, step in enumerate(steps):
        rows = mentions(spark, step)
        if n:
            rows = rows.unionByName(spark.createDataFrame([(1, None, None)], rows.schema))
        rows.coalesce(1).write.mode("append").parquet(str(folder))
        graph = LiveGraph(spark, str(tmp_path / "g"), parts=2)
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        graph.follow(source, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        assert held(graph) == model(step)


def test_a_deletion_reaches_every_store_and_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    corpus = LiveCorpus(spark, str(tmp_path / "c"), parts=2)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    corpus.change(
        0,
        ids(spark, [1, 2]),
        mentions(spark, {1: {10: {"a", "b"}}, 2: {20: {"a"}}}),
        chunks=frame([(1, 10, "one two"), (2, 20, "two three")], "document_id long, chunk_id long, content string"),
        wiki=frame([(1, "w"), (2, "x")], "document_id long, summary string"),
        vectors=frame([(1, 100), (1, 101), (2, 200)], "document_id long, vector_id long"),
    )

    def seen():
        return {n: t.rows().count() for n, t in corpus.tables.items()} | {"entities": corpus.graph.entities().count(), "indexed": sorted(r["id"] for r in corpus.index.documents().collect())}

    assert seen() == {"chunks": 2, "wiki": 2, "vectors": 3, "entities": 2, "indexed": [10, 20]}
    monkeypatch.setattr(LiveGraph, "_derive", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        corpus.change(1, ids(spark, [1]))
    assert corpus.batches() == [0]
    monkeypatch.undo()
    for _ in range(2):
        corpus.change(1, ids(spark, [1]))
        assert corpus.batches() == [0, 1]
        assert seen() == {"chunks": 1, "wiki": 1, "vectors": 1, "entities": 1, "indexed": [20]}
