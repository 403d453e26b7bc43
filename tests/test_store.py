from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recallkit.config import ListFilter, SearchStrategy
from recallkit.operators import filters, policy
from recallkit.plans import ingest, lifecycle
from recallkit.sources.embedders import embed, hash_vectors, with_retries
from recallkit.sources.store import MEMORY, ReadOnly, Store, check_dimension

NOW = dt.datetime(2024, 1, 1)


def row(i, content="c", embedding=None, **more):
    base = dict(
        id=str(i), content=content, memory_type="episodic", source_type="manual", source_metadata={}, embedding=embedding,
        semantic_relevance=0.5, importance_score=0.5, access_count=0, last_accessed_at=NOW, created_at=NOW,
        updated_at=NOW, archived_at=None, tags=[], project=None,
    )
    return tuple((base | more)[f] for f in MEMORY.fieldNames())


def test_changelog(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), unique_content=True)
    assert store.current().count() == 0 and store.dimension() is None
    store.save(spark.createDataFrame([row(1, "a", [1.0, 0.0]), row(2, "b")], MEMORY))
    assert store.dimension() == 2
    check_dimension(store, 2)
    with pytest.raises(ValueError, match="DIMENSION"):
        check_dimension(store, 3)
    with pytest.raises(ValueError, match="INVALID_EMBEDDING"):
        store.save(spark.createDataFrame([row(3, "d", [float("nan"), 0.0])], MEMORY))
    with pytest.raises(ValueError, match="DUPLICATE"):
        store.save(spark.createDataFrame([row(4, "a")], MEMORY))
    store.update(spark.createDataFrame([("2", "B")], "id string, content string"))
    store.touch(spark.createDataFrame([("2",), ("2",)], "id string"), "2024-02-01")
    found = {r.id: r for r in store.current().collect()}
    assert found["2"].content == "B" and found["2"].access_count == 2 and found["1"].access_count == 0
    with pytest.raises(ValueError, match="INVALID_PARAMETER"):
        store.update(spark.createDataFrame([("2", NOW)], "id string, created_at timestamp"))
    store.delete(spark.createDataFrame([("1",)], "id string"))
    assert [r.id for r in store.current().collect()] == ["2"]
    store.compact(str(tmp_path / "t"))
    assert Store(spark, str(tmp_path / "t")).current().count() == 1
    with pytest.raises(ReadOnly):
        Store(spark, str(tmp_path / "s"), read_only=True).save(spark.createDataFrame([row(9)], MEMORY))


def test_orders_and_limits_are_checked(spark):
    m = spark.createDataFrame([row(1)], MEMORY)
    for bad in ("content", "id SIDEWAYS", "id ASC x"):
        with pytest.raises(ValueError, match="INVALID_PARAMETER"):
            filters.list_rows(m, ListFilter(order_by=bad))
    with pytest.raises(ValueError, match="INVALID_PARAMETER"):
        filters.list_rows(m, ListFilter(limit=-1))
    assert filters.clamp_top_k(0) == 10 and filters.clamp_top_k(3) == 3 and filters.clamp_max_tokens(0) is None
    with pytest.raises(ValueError):
        SearchStrategy(0.5, 0.5, 0.5)


def test_keyset_pushes_down(spark, sf_dir):
    from recallkit.sources import views

    m = views.memories(spark, sf_dir)
    plan = filters.list_rows(m, ListFilter(created_after="2024-01-02 00:00:00", id_after=3))._jdf.queryExecution().toString()
    assert "GreaterThan" in plan and "PushedFilters" in plan


def test_embedding_keeps_order_and_retries(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, content string")
    found = {r.id: list(r.embedding) for r in embed(rows).collect()}
    assert found[1] == found[3] != found[2] and len(found[1]) == 16
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise TimeoutError
        return hash_vectors(texts)

    assert with_retries(flaky, wait=0)(["x"] * 150) == hash_vectors(["x"] * 150)
    assert calls == [100, 100, 50]


def test_ingestion(spark):
    schema = "id int, text string, source_type string, project string, metadata map<string,string>"
    raw = spark.createDataFrame(
        [(1, "手順: how to", "manual", "p", None), (2, " ", "manual", None, None), (3, "x" * 7000, "url", "p", {"a": "b"})], schema
    )
    stored = spark.createDataFrame([row("old", "手順: how to", hash_vectors(["手順: how to"])[0], project="p")], MEMORY)
    batch = ingest.ingest(raw, stored, "2024-01-02 00:00:00")
    assert batch.memories.count() == 4 and [r.error for r in batch.failed.collect()] == ["EMPTY_CONTENT"]
    # of the two equal chunks of the third text the second replaces the first, as rows come one after the other
    parts = {r.id: (r.content[:2], r.chunk_index) for r in batch.memories.collect()}
    decided = {parts[r.id]: (r.action, parts.get(r.existing_id, r.existing_id)) for r in batch.decisions.collect()}
    assert decided == {
        ("手順", 0): ("REPLACE", "old"), ("xx", 0): ("INSERT", None), ("xx", 1): ("REPLACE", ("xx", 0)), ("xx", 2): ("INSERT", None),
    }
    kinds = {r.edge_type for r in batch.edges.collect()}
    assert {"CHUNK_NEXT", "CHUNK_PREV", "SUPERSEDES", "TEMPORAL_NEXT", "TEMPORAL_PREV"} == kinds


def test_related_rows_are_those_active_at_the_time(spark):
    vectors = {"a": [1.0, 0.0, 0.0], "b": [0.8, 0.6, 0.0], "c": [1.0, 0.01, 0.0], "d": [0.8, 0.0, 0.6], "e": [0.8, 0.6, 0.001]}
    schema = "id int, text string, source_type string, project string, metadata map<string,string>"
    raw = spark.createDataFrame([(i, t, "manual", "q" if t == "d" else "p", {}) for i, t in enumerate("abcde")], schema)
    batch = ingest.ingest(raw, spark.createDataFrame([], MEMORY), "2024-01-02 00:00:00", lambda ts: [vectors[t] for t in ts])
    name = {r.id: r.content for r in batch.memories.collect()}
    edges = {(name[r.from_id], name[r.to_id]) for r in batch.edges.where("edge_type = 'SEMANTICALLY_RELATED'").collect()}
    # b saw a; c replaced a and saw b; d is of another project; e replaced b and saw c
    assert edges == {("b", "a"), ("c", "b"), ("e", "c")}
    assert {(name[r.id], name.get(r.existing_id)) for r in batch.decisions.where("action = 'REPLACE'").collect()} == {("c", "a"), ("e", "b")}


def test_retention_is_strict(spark):
    m = spark.createDataFrame([(1, "2024-01-01"), (2, "2023-12-31")], "id int, a string")
    m = m.select("id", F.col("a").cast("timestamp_ntz").alias("archived_at"))
    assert [r.id for r in lifecycle.purge_candidates(m, "2024-03-31 00:00:00", 90).collect()] == [2]


def test_policy(spark):
    payload = spark.sql("SELECT 1 a, named_struct('x', 1, 'y', 2) s, array(named_struct('x', 1, 'y', 2)) l, 5 n")
    kept = policy.allow(payload, {"a": True, "s": ["y"], "l": ["x"], "n": ["x"], "gone": True})
    assert kept.columns == ["a", "s", "l"] and kept.first().asDict(True) == {"a": 1, "s": {"y": 2}, "l": [{"x": 1}]}
    assert policy.allow(payload, None).columns == []
    agents = spark.createDataFrame([("a1", ["i1", "i9"])], "name string, intents array<string>")
    intents = spark.createDataFrame([("i1", "f9"), ("i2", None)], "name string, filter string")
    broken = policy.broken_references(agents, intents, spark.createDataFrame([("f1",)], "name string"))
    assert {tuple(r) for r in broken.collect()} == {("agent", "a1", "i9"), ("intent", "i1", "f9")}
