"""The engine from end to end, on the calls of its users."""

from __future__ import annotations

from collections import Counter

import pytest

from recallkit.operators import keyword
from recallkit.plans import lifecycle
from recallkit.plans.engine import RAW, Engine
from recallkit.sources.store import ReadOnly


def test_save_search_prune_delete(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    now = "2024-01-01 00:00:00"
    engine.save("the red fox jumps", now, "manual", "p")
    engine.save("a blue whale sings", now, "manual", "p")
    assert engine.stats().first().asDict() == {"active": 2, "archived": 0, "total": 2}
    again = engine.save("the red fox jumps", "2024-01-02 00:00:00", "manual", "p").first()
    assert again.action == "REPLACE"
    assert engine.stats().first().asDict() == {"active": 2, "archived": 1, "total": 3}
    assert engine.edges().where("edge_type = 'SUPERSEDES'").count() == 1
    hits = engine.search("red fox", "2024-01-03 00:00:00").collect()
    assert hits[0].content == "the red fox jumps" and all(0 <= h.score <= 1 for h in hits)
    assert engine.memories().where("access_count > 0").count() == len(hits)
    assert engine.search_graph("red", "2024-01-03 00:00:00").count() <= 5
    engine.flush("User: hi\nAI: hello\nUser: bye", now, "s1", "q")
    assert sorted(r.project for r in engine.projects().collect()) == ["p", "q"]
    dry = engine.prune("2024-06-01 00:00:00")
    assert dry.first().purged == 1 and engine.stats().first().total == 4
    engine.prune("2024-06-01 00:00:00", dry_run=False)
    assert engine.stats().first().total == 3
    engine.reembed(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert engine.store.dimension() == 2
    with pytest.raises(ValueError, match="INVALID_PARAMETER"):
        engine.flush("x" * 200_001, now)
    engine.delete([r.id for r in engine.memories().where("project = 'q'").collect()])
    assert engine.stats().first().total == 2
    with pytest.raises(ReadOnly):
        Engine(spark, str(tmp_path / "e"), read_only=True).save("x", now)


def test_cleanup_is_due():
    now = "2024-01-02 00:00:00"
    assert lifecycle.due(100, None, now) and not lifecycle.due(99, None, now) and not lifecycle.due(0, None, now)
    assert lifecycle.due(1, "2024-01-01 00:00:00", now) and not lifecycle.due(1, "2024-01-01 00:00:01", now)


def test_pages(spark, sf_dir, tmp_path):
    engine = Engine(spark, str(tmp_path / "f"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(3)
    engine.save_pages(pages, "2024-01-01 00:00:00")
    rows = engine.memories().select("source_metadata").collect()
    assert len(rows) >= 3 and all("url" in r.source_metadata for r in rows)


def test_edges_and_decisions_of_batches(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "g"))
    log = "User: one\nAI: two\nUser: three\nAI: four\nUser: five\nAI: six\nUser: see https://a.example/x"
    engine.flush(log, "2024-01-01 00:00:00", "s1", "p", tags=["x", "y"])
    engine.flush("User: later words of the same session", "2024-01-02 00:00:00", "s1", "p")
    engine.flush("User: another session speaks", "2024-01-03 00:00:00", "s2", "p")
    kinds = Counter(r.edge_type for r in engine.edges().collect())
    assert kinds["TEMPORAL_NEXT"] == kinds["TEMPORAL_PREV"] == 2 and kinds["REFERENCES"] == 1
    assert engine.links().where("edge_type = 'REFERENCES'").count() == 0
    names = {r.id: r.content[:11] for r in engine.memories().collect()}
    after = {(names[r.from_id], names[r.to_id]) for r in engine.edges().where("edge_type = 'TEMPORAL_NEXT'").collect()}
    assert after == {("User: one\nA", "AI: six\nUse"), ("AI: six\nUse", "User: later")}
    assert {tuple(r.tags) for r in engine.memories().where("source_metadata['turn_end'] = '4'").collect()} == {("x", "y")}
    raw = [(str(i), t, "manual", "q", {}) for i, t in enumerate(["same words here", "same words here", None, "same words here"])]
    decisions = engine.save_all(spark.createDataFrame(raw, RAW), "2024-01-04 00:00:00").collect()
    assert Counter(r.action for r in decisions) == {"INSERT": 1, "REPLACE": 2}
    rows = engine.memories().where("project = 'q'").collect()
    assert len(rows) == 3 and sum(r.archived_at is None for r in rows) == 1
    assert [tuple(r) for r in engine.failures().select("id", "error").collect()] == [("2", "EMPTY_CONTENT")]
    assert engine.save("weighty", "2024-01-05 00:00:00", "manual", "q", importance=0.9).count() == 1
    assert engine.memories().where("importance_score = 0.9").count() == 1
    whole = engine.answer("words", "2024-01-06 00:00:00", top_k=1).first()
    assert whole.query == "words" and whole.strategy.depth == 2 and len(whole.results) == 1 < whole.total_count


def test_stored_index_finds_what_a_scan_finds(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "i"))
    texts = ["that that that the", "of the people of the land", "Qu\u00e9 la of-the", "the of", "x"]
    raw = [(str(i), t, "manual", "r", {}) for i, t in enumerate(texts)]
    engine.save_all(spark.createDataFrame(raw, RAW), "2024-01-01 00:00:00")

    def same() -> None:
        m = engine.memories()
        for query in ("of-the", "that-that", "that-that the", "que la", "the of", "absent", "  "):
            scan = {tuple(r) for r in keyword.bm25(m, query, None).collect()}
            assert {tuple(r) for r in engine.index.bm25(m, query, None).collect()} == scan, query

    same()
    first = engine.memories().where("content = 'the of'").first().id
    engine.store.update(spark.createDataFrame([(first, "that of-the other")], "id string, content string"))
    engine.reindex()
    engine.delete([engine.memories().where("content = 'x'").first().id])
    same()


def test_a_source_that_fails_gives_no_hits(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "j"))
    engine.save("the red fox jumps", "2024-01-01 00:00:00", "manual", "p")

    class Broken:
        def bm25(self, *_):
            raise RuntimeError("no index")

    engine.index = Broken()
    assert [h.content for h in engine.search("red fox", "2024-01-02 00:00:00").collect()] == ["the red fox jumps"]
    engine.index, engine.provider = type(engine.index)(), lambda texts: [[1.0] * 3 for _ in texts]
    assert engine.search("red fox", "2024-01-02 00:00:00").count() == 0


def test_survivors_of_consolidation_get_new_vectors(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "k"))
    engine.save("one", "2024-01-01 00:00:00", "manual", "p")
    engine.save("two", "2024-01-02 00:00:00", "manual", "p")
    ids = [(r.id, [1.0, 0.0]) for r in engine.memories().collect()]
    engine.store.update(spark.createDataFrame(ids, "id string, embedding array<double>"))
    engine.provider = lambda texts: [[float(len(t)), 2.0] for t in texts]
    assert engine.prune("2024-01-03 00:00:00", dry_run=False).first().consolidated == 1
    rows = {r.content: (list(r.embedding), r.archived_at is None) for r in engine.memories().collect()}
    assert rows == {"one": ([1.0, 0.0], False), "two": ([3.0, 2.0], True)}
