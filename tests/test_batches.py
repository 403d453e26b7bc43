"""Batches are seen whole or not at all; the log is read without moving texts."""

from __future__ import annotations

import datetime as dt
import json
import os
import threading

import pytest

from recallkit.plans import ingest
from recallkit.plans.engine import RAW, Engine
from recallkit.sources.embedders import hash_vectors, with_retries
from recallkit.sources.manifest import Manifest
from recallkit.sources.store import MEMORY, Store
from test_store import row

NOW = "2024-01-01 00:00:00"


def day(days: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=days)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_writers_take_different_numbers(spark, tmp_path):
    taken = []
    manifests = [Manifest(spark, str(tmp_path / "m")) for _ in range(4)]
    threads = [threading.Thread(target=lambda m=m, i=i: taken.extend(m.commit(f"b{i}-{j}", ["rows"]) for j in range(5))) for i, m in enumerate(manifests)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(taken) == list(range(1, 21))
    assert [e["number"] for e in Manifest(spark, str(tmp_path / "m")).entries()] == list(range(1, 21))
    assert not [f for f in os.listdir(tmp_path / "m") if f.startswith("_")]


def test_a_base_hides_what_it_replaces(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    m.commit("a", ["rows", "touches"])
    m.commit("b", ["rows"])
    m.commit("late", ["rows"])  # listed while the base was being written
    m.commit("base", ["rows"], base=["rows", "touches"], upto=2)
    m.commit("c", ["touches"])
    assert m.visible("rows") == {"base": 2, "late": 3} and m.visible("touches") == {"c": 5}
    assert m.visible("rows", 3) == {"a": 1, "b": 2, "late": 3}


def test_rows_meet_their_last_version_without_moving(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(spark.createDataFrame([row(i, f"text {i}", [1.0, float(i)]) for i in range(20)], MEMORY))
    store.update(spark.createDataFrame([("3", "new")], "id string, content string"))
    before = {f for _, _, names in os.walk(tmp_path / "s" / "rows") for f in names}
    store.touch(spark.createDataFrame([("3",), ("3",), ("4",), ("gone",)], "id string"), "2024-02-01")
    assert before == {f for _, _, names in os.walk(tmp_path / "s" / "rows") for f in names}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(store.current().select("id", "content"))
        moved = [part for part in plan.split("Exchange ")[1:]]
        assert "Bucketed: true" in store.current()._jdf.queryExecution().toString() or "Bucketed" in plan
        assert all("content" not in part.split("Scan")[1].split("PartitionFilters")[0] for part in moved if "Scan" in part)
        assert "BroadcastNestedLoopJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    found = {r.id: (r.content, r.access_count) for r in store.current().collect()}
    assert len(found) == 20 and found["3"] == ("new", 2) and found["4"] == ("text 4", 1) and found["5"] == ("text 5", 0)
    store.update(spark.createDataFrame([("3", "newer")], "id string, content string"))  # accesses are counted once
    store.touch(spark.createDataFrame([("3",)], "id string"), "2024-03-01")
    store.compact()
    store.touch(spark.createDataFrame([("4",)], "id string"), "2024-03-01")
    found = {r.id: (r.content, r.access_count) for r in Store(spark, str(tmp_path / "s")).current().collect()}
    assert found["3"] == ("newer", 3) and found["4"] == ("text 4", 2) and len(found) == 20
    assert len(store.manifest.visible("rows")) == 1


def test_ids_of_a_batch_are_distinct(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for rows in ([row(1), row(1)], [row(1)[:0] + (None, *row(1)[1:])]):
        with pytest.raises(ValueError, match="DUPLICATE_ID"):
            store.save(spark.createDataFrame(rows, MEMORY))
    assert store.current().count() == 0


@pytest.mark.parametrize("vector, error", [([float("nan")] * 16, "INVALID_EMBEDDING"), ([1.0] * 3, "DIMENSION_MISMATCH"), ([], "INVALID_EMBEDDING")])
def test_the_engine_refuses_broken_vectors(spark, tmp_path, vector, error):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.save("the red fox jumps", NOW, "manual", "p")
    engine.provider = lambda texts: [vector for _ in texts]
    with pytest.raises(ValueError, match=error):
        engine.save("a blue whale sings", NOW, "manual", "p")
    assert [r.content for r in engine.memories().collect()] == ["the red fox jumps"]


@pytest.mark.parametrize("step", ["index.write", "_write_edges", "store.write_rows", "manifest.commit"])
def test_a_batch_is_all_or_nothing(spark, tmp_path, step):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.save("the red fox jumps", NOW, "manual", "p")

    def state():
        fresh = Engine(spark, str(tmp_path / "e"))
        return fresh.memories().count(), fresh.edges().count(), fresh.index.bm25(fresh.memories(), "whale", None).count(), fresh.failures().count()

    before = state()
    owner, _, name = step.rpartition(".")
    part = getattr(engine, owner) if owner else engine
    whole = getattr(part, name)

    def killed(*args, **kwargs):
        if name != "commit":
            whole(*args, **kwargs)  # its files are there
        raise KeyboardInterrupt

    raw = [("a", "the whale of https://a.example/x", "manual", "p", {}), ("b", None, "manual", "p", {}), ("c", "a whale again", "manual", "p", {})]
    setattr(part, name, killed)
    with pytest.raises(KeyboardInterrupt):
        engine.save_all(spark.createDataFrame(raw, RAW), NOW)
    assert state() == before
    delattr(part, name)
    engine.save_all(spark.createDataFrame(raw, RAW), NOW)
    after = state()
    assert after[0] == 3 and after[1] > before[1] and after[2] == 2 and after[3] == 1
    engine.save_all(spark.createDataFrame(raw, RAW), NOW)  # the batch once more
    assert state() == (*after[:3], 2)


def test_repeated_ids(spark):
    rows = [("a", "one text here", "manual", "p", {}), ("a", "one text here", "manual", "p", {}), ("a", "another text", "manual", "p", {}),
            (None, "no id", "manual", "p", {}), ("b", "third words", "manual", "p", {"k": "v"}), ("b", "third words", "manual", "p", {})]
    raw = spark.createDataFrame(rows, RAW)
    batch = ingest.ingest(raw, spark.createDataFrame([], MEMORY), NOW)
    assert sorted(r.content for r in batch.memories.collect()) == ["another text", "one text here", "third words"]
    assert batch.decisions.count() == 3 and [r.error for r in batch.failed.collect()] == ["MISSING_ID"]
    assert batch.edges.where("from_id = to_id").isEmpty()
    again = ingest.ingest(spark.createDataFrame(rows[::-1], RAW), spark.createDataFrame([], MEMORY), NOW)
    assert {r.id for r in again.memories.collect()} == {r.id for r in batch.memories.collect()}
    # a second try of a stored batch decides as the first
    stored = batch.memories.select(*MEMORY.fieldNames())
    retried = ingest.ingest(raw, stored, NOW)
    assert {tuple(r) for r in retried.decisions.collect()} == {tuple(r) for r in batch.decisions.collect()}
    assert "BroadcastNestedLoopJoin" not in plan_of(batch.edges) and "CartesianProduct" not in plan_of(batch.edges)


def test_consolidation_is_taken_up_where_it_stood(spark, tmp_path):
    vectors = {"a": [1.0, 0.0], "b": [1.0, 0.01], "c": [0.0, 1.0], "d": [0.01, 1.0], "e": [-1.0, 0.0]}
    engine = Engine(spark, str(tmp_path / "e"), lambda texts: [vectors[t] for t in texts])
    rows = [row(t, t, vectors[t], created_at=day(i), project="p") for i, t in enumerate("abcde")]
    engine.store.save(spark.createDataFrame(rows, MEMORY))
    assert engine.consolidate_all("2024-02-01 00:00:00", 2, most=1) == 1
    assert engine.manifest.latest("cursor")[1] == "b"
    again = Engine(spark, str(tmp_path / "e"), engine.provider)
    assert again.consolidate_all("2024-02-01 00:00:00", 2) >= 1
    kept = {r.id for r in again.memories().where("archived_at IS NULL").collect()}
    assert kept == {"b", "d", "e"}
    assert {(r.from_id, r.to_id) for r in again.edges().collect()} == {("b", "a"), ("d", "c")}
    assert again.consolidate_all("2024-02-01 00:00:00", 2) == 0  # nothing was saved since


def test_refused_pages_are_listed(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    pages = [(1, "https://a.example/", "<p>kept words</p>", "text/html"), (2, "ftp://a.example/", "<p>x</p>", "text/html"),
             (3, "https://b.example/", "<p>x</p>", "image/png"), (4, "https://c.example/", None, "text/html"), (5, "https://d.example/", " ", "text/html")]
    engine.save_pages(spark.createDataFrame(pages, "page_id long, url string, html string, content_type string"), NOW)
    assert [r.content for r in engine.memories().collect()] == ["kept words"]
    found = {r.id.split("|")[0]: r.error for r in engine.failures().collect()}
    assert found == {"2": "INVALID_URL", "3": "CONTENT_TYPE", "4": "EMPTY_CONTENT", "5": "EMPTY_CONTENT"}


def test_answers_tell_what_was_cut_short(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.save("the red fox jumps", NOW, "manual", "p")
    assert engine.answer("fox", NOW).first().flags == []
    cut_short = engine.answer("fox", NOW, graph_seconds=-1.0).first()
    assert cut_short.flags == ["graph:timed_out"] and len(cut_short.results) == 1


def test_requests_are_made_again_by_status():
    class Answer(Exception):
        def __init__(self, code):
            self.status_code = code

    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise Answer(429 if len(calls) == 1 else 503)
        return hash_vectors(texts)

    assert with_retries(flaky, wait=0)(["x"]) == hash_vectors(["x"]) and len(calls) == 3
    with pytest.raises(Answer):
        with_retries(lambda texts: (_ for _ in ()).throw(Answer(400)), wait=0)(["x"])


def test_a_search_leaves_a_row(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), log_actions=True)
    engine.save("the red fox jumps", NOW, "manual", "p")
    hit = engine.search("red fox", NOW, project="p").first()
    action = engine.actions.actions().first()
    assert action.action == "search" and action.counts == {"vector": 1, "keyword": 1, "graph": 1, "returned": 1}
    assert json.loads(action.about)["strategy"]["depth"] == 2 and json.loads(action.about)["project"] == "p"
    signals = [(hit.memory_id, action.action_id, 1.0), (hit.memory_id, action.action_id, 0.0)]
    engine.actions.reward(spark.createDataFrame(signals, "memory_id string, action_id string, signal double"), NOW)
    engine.search("blue", NOW)
    engine.actions.compact()
    assert engine.actions.actions().count() == 2 and engine.actions.rewards().count() == 2
    assert [(r.searches, r.rewarded, r.signal) for r in engine.actions.by_strategy().collect()] == [(2, 1, 0.5)]


def test_adapters(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    with pytest.raises(ValueError, match="INVALID_PARAMETER"):
        engine.ingest("mail", NOW)
    engine.ingest("manual", NOW, notes=spark.createDataFrame([(1, "a note")], "id int, text string"), project="p")
    engine.ingest("conversation", NOW, logs=spark.createDataFrame([("s", "User: hi\nAI: hello")], "id string, text string"))
    stored = [("https://a.example/x", 302, "y", None, None), ("https://a.example/y", 200, None, "text/html; charset=latin-1", "<p>café</p>".encode("latin-1")),
              ("https://a.example/z", 200, None, "text/plain; charset=nonsense", "<b>é</b>".encode()), ("https://a.example/big", 200, None, "text/plain", b"x" * 50),
              ("https://a.example/nowhere", 301, None, None, None), ("https://[::1]/", 200, None, "text/plain", b"x")]
    asked = ["https://a.example/x", "https://a.example/z", "https://a.example/big", "https://a.example/nowhere", "https://[::1]/", "https://gone.example/", None, "https://user@10.0.0.1:80/"]
    engine.ingest(
        "url", NOW, requests=spark.createDataFrame(list(enumerate(asked)), "id int, url string"),
        stored=spark.createDataFrame(stored, "url string, status int, location string, content_type string, body binary"), max_bytes=40,
    )
    rows = {r.content: dict(r.source_metadata) for r in engine.memories().where("source_type = 'url'").collect()}
    assert set(rows) == {"café", "<b>é</b>"}
    assert rows["café"]["final_url"] == "https://a.example/y" and rows["café"]["url"] == "https://a.example/x"
    errors = {r.id.split("|")[0]: r.error for r in engine.failures().collect()}
    assert errors == {"2": "TOO_LARGE", "3": "NO_LOCATION", "4": "RESTRICTED_ADDRESS", "5": "NO_RESPONSE", "6": "INVALID_URL", "7": "RESTRICTED_ADDRESS"}
    assert engine.memories().count() == 4


def test_vacuum_takes_what_nobody_sees(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.save("the red fox jumps", NOW, "manual", "p")
    engine.save("a blue whale sings", NOW, "manual", "p")
    engine.index.write("dead", engine.memories().limit(1))  # of a writer that died
    assert engine.vacuum() == 0 and engine.vacuum(0) == 2
    engine.compact()
    assert engine.vacuum(0) >= 6
    found = engine.search("red fox", NOW).first()
    assert found.content == "the red fox jumps" and engine.memories().count() == 2
