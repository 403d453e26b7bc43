"""What only shows on larger tables: repeated addresses, chance neighbours, many rows of one kind."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from recallkit import queries
from recallkit.llm import quality
from recallkit.operators import cells, dedup, graph, keyword, links, vector
from recallkit.sources import responses, views
from recallkit.sources.index import Index


def test_requests_of_one_address_have_their_own_responses(spark):
    head = "id long, url string, status int, location string, content_type string, body binary"
    stored = spark.createDataFrame([
        (1, "https://a.example/x", 200, None, "text/plain", b"one"), (2, "https://a.example/x", 404, None, "text/plain", b"two"),
        (3, "https://a.example/old", 301, "/x", None, None), (3, "https://a.example/x", 200, None, "text/plain", b"three"),
    ], head)
    asked = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://a.example/x"), (3, "https://a.example/old"), (4, "https://a.example/x")], "id long, url string")
    found = {r.id: (r.error, r.page) for r in responses.fetched(asked, stored).collect()}
    assert found == {1: (None, "one"), 2: ("HTTP_404", None), 3: (None, "three"), 4: ("NO_RESPONSE", None)}
    alike = {r.id: r.error for r in responses.resolved(asked, stored.drop("id")).collect()}
    assert alike == {1: "HTTP_404", 2: "HTTP_404", 3: "HTTP_404", 4: "HTTP_404"}


def test_vectors_without_clusters_meet_in_blocks_of_one_cell(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    monkeypatch.setattr(cells, "PART_ROWS", 60)
    monkeypatch.setattr(cells, "TILE", (64, 32))
    draw, sent, send = np.random.default_rng(3), [], cells._sent
    monkeypatch.setattr(cells, "_sent", lambda rows, side, centroids, *rest: sent.append(len(centroids)) or send(rows, side, centroids, *rest))
    x = draw.normal(size=(300, 12))
    x[250:] = x[:50]  # ties
    projects = [None, "a", "b"]
    rows = [(i, v.tolist(), projects[i % 3]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, project string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)

    def best(i, sees):
        near = sorted((-scores[i, j], j) for j in range(300) if sees(i, j) and scores[i, j] >= 0.3)[:4]
        return [(i, j, -s) for s, j in near]

    found = {(r.query_id, r.id, r.score) for r in cells.near_rows(df, df, 0.3, 4).collect()}
    assert found == {p for i in range(300) for p in best(i, lambda i, j: True)} and sent == [1, 1]
    scoped = cells.near_rows(df, df, 0.3, 4, scope="project", allowed=lambda left, right, i, j: left["q_id"].to_numpy()[i] != right["v_id"].to_numpy()[j])
    wanted = {p for i in range(300) for p in best(i, lambda i, j: i != j and (i % 3 == 0 or i % 3 == j % 3))}
    assert {(r.query_id, r.id, r.score) for r in scoped.collect()} == wanted
    edges = {(r.from_id, r.to_id) for r in links.semantic_edges(df, 0.3, 4).collect()}
    assert edges == {(i, j) for i, j, _ in found if i != j}


def test_one_large_component_is_folded_in_rounds(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=4).tolist(), [None, "a", "b"][i % 3], i % 4 == 0) for i in range(240)]
    rows += [(240 + i, rows[i][1], "a", False) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, project string, is_stored boolean")
    new = df.where("NOT is_stored").select("id", "embedding", "project", (F.col("id") * 7 % 260).alias("place"))
    stored = df.where("is_stored").select("id", "embedding", "project")
    whole = {tuple(r) for r in dedup.decide_batch(new, stored, 0.9, 0.7).collect()}
    monkeypatch.setattr(dedup, "ROUND_PAIRS", 50)
    rounds = dedup._fold_in_rounds
    called = []
    monkeypatch.setattr(dedup, "_fold_in_rounds", lambda *a: called.append(1) or rounds(*a))
    assert {tuple(r) for r in dedup.decide_batch(new, stored, 0.9, 0.7).collect()} == whole and called
    assert {"REPLACE", "MERGE_CANDIDATE", "INSERT"} == {r[1] for r in whole}


def test_texts_near_by_chance_are_inserted(spark, tmp_path):
    """The MD5 digits of these two have a cosine of 0.86."""
    rows = [(7, 0, "user", "note 35996"), (7, 1, "user", "note 119441"), (7, 2, "user", "note 35996")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.queries()["ingest_saved"](spark, str(tmp_path)).collect()
    assert sorted(r.action for r in found) == ["INSERT", "INSERT", "REPLACE"]


def test_bands_are_fitted_on_all_good_documents(spark, monkeypatch):
    import zstandard

    monkeypatch.setattr(quality, "MAX_FIT", 5, raising=False)  # once a limit
    draw = np.random.default_rng(2)
    texts = ["".join(draw.choice(list("abcd efgh "), size=int(n))) for n in draw.integers(300, 500, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(60)] + [(0, 0)], "doc_id long, quality int")
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    ratios = sorted(len(press.compress(t.encode())) / len(t) for i, t in enumerate(texts) if i % 6 and 256 <= len(t) < 512)
    low, high = quality.band(int(2**8.5), quality.fit_bands(docs, labels))
    assert len(ratios) >= quality.MIN_FIT
    assert abs(low - (ratios[0] - quality.MARGIN)) < 1e-3 and abs(high - (ratios[-1] + quality.MARGIN)) < 1e-3


def test_planes_that_move_more_than_the_exact_join_are_not_drawn(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(120, 16)))]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    found = vector.similar_pairs_by_planes(df, 0.4)
    assert {r[:2] for r in found.collect()} == {r[:2] for r in vector.similar_pairs(df, 0.4).collect()}
    assert "Generate explode(keys" not in found._jdf.queryExecution().toString()


def test_an_index_splits_each_text_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword, "HELD_TOKENS", 3)
    seen = spark.sparkContext.accumulator(0)
    split = keyword.tokens_of

    def counted(text):
        seen.add(1)
        return split(text)

    monkeypatch.setattr(keyword, "tokens_of", counted)
    rows = [(1, "a b a c"), (2, ""), (3, None), (4, "b b b b b b"), (5, "c a")]
    df = spark.createDataFrame(rows, "id long, content string").withColumns({"project": F.lit("p"), "archived_at": F.lit(None).cast("timestamp")})
    index = Index(spark, str(tmp_path / "index"))
    index.add(df)
    assert seen.value == len(rows)
    lengths = {r.id: r.dl for r in spark.read.parquet(f"{index.path}/lengths").collect()}
    assert lengths == {"1": 4, "2": 0, "3": 0, "4": 6, "5": 2}
    places = {(r.term, r.id): r.positions for r in keyword.postings(df).collect()}
    assert places[("a", 1)] == [0, 2] and places[("b", 4)] == list(range(6)) and len(places) == 6
    assert {tuple(r) for r in index.bm25(df, "a c", None).collect()} == {tuple(r) for r in keyword.bm25(df, "a c", None).collect()}


def test_a_large_component_is_consolidated_in_ranges_of_turns(spark, monkeypatch):
    """Against a row-at-a-time version; pairs of a component, and of copies, are never one task's."""
    draw = np.random.default_rng(6)
    vectors = [*draw.normal(size=(150, 4)), *[[1.0, 2.0, 3.0, 4.0]] * 120]
    rows = [(i, int(at), "ab"[i % 7 == 0] if i % 11 else None, [float(x) for x in v]) for i, (v, at) in enumerate(zip(vectors, draw.integers(0, 90, 270)))]
    unit = np.array([r[3] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores, gone = np.round(unit @ unit.T, 6), {}
    for now in sorted(range(270), key=lambda i: (rows[i][1], i)):
        live = sorted((-1.0 if o == now else -scores[now, o], o) for o in range(270) if o not in gone and (o == now or scores[now, o] >= 0.7))[:5]
        for s, o in live:
            if o != now and rows[o][2] == rows[now][2] and now not in gone:
                old, new = sorted((now, o), key=lambda i: (rows[i][1], i))
                gone[old] = (new, "self-healing" if -s >= 0.9 else "consolidation")
    df = spark.createDataFrame(rows, "id long, at long, project string, embedding array<double>")
    df = df.select("id", F.timestamp_seconds("at").alias("created_at"), "project", "embedding", F.lit(None).cast("timestamp").alias("archived_at"))
    seen, dealt = [], dedup._turns
    monkeypatch.setattr(dedup, "TURN_ENTRIES", 2_000)
    monkeypatch.setattr(dedup, "_turns", lambda r, lists: seen.append(lists.count()) or dealt(r, lists))
    assert {r.id: (r.survivor, r.stage) for r in dedup.consolidate(df, 0.9, 0.7).collect()} == gone
    assert seen[0] < 0.25 * (scores >= 0.7).sum()


def test_a_pair_of_blocks_of_one_table_meets_once(spark, monkeypatch):
    """Its product serves the rows of both; the rows sent are about half of those of two tables."""
    monkeypatch.setattr(cells, "PART_ROWS", 30)
    monkeypatch.setattr(cells, "TILE", (32, 16))
    x = np.random.default_rng(5).normal(size=(240, 8))
    x[200:] = x[:40]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    met, meet = [], cells._met
    monkeypatch.setattr(cells, "_met", lambda a, b, *rest: met.append(a.count() + b.count()) or meet(a, b, *rest))
    centroids = np.zeros((1, 8))
    for threshold in (0.3, -1.0):
        once, twice = cells.near_rows(df, df, threshold, 5, centroids=centroids), cells.near_rows(df, df.select("*"), threshold, 5, centroids=centroids)
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert met[0] < 0.7 * met[1] and met[2:] == met[:2]


def test_large_tables_are_dealt_to_fewer_parts():
    assert [cells._part_rows(n, 10) // cells.PART_ROWS for n in (1_000, 102_564, 300_000, 615_000, 10**8)] == [2, 2, 4, 4, 4]
    assert cells._part_rows(10**8, None) == cells.PART_ROWS


def test_joins_of_edges_and_searches_do_not_move_texts(spark, sf_dir, monkeypatch):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    edges = [line for line in plan(views.edges(spark, sf_dir)).splitlines() if "Project" in line and "text#" in line]
    assert edges and all("sha2(" in line for line in edges)
    counted, cut = [], keyword.cut
    monkeypatch.setattr(keyword, "cut", lambda df: counted.append(plan(df)) or cut(df))
    m = views.memories(spark, sf_dir)
    apart = keyword.bm25(m, "of the", None, texts=views.texts(spark, sf_dir)).collect()
    assert counted[0].index("Join") < counted[0].index("counts(")
    assert apart and apart == keyword.bm25(m, "of the", None).collect()


def test_a_small_frontier_goes_to_the_edges(spark, monkeypatch):
    draw = np.random.default_rng(9)
    kinds = ["CHUNK_NEXT", "SUPERSEDES"]
    edges = spark.createDataFrame([(int(a), int(b), kinds[int(a + b) % 2]) for a, b in draw.integers(0, 120, (200, 2))], "from_id long, to_id long, edge_type string")
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    sent = sorted(map(tuple, graph.reachable(edges, spark.range(120), [3, 4], 2)[0].collect()))
    joins = [p for p in plans if "Join Inner" in p]
    assert len(sent) > 5 and joins and all("strategy=broadcast" in p for p in joins) and len(plans) == len(joins) + 1
    monkeypatch.setattr(graph, "SENT_ROWS", 0)
    assert sent == sorted(map(tuple, graph.reachable(edges, spark.range(120), [3, 4], 2)[0].collect()))
    assert any("Join Inner" in p and "strategy=broadcast" not in p for p in plans)


def test_consolidation_reads_no_texts(spark, sf_dir):
    plan = queries._one_project(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "Relation" not in line]  # a relation lists all its columns
    assert len(read) > 4 and not any("text#" in line for line in read)
