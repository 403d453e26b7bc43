"""Ordered folds against row-at-a-time versions."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallkit.operators import cells, dedup, vector
from recallkit.plans import lifecycle

START = dt.datetime(2024, 1, 1)


def sample(seed, n=40):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 5))
    rows = []
    for i in range(n):
        v = base[rng.integers(6)] + rng.normal(size=5) * rng.choice([0.0, 0.15, 0.4])
        project = [None, "a", "b"][rng.integers(3)]
        rows.append((i, START + dt.timedelta(minutes=int(rng.integers(30))), project, [float(np.float32(x)) for x in v]))
    return rows


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, created_at timestamp, project string, embedding array<float>")


@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed):
    rows = sample(seed)
    by = {r[0]: r for r in rows}
    archived, before, expected = set(), [], {}
    for now in sorted(by, key=lambda i: (by[i][1], i)):
        live = [o for o in before if o not in archived and (by[now][2] is None or by[o][2] == by[now][2])]
        best = min(live, key=lambda o: (-cosine(by[now][3], by[o][3]), o), default=None)
        score = cosine(by[now][3], by[best][3]) if best is not None else -1
        action = "REPLACE" if score >= 0.9 else "MERGE_CANDIDATE" if score >= 0.85 else "INSERT"
        expected[now] = (action, best if action != "INSERT" else None)
        if action == "REPLACE":
            archived.add(best)
        before.append(now)
    found = {r.id: (r.action, r.existing_id) for r in dedup.fold(frame(spark, rows)).collect()}
    assert found == expected


@pytest.mark.parametrize("seed", range(3))
def test_consolidate(spark, seed):
    rows = sample(seed)
    by = {r[0]: r for r in rows}
    gone: dict = {}
    for now in sorted(by, key=lambda i: (by[i][1], i)):
        if now in gone:
            continue
        live = sorted((-cosine(by[now][3], by[o][3]), o) for o in by if o not in gone and o != now)
        live = [(-s, o) for s, o in live][:4]
        live = [(s, o) for s, o in live if by[o][2] == by[now][2]]
        for low, high in ((0.9, 9), (0.85, 0.9)):
            for s, o in live:
                if low <= s < high and now not in gone and o not in gone:
                    old, new = sorted((now, o), key=lambda i: (by[i][1], i))
                    gone[old] = new
    from pyspark.sql import functions as F

    m = frame(spark, rows).withColumn("archived_at", F.lit(None).cast("timestamp"))
    assert {r.id: r.survivor for r in dedup.consolidate(m).collect()} == gone


def test_blocks_meet_once(spark, monkeypatch):
    rows = sample(9)
    whole = {(r.id_a, r.id_b, r.score) for r in vector.similar_pairs(frame(spark, rows), 0.5).collect()}
    monkeypatch.setattr(vector, "BLOCK_ROWS", 7)
    found = [(r.id_a, r.id_b, r.score) for r in vector.similar_pairs(frame(spark, rows), 0.5).collect()]
    assert len(found) == len(whole) and set(found) == whole
    near = vector.nearest(frame(spark, rows), frame(spark, rows), 3)
    assert near.count() == 120
    assert vector.similar_pairs(frame(spark, []), 0.5).count() == 0
    planes = {(r.id_a, r.id_b) for r in vector.similar_pairs_by_planes(frame(spark, rows), 0.85, tables=24, planes=3).collect()}
    exact = {(a, b) for a, b, s in whole if s >= 0.85}
    assert planes <= exact and len(planes) >= 0.9 * len(exact)


def test_long_chains_are_one_component(spark):
    from pyspark.sql import functions as F

    chain = spark.range(200).where("id <> 120").select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    found = {r.id: r.root for r in dedup._components(chain).collect()}
    assert found == {i: 0 if i <= 120 else 121 for i in range(201)}


def test_batches_are_decided_in_order(spark):
    """Against a row-at-a-time version, on vectors of few directions."""
    import random

    draw = random.Random(5)
    base = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(80):
        v = [x + draw.gauss(0, 0.25) for x in draw.choice(base)]
        rows.append((i, None if i % 13 == 0 else v, [None, "a", "b"][i % 3], i % 4 == 0))
    schema = "id long, embedding array<double>, project string, is_stored boolean"
    df = spark.createDataFrame(rows, schema)
    stored, new = df.where("is_stored").drop("is_stored"), df.where("NOT is_stored").withColumn("place", F.col("id"))
    found = {r.id: (r.action, r.existing_id) for r in dedup.decide_batch(new, stored, 0.97, 0.9).collect()}

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return round(dot / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 6)

    live, expected = {i: (v, p) for i, v, p, s in rows if s}, {}
    for i, v, p, s in rows:
        if s:
            continue
        near = sorted((-cosine(v, w), o) for o, (w, q) in live.items() if v and w and (p is None or p == q))
        if near and -near[0][0] >= 0.9:
            expected[i] = ("REPLACE" if -near[0][0] >= 0.97 else "MERGE_CANDIDATE", near[0][1])
            if -near[0][0] >= 0.97:
                del live[near[0][1]]
        else:
            expected[i] = ("INSERT", None)
        live[i] = (v, p)
    assert found == expected and {"REPLACE", "MERGE_CANDIDATE", "INSERT"} == {a for a, _ in expected.values()}


def test_planes_reach_their_recall(spark):
    from recallkit.operators import vector
    from recallkit.sources import views

    vectors = views.memories(spark, "/root/testdata/sf0.01").where("embedding IS NOT NULL").select("id", "embedding").cache()
    exact = {(r.id_a, r.id_b) for r in vector.similar_pairs(vectors, 0.4).collect()}
    found = [(r.id_a, r.id_b) for r in vector.similar_pairs_by_planes(vectors, 0.4).collect()]
    assert len(found) == len(set(found)) and set(found) <= exact and len(found) >= 0.9 * len(exact) > 40


def test_cells_find_every_pair(spark, monkeypatch):
    """Clustered, equal, opposite and zero vectors, with cells and parts small enough to matter."""
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    monkeypatch.setattr(cells, "PART_ROWS", 15)
    draw = np.random.default_rng(11)
    centers = draw.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + draw.normal(scale=0.2, size=8)).tolist()) for i in range(200)]
    rows += [(200 + i, [1.0] + [0.0] * 7) for i in range(40)] + [(240, [0.0] * 8), (241, [0.0] * 8), (242, [-1.0] + [0.0] * 7)]
    vectors = spark.createDataFrame([(i, v, i % 2) for i, v in rows], "id long, embedding array<double>, side int")
    x = np.array([v for _, v in rows])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 6)
    for threshold in (0.9, 0.3, 0.0, -1.0):
        expected = {(i, j, scores[i, j]) for i in range(len(x)) for j in range(i + 1, len(x)) if scores[i, j] >= threshold}
        found = [tuple(r) for r in cells.similar_pairs(vectors.select("id", "embedding"), threshold).collect()]
        assert len(found) == len(expected) and {p[:2] for p in found} == {p[:2] for p in expected}
    best = cells.near_rows(
        vectors, vectors, 0.5, 3, lambda left, right: left["q_side"].to_numpy()[:, None] != right["v_side"].to_numpy()[None, :]
    ).collect()
    wanted = {}
    for i in range(len(x)):
        near = sorted((-scores[i, j], j) for j in range(len(x)) if i % 2 != j % 2 and scores[i, j] >= 0.5)[:3]
        wanted |= {i: [j for _, j in near]} if near else {}
    by_query = {}
    for r in sorted(best, key=lambda r: (r.query_id, -r.score, r.id)):
        by_query.setdefault(r.query_id, []).append(r.id)
    assert by_query == wanted
    plan = cells.near_rows(vectors, vectors, 0.5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert cells.similar_pairs(vectors.select("id", "embedding").where("false"), 0.5).count() == 0


def test_many_equal_rows_are_one_node(spark):
    """A chain of equal rows: each replaces the one before; no pair list of all of them."""
    n = 1500
    new = spark.range(n).select("id", F.lit([0.5] * 4).alias("embedding"), F.lit("p").alias("project"), F.col("id").alias("place"))
    stored = new.where("false").select("id", "embedding", "project")
    found = {r.id: (r.action, r.existing_id) for r in dedup.decide_batch(new, stored).collect()}
    assert found == {0: ("INSERT", None)} | {i: ("REPLACE", i - 1) for i in range(1, n)}


def test_pages_of_a_consolidation_are_one_run(spark):
    draw = np.random.default_rng(5)
    rows = [(i, f"2024-01-{1 + i % 9:02d} 00:00:00", draw.normal(size=3).tolist(), "ab"[i % 2]) for i in range(60)]
    rows += [(60 + i, "2024-01-05 00:00:00", rows[i][2], "a") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, created_at string, embedding array<double>, project string")
    df = df.select("id", F.col("created_at").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("archived_at"), "embedding", "project")
    whole = {tuple(r) for r in dedup.consolidate(df).collect()}
    pages = list(lifecycle.consolidation_pages(df, 16))
    assert {tuple(r) for p in pages for r in p.merged.collect()} == whole and whole
    cursors = [p.cursor for p in pages]
    assert cursors == sorted(cursors) and pages[-1].last and not pages[0].last
