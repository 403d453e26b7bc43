from __future__ import annotations

import random

import pytest

from recallkit.operators import graph


def walk(edges, seeds, depth, hops=50, types=None):
    """Rows of all simple paths, by recursion."""
    found = set()

    def go(node, logical, physical, seen):
        for a, b, kind in edges:
            if a != node or b in seen or types and kind not in types:
                continue
            deeper = logical + (kind != "SUPERSEDES")
            if deeper <= min(depth, 5) and physical + 1 <= hops:
                found.add((b, a, b, kind, deeper, physical + 1))
                go(b, deeper, physical + 1, seen | {b})

    for s in set(seeds):
        found.add((s, None, None, None, 0, 0))
        go(s, 0, 0, {s})
    return found


def frame(spark, edges):
    return spark.createDataFrame(edges, "from_id long, to_id long, edge_type string")


@pytest.mark.parametrize("seed", range(3))
def test_traversal_equals_recursion_and_frontier(spark, seed):
    draw = random.Random(seed)
    kinds = ["SUPERSEDES", "CHUNK_NEXT", "REFERENCES"]
    edges = sorted({(draw.randrange(8), draw.randrange(8), draw.choice(kinds)) for _ in range(14)})
    nodes = spark.range(8)
    for depth in (0, 2):
        rows = graph.traverse(frame(spark, edges), nodes, [0, 1], depth).collect()
        expected = walk(edges, [0, 1], depth)
        assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)
        known, late = graph.reachable(frame(spark, edges), nodes, [0, 1], depth)
        assert {r.id for r in known.collect()} == {r[0] for r in expected} and not late


def test_chain_is_clamped_and_replacements_are_free(spark):
    chain = [(i, i + 1, "TEMPORAL_NEXT") for i in range(7)]
    rows = graph.traverse(frame(spark, chain), spark.range(8), [0], 10).collect()
    assert max(r.node_id for r in rows) == 5
    free = [(0, 1, "SUPERSEDES"), (1, 2, "SUPERSEDES"), (2, 3, "TEMPORAL_NEXT")]
    assert {r.node_id for r in graph.traverse(frame(spark, free), spark.range(4), [0], 1).collect()} == {0, 1, 2, 3}
    assert graph.traverse(frame(spark, free), spark.range(4), [], 1).count() == 0
    assert graph.traverse(frame(spark, free), spark.range(4), [0], 1, ["NONE"]).count() == 1


def test_deadline_gives_what_is_known(spark):
    known, late = graph.reachable(frame(spark, [(0, 1, "CHUNK_NEXT")]), spark.range(2), [0], 2, deadline=-1.0)
    assert late and known.count() == 1


def test_updates(spark):
    schema = "from_id long, to_id long, edge_type string, props map<string,string>"
    old = spark.createDataFrame([(1, 2, "A", {"x": "1", "y": "1"})], schema)
    new = spark.createDataFrame([(1, 2, "A", {"y": "2"}), (2, 9, "A", {})], schema)
    assert {(r.from_id, r.to_id): r.props for r in graph.merge_edges(old, new).collect()} == {
        (1, 2): {"x": "1", "y": "2"}, (2, 9): {},
    }
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    added = graph.add_edges(old, new, nodes).collect()
    assert [(r.from_id, r.props) for r in added] == [(1, {"x": "1", "y": "1"})]


def test_layout_limits(spark):
    with pytest.raises(ValueError):
        graph.layout(spark.range(1), 0)
