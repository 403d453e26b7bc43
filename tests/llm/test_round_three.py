"""Centroids, lattice scores and the prefix trie against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallkit.llm import centroids, lattice, prefix_trie
from recallkit.llm import queries as q

# -- 11: centroids


def test_centroids_equal_sql(spark, sf_dir, same):
    same(q.op11_centroids(spark, sf_dir), q.oracle_sql()["op11_centroids"])


def test_annulus_finds_the_nearest_and_the_smaller_of_ties():
    draw = np.random.default_rng(3)
    for k in (1, 2, 16):
        centers = draw.integers(-9, 9, size=(k, 5))
        centers[k // 2] = centers[0]  # equal centroids
        points = np.concatenate([draw.integers(-12, 12, size=(400, 5)), centers, np.zeros((1, 5), np.int64)]).astype(np.int64)
        whole = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
        who, best = centroids.nearest(points, centers.astype(np.int64))
        assert (who == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()


def test_annulus_with_the_largest_components():
    most = centroids.LIMIT
    points = np.array([[most] * 64, [-most] * 64, [0] * 64, [most] * 63 + [most - 1]], np.int64)
    who, best = centroids.nearest(points, points[[1, 0, 3]])
    assert who.tolist() == [1, 0, 1, 2] and best.tolist() == [0, 0, 64 * most**2 - 0, 0] or who.tolist()[2] == 2
    assert best[2] == min(64 * most**2, 63 * most**2 + (most - 1) ** 2)


def test_centroids_odd_rows(spark):
    sound = [0.5] * 64
    rows = [
        (1, sound, 9), (1, sound, 9), (None, [0.25] * 64, 9), (2, [float("nan")] + [0.0] * 63, 9), (3, [float("inf")] * 64, 9),
        (4, [None] + [0.0] * 63, 9), (5, [0.0] * 63, 9), (6, None, 9), (7, [], 9), (8, [3e38] * 64, 9), (9, [-0.001] * 64, 9),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int")
    found = centroids.cluster_vectors(df, k=3).collect()
    assert sorted((r.vec_id or 0) for r in found) == [0, 1, 1, 8, 9] and found[0].asDict().keys() >= {"vec_id", "cluster", "inertia"}
    assert {r.cluster_inertia for r in found} and len({r.inertia for r in found}) == 1
    assert sum({r.cluster: r.cluster_inertia for r in found}.values()) == found[0].inertia
    assert len({(r.cluster, r.distance) for r in found if r.vec_id == 1}) == 1
    few = centroids.cluster_vectors(df.where("vec_id = 9"), k=16).first()
    assert (few.cluster, few.distance) == (0, 0)
    assert few.centroid_sha256 == hashlib.sha256(",".join(["-1"] * 64).encode()).hexdigest()
    assert centroids.cluster_vectors(df.where("false")).columns == centroids.cluster_vectors(df).columns
    assert centroids.cluster_vectors(df.where("false")).count() == 0


# -- 12: lattice


def brute(model: lattice.Pieces, word: bytes) -> tuple[float, Counter]:
    """Probability of a word by all its segmentations, and the expected number of each piece."""
    number = {s: i for i, s in enumerate(model.strings) if s}
    total, counts = 0.0, Counter()
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(ends, ends[1:])]
        if all(p in number for p in parts):
            p = math.exp(sum(model.log[number[x]] for x in parts))
            total += p
            for x in parts:
                counts[number[x]] += p
    return total, Counter({k: v / total for k, v in counts.items()})


@pytest.fixture(scope="module")
def model():
    strings = [b" a", b" ab", b"b", b"ba", b"ab", b"a", b" ", b"bab", "é".encode(), *[bytes([x]) for x in range(256) if x not in (0x20, 0x61, 0x62)], b""]
    weights = np.random.default_rng(5).random(len(strings)) + 0.1
    return lattice.Pieces(strings, weights / weights.sum())


def test_forward_sums_all_segmentations(model):
    words = [b"a", b"ab", b"abab", b"babba", "éa".encode(), b"zzab", b"aaaaaaaa"]
    for word in words:
        row = np.frombuffer(b" " + word, np.uint8)[None, :]
        total, counts = brute(model, b" " + word)
        assert math.isclose(model.forward(row)[0], math.log(total), rel_tol=1e-12)
        assert math.isclose(model.forward_long(b" " + word), math.log(total), rel_tol=1e-12)
        found = model.expected(row, np.array([3.0]))
        for i in np.flatnonzero(found):
            assert math.isclose(found[i], 3 * counts[i], rel_tol=1e-9)
        assert set(np.flatnonzero(found)) == set(counts)
    together = [w for w in words if len(w) == 2]
    for places, rows in lattice._by_length(words):
        for place, value in zip(places, model.forward(rows)):
            assert math.isclose(value, math.log(brute(model, b" " + words[place])[0]), rel_tol=1e-12)
    assert together and list(lattice._by_length([])) == []


WORDS = [(1, "The the THE cat"), (2, "the dog"), (3, None), (4, ""), (2, "the dog"), (5, "É é " + "x" * 1500), (None, "stray cat"), (12, "cat\x0bdog x")]


def scored(spark, rows, held, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    return lattice.score_texts(df, q.pieces_vocabulary(), held, **options)


@pytest.mark.parametrize("hot", [1 << 17, 0])
def test_scores_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lattice, "HOT", hot)
    out = F.col("doc_id") == 2
    found = scored(spark, WORDS, out, rounds=1).collect()
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in WORDS]
    train = Counter(w for (i, _), ws in zip(WORDS, tokens) if i != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    strings, first = lattice.read_vocabulary(q.pieces_vocabulary())
    model = lattice.Pieces(strings, first)
    expected = lattice.PRIOR * first
    for word, c in train.items():
        if word is not None:
            for i in range(0, len(word), lattice.LONG):
                expected = expected + model.expected(np.frombuffer(b" " + word[i : i + lattice.LONG], np.uint8)[None, :], np.array([float(c)]))
    expected[-1] += train[None]
    learnt = lattice.Pieces(strings, expected / expected.sum())
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    assert len(found) == len(WORDS) and {r.train_tokens for r in found} == {n}
    for (i, _), ws in zip(WORDS, tokens):
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(learnt.log[-1] if w is None else learnt.forward_long(b" " + w) for w in ws) / math.log(10)
        for r in by_id[i]:
            assert (r.held_out, r.n_tokens, r.n_known) == (i == 2, len(ws), sum(train[w] > 0 for w in ws))
            assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_scores_without_training_or_rows(spark):
    assert scored(spark, [], F.col("doc_id") == 2).count() == 0
    alone = scored(spark, [(2, "the dog"), (2, None)], F.lit(True)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and r.score < 0 for r in alone)


def test_learning_helps_on_held_out_texts(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    means = [lattice.score_texts(docs, q.pieces_vocabulary(), out, rounds=r, keep=["doc_id"]).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0] for r in (0, 1, 2)]
    assert means[0] + 2 < means[1] < means[2] < 0


# -- 13: prefix trie


def trie_of(rows: list[tuple]) -> list[tuple]:
    """The contract by brute force over all rebuilt conversations."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    found = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(o) == len(p) + 1 and o[: len(p)] == p for o in members)]
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        found.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
                      sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(spark, rows, **bounds) -> list[tuple]:
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    return sorted((tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(df, **bounds).collect()), key=repr)


def test_trie_equals_sql(spark, sf_dir, same):
    same(q.op13_prefix_trie(spark, sf_dir).select(*NODE), q.oracle_sql()["op13_prefix_trie"])


def talk(conv: int, length: int, words: str = "ab") -> list[tuple]:
    return [(conv, t, "user" if t % 2 else "bot", words[(conv * 7 + t) % len(words)] * (t % 3)) for t in range(length)]


@pytest.mark.parametrize("near, run", [(64, 4096), (9, 2)])
def test_trie_against_brute_force(spark, near, run):
    """Copies that share all, part or none of a path; long ones that leave the cogroup of their family."""
    rows = [r for c in (0, 1, 2, 5, 8, 11, 14, 20) for r in talk(c, 4 + c)]
    rows += [(c, t, "user", f"common {t}") for c in range(30, 60) for t in range(3 + (c % 2) * 20)]  # copies
    rows += [(c, t, "user", f"common {t}" if t < 15 else f"own {c}") for c in (60, 61, 65) for t in range(25)]
    assert found_trie(spark, rows, near=near, run=run) == trie_of(rows)


def test_trie_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (3, None, "user", "first"), (3, 0, None, None), (3, 1, "user", "é\n漢字"), (3, 1, "user", "é\n漢字"),
        (4, 0, "", ""), (7, 5, "user", "x" * 100_000), (7, 5, "user", None), (-3, 0, "user", "below zero"), (0, 0, "user", "base"),
        (1 << 40, 0, "user", "far"),
    ]
    rows = [r for r in rows if r != (7, 5, "user", None)]  # ties of different texts go by digest; see the docstring
    assert found_trie(spark, rows) == trie_of(rows)
    tied = found_trie(spark, [(5, 1, "user", t) for t in ("b", "a", "c", "a")])
    assert len(tied) == 5 and tied == found_trie(spark, [(5, 1, "user", t) for t in ("a", "c", "a", "b")])
    assert found_trie(spark, [(None, 0, "a", "b")]) == [] == found_trie(spark, [])
