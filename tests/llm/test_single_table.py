"""Operators on one table, against brute force; and the cases every operator must bear."""

from __future__ import annotations

import argparse
import hashlib
import json.decoder
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from recallkit.llm import components, decontaminate, licenses, mixing, pii, quality, simhash, substrings, tokens
from recallkit.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None, "a", 5),
    (2, "", None, 5),
    (3, " \t\n\x0b\x0c\r", "a", None),
    (4, "one", "b", 5),
    (4, "one", "b", 5),
    (None, "null id text here", "b", 5),
    (5, LONG, "a", 5),
    (6, LONG + " tail", "a", 5),
    (7, "é ñ 漢字　x\n\nx\n", "a", 5),
]
#: Columns named like results of the operators.
CLASHES = ("n_words", "kept", "ratio", "score", "size", "n_entities", "fp", "ids", "target", "taken", "mark", "spans")


def frame(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# -- 1: tokens


def test_tokens_equal_whole_text_encoding(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.vocabulary())
    start, expected = 0, {}
    for i in sorted(docs):
        ids = [*t.encode(docs[i], add_special_tokens=False).ids, 0]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in q.op1_token_ids(spark, sf_dir).collect()}
    assert found == expected


@pytest.mark.parametrize(("bits", "chunk"), [(21, 100_000), (7, 20)])
def test_encoder_on_odd_blanks(monkeypatch, bits, chunk):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "TABLE_BITS", bits)
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    e, plain = tokens.Encoder(q.vocabulary()), Tokenizer.from_file(q.vocabulary())
    texts = ["hi <|endoftext|> there", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext", "x  y", ""]
    draw, letters = random.Random(1), list("ab É \n\t'st'll12  .,!_\x1c\x85　漢é́<") + ["<|endoftext|>", "x" * 60]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], e.encode(texts[at : at + 500]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert e.table.held <= e.table.limit


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    import pyarrow.parquet as pq

    path = str(tmp_path / encoding)
    tokens.write_tokens(frame(spark), path, q.vocabulary(), encoding=encoding)
    rows = tokens.read_tokens(spark, path).collect()
    assert len(rows) == len(ODD) and all(len(r.ids) == r.n_tokens and r.ids[-1] == 0 for r in rows)
    assert tokens.read_tokens(spark, path, ("doc_id", "n_tokens")).where("doc_id = 5").count() == 1
    column = next(pq.ParquetFile(p) for p in sorted((tmp_path / encoding).glob("part-*"))).metadata.row_group(0).column(2)
    assert column.has_offset_index and column.has_column_index
    assert any("DELTA" in x if encoding == "delta" else "DICTIONARY" in x for x in column.encodings)
    found = tokens.digest(spark, path).orderBy("start").collect()
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 4, 5, 6, 7]


# -- 3: quality


def brute_in_bands(text: bytes, bands) -> bool:
    """The bands by their definition: whole text, then chunks, limits linear in the logarithm of the length."""

    def inside(part):
        x, points = math.log2(len(part)), [(math.log2(n), low, high) for n, low, high in bands]
        low, high = points[0][1:] if x <= points[0][0] else points[-1][1:]
        for (a, *p), (b, *r) in zip(points, points[1:]):
            if a < x <= b:
                low, high = (p[i] + (r[i] - p[i]) * (x - a) / (b - a) for i in (0, 1))
        return low <= len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part) <= high

    whole, rest = divmod(len(text), 4096)
    cuts = [4096 * i for i in range(whole + (rest >= 1024 or not whole))] + [len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    return inside(text) and 2 * sum(not inside(p) for p in parts) <= len(parts) if len(parts) > 1 else inside(text)


def test_quality_measures(spark, sf_dir, docs):
    bands = quality.fit_bands(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels")))
    for r in q.op3_compression_bands(spark, sf_dir).collect():
        text = docs[r.doc_id]
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed,
        )
        assert r.kept == (not failed and brute_in_bands(text.encode(), bands))


def test_quality_keeps_labelled_good_text(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = q.op3_compression_bands(spark, d).where("NOT base_failed").join(labels, "doc_id")
    shares = {r.quality: r.k for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert shares[1] > 0.97 and shares[0] < 0.3


def test_quality_noise_and_repeats():
    press = zstandard.ZstdCompressor(level=3)
    draw = random.Random(2)
    noise = " ".join("".join(chr(draw.randrange(33, 126)) for _ in range(8)) for _ in range(400)).encode()
    assert not quality.compression_verdict(noise, press)[2]
    assert not quality.compression_verdict(b"all work and no play " * 100, press)[2]
    code = Path(argparse.__file__).read_bytes()
    table = "\n".join(f"| row {i} | {draw.random():.3f} | {draw.randrange(10**6)} |" for i in range(400)).encode()
    for text in (code, code[:3000], table, Path(json.decoder.__file__).read_bytes(), LONG[:20000].encode()):
        assert quality.compression_verdict(text, press)[2]
    assert [len(c) for c in quality.chunks_of(b"x" * 9000)] == [4096, 4904] and len(quality.chunks_of(b"x" * 9300)) == 3
    assert quality.repeated_words([b"a"] * 9) == 9 and quality.repeated_words([b"a"] * 8) == 0


def test_quality_odd_rows(spark):
    df = quality.compression_bands(frame(spark))
    assert df.count() == len(ODD) and df.columns.count("n_words") == 1
    kept = quality.keep_acceptable(frame(spark))
    assert kept.columns == frame(spark).columns and {r.doc_id for r in kept.collect()} <= {5, 6}
    assert quality.compression_bands(frame(spark, [])).count() == 0


# -- 5: SimHash


def brute_fingerprint(text: str) -> int:
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict) -> dict:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark, sf_dir, docs):
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    groups = brute_components(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op5_simhash(spark, sf_dir).collect()}
    assert found == {i: (f"{prints[i]:016x}", groups[i]) for i in docs}


@pytest.mark.parametrize("list_max", [1024, 2])
def test_simhash_links_of_crowded_lists(spark, monkeypatch, list_max):
    monkeypatch.setattr(simhash, "LIST_MAX", list_max)
    rng = np.random.default_rng(3)
    values = set()
    for base in rng.integers(0, 2**63, 4):
        for _ in range(40):
            v = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                v ^= 1 << int(bit)
            values.add(v - (1 << 64) if v >> 63 else v)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = components.components(simhash.links(df), "x", "y")
    roots = {r.node: r.root for r in found.collect()}
    unsigned = {v: v & (1 << 64) - 1 for v in values}
    assert {v: roots.get(v, v) for v in values} == brute_components(unsigned)


def test_simhash_by_flips():
    rng = np.random.default_rng(4)
    v = np.unique(rng.integers(0, 2**24, 400).astype(np.uint64) & np.uint64(0x0F0F0F) | np.uint64(0xABCD << 40))

    def groups(links):
        root = {int(x): int(x) for x in v}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            a, b = sorted((find(int(a)), find(int(b))))
            root[b] = a
        return {i: find(i) for i in root}

    assert groups(simhash._forest_by_flips(np.sort(v))) == groups(simhash.forest(v)) == brute_components({int(x): int(x) for x in v})


def test_simhash_odd_rows(spark):
    found = simhash.near_duplicates(frame(spark)).where("doc_id IS NOT NULL").collect()
    roots = {r.doc_id: r.component_id for r in found}
    assert len(found) == len(ODD) - 1 and roots[1] == roots[2] == roots[3] == 1 and roots[6] == 5
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    two = [(1, "some text of one kind here", "a", 0), (1, "other words that have nothing in common", "b", 0), (None, "some text of one kind here", "c", 0), (None, "alone", "a", 0), (None, "alone", "a", 1)]
    kept = simhash.keep_one(frame(spark, two)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "alone"), (1, two[1][1]), (1, two[0][1])]
    assert simhash.keep_one(frame(spark, [])).count() == 0
    kept = simhash.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]


def test_long_chain_is_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    found = components.components(chain.where("x <> 150"), "x", "y")
    assert Counter(r.root for r in found.collect()) == {0: 151, 151: 150}


# -- 6: substrings


def brute_kept(rows: list[tuple], window: int = 50) -> list[tuple]:
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first: dict = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_max", [64, 1])
def test_substrings(spark, monkeypatch, shard_max):
    monkeypatch.setattr(substrings, "SHARD_MAX", shard_max)
    draw = random.Random(5)
    pool = [[f"{draw.choice('abcdef')}{draw.randrange(30)}" for _ in range(n)] for n in (55, 80, 200, 49)]
    rows = []
    for i in range(60):
        words: list[str] = []
        for _ in range(draw.randint(0, 5)):
            part = draw.choice(pool)
            a = draw.randrange(0, 10)
            words += part[a : len(part) - draw.randrange(0, 10)]
            words += [f"z{draw.randrange(10**6)}" for _ in range(draw.randint(0, 30))]
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(words)))
    rows += [(rows[3][0], rows[3][1]), (200, "r " * 120), (201, "r " * 120), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_kept(rows)


def test_substrings_query(spark, sf_dir, docs):
    found = q.op6_substrings(spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=repr) == brute_kept(list(docs.items()))


def test_substrings_sql(spark, sf_dir, same):
    same(q.op6_substrings(spark, sf_dir), q.OP6_SQL)


def test_substrings_odd_rows(spark):
    found = substrings.remove_repeats(frame(spark)).collect()
    assert {r.doc_id: r.n_removed for r in found if r.doc_id} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 30_000, 7: 0}
    assert len(found) == len(ODD) and substrings.remove_repeats(frame(spark, [])).count() == 0


def test_automaton():
    machine = substrings.SuffixAutomaton()
    draw = random.Random(6)
    texts = [[draw.choice("ab") for _ in range(40)] for _ in range(4)]
    for t in texts:
        machine.add(t)
    grams = {tuple(t[i : i + 6]) for t in texts for i in range(35)}
    probe = [draw.choice("ab") for _ in range(200)]
    covered = {j for i in range(195) if tuple(probe[i : i + 6]) in grams for j in range(i, i + 6)}
    assert {j for a, b in machine.spans(probe, 6) for j in range(a, b)} == covered


# -- 7: PII


def test_surrogates():
    s, f = pii.Surrogates("key"), pii.Finder()
    text = (
        "Mail und.34@mail7.example.com or call +1 (974) 555-3436, card 4111 1111 1111 1111, ip 96.153.118.61, "
        'token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71", DE89 3704 0044 0532 0130 00, 123-45-6789, '
        "Mr. John Smith met Frau Müller and Мария Иванова. Later Smith left."
    )
    kinds = [k for k, _ in pii.entities(text, f)]
    assert kinds == ["email", "phone", "card", "ip", "secret", "iban", "ssn"] + ["person"] * 4
    new, found = pii.replace(text, f, s, {})
    assert len(found) == 11 and len(new) >= len(text) - 20
    for _, entity in pii.entities(text, f):
        assert entity not in new
    card = next(e for k, e in pii.entities(new, f) if k == "card")
    digits = [int(c) for c in card if c.isdigit()]
    assert pii._luhn(digits[:-1]) == digits[-1] and digits[0] == 4
    iban = next(e for k, e in pii.entities(new, f) if k == "iban")
    assert int(iban[2:4]) == pii._iban_check("DE", iban[4:]) and [i for i, c in enumerate(iban) if c == " "] == [4, 9, 14, 19, 24]
    male, female = pii.GIVEN_NAMES[0], pii.GIVEN_NAMES[3]
    assert s.person("Mr. John Smith").split()[1] in male and s.person("Мария Иванова").split()[0] in female
    assert s.person("Mr. John Smith").split()[2] == s.person("Smith") and f"Later {s.person('Smith')} left" in new
    assert pii.replace("clean text, v2.0 of 2024-01-02", f, s, {}) == ("clean text, v2.0 of 2024-01-02", [])
    assert pii.Surrogates("other").email("a.b@c.org") != s.email("a.b@c.org")


ALONE = {
    "email": "a@b.co", "secret": "abcdefab" * 4, "iban": "DE89 3704 0044 0532 0130 00", "ip": "8.8.8.8",
    "card": "4111-1111-1111-1111", "phone": "974-555-3436", "ssn": "123-45-6789", "person": "Priya Patel",
}


@pytest.mark.parametrize("kind", ALONE)
def test_every_pattern_alone(kind):
    for text in (ALONE[kind], f"dns {ALONE[kind]} ok"):
        assert pii.entities(text, pii.Finder()) == [(kind, ALONE[kind])]
    assert [e for _, e in pii.entities("Hello, my name is Zorblax Quux. Quux it is.", pii.Finder())] == ["Zorblax Quux", "Quux"]
    assert [e for _, e in pii.entities("Wei Chen spoke", pii.Finder())] == ["Wei Chen"]


def test_surrogates_do_not_depend_on_format():
    s = pii.Surrogates("key")
    bare = lambda x: re.sub(r"\W", "", x).lower()
    for kind, forms in {
        "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
        "phone": ["+49 30 123-4567", "+49301234567", "+49 (30) 1234567"],
        "card": ["4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111"],
        "email": ["John@x.com", "john@X.com"],
        "secret": ["ABCDEF12" * 4, "abcdef12" * 4],
    }.items():
        assert len({bare(s.of(kind, x)) for x in forms}) == 1
        for x in forms:
            same = [(re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", t)))) for t in (x, s.of(kind, x))]
            assert kind == "secret" or same[0] == same[1]
    assert s.of("email", "amy@acme.com").split("@")[1] == s.of("email", "bob@acme.com").split("@")[1]


def test_permutations_are_one_to_one():
    s = pii.Surrogates("key")
    assert len({s.letters("t", f"{i:03d}") for i in range(1000)}) == 1000
    assert len({s.letters("t", c) for c in "aeiouy"}) == 6
    assert len({s.ip(f"10.0.{i}.{j}") for i in range(20) for j in range(20)}) == 400
    assert sorted(s.person(n) for n in pii.GIVEN_NAMES[0]) == sorted(pii.GIVEN_NAMES[0])


def test_surrogates_query(spark, sf_dir, docs):
    """Against what must hold of any right replacement, by patterns of the test's own."""
    found = {r.doc_id: r for r in q.op7_surrogates(spark, sf_dir).collect()}
    assert set(found) == set(docs)
    private = re.compile(r"[\w.]+@mail\w*\.\w+\.\w+|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\+1 \(\d{3}\) 555-\d{4}|\b[0-9A-Fa-f]{40}\b")
    shape = lambda t: re.sub(r"\d+", "0", t.split("@")[0])[:0] + re.sub(r"\w", "x", t)
    to, back = {}, {}
    for i, text in docs.items():
        old = private.findall(text)
        assert (found[i].n_entities > 0) == bool(old) and found[i].n_entities >= len(old)
        if not old:
            assert found[i].text == text
            continue
        rest = found[i].text
        for part in private.split(text):
            at = rest.find(part) if part else 0
            assert at >= 0
            rest = rest[at + len(part) :]
        for e in old:
            assert e not in found[i].text
        new = private.findall(found[i].text)
        for e, n in zip(old, new) if len(old) == len(new) else []:
            assert to.setdefault(e, n) == n and back.setdefault(n, e) == e
            assert "." in e and e[0].isdigit() or shape(e) == shape(n)
    assert len(to) >= 5


def test_collisions(spark):
    kind = "kind string, entity string, surrogate string"
    clash = spark.createDataFrame([("email", "a", "x"), ("email", "b", "x"), ("ip", "c", "y"), ("ip", "c", "z"), ("ip", "d", "c")], kind)
    assert {(r.side, r.value) for r in pii.collisions(clash).collect()} == {("surrogate", "x"), ("entity", "c")}
    assert [r.surrogate for r in pii.met_again(clash).collect()] == ["c"]


def test_surrogates_odd_rows(spark, monkeypatch):
    found = pii.with_surrogates(frame(spark), "key")
    assert found.columns.count("n_entities") == 1
    texts = Counter((r.doc_id, r.text) for r in found.collect())
    assert texts == Counter((i, t) for i, t, *_ in ODD)
    assert pii.checked_surrogates(frame(spark, []), "key").count() == 0
    two = frame(spark, [(1, "x a@b.co y", "a", 0), (1, "x a@b.co y", "a", 0), (2, LONG + " c@b.co", "a", 0)])
    rows = pii.checked_surrogates(two, "key").collect()
    assert len({r.text for r in rows if r.doc_id == 1}) == 1 and all(r.n_entities == 1 for r in rows)


# -- 8: mixing


def test_mixture_equals_sql(spark, sf_dir, same):
    same(q.op8_mixing(spark, sf_dir), q.OP8_SQL)


@pytest.mark.parametrize("weight", [1.0, 0.25])
def test_mixing_slices(spark, weight):
    """Slices follow the order of the keys, and none holds more than its bound (and chance) of one weight."""
    keys = spark.range(100_000).select(mixing.exponential_key(F.col("id"), F.lit(5), F.lit(weight)).alias("key"))
    rows = keys.select("key", mixing.key_slice(F.col("key"), 1024).alias("slice")).orderBy("key").collect()
    slices = [r.slice for r in rows]
    assert slices == sorted(slices)
    expected = 100_000 * len(mixing.SLICE_WEIGHTS) / 1024
    assert max(Counter(slices).values()) < expected + 6 * expected**0.5


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, None: 90}
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights = dict(zip(["a", "b", "c", None], [3, 1, 2, 3]))
    left, open_, expected = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            expected |= {s: level * weights[s] for s in open_}
            break
        expected |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert found == pytest.approx(expected)


def test_mixture_odd_rows(spark):
    found = mixing.mixture(frame(spark)).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target)
    assert mixing.mixture(frame(spark, [])).count() == 0
    assert mixing.mixture(frame(spark, [(1, None, None, 0)])).collect()[0].taken == 0


def test_heavier_documents_come_first(spark):
    rows = [(i, "w " * 10, "s", 0) for i in range(2000)] + [(-1, "x " * 20000, "t", 0), (-2, "y " * 20000, "u", 0)]
    weights = spark.createDataFrame([(i, 1.0 if i % 2 else 0.1) for i in range(2000)], "doc_id long, weight double")
    found = mixing.mixture(frame(spark, rows), weights).where("source = 's'").collect()
    epochs = min(r.taken for r in found)
    more = Counter(r.doc_id % 2 for r in found if r.taken > epochs)
    assert more[1] > 1.5 * more[0] > 0 or sum(more.values()) in (0, 2000)


def test_mixed_documents(spark):
    copies = [(50, "one two three four five", "c", 0)] * 7 + [(None, "a b c", "c", 0), (None, "d e f", "c", 0)]
    docs = frame(spark, ODD + copies)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    wanted, words = Counter(), Counter()
    for r in mixing.mixture(docs).collect():
        wanted[r.doc_id, r.source] += r.taken
    for r in mixed.collect():
        words[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == +wanted
    assert mixing.mix_documents(frame(spark, [])).count() == 0


# -- 9: licences


def brute_licences(text: str, templates: dict, threshold: float) -> list[tuple]:
    """All runs of words against all templates; then greedily the best that do not overlap."""
    words = licenses.words_of(text)
    runs = []
    for name, texts in templates.items():
        for number, template in enumerate(texts):
            grams = licenses.bigrams(licenses.words_of(template))
            for i in range(len(words)):
                best = None
                for j in range(i + 2, len(words) + 1):
                    own = licenses.bigrams(words[i:j])
                    if (words[i], words[i + 1]) in grams and (words[j - 2], words[j - 1]) in grams:
                        score = licenses.dice(own, grams)
                        if score >= threshold and (best is None or score >= best[0]):
                            best = (score, j - i)
                if best:
                    runs.append((name, number, best[0], i, best[1]))
    taken: list[tuple] = []
    for run in sorted(runs, key=lambda x: (-x[2], -x[4], x[3], x[0])):
        if all(run[3] + run[4] <= t[3] or run[3] >= t[3] + t[4] for t in taken):
            taken.append(run)
    return sorted(taken, key=lambda x: (x[3], x[0]))


def test_licences(spark, sf_dir, docs):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    found = q.op9_license_scan(spark, sf_dir).collect()
    assert {r.doc_id for r in found} == {i for i, t in docs.items() if re.search("licensed under|MIT License", t, re.I)}
    some = sorted(docs, key=lambda i: len(docs[i]))[:40]
    small = {n: t[:1] for n, t in licenses.TEMPLATES.items() if len(t[0]) < 100}
    for i in some:
        assert licenses.Scanner(small, 0.8).scan(docs[i]) == brute_licences(docs[i], small, 0.8)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert [x[0] for x in scanner.scan("Some words here.\n" + text + "\nMore words there.")] == [name]
    assert scanner.scan("He licensed the song under other terms.") == []
    for text, name in (
        ("This file is licensed under the MIT license", "MIT"),
        ("All the photos on these pages are licensed under CC BY 4.0 unless noted", "CC-BY-4.0"),
        ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ):
        assert [x[0] for x in scanner.scan(text)] == [name]
    twice = scanner.scan("Licensed under the MIT License. Then more. Released under the MIT License, and Licensed under the BSD 2-Clause License.")
    assert [x[0] for x in twice] == ["MIT", "MIT", "BSD-2-Clause"]


def test_licences_recall_on_changed_texts():
    """Templates with one word in twenty changed, inside other words, are found by name."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    draw, tried, right = random.Random(7), 0, 0
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            words = text.split()
            if len(words) < 20:
                continue
            for _ in range(5):
                changed = [w if draw.random() > 0.05 else f"x{draw.randrange(99)}" for w in words]
                tried += 1
                right += name in [x[0] for x in scanner.scan(" ".join(["aa bb cc", *changed, "dd ee"]))]
    assert tried > 50 and right / tried > 0.95


def test_licences_against_all_runs():
    draw = random.Random(7)
    small = {n: [t for t in texts if len(t) < 70] for n, texts in licenses.TEMPLATES.items()}
    units = ["Released under the MIT License", "Licensed under CC BY-NC 4.0.", "Just some words", "under the License", "x", "the MIT"]
    for _ in range(40):
        text = " ".join(draw.choice(units) for _ in range(5))
        assert licenses.Scanner(small, 0.8).scan(text) == brute_licences(text, small, 0.8)


def test_licences_odd_rows(spark):
    assert licenses.scan_licenses(frame(spark)).count() == 0
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


# -- 10: decontamination


def substring_distance(pattern: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            new[j] = min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def mutate(text: bytes, edits: int, draw: random.Random) -> bytes:
    out = bytearray(text)
    for _ in range(edits):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        if kind == 0:
            out[at] = 97 + draw.randrange(26)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, 97 + draw.randrange(26))
    return bytes(out)


def test_leaks_against_whole_alignment():
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n)).encode()
    items = [(i, say(n)) for i, n in enumerate((25, 60, 8, 5, 2, 1))]
    index = decontaminate.Index(items, 0)
    for _ in range(60):
        item, pattern = draw.choice(index.patterns)
        planted = mutate(pattern, draw.randint(0, int(0.2 * len(pattern))), draw)
        text = decontaminate.normalise(say(draw.randint(0, 12)) + b" " + planted + b" " + say(draw.randint(0, 12)))
        found = {m[1] for m in index.matches(text + bytes(240), np.array([len(text) + 240]))}
        expected = {i for i, p in index.patterns if substring_distance(p, text) <= decontaminate.edit_budget(len(p))}
        assert found == expected


def test_leaks_query(spark, sf_dir, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    plain = lambda t: decontaminate.normalise(t.encode())
    exact = {(i, k) for i, t in docs.items() for k, v in items.items() if plain(v) in plain(t)}
    found = q.op10_decontamination(spark, sf_dir).collect()
    assert exact and exact <= {(r.doc_id, r.item_id) for r in found}
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    clean = decontaminate.drop_leaked(documents, benchmark)
    assert {r.doc_id for r in clean.collect()} == set(docs) - {r.doc_id for r in found}


def test_leaks_in_blocks_and_odd_rows(spark, monkeypatch):
    texts = [("1", LONG[:300]), ("1", LONG[5000:5300]), ("2", None), ("3", "w1x1 w2x2"), ("4", LONG[600:900]), (None, LONG[600:900]), ("4", LONG[600:900])]
    items = spark.createDataFrame(texts, "item_id string, text string")
    whole = sorted(map(repr, decontaminate.find_leaks(frame(spark), items).collect()))
    rows = decontaminate.find_leaks(frame(spark), items).collect()
    assert Counter((r[0], r[1]) for r in rows) == {(d, i): n for d in (5, 6) for i, n in (("1", 2), ("4", 2), (None, 1))}
    assert all(r.edits == 0 for r in rows)
    for size in (10, 650, 1000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(map(repr, decontaminate.find_leaks(frame(spark), items).collect())) == whole
        assert {r.doc_id for r in decontaminate.drop_leaked(frame(spark), items).collect()} == {None, 1, 2, 3, 4, 7}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(frame(spark), empty).count() == 0
    assert decontaminate.drop_leaked(frame(spark), empty).count() == len(ODD)
    assert decontaminate.find_leaks(frame(spark, []), items).count() == 0


def test_short_items_are_found_if_asked_for(spark):
    docs = spark.createDataFrame([(1, "So: What is the capital  of PERU? Lima."), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "What is the capital of Peru?")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, items).count() == 0
    assert [(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs, items, least=20).collect()] == [(1, 7, 0)]
    assert [r.doc_id for r in decontaminate.drop_leaked(docs, items, 20).collect()] == [2]


def test_leaks_against_alignment_of_whole_tables(spark):
    """The query's operator against the definition: some pattern within its budget anywhere in the text."""
    draw = random.Random(9)
    say = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((12, 30, 45))]
    docs = []
    for i in range(24):
        planted = mutate(decontaminate.normalise(draw.choice(items)[1].encode()), draw.choice([0, 2, 6, 30]), draw).decode()
        docs.append((i, say(draw.randint(0, 15)) + " " + planted + " " + say(draw.randint(0, 15))))
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    expected = {
        (d, items[n][0])
        for d, t in docs
        for n, p in decontaminate.patterns([(i, x.encode()) for i, x in items], decontaminate.MIN_ITEM)
        if substring_distance(p, decontaminate.normalise(t.encode())) <= decontaminate.edit_budget(len(p))
    }
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and len(expected) > 8
