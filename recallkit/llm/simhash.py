"""SimHash near-dedup (operator 5): a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes.  Two that differ in at most three
bits share at least five positional bytes, and of five shared bytes at least three lie in
the same half of the fingerprint.  So the index posts every distinct fingerprint under its
eight byte triples (four in each half), which loses no pair.  Within a posting list the
shared positional bytes of a pair are tallied, pairs with the guaranteed minimum of five
are retained, and these are verified bit by bit.

A posting list of over ``LIST_MAX`` fingerprints is split by two more of its bytes (of the
five remaining bytes at least two are shared, so again no pair is lost).  A list that fixes
five bytes has at most 2**24 members whatever the input.  Lists of over ``SCAN_MAX`` members
find the candidates of each by its flipped bits, tally their shared bytes and verify them like
any other.  A list emits a spanning forest of its links, never all pairs, so links grow with
the fingerprints.  Posting under single bytes would put 1/256 of all fingerprints into each
list, which no task could hold; triples keep the guarantee and the tally.

Cases: null and wordless texts have fingerprint zero and are linked like any other; texts
of one or two words are one shingle; very long texts are hashed whole, in steps; repeated
rows share a component; rows with a null id take part (the component of null ids alone is
null); empty table, empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.llm.common import add_columns, join_heavy, map_arrow, staged
from recallkit.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
LIST_MAX = 1024
#: Lists above this look neighbours up by flipped bits instead of scanning.
SCAN_MAX = 8192
#: Parts in which a crowded list is dealt; crowded lists are at most one in LIST_MAX postings.
SALTS = 32
#: Byte positions of an index key: any five of the eight contain one of these triples.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64
        )
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long, beside the columns in ``keep``."""

    def compute(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    added = T.StructType([T.StructField("fp", T.LongType())])
    return add_columns(docs, text_col, added, compute, [id_col, *(keep or [])]).withColumnRenamed(id_col, "doc_id")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest among distinct fingerprints at ``MAX_BITS`` bits or fewer."""
    if len(values) > SCAN_MAX:
        return _forest_by_flips(np.sort(values))
    links, left = [], values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            differ = left ^ one
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = shared >= MIN_SHARED
            near[near] = np.bitwise_count(differ[near]) <= MAX_BITS
            if near.any():
                links += [(int(one), int(x)) for x in left[near]]
                queue += list(left[near])
                left = left[~near]
    return links


def _forest_by_flips(values: np.ndarray) -> list[tuple[int, int]]:
    """As :func:`forest` for a list whose members agree in five bytes: 24 free bits."""
    spread = int(np.bitwise_or.reduce(values ^ values[0]))
    free = [1 << b for b in range(64) if spread >> b & 1]
    root = np.arange(len(values))
    for at, hit in _flipped(values, free):
        np.minimum.at(root, np.flatnonzero(hit), at[hit])
    # the smallest neighbour links most members; the rest of the links come from a sweep over roots
    links = [(int(values[i]), int(values[r])) for i, r in enumerate(root) if r != i]
    for at, hit in _flipped(values, free):
        hit = hit & (root != root[at])
        ends = np.unique(np.stack([root[hit], root[at[hit]]], 1), axis=0)
        links += [(int(values[a]), int(values[b])) for a, b in ends if a < b]
    return links


def _flipped(values: np.ndarray, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each choice of bits: where each value with these bits flipped would stand, and whether it does."""
    for n in range(1, MAX_BITS + 1):
        for chosen in combinations(free, n):
            other = values ^ np.uint64(sum(chosen))
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = values[at] == other
            shared = ((values[at] ^ values)[hit].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            hit[hit] = shared >= MIN_SHARED
            yield at, hit


def _key(number: int, positions: tuple[int, ...]) -> F.Column:
    """Key ``number`` of a fingerprint: its bytes at ``positions`` and the number itself."""
    mask = sum(0xFF << 8 * p for p in positions)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.struct(F.lit(number).alias("k"), F.col("fp").bitwiseAND(F.lit(signed)).alias("v"))


def links(prints: DataFrame) -> DataFrame:
    """``x, y``: fingerprint links of a spanning forest; ``prints`` has distinct ``fp``."""
    posted = prints.select("fp", F.explode(F.array(*[_key(i, t) for i, t in enumerate(TRIPLES)])).alias("key"))
    posted = posted.select("fp", "key.k", "key.v")
    # a crowded list is dealt over SALTS tasks when its members learn that it is
    sizes = posted.groupBy("k", "v").agg(F.count("*").alias("n"))
    crowded = sizes.where(F.col("n") > LIST_MAX).select(
        "k", "v", F.lit(True).alias("crowded"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salted = posted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    listed = salted.join(crowded, ["k", "v", "salt"], "left")
    small = listed.where("crowded IS NULL").select("k", "v", "fp")
    finer = []
    for i, triple in enumerate(TRIPLES):
        rest = [p for p in range(8) if p not in triple]
        for j, pair in enumerate(combinations(rest, 2)):
            finer.append((i, _key(len(TRIPLES) + 100 * i + j, triple + pair)))
    by_triple = F.lit(None)
    for i in range(len(TRIPLES)):
        by_triple = F.when(F.col("k") == i, F.array(*[key for k, key in finer if k == i])).otherwise(by_triple)
    large = listed.where("crowded").select("fp", F.explode(by_triple).alias("key"))
    large = large.select("key.k", "key.v", "fp")
    lists = small.unionByName(large).groupBy("k", "v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = column.offsets.to_numpy()
            found = [link for a, b in zip(at, at[1:]) for link in forest(values[a:b])]
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["x", "y"])

    return lists.select("fps").transform(map_arrow, run, "x bigint, y bigint").distinct()


def roots(prints: DataFrame) -> DataFrame:
    """``fp, root`` of every different fingerprint: the smallest one it reaches."""
    distinct = prints.select("fp").distinct()
    found = components(links(distinct), "x", "y").withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = staged(groups.join(roots(prints), "fp"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = staged(join_heavy(rooted, least, ["root"], "m").select("fp", "component_id", "n"), "named")
    return join_heavy(prints, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def hex16(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group; columns unchanged.

    The row of the smallest ``doc_id`` stays (rows without an id come last), of rows that
    repeat an id the one with the smallest hash of its text; rows equal in both are told apart
    by a hash of all their columns, and of equal rows one stays.
    """
    mark = F.xxhash64(F.col("text").cast("string"))
    prints = staged(fingerprints(docs.select("doc_id", "text", mark.alias("mark")), keep=["mark"]), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    groups = prints.groupBy("fp").agg(F.min(order).alias("first"))
    firsts = groups.join(roots(prints), "fp").groupBy("root").agg(F.min("first").alias("first"))
    firsts = firsts.select(F.col("first.doc_id").alias("__id"), F.col("first.mark").alias("__mark"))
    marked = docs.withColumn("__own", mark)
    kept = marked.join(firsts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")))
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.groupBy("__id", "__mark").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), every).alias("row"))
    return one.select("row.*")
