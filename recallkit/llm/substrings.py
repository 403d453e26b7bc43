"""Substring dedup (operator 6): suffix automata of reference shards.

A word goes if a window of ``WINDOW`` words over it also starts in a document with a
smaller id.  An automaton of every earlier document, streamed against all later ones,
grows with the square of the corpus; here the reference is cut into shards that hold all
a window can match:

* The *anchor* of a window is its smallest word-gram by hash, the leftmost of equals: it
  depends on the window's words only.  A run of windows with one anchor is a *segment*;
  equal windows always lie in segments of the same anchor.
* Anchors met in one document only are dropped.  Equal segments are one reference entry
  with the smallest id that has it; a later document with that segment matches it in full.
* Where the entries of an anchor differ, they are a shard: in ascending order of id each is
  streamed through a suffix automaton of the entries with smaller ids, whose matching
  statistic is the longest match ending at each word; where it reaches ``WINDOW`` the
  maximal span is removed.  Shards meet their automaton by a shuffle on the anchor; it is
  not broadcast, since the reference has no proven bound.
* An anchor with over ``SHARD_MAX`` differing entries (a phrase of very many documents) is
  split further, by the whole window: least id by window, then the windows of entries with
  a larger id are removed.  The outcome is the same and no task holds the anchor's entries.

Joins on anchors, entries and windows deal the few heavy keys by broadcast, the others by a
shuffle (:func:`~recallkit.llm.common.join_heavy`).  Segments and windows are named by 128 bits
of independent hashes, which are not compared word by word again.

Cases: null or short texts have no window and stay; a very long text is many segments, dealt
like those of any others; a null id is neither smaller nor
larger, so that row stays and removes nothing; rows that repeat an id do not remove each
other's text; an empty table gives an empty result; columns besides id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.llm.common import add_columns, discard, join_heavy, map_arrow, slices, staged, texts_of

WINDOW = 50
GRAM = 8
SHARD_MAX = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to its 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def segments(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word and number of words of each segment of a document."""
    n = len(words)
    if n < window:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    gram = h[: n - GRAM + 1].copy()
    for j in range(1, GRAM):
        gram = gram * _BASE + h[j : n - GRAM + 1 + j]
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    at = np.lib.stride_tricks.sliding_window_view(gram, window - GRAM + 1).argmin(axis=1) + np.arange(n - window + 1)
    begin = np.flatnonzero(np.diff(at, prepend=-1))
    end = np.append(begin[1:], len(at))
    return gram[at[begin]], begin, end - begin + window - 1


class SuffixAutomaton:
    """Suffix automaton of the word sequences added to it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def _extend(self, word) -> None:
        now = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[self.last] + 1)
        p = self.last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[now] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.link.append(self.link[q])
                self.length.append(self.length[p] + 1)
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = self.link[now] = copy
        self.last = now

    def add(self, words: list[bytes]) -> None:
        """Add a sequence; a separator of its own keeps matches within sequences."""
        for word in words:
            self._extend(word)
        self._extend(len(self.next))

    def spans(self, words: list[bytes], window: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by matches of at least ``window`` words."""
        found: list[tuple[int, int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= window:
                if found and i - window < found[-1][1]:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((i - window + 1, i + 1))
        return found


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, mark, packed``: id, hash of the words, and the words compressed for shuffles."""

    def compute(texts: list[bytes]) -> list[pa.Array]:
        press = zstandard.ZstdCompressor(level=1)
        joined = [b" ".join(t.split()) for t in texts]
        return [pa.array([_mark(x) for x in joined], pa.int64()), pa.array(list(map(press.compress, joined)), pa.binary())]

    added = T.StructType([T.StructField("mark", T.LongType()), T.StructField("packed", T.BinaryType())])
    return add_columns(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", added, compute, ["doc_id"])


def _mark(joined: bytes) -> int:
    return _signed(xxhash.xxh64_intdigest(joined, 7))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, mark, anchor, entry, first, size`` of every segment."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, marks, anchors, entries, firsts, sizes, rows = [], [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                words = text.split()
                anchor, first, size = segments(words, window)
                if not len(anchor):
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.append(0, ends[:-1] + 1)
                a, b = starts[first].tolist(), ends[first + size - 1].tolist()
                entries += [xxhash.xxh64_intdigest(joined[x:y], 1) for x, y in zip(a, b)]
                anchors.append(anchor)
                firsts.append(first)
                sizes.append(size)
                rows.append(len(anchor))
                ids.append(i)
                marks.append(_mark(joined))
            none = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.array(ids, np.int64), rows))),
                    pa.array(np.repeat(np.array(marks, np.int64), rows)),
                    pa.array(np.concatenate(anchors or [np.empty(0, np.uint64)]).view(np.int64)),
                    pa.array(np.array(entries, np.uint64).view(np.int64)),
                    pa.array(np.concatenate(firsts or none).astype(np.int32)),
                    pa.array(np.concatenate(sizes or none).astype(np.int32)),
                ],
                names=["doc_id", "mark", "anchor", "entry", "first", "size"],
            )

    schema = f"doc_id {kind.simpleString()}, mark bigint, anchor bigint, entry bigint, first int, size int"
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").transform(map_arrow, run, schema)


def _contents(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``anchor, entry, least, n, words`` from the documents that hold the entries."""
    by_doc = wanted.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(
        F.collect_list(F.struct("anchor", "entry", "first", "size", "n")).alias("parts")
    )
    joined = packed.join(by_doc, (F.col("doc_id") == F.col("d")) & (F.col("mark") == F.col("m")))
    kind = packed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, packed, parts in zip(*(c.to_pylist() for c in batch.columns)):
                words = press.decompress(packed).split()
                for p in parts:
                    row = (p["anchor"], p["entry"], doc_id, p["n"], b" ".join(words[p["first"] : p["first"] + p["size"]]))
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), batch.column(0).type, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=["anchor", "entry", "least", "n", "words"]
            )

    schema = f"anchor bigint, entry bigint, least {kind}, n bigint, words binary"
    return joined.select("doc_id", "packed", "parts").transform(map_arrow, run, schema).dropDuplicates(["anchor", "entry"])


def _by_automaton(contents: DataFrame, window: int) -> DataFrame:
    """``anchor, entry, begin, end``: spans of entries that entries with smaller ids match."""
    shards = contents.groupBy("anchor").agg(F.collect_list(F.struct("least", "entry", "words")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, held in zip(*(c.to_pylist() for c in batch.columns)):
                machine, waiting, now = SuffixAutomaton(), [], None
                for x in sorted(held, key=lambda x: x["least"]):
                    if x["least"] != now:
                        for words in waiting:
                            machine.add(words)
                        waiting, now = [], x["least"]
                    words = x["words"].split()
                    out += [(anchor, x["entry"], a, b) for a, b in machine.spans(words, window)]
                    waiting.append(words)
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                names=["anchor", "entry", "begin", "end"],
            )

    return shards.transform(map_arrow, run, "anchor bigint, entry bigint, begin int, end int")


def _by_window(contents: DataFrame, window: int) -> DataFrame:
    """As :func:`_by_automaton`, for anchors with too many entries for one shard."""
    kind = contents.schema["least"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for anchor, entry, least, joined in zip(*(c.to_pylist() for c in batch.columns)):
                words = joined.split()
                for i in range(len(words) - window + 1):
                    name = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + window]))
                    low = _signed(name & (1 << 64) - 1)
                    for column, value in zip(rows, (anchor, entry, least, i, _signed(name >> 64), low)):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), batch.column(2).type, pa.int32(), pa.int64(), pa.int64()]
            names = ["anchor", "entry", "least", "begin", "w1", "w2"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    schema = f"anchor bigint, entry bigint, least {kind}, begin int, w1 bigint, w2 bigint"
    windows = staged(contents.select("anchor", "entry", "least", "words").transform(map_arrow, run, schema), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("least").alias("earliest"), F.count("*").alias("n"))
    late = join_heavy(windows, staged(first.where("n > 1"), "firsts"), ["w1", "w2"], "n").where("earliest < least")
    return late.select("anchor", "entry", "begin", (F.col("begin") + window).alias("end"))


def repeated_spans(docs: DataFrame, packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, mark, spans``: word ranges to remove, of documents that have any."""
    runs = staged(_runs(docs, window), "runs")
    met = runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    shared = staged(met.where("a < b").select("anchor", "n"), "shared")
    every, runs = runs, staged(join_heavy(runs, shared, ["anchor"], "n").drop("n"), "shared-runs")
    discard(every)
    at = F.min(F.struct("doc_id", "mark", "first", "size")).alias("at")
    entries = staged(runs.groupBy("anchor", "entry").agg(at, F.count("*").alias("holders")), "anchored")
    differing = staged(entries.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "differing")
    wanted = join_heavy(entries, differing, ["anchor"], "n").select("anchor", "entry", "at.*", "n")
    contents = staged(_contents(packed, wanted), "entries")
    parts = _by_automaton(contents.where(F.col("n") <= SHARD_MAX), window).unionByName(
        _by_window(contents.where(F.col("n") > SHARD_MAX), window)
    )
    parts = parts.groupBy("anchor", "entry").agg(F.collect_list(F.struct("begin", "end")).alias("parts"))
    least = entries.select("anchor", "entry", "holders", F.col("at.doc_id").alias("least"))
    known = staged(least.join(parts, ["anchor", "entry"], "left"), "known")
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("size").alias("end")))
    # a document that is not the entry's first has all its windows in the first
    removed = join_heavy(runs, known, ["anchor", "entry"], "holders").withColumn(
        "parts", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(F.col("parts"))
    )
    placed = removed.where("parts IS NOT NULL").select(
        "doc_id",
        "mark",
        F.transform(
            "parts",
            lambda p: F.struct((p["begin"] + F.col("first")).alias("begin"), (p["end"] + F.col("first")).alias("end")),
        ).alias("parts"),
    )
    return placed.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("parts")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` of each row, the kept words joined by one space."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    packed = pack(source, "doc_id", "text")
    spans = repeated_spans(source, packed, window)
    spans = spans.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "spans")
    joined = packed.join(spans, (F.col("doc_id") == F.col("d")) & (F.col("mark") == F.col("m")), "left")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, removed, texts = [], [], []
            for packed, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = press.decompress(packed)
                n = text.count(b" ") + 1 if text else 0
                gone = 0
                if found:
                    keep = np.ones(n, bool)
                    for span in found:
                        keep[span["begin"] : span["end"]] = False
                    words = text.split()
                    text = b" ".join([words[i] for i in np.flatnonzero(keep)])
                    gone = n - int(keep.sum())
                counts.append(n)
                removed.append(gone)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return joined.select("doc_id", "packed", "spans").transform(
        map_arrow,
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, text string"
    )
