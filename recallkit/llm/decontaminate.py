"""Benchmark decontamination (operator 10): the q-gram lemma in diagonal bands.

Benchmark items become patterns of up to ``PATTERN`` bytes, cut with half a pattern of
overlap from text in lower case with single blanks.  A region of a document within
``k = ERROR_RATE * m`` edits of a pattern of ``m`` bytes shares at least ``m + 1 - Q * (k + 1)``
of its q-grams, on diagonals that span at most ``k``.  Shared q-grams are counted in bands
of ``2 * (k + 1)`` diagonals that overlap by half; a band reaching the bound is retained, and
verified by a banded alignment of the pattern with the region.

Whole documents are scanned, many at once as one array of q-gram codes.  The benchmark is a
stated query set: it goes to the executors in blocks of at most ``BLOCK_BYTES``, one after the
other; the driver holds one block, and each further block is one more scan of the documents.
An item is never split, so the rows do not depend on the size of the blocks.

Cases: null and empty texts match nothing; a very long text is one row of the scan; items of
under ``least`` bytes after normalisation say too little and are ignored, as are null texts;
item ids of any type, null included, are carried as they are; repeated rows and repeated items
(equal ids or equal texts) each give their own rows; of equally good places the first counts;
an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from recallkit.llm.common import map_arrow, slices, staged, texts_of

Q = 8
PATTERN = 120
ERROR_RATE = 0.1
MIN_ITEM = 40
BLOCK_BYTES = 2 << 20
SCAN_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22
_COUNT_BITS = 20


def normalise(text: bytes) -> bytes:
    """ASCII letters in lower case, runs of blanks as one space."""
    return b" ".join(text.lower().split())


Item = tuple[Any, bytes]


def patterns(items: list[Item], least: int) -> list[tuple[int, bytes]]:
    """Number of the item and bytes of each pattern; the last pattern of an item ends with it."""
    found = []
    for number, (_, text) in enumerate(items):
        text = normalise(text)
        if len(text) < max(Q, least):
            continue
        last = max(0, len(text) - PATTERN)
        for at in [*range(0, last, PATTERN // 2), last]:
            found.append((number, text[at : at + PATTERN]))
    return found


def edit_budget(size: int) -> int:
    """Edits allowed in a pattern of ``size`` bytes; the shared q-grams required stay positive."""
    return max(0, min(int(ERROR_RATE * size), size // Q - 1))


def codes(data: bytes) -> np.ndarray:
    """The q-gram at each position, as an integer."""
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), Q).copy().view("<u8").ravel()


def align(pattern: bytes, region: bytes, band: int) -> tuple[int, int]:
    """Least edits between the pattern and a part of the region, and where that part ends.

    Row ``i`` is computed for region offsets ``i .. i + band`` only.
    """
    text = np.frombuffer(region, np.uint8)
    width = min(band, len(text)) + 1
    lane = np.arange(width)
    far = len(pattern) + len(text) + 1
    row = np.zeros(width, np.int64)  # offset j = lane + i; the part may begin anywhere
    for i, letter in enumerate(pattern):
        # from row i to i + 1 the lanes move one letter on: same lane is a substitution or match
        j = lane + i
        inside = j < len(text)
        same = np.where(inside, text[np.minimum(j, len(text) - 1)] != letter, 1) if len(text) else 1
        step = np.minimum(np.where(inside, row + same, far), np.append(row[1:], far) + 1)
        row = np.minimum.accumulate(step - lane) + lane
        row[lane + i + 1 > len(text)] = far
    best = int(row.argmin())
    return int(row[best]), min(len(text), best + len(pattern))


class Index:
    """Q-grams of the patterns: a bit table, sorted codes and their places."""

    def __init__(self, items: list[Item], least: int = MIN_ITEM):
        self.names = [name for name, _ in items]
        self.patterns = patterns(items, least)
        grams = [codes(p) for _, p in self.patterns]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.codes = np.unique(flat)
        self.starts = np.searchsorted(flat[order], self.codes)
        self.counts = np.diff(np.append(self.starts, len(flat)))
        self.owner, self.place = owner[order], place[order]
        self.sizes = np.array([len(p) for _, p in self.patterns], np.int64)
        self.budget = np.array([edit_budget(n) for n in self.sizes], np.int64)
        self.needed = self.sizes + 1 - Q * (self.budget + 1)
        self.table = np.zeros(1 << _TABLE_BITS, np.bool_)
        self.table[self.slot(self.codes)] = True

    @staticmethod
    def slot(values: np.ndarray) -> np.ndarray:
        return (values * _MIX) >> np.uint64(64 - _TABLE_BITS)

    def retained(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """Pattern, first and last diagonal of each band of ``data`` that reaches the bound."""
        if len(data) < Q or not len(self.codes):
            return
        values = codes(data)
        at = np.flatnonzero(self.table[self.slot(values)])
        found = np.minimum(np.searchsorted(self.codes, values[at]), len(self.codes) - 1)
        real = self.codes[found] == values[at]
        at, found = at[real], found[real]
        n = self.counts[found]
        take = np.repeat(self.starts[found] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        owner, place = self.owner[take], self.place[take]
        diagonal = np.repeat(at, n) - place
        half, needed = self.budget[owner] + 1, self.needed[owner]
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            key = (owner << 36) + (band + (1 << 20))
            # hashed counts are upper bounds: most pairs end here
            slot = ((key.view(np.uint64) * _MIX) >> np.uint64(64 - _COUNT_BITS)).view(np.int64)
            maybe = np.bincount(slot, minlength=1 << _COUNT_BITS)[slot] >= needed
            # each q-gram of the pattern counts once, however often the text repeats it
            pairs = np.unique(key[maybe] * PATTERN + place[maybe]) // PATTERN
            keys, hits = np.unique(pairs, return_counts=True)
            for k in keys[hits >= self.needed[keys >> 36]].tolist():
                p, b = k >> 36, (k & ((1 << 36) - 1)) - (1 << 20)
                h = int(self.budget[p]) + 1
                yield p, b * 2 * h - shift * h, b * 2 * h - shift * h + 2 * h - 1

    def matches(self, data: bytes, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Text number, item number, edits and place of the best match of each item in each text.

        ``data`` is texts joined by blocks of zero bytes; text ``i`` ends at ``ends[i]``.
        """
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for p, low, high in self.retained(data):
            item, pattern = self.patterns[p]
            k = int(self.budget[p])
            if high < -k:  # over k letters of the pattern would lie before the text
                continue
            start = low - k
            number = int(np.searchsorted(ends, max(low, 0) + len(pattern) // 2))
            if number >= len(ends):
                continue
            # before the first letter, letters that match none
            region = b"\xff" * -min(start, 0) + data[max(start, 0) : high + len(pattern) + k + 1]
            exact = region.find(pattern)
            if exact >= 0:
                edits, end = 0, exact + len(pattern)
            else:
                edits, end = align(pattern, region, high + k + 1 - start)
            if edits <= k:
                found = (edits, start + end - len(pattern), start + end)
                if found < best.get((number, item), (k + 1,)):
                    best[number, item] = found
        return [(number, item, *found) for (number, item), found in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """The benchmark's items in blocks of at most ``BLOCK_BYTES`` (or one item), one at a time."""
    rows = benchmark.select(F.col(f"`{id_col}`").alias("i"), F.encode(F.col(f"`{text_col}`"), "utf-8").alias("t"))
    block, size = [], 0
    for row in rows.where("t IS NOT NULL").toLocalIterator():
        if block and size + len(row["t"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["i"], bytes(row["t"])))
        size += len(row["t"])
    yield block


def _joined(batch_texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """First row and normalised texts of runs of about ``SCAN_BYTES``."""
    first, held, size = 0, [], 0
    for i, text in enumerate(batch_texts):
        held.append(normalise(text))
        size += len(held[-1]) + 2 * PATTERN
        if size >= SCAN_BYTES or i + 1 == len(batch_texts):
            yield first, held
            first, held, size = i + 1, [], 0


def _matches(index: Index, texts: list[bytes]) -> tuple[list[tuple], np.ndarray]:
    """Matches of texts scanned as one, and where each text begins."""
    gap = bytes(2 * PATTERN)
    ends = np.cumsum([len(t) + len(gap) for t in texts])
    return index.matches(gap.join([*texts, b""]), ends), np.append(0, ends)


def _scan(docs: DataFrame, items: list[Item], item_type: T.DataType, least: int) -> DataFrame:
    """Matches of one block of items; ``docs`` has ``doc_id`` and ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", item_type)])
    for name, kind in (("edits", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType())):
        schema = schema.add(name, kind)
    item_kind = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, least)
        for batch in slices(batches, 1):
            for first, texts in _joined(texts_of(batch.column(1))):
                found, begins = _matches(index, texts)
                rows = pa.array([first + n for n, *_ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        pa.array([index.names[item] for _, item, *_ in found], item_kind),
                        pa.array([edits for _, _, edits, *_ in found], pa.int32()),
                        pa.array([max(0, a - int(begins[n])) for n, _, _, a, _ in found], pa.int64()),
                        pa.array([b - int(begins[n]) for n, _, _, _, b in found], pa.int64()),
                    ],
                    names=schema.fieldNames(),
                )

    return docs.transform(map_arrow, run, schema)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = MIN_ITEM,
) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: the best match of each item in each document.

    Places count bytes of the normalised text.  Items of under ``least`` bytes (``Q`` at the least) are
    not looked for: with a small value short questions are found, and so are common phrases.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = benchmark.schema[item_col].dataType
    parts: list[DataFrame] = []
    for items in blocks(benchmark, item_col, item_text_col):
        if parts:
            parts[-1] = staged(parts[-1], "leaks")  # a block is done before the next is fetched
        parts.append(_scan(source, items, kind, least))
    return reduce(DataFrame.unionByName, parts)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, least: int = MIN_ITEM) -> DataFrame:
    """The rows of ``docs`` without a match, columns unchanged; ``least`` as in :func:`find_leaks`.

    A scan without a shuffle while the benchmark is one block; each further block reads what
    the ones before it have kept.
    """
    at = docs.columns.index("text")

    def without(rows: DataFrame, items: list[Item]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, least)
            for batch in slices(batches, at):
                clean = np.ones(batch.num_rows, bool)
                for first, texts in _joined(texts_of(batch.column(at))):
                    for number, *_ in _matches(index, texts)[0]:
                        clean[first + number] = False
                yield batch.filter(pa.array(clean))

        return rows.transform(map_arrow, run, rows.schema)

    kept = None
    for items in blocks(benchmark, "item_id", "text"):
        kept = without(docs, items) if kept is None else without(staged(kept, "unleaked"), items)
    return kept
