"""Token-ID output (operator 1): token ids in Parquet list columns.

The files hold one row a document: ``doc_id``, ``n_tokens`` and ``ids``, in ascending id
order within and across files (``part-00000`` first).  Row groups are bounded by
``ROW_GROUP_BYTES``, pages by ``PAGE_BYTES`` and ``PAGE_ROWS``; Parquet's column and offset
indexes let a reader skip pages by ``doc_id``, and column pruning reads lengths without
ids.  ``encoding`` chooses dictionary pages (default: token ids are a skewed vocabulary)
or delta binary packing.

Text is encoded after the shuffle that orders it: text is smaller than its ids there, and
a lost executor re-encodes only its own partitions.  Rows of one id are dealt by the hash of
their text as well, so no id has to fit in one task.  A tokenizer with byte-level
pre-tokenisation is run on the pre-tokens a worker has not met yet; ids of known ones come
from a cache bounded in bytes.  Other tokenizers, and texts that hold one of the
tokenizer's added tokens, are encoded whole by the library.

The cache is a hash table in arrays (:class:`IdTable`): strings are known by 64-bit hashes, so
a million of them take some 60 MB, and a batch of texts is looked up in a few array steps.

Cases: null and empty texts have the end id alone; a very long text is encoded whole, as one
row; repeated rows are encoded each, rows of one id in the order of a hash of their texts;
rows with a null id come first; an empty table gives an empty result; other columns are not
carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallkit.llm.common import give_back, map_arrow, slices, stage_path

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000
#: Slots of a worker's table (16 bytes each) and ids it holds (4 bytes each) before it starts anew.
TABLE_BITS = 21
POOL_IDS = 6_000_000
#: Strings looked up at once.
CHUNK = 100_000

#: The byte-level pre-tokenisation pattern (a fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class IdTable:
    """Token ids by the 64-bit hash of a string: open addressing over arrays, bounded in size.

    Two strings of one hash would share ids; with a million entries that befalls one new
    string in 10**13.
    """

    def __init__(self, bits: int, pool: int):
        self.mask, self.limit, self.pool_limit = np.uint64((1 << bits) - 1), (1 << bits) * 6 // 10, pool
        self.reset()

    def reset(self) -> None:
        size = int(self.mask) + 1
        self.keys = np.zeros(size, np.uint64)
        self.size = np.zeros(size, np.int32)  # number of ids; -1 for strings that have none
        self.start = np.zeros(size, np.uint32)
        self.pool = np.empty(1 << 16, np.uint32)
        self.held = self.used = 0

    def make_room(self, strings: int) -> None:
        if self.held + strings > self.limit or self.used > self.pool_limit:
            self.reset()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not held."""
        found = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            found[left[hit]] = slot[hit]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return found

    def insert(self, keys: np.ndarray, rows: list[np.ndarray | None]) -> None:
        """Add distinct keys that are not held."""
        sizes = np.array([-1 if r is None else len(r) for r in rows], np.int32)
        new = np.concatenate([r for r in rows if r is not None] or [np.empty(0, np.uint32)])
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + len(new), np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        starts = self.used + np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        self.used += len(new)
        self.held += len(keys)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of keys that want one slot the last gets it
            won = self.keys[slot] == keys[left]
            self.start[slot[won]], self.size[slot[won]] = starts[left[won]], sizes[left[won]]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) & self.mask

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of all slots in turn."""
        n = np.maximum(self.size[slots], 0).astype(np.int64)
        before = np.cumsum(n) - n
        return self.pool[np.repeat(self.start[slots].astype(np.int64) - before, n) + np.arange(n.sum())]


class Encoder:
    """Token ids of texts as unsigned 32-bit integers, without the end id."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        pre = self.tokenizer.pre_tokenizer
        self.piecewise = (
            self.tokenizer.normalizer is None
            and isinstance(pre, pre_tokenizers.ByteLevel)
            and not pre.add_prefix_space
            and getattr(pre, "use_regex", True)
        )
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pretokens = regex.compile(PRETOKEN)
        self.letters = _byte_letters()
        self.table = IdTable(TABLE_BITS, POOL_IDS)

    def _pretoken(self, text: str) -> list[int]:
        """Ids of one pre-token, by the vocabulary's merges."""
        if text.isascii() and text.isprintable():
            letters = text.replace(" ", self.letters[32])
        else:
            letters = text.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def _piece(self, piece: str) -> list[int] | None:
        """Ids of a blank and what follows it up to the next; None if a blank or nothing follows."""
        if not piece or piece[0].isspace():
            return None
        if piece.isalpha():
            return self._pretoken(" " + piece)
        return [i for t in self.pretokens.findall(" " + piece) for i in self._pretoken(t)]

    def _ids(self, strings: list[str], work_out, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in turn, and the number of each string (-1: ``work_out`` gave None)."""
        ids, sizes = [], []
        for at in range(0, len(strings), CHUNK):
            part = strings[at : at + CHUNK]
            self.table.make_room(len(part))
            keys = np.fromiter(map(hash, part), np.int64, len(part)).view(np.uint64) ^ np.uint64(salt)
            keys[keys == 0] = 1
            slots = self.table.find(keys)
            missing = np.flatnonzero(slots < 0)
            if len(missing):
                new, first = np.unique(keys[missing], return_index=True)
                rows = [work_out(part[i]) for i in missing[first].tolist()]
                self.table.insert(new, [None if r is None else np.array(r, np.uint32) for r in rows])
                slots[missing] = self.table.find(keys[missing])
            ids.append(self.table.gather(slots))
            sizes.append(self.table.size[slots])
        return np.concatenate(ids or [np.empty(0, np.uint32)]), np.concatenate(sizes or [np.empty(0, np.int32)])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.piecewise:
            return [self._whole(t) for t in texts]
        out: list = [self._whole(t) if any(a in t for a in self.added) else None for t in texts]
        # No pre-token spans the start of a single blank that a non-blank follows: such texts are cut at blanks.
        left = [i for i, found in enumerate(out) if found is None]
        cut = [texts[i].split(" ") for i in left]
        heads = [self.pretokens.findall(pieces[0]) for pieces in cut]
        tails = self._split([pieces[1:] for pieces in cut], self._piece, 0)
        odd = [k for k, tail in enumerate(tails) if tail is None]
        for k in odd:
            heads[k] = self.pretokens.findall(texts[left[k]])
        for i, head, tail in zip(left, self._split(heads, self._pretoken, 1 << 40), tails):
            out[i] = head if tail is None else np.concatenate([head, tail])
        return out

    def _split(self, groups: list[list[str]], work_out, salt: int) -> list[np.ndarray | None]:
        """The ids of each group of strings; None for a group with a string that has none."""
        ids, sizes = self._ids([x for group in groups for x in group], work_out, salt)
        ends = np.cumsum([0, *map(len, groups)])
        total = np.append(0, np.cumsum(np.maximum(sizes, 0)))
        bad = np.append(0, np.cumsum(sizes < 0))
        return [
            None if bad[b] > bad[a] else ids[total[a] : total[b]] for a, b in zip(ends.tolist(), ends[1:].tolist())
        ]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its caches last across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row, in the order of the rows; the end id is last."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(vocabulary)
        end = np.array([END_ID], np.uint32)

        def packed(doc_ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
            counts = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
            ends = np.cumsum(counts)
            ids = np.concatenate([x for row in rows for x in (row, end)]).view(np.int32)
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), lists], names=["doc_id", "n_tokens", "ids"])

        for batch in slices(batches, 1):
            yield packed(batch.column(0), one.encode([t or "" for t in batch.column(1).to_pylist()]))

    return source.transform(map_arrow, run, f"doc_id {kind}, n_tokens bigint, ids array<int>")


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    encoding: str = "dictionary",
) -> None:
    """Encode ``docs`` and write the token files in ascending id order."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("text")
    ordered = source.repartitionByRange(files, "doc_id", spread).sortWithinPartitions("doc_id", spread)
    delta = encoding == "delta"
    (
        encode(ordered, vocabulary)
        .write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", str(not delta).lower())
        .option("parquet.writer.version", "PARQUET_2_0" if delta else "PARQUET_1_0")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Token files by column; a filter on ``doc_id`` reads matching pages only."""
    return spark.read.parquet(path).select(*columns)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from token files.

    ``start`` counts the ids of all earlier documents: totals of files, in the order of the
    numbers in their names, then of rows within a file.  Only file totals meet in one window.
    """
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    rows = spark.read.parquet(path).select(
        "doc_id", file.alias("file"), F.col("_metadata.row_index").alias("row"), "n_tokens", "ids"
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            offsets = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)))
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + [pa.array(crc, pa.int64())],
                names=["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )
            give_back()

    hashed = rows.transform(map_arrow, run, f"doc_id {kind}, file bigint, row bigint, n_tokens bigint, ids_crc32 bigint")
    lengths = spark.read.parquet(path).select(file.alias("f"), "n_tokens")
    earlier_files = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        lengths.groupBy("f")
        .agg(F.sum("n_tokens").alias("total"))
        .select("f", F.coalesce(F.sum("total").over(earlier_files), F.lit(0)).alias("offset"))
    )
    earlier_rows = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        hashed.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier_rows), F.lit(0)))
        .join(offsets, F.col("file") == F.col("f"))
        .select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokenized(docs: DataFrame, vocabulary: str, encoding: str = "dictionary") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return their digest."""
    spark = docs.sparkSession
    path = stage_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, encoding=encoding)
    return digest(spark, path)
