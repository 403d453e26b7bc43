"""Quality rules (operator 3): compression bands.

Two base rules reject a text of under 20 words, and one in which over 30 % of the words
stand in 8-word windows that occur more than once.  What passes is held against
compression bands: the zstandard ratio (compressed size over raw size) of the whole
document, and of each fixed chunk of ``CHUNK`` bytes, must lie between a low limit
(below it the text is repetitive) and a high one (above it, incompressible noise).
Short texts compress worse than long ones, so both limits are functions of the length
in bytes, interpolated between the points of a band table on the logarithm of the length.

``BANDS`` are limits for any text: prose, tables and source code pass, pages of one repeated
line and random or encoded bytes do not.  :func:`fit_bands` narrows them to a corpus: the
limits of each power of two of length are quantiles over all labelled good documents and their
chunks; lengths with too few of them keep the general limits.

Cases: a null or empty text has no words and fails the base rules; a very long text is cut
into chunks like any other, its last chunk joined to the one before if it is under a quarter
of ``CHUNK``; repeated rows and ties are judged one by one; an empty table gives an empty
result, and labels without good documents leave ``BANDS``; columns whose names clash with
the measures are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.llm.common import add_columns, filter_rows, map_arrow, slices, texts_of
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
LEVEL = 3
CHUNK = 4096
Bands = tuple[tuple[float, float, float], ...]
#: (bytes, lowest ratio, highest ratio) of text of any kind at zstandard level 3.
BANDS: Bands = (
    (64, 0.45, 1.25),
    (128, 0.38, 1.06),
    (256, 0.30, 0.96),
    (512, 0.24, 0.87),
    (1024, 0.20, 0.80),
    (4096, 0.15, 0.75),
    (16384, 0.12, 0.73),
    (65536, 0.10, 0.72),
)
#: What limits leave out at either end, and to how many parts of one they are worked out.
STEPS = 10_000
TAIL = 0.003
MARGIN = 0.015
MIN_FIT = 30
#: A document goes if over this share of its chunks is outside the band.
MAX_CHUNK_SHARE = 0.5

MEASURES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("chunks_out", T.LongType()),
        T.StructField("kept", T.BooleanType()),
    ]
)
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of eight occurring at least twice.

    Windows get exact ranks by doubling: ranks of words, then of pairs, fours and eights.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(known) == n:
        return 0
    rank = np.fromiter(map(known.__getitem__, words), np.int64, n)
    for step in (1, 2, 4):
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        if int(rank.max()) + 1 == len(rank):
            return 0
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines holding a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return len(lines) - len(set(lines))


def band(size: int, bands: Bands = BANDS) -> tuple[float, float]:
    """Lowest and highest acceptable ratio of a text of so many bytes."""
    at = np.log2([b[0] for b in bands])
    x = np.log2(max(size, 1))
    return float(np.interp(x, at, [b[1] for b in bands])), float(np.interp(x, at, [b[2] for b in bands]))


def chunks_of(text: bytes) -> list[bytes]:
    """Fixed chunks; a last one under a quarter of ``CHUNK`` is part of the one before."""
    starts = list(range(0, len(text), CHUNK))
    if len(starts) > 1 and len(text) - starts[-1] < CHUNK // 4:
        starts.pop()
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def compression_verdict(
    text: bytes, press: zstandard.ZstdCompressor, bands: Bands = BANDS
) -> tuple[float, int, bool]:
    """Ratio of the whole, chunks outside their band, and whether the text is accepted."""
    ratio = len(press.compress(text)) / len(text)
    low, high = band(len(text), bands)
    chunks = chunks_of(text)
    if len(chunks) == 1:
        return ratio, int(not low <= ratio <= high), low <= ratio <= high
    out = 0
    for chunk in chunks:
        c_low, c_high = band(len(chunk), bands)
        out += not c_low <= len(press.compress(chunk)) / len(chunk) <= c_high
    return ratio, out, low <= ratio <= high and out <= MAX_CHUNK_SHARE * len(chunks)


def fit_bands(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Bands:
    """Limits from labelled good documents (``labels``: ``doc_id, quality``) by length; ``BANDS`` elsewhere."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("quality"))
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("__doc"))

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches, 0):
            owners, sizes, found = [], [], []
            for row, text in enumerate(texts_of(batch.column(0))):
                chunks = chunks_of(text)
                for part in [text, *chunks] if len(chunks) > 1 else filter(None, chunks):
                    owners.append(row)
                    sizes.append(int(np.log2(len(part))))
                    found.append(round(STEPS * len(press.compress(part)) / len(part)))
            columns = [batch.column(1).take(pa.array(owners, pa.int64())), pa.array(sizes, pa.int32()), pa.array(found, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["__doc", "bin", "step"])

    # every text is measured, so that no text has to meet its label
    kind = source.schema["__doc"].dataType.simpleString()
    measured = source.transform(map_arrow, ratios, f"__doc {kind}, bin int, step int")
    good = measured.join(known.where("quality = 1"), F.col("__doc") == F.col("__id"))
    counts = good.groupBy("bin", "step").agg(F.count("*").alias("n"))  # bounded: lengths by steps
    rising, whole = Window.partitionBy("bin").orderBy("step"), Window.partitionBy("bin")
    placed = counts.select("bin", "step", F.sum("n").over(rising).alias("upto"), F.sum("n").over(whole).alias("all"))
    ends = [F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step"))) / STEPS for q in (TAIL, 1 - TAIL)]
    limits = placed.groupBy("bin").agg(F.first("all").alias("n"), F.array(*ends).alias("at"))
    fitted = {r["bin"]: r["at"] for r in limits.collect() if r["n"] >= MIN_FIT}  # a row a power of two
    if not fitted:
        return BANDS
    points = []
    for bin in range(6, 21):
        middle = 2.0 ** (bin + 0.5)
        low, high = (fitted[bin][0] - MARGIN, fitted[bin][1] + MARGIN) if bin in fitted else band(int(middle))
        points.append((middle, low, high))
    return tuple(points)


def measure(texts: list[bytes], bands: Bands = BANDS) -> list[tuple]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for text in texts:
        words = text.split()
        n = len(words)
        chars = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUATION)))
        symbols = len(text) - len(text.translate(None, _SYMBOLS))
        repeats = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        ratio, out, fine = compression_verdict(text, press, bands) if text else (None, 0, False)
        rows.append((n, chars, symbols, duplicate_lines(text), repeats, failed, ratio, out, fine and not failed))
    return rows


def compression_bands(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, bands: Bands = BANDS
) -> DataFrame:
    """Measures and verdict beside the columns of ``docs`` (or those in ``keep``)."""

    def compute(texts: list[bytes]) -> list[pa.Array]:
        columns = list(zip(*measure(texts, bands))) or [()] * len(MEASURES)
        kinds = {"boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}
        return [
            pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, MEASURES.fields, strict=True)
        ]

    return add_columns(docs, text_col, MEASURES, compute, keep)


def keep_acceptable(docs: DataFrame, text_col: str = "text", bands: Bands = BANDS) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged; one scan, no shuffle."""
    return filter_rows(docs, text_col, lambda texts: [row[-1] for row in measure(texts, bands)])
