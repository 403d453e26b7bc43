"""Probability of a text under a subword lattice: the sum over all its segmentations.

A text is its words, each led by a blank, and one end.  Pieces of an existing vocabulary are
drawn independently, so the probability of a text is the sum over all ways to cut it into
pieces; no piece goes on beyond a blank, so that sum is a product over words, and a word's
factor is found by a forward recursion over its bytes, in log space.  Single bytes that are
no piece get a byte piece: every text has a segmentation.

Weights: the vocabulary's own scores first (log probabilities of a unigram model; of a merge
vocabulary, whose scores are ranks, by Zipf's law), then re-estimated from all words of the
training documents by forward-backward passes, with the vocabulary's weights as a prior.

Words are counted once for the corpus, and each distinct word's lattice is worked out once.
The words that most tokens bear (``HOT`` at most, found from a histogram of counts) are
broadcast; the others meet their documents by a shuffle on the word, and none of them is heavy.

Cases: a null text is empty and has the end alone; a null id is not held out and is learnt from;
repeated rows count each; words have any length (those over ``LONG`` bytes are scored whole
and learnt from in parts of that length); without training documents the weights are the vocabulary's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.llm.common import discard, give_back, map_arrow, slices, staged, texts_of

#: Words that are broadcast, at most, of at most so many bytes.
HOT = 1 << 17
HOT_BYTES = 64
#: Bytes from which a word goes through the recursion alone.
LONG = 512
#: Entries after which a worker hands on its counts.
FLUSH = 200_000
#: Words of one length that go through the recursion at once.
GROUP = 4096
#: Pieces that the vocabulary's own weights count for, beside those of the training documents.
PRIOR = 1000.0
_BLANK = 0x20


class Pieces:
    """A vocabulary as a byte trie with a weight of each piece; the blank that leads a word is byte 0x20."""

    def __init__(self, strings: list[bytes], weights: np.ndarray):
        self.strings, self.log = strings, np.log(weights)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, string in enumerate(strings):
            at = 0
            for byte in string:
                at = children[at].setdefault(byte, len(children))
                if at == len(children):
                    children.append({})
                    ends.append(-1)
            ends[at] = number
        self.ends = np.array(ends, dtype=np.int32)
        self.to = np.zeros((len(children), 256), dtype=np.uint16 if len(children) < 1 << 16 else np.int32)
        for at, below in enumerate(children):
            if below:
                self.to[at, list(below)] = list(below.values())

    def edges(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``start, stop, rows, pieces`` of all pieces in words of one length, by ascending start."""
        length = words.shape[1]
        for start in range(length):
            rows = np.arange(len(words))
            state = self.to[0, words[:, start]].astype(np.int64)
            stop = start + 1
            while True:
                piece = self.ends[state]
                met = piece >= 0
                if met.any():
                    yield start, stop, rows[met], piece[met]
                if stop == length:
                    break
                state = self.to[state, words[rows, stop]].astype(np.int64)
                alive = state > 0
                if not alive.all():
                    rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                stop += 1

    def forward(self, words: np.ndarray) -> np.ndarray:
        """Log probabilities of words of one length (a row of bytes each, blank first)."""
        alpha = np.full((len(words), words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0.0
        for start, stop, rows, piece in self.edges(words):
            alpha[rows, stop] = np.logaddexp(alpha[rows, stop], alpha[rows, start] + self.log[piece])
        return alpha[:, -1]

    def forward_long(self, word: bytes) -> float:
        """The same for one word of any length: only the sums within reach of a piece are held."""
        reach = max(map(len, self.strings)) + 1
        alpha = [-math.inf] * reach
        alpha[0] = 0.0
        to, ends, log = self.to, self.ends, self.log
        for start in range(len(word)):
            here, alpha[start % reach] = alpha[start % reach], -math.inf
            state, stop = 0, start
            while stop < len(word):
                state = to[state, word[stop]]
                if not state:
                    break
                stop += 1
                if ends[state] >= 0:
                    a, b = alpha[stop % reach], here + log[ends[state]]
                    low, high = (a, b) if a < b else (b, a)
                    alpha[stop % reach] = high + math.log1p(math.exp(low - high))
        return float(alpha[len(word) % reach])

    def expected(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in ``counts`` copies of the words."""
        alpha = np.full((len(words), words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0.0
        edges = list(self.edges(words))
        for start, stop, rows, piece in edges:
            alpha[rows, stop] = np.logaddexp(alpha[rows, stop], alpha[rows, start] + self.log[piece])
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0.0
        found = np.zeros(len(self.log))
        for start, stop, rows, piece in reversed(edges):
            after = self.log[piece] + beta[rows, stop]
            share = np.exp(alpha[rows, start] + after - alpha[rows, -1]) * counts[rows]
            found += np.bincount(piece, share, minlength=len(found))
            beta[rows, start] = np.logaddexp(beta[rows, start], after)
        return found


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Strings and weights (sum 1) of a sentencepiece vocabulary and, last, the end of a text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            string = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in string[1:]:  # runs of blanks do not occur
                scores[string] = model.get_score(i)
    values = np.array(list(scores.values()))
    ranks = bool(len(values)) and bool((values == np.round(values)).all())
    weights = 1.0 / (8.0 - values) if ranks else np.exp(values)
    missing = [bytes([b]) for b in range(256) if bytes([b]) not in scores]
    strings = [*scores, *missing, b""]
    least, most = (weights.min(), weights.max()) if len(weights) else (1.0, 1.0)
    weights = np.concatenate([weights, np.full(len(missing), least), [most]])
    return strings, weights / weights.sum()


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # ASCII letters alone


def count_words(docs: DataFrame, text_col: str, held_out: Column) -> DataFrame:
    """``word, c, n``: how often in training documents and in all; the null word is the end of a text."""
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, learnt = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            words = list(seen)
            columns = [pa.array(words, pa.binary()), pa.array([learnt[w] for w in words], pa.int64()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            learnt.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "c", "n"])

        for batch in slices(batches, 0):
            for text, out in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                words = _words(text)
                words.append(None)
                seen.update(words)
                if not out:
                    learnt.update(words)
            if len(seen) > FLUSH:
                yield rows()
        if seen:
            yield rows()

    parts = map_arrow(source, run, "word binary, c bigint, n bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and byte rows of words of one length, blank first."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for first in np.r_[0, np.flatnonzero(np.diff(sizes[order])) + 1] if len(words) else []:
        size = int(sizes[order[first]])
        places = order[first : np.searchsorted(sizes[order], size, "right")]
        for i in range(0, len(places), GROUP):
            part = places[i : i + GROUP]
            rows = np.frombuffer(b"".join(words[p] for p in part), np.uint8).reshape(len(part), size)
            yield part, np.concatenate([np.full((len(part), 1), _BLANK, np.uint8), rows], axis=1)


def learn_weights(counted: DataFrame, strings: list[bytes], weights: np.ndarray, rounds: int, ends: int) -> np.ndarray:
    """Weights after passes over the words of ``counted``; sums of a vocabulary's length reach the driver."""
    first, spark = weights, counted.sparkSession
    learnt = counted.where("c > 0 AND word IS NOT NULL").select("word", "c")
    for _ in range(rounds if ends else 0):
        given = spark.sparkContext.broadcast((strings, weights))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            model = Pieces(*given.value)
            found = np.zeros(len(model.log))
            for batch in slices(batches, 0):
                words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                cut = [(w[i : i + LONG], n) for w, n in zip(words, counts) if len(w) > LONG for i in range(0, len(w), LONG)]
                short = [(w, n) for w, n in zip(words, counts) if len(w) <= LONG] + cut
                counts = np.array([n for _, n in short], dtype=float)
                for part, rows in _by_length([w for w, _ in short]):
                    found += model.expected(rows, counts[part])
            met = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(found[met])], names=["piece", "expected"])

        sums = map_arrow(learnt, run, "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("expected"))
        expected = PRIOR * first
        for row in sums.collect():  # one a piece at most
            expected[row["piece"]] += row["expected"]
        expected[-1] += ends
        weights = expected / expected.sum()
        given.unpersist()
    return weights


def score_words(counted: DataFrame, strings: list[bytes], weights: np.ndarray) -> DataFrame:
    """``counted`` (without the end) with ``chance``, the log10 probability of each word."""
    given = counted.sparkSession.sparkContext.broadcast((strings, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in slices(batches, 0):
            model = model or Pieces(*given.value)
            words = batch.column(0).to_pylist()
            chance = np.zeros(len(words))
            short = [i for i, w in enumerate(words) if len(w) <= LONG]
            for part, rows in _by_length([words[i] for i in short]):
                chance[np.array(short)[part]] = model.forward(rows)
            for i, w in enumerate(words):
                if len(w) > LONG:
                    chance[i] = model.forward_long(bytes([_BLANK]) + w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance / math.log(10))], names=[*batch.schema.names, "chance"])

    rows = counted.where("word IS NOT NULL").select("word", "c", "n")
    return map_arrow(rows, run, "word binary, c bigint, n bigint, chance double")


def _hot(scored: DataFrame) -> list:
    """The most frequent words, ``HOT`` at most: a histogram of counts gives the least count."""
    usable = scored.where(F.octet_length("word") <= HOT_BYTES).withColumn("bin", F.floor(F.log2("n") * 8))
    bins = sorted(usable.groupBy("bin").agg(F.count("*").alias("words")).collect(), reverse=True)  # 512 at most
    least, total = None, 0
    for row in bins:
        total += row["words"]
        if total > HOT:
            break
        least = row["bin"]
    return [] if least is None else usable.where(F.col("bin") >= least).select("word", "c", "chance").collect()


def score_texts(
    docs: DataFrame,
    vocabulary: str,
    held_out: Column,
    rounds: int = 2,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``held_out, n_tokens, n_known, train_tokens, base_score, score`` beside the kept columns (all by default).

    ``base_score`` is that of add-one word counts, ``score`` that of the lattice, both log10
    probabilities of the text with its end.  A kept column of an added one's name is dropped.
    """
    spark = docs.sparkSession
    added = {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    names = [c for c in (keep or docs.columns) if c.lower() not in added]
    counted = staged(count_words(docs, text_col, held_out), "words")
    corpus = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.max(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    tokens, kinds, ends = corpus["n"] or 0, corpus["v"], corpus["ends"] or 0
    strings, weights = read_vocabulary(vocabulary)
    weights = learn_weights(counted, strings, weights, rounds, ends)
    scored = staged(score_words(counted, strings, weights), "chances")
    discard(counted)
    hot = _hot(scored)
    rest_log = math.log10(tokens + kinds + 1)
    numbers = {row["word"]: i for i, row in enumerate(hot)}
    known = np.array([row["c"] > 0 for row in hot] + [False])  # the last stands for the words that are not hot
    base = np.array([math.log10(row["c"] + 1) - rest_log for row in hot] + [0.0])
    chance = np.array([row["chance"] for row in hot] + [0.0])
    given = spark.sparkContext.broadcast(({bytes(w): i for w, i in numbers.items()}, known, base, chance))
    end = (int(ends > 0), math.log10(ends + 1) - rest_log, math.log10(weights[-1]))

    out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    source = docs.select(
        *[F.col(f"`{c}`") for c in names], out, F.monotonically_increasing_id().alias("__row"),
        F.col(f"`{text_col}`").cast("string").alias("__text"),
    )
    at = len(names) + 2
    extra = "n_tokens bigint, __known bigint, __base double, __score double, __words array<binary>, __counts array<bigint>"
    schema = T.StructType([*source.schema.fields[:at], *T.StructType.fromDDL(extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known, base, chance = given.value
        none = repeat(len(known) - 1)
        for batch in slices(batches, at):
            sums, words_left, counts_left, offsets = [], [], [], [0]
            for text in texts_of(batch.column(at)):
                words = _words(text)
                found = np.fromiter(map(numbers.get, words, none), np.int64, len(words))
                left = Counter(compress(words, (found == len(known) - 1).tolist()))
                words_left += left.keys()
                counts_left += left.values()
                offsets.append(len(words_left))
                sums.append((len(words) + 1, int(known[found].sum()) + end[0], base[found].sum() + end[1], chance[found].sum() + end[2]))
            columns = [pa.array(c, t) for c, t in zip(zip(*sums), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, t)) for v, t in ((words_left, pa.binary()), (counts_left, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(at)] + columns + lists, names=schema.fieldNames())
            give_back()

    part = staged(map_arrow(source, run, schema), "sums")
    rare = part.select("__row", F.explode(F.arrays_zip("__words", "__counts")).alias("r")).select(
        "__row", F.col("r.__words").alias("word"), F.col("r.__counts").alias("times")
    )
    met = rare.join(scored.select("word", "c", "chance"), "word").groupBy("__row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("__more_known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1) - F.lit(rest_log))).alias("__more_base"),
        F.sum(F.col("times") * F.col("chance")).alias("__more_score"),
    )
    whole = part.drop("__words", "__counts").join(met, "__row", "left")

    def total(name: str) -> Column:
        return F.col(f"__{name}") + F.coalesce(F.col(f"__more_{name}"), F.lit(0))

    return whole.select(
        *[F.col(f"`{c}`") for c in names], "held_out", "n_tokens", total("known").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), total("base").alias("base_score"), total("score").alias("score"),
    )
