"""Language ID (operator 4): Bayesian fusion of evidence.

The evidence about a page is combined as log-probabilities:

* text: naive Bayes over character trigrams, learnt from all documents with a known language
  by grouped counting.  Trigrams fall into ``BUCKETS`` hashed classes, so every trigram counts
  and the model has a fixed size; long texts are tempered to ``TEXT_WEIGHT`` trigrams, since
  trigrams of one text are far from independent;
* the language the markup declares, by ``P(value | language)``;
* a prior by address, smoothed by levels: the counts of a host are shrunk to those of its
  registrable domain, these to the counts of the suffix, these to the counts of all pages.  So
  the suffix is evidence once, as the level between domain and all.

The tables of the last two are counted over all pages by grouped aggregation, each page
counting for the language its text makes likeliest; the vote of a page itself is taken out of
the counts it is judged by.  Hosts, domains, suffixes and declared values are joined back with
the heavy ones dealt by broadcast.

Cases: null or empty pages, and texts without letters, are judged by the other evidence; very
long texts are read whole and tempered; a null address has the empty host; rows with a null id
are judged like others; ties go to the first language by name; repeated rows each count and
each get their row; without training rows the languages are null, without pages there are no
rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallkit.llm.common import join_heavy, map_arrow, slices, staged

GRAM = 3
BUCKETS = 1 << 17
MAX_HELD_WORDS = 200_000
TEXT_WEIGHT = 200.0
HOST_STRENGTH = 5.0
DOMAIN_STRENGTH = 10.0
SUFFIX_STRENGTH = 20.0
SMOOTHING = 0.5

_DROPPED = re.compile(r"(?is)<(script|style|noscript|head)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(words: Counter) -> Counter:
    """Character trigrams of counted words, with a blank at either end of each."""
    grams: Counter = Counter()
    for word, n in words.items():
        padded = f" {word} "
        for i in range(len(padded) - GRAM + 1):
            grams[padded[i : i + GRAM]] += n
    return grams


def words_of(text: str) -> list[str]:
    return _NOT_LETTERS.sub(" ", text.lower()).split()


def page_text(source: str) -> str:
    return html.unescape(_TAG.sub(" ", _DROPPED.sub(" ", source)))


class Buckets(dict):
    """Trigram to its hashed class; bounded."""

    def __missing__(self, gram: str) -> int:
        if len(self) > MAX_HELD_WORDS:
            self.clear()
        value = self[gram] = zlib.crc32(gram.encode()) % BUCKETS
        return value


def learn_trigrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log-likelihood of each class of trigrams (row) by language (column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        seen: dict[str, np.ndarray] = {}
        bucket = Buckets()

        def settle(lang: str) -> None:
            table = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for gram, n in trigrams(words[lang]).items():
                table[bucket[gram]] += n
            words[lang].clear()

        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = words.setdefault(lang, Counter())
                held.update(words_of(text or ""))
                if len(held) > MAX_HELD_WORDS:
                    settle(lang)
        for lang in words:
            settle(lang)
            at = np.flatnonzero(seen[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(seen[lang][at])],
                names=["lang", "bucket", "n"],
            )

    source = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = source.where("lang IS NOT NULL").transform(map_arrow, count, "lang string, bucket int, n bigint")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    langs = sorted(found["lang"].unique())
    table = np.zeros((BUCKETS, len(langs)))
    table[found["bucket"].to_numpy(np.int64), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = found["n"]
    shares = (table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BUCKETS)
    return langs, np.log(shares).astype(np.float32)


class TextModel:
    """Log-likelihoods of texts."""

    def __init__(self, table: np.ndarray):
        self.table, self.bucket = table, Buckets()

    def likelihood(self, text: str) -> np.ndarray:
        """Log-likelihood by language, tempered to ``TEXT_WEIGHT`` trigrams."""
        grams = trigrams(Counter(words_of(text)))
        if not grams:
            return np.zeros(self.table.shape[1])
        at, n = np.array([(self.bucket[g], n) for g, n in grams.items()]).T
        return (n[:, None] * self.table[at]).sum(axis=0, dtype=float) * min(1.0, TEXT_WEIGHT / n.sum())


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def _level(counts: Column, own: Column, above: Column, strength: float) -> Column:
    """Shares of languages without one's own vote: ``(counts + strength * above) / (total + strength)``."""
    others = F.zip_with(counts, own, lambda c, o: (c - o).cast("double"))
    total = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(others, above, lambda c, p: (c + strength * p) / (total + strength))


def identify_languages(
    pages: DataFrame,
    docs: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``page_id, host, declared, suffix, text_lang, lang, confidence`` for every page."""
    langs, table = learn_trigrams(docs)
    model = pages.sparkSession.sparkContext.broadcast(table)  # BUCKETS rows
    width = len(langs)
    address, source = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    declared = F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    raw = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        host_of(address).alias("host"),
        declared.alias("declared"),
        source.alias("html"),
    )
    kind = raw.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = TextModel(model.value)
        for batch in slices(batches, 3):
            scores = [text.likelihood(page_text(x or "")).tolist() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(scores, pa.list_(pa.float64()))],
                names=["page_id", "host", "declared", "text"],
            )

    schema = f"page_id {kind}, host string, declared string, text array<double>"
    read_pages = staged(raw.transform(map_arrow, read, schema), "page-text")
    labels = F.regexp_count("host", F.lit(r"\."))
    split = read_pages.select(
        "*",
        F.when(labels >= 1, F.substring_index("host", ".", -2)).otherwise(F.col("host")).alias("domain"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.when(F.array_max("text") == F.array_min("text"), F.lit(0))
        .otherwise(F.array_position("text", F.array_max("text")))
        .alias("best"),
    )
    if not width:
        unknown = F.lit(None).cast("string")
        return split.select(
            "page_id", "host", "declared", "suffix", unknown.alias("text_lang"), unknown.alias("lang"),
            F.lit(None).cast("double").alias("confidence"),
        )
    own = F.array(*[(F.col("best") == i + 1).cast("long") for i in range(width)])
    votes = F.array(*[F.count_if(F.col("best") == i + 1) for i in range(width)])
    add = F.array(*[F.sum(F.col("n")[i]) for i in range(width)])
    by_host = staged(split.groupBy("host", "domain", "suffix").agg(votes.alias("n"), F.count("*").alias("pages")), "hosts")
    by_domain = by_host.groupBy("domain", "suffix").agg(add.alias("n"), F.count("*").alias("hosts"))
    by_suffix = by_domain.groupBy("suffix").agg(add.alias("n"), F.sum("hosts").alias("hosts"))
    overall = by_suffix.agg(add.alias("n")).first()["n"]
    overall = [x or 0 for x in overall]
    domains = by_domain.select("domain", F.col("n").alias("domain_n"), "hosts")
    suffixes = by_suffix.select("suffix", F.col("n").alias("suffix_n"), F.col("hosts").alias("suffix_hosts"))
    levels = staged(join_heavy(by_host, staged(domains, "domains"), ["domain"], "hosts"), "host-domains")
    levels = join_heavy(levels, staged(suffixes, "suffixes"), ["suffix"], "suffix_hosts")
    levels = staged(levels.select("host", "pages", F.col("n").alias("host_n"), "domain_n", "suffix_n"), "levels")
    declared = split.groupBy("declared").agg(votes.alias("declared_n"), F.count("*").alias("declaring"))
    declared = staged(declared, "declared")
    values = declared.count()
    placed = staged(join_heavy(split, levels, ["host"], "pages"), "placed")
    placed = join_heavy(placed, declared, ["declared"], "declaring").withColumn("own", own)
    even = F.array(*[F.lit(1.0 / width)] * width)
    prior = _level(F.array(*map(F.lit, overall)), F.col("own"), even, 1.0)
    for column, strength in (("suffix_n", SUFFIX_STRENGTH), ("domain_n", DOMAIN_STRENGTH), ("host_n", HOST_STRENGTH)):
        prior = _level(F.col(column), F.col("own"), prior, strength)
    said = F.zip_with(F.zip_with("declared_n", "own", lambda c, o: c - o), F.zip_with(F.array(*map(F.lit, overall)), "own", lambda c, o: c - o),
                      lambda c, t: F.ln((c + SMOOTHING) / (t + SMOOTHING * values)))
    fused = placed.withColumn("prior", prior).withColumn("said", said).withColumn(
        "sum", F.zip_with(F.zip_with("text", F.transform("prior", F.ln), lambda a, b: a + b), "said", lambda a, b: a + b)
    )
    names = F.array(*map(F.lit, langs))
    top = F.array_max("sum")
    spread = F.aggregate(F.transform("sum", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return fused.select(
        "page_id",
        "host",
        "declared",
        "suffix",
        F.when(F.col("best") > 0, names[(F.col("best") - 1).cast("int")]).alias("text_lang"),
        names[(F.array_position("sum", top) - 1).cast("int")].alias("lang"),
        (1 / spread).alias("confidence"),
    )
