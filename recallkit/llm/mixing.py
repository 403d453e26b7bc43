"""Mixing sources to target weights (operator 8): Efraimidis-Spirakis sampling.

Every source has a target of words.  ``floor(target / source size)`` complete epochs of
the source come first; the rest is filled by a weighted random order without
replacement: each document draws an exponential key ``-ln(u) / weight`` and documents
are taken in ascending key order until the budget is spent.  The document at the
boundary gives only the words still wanted, so each source meets its target to the word.

``u`` comes from a hash of seed, document and length, so reruns agree.  The weight is the
quality weight of the document's label if there is one, else 1.

The order within a source is never sorted in one task: keys fall into slices, one for each
``SLICE_ROWS`` rows of the table, by a monotone map, slice totals are summed first, and only the rows of one slice of one
source are sorted together.  The map is the mean of the distributions that keys of the
weights in ``SLICE_WEIGHTS`` have, so one of ``n`` slices gets at most ``len(SLICE_WEIGHTS) / n``
of the rows of any of these weights, however the weights are mixed.

Cases: a null text has size 0; null is a source of its own, after all others; a document
of size 0 takes 0 words; repeated rows each count and each take their own share (ties in the
key are broken by id, then by a hash of the text); rows with a null id draw by that hash; a
very long text is one document like any other; empty table, empty result; all columns beside
id, text and source are ignored by :func:`mixture`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit.llm.common import WORD, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Rows a slice, about; a small table has ``MIN_SLICES``.
SLICE_ROWS = 50_000
MIN_SLICES = 64
LOW_WEIGHT = 0.25
SLICE_WEIGHTS = (1.0, LOW_WEIGHT)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from rows with ``source, size``.

    Water-filling in closed form: a source stops at ``MAX_EPOCHS`` times its size; with the
    sources in ascending order of cap over weight, the stopped ones are a prefix.  One row a
    source is all that meets in the windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = (
        totals.withColumn("place", F.row_number().over(named))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", (F.lit(MAX_EPOCHS) * F.col("source_size")).cast("double"))
        .withColumn("level", F.col("cap") / F.col("weight"))
    )
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    pool = F.lit(SHARE) * F.sum("source_size").over(every)
    rest = (pool - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("rest", rest).withColumn(
        "common", F.max(F.when(F.col("level") >= F.col("rest"), F.col("rest"))).over(every)
    )
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("common"), F.col("cap")))
    return filled.select("source", "source_size", target.alias("target"))


def exponential_key(doc_id: Column, size: Column, weight: Column, mark: Column | None = None) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1) from 52 hashed bits; ``mark`` names rows without an id."""
    name = F.coalesce(doc_id.cast("string"), F.lit(None) if mark is None else F.concat(F.lit("#"), mark.cast("string")))
    digest = F.md5(F.concat_ws("|", F.lit(SEED), name, size.cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.ln(u) / weight


def key_slice(key: Column, slices: int) -> Column:
    """Slice of a key, of so many: a monotone map under which keys of every slice weight lie evenly enough."""
    below = sum((1 - F.exp(-F.lit(w) * key) for w in SLICE_WEIGHTS), F.lit(0.0)) / len(SLICE_WEIGHTS)
    return F.least(F.lit(slices - 1), F.floor(slices * below)).cast("int")


def mixture(
    docs: DataFrame,
    quality: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``.

    ``quality`` (``doc_id, weight``, one row an id, weights in (0, 1]) scales the keys;
    absent documents weigh 1.
    """
    sizes = staged(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").alias("source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
            F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"),
        ),
        "sizes",
    )
    return _shares(sizes, quality).select("doc_id", "source", "size", "source_size", "target", "taken")


def _shares(sizes: DataFrame, quality: DataFrame | None) -> DataFrame:
    """``sizes`` (``doc_id, source, size, mark``, staged) with ``source_size, target, taken``."""
    n_slices = max(MIN_SLICES, -(-sizes.count() // SLICE_ROWS))
    weighed = sizes.withColumn("weight", F.lit(1.0))
    if quality is not None:
        per_id = quality.groupBy("doc_id").agg(F.max("weight").alias("quality_weight"))
        weighed = sizes.join(per_id, "doc_id", "left").withColumn(
            "weight", F.coalesce(F.col("quality_weight"), F.lit(1.0))
        )
    keyed = weighed.withColumn("key", exponential_key(*map(F.col, ("doc_id", "size", "weight", "mark")))).withColumn(
        "slice", key_slice(F.col("key"), n_slices)
    )
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sizes)
    offsets = slices.withColumn("offset", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).join(
        targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))
    )
    offsets = offsets.select(
        F.col("source").alias("o_source"), F.col("slice").alias("o_slice"), "offset", "source_size", "target"
    )
    within = (
        Window.partitionBy("source", "slice")
        .orderBy("key", "doc_id", "mark")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice"))
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    taken = (epochs * F.col("size") + part).cast("long").alias("taken")
    return placed.select("doc_id", "source", "size", "mark", "source_size", "target", taken)


def mix_documents(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The mix itself: rows of ``docs`` (``doc_id, text, source`` and more), repeated or cut.

    A document appears once per complete epoch, and once more with its first words if the
    budget ends within it.  ``n_chars``, where there is one, follows the text.  Of rows equal in
    id, source and text each takes one of the shares they drew.
    """
    text = F.col("text").cast("string")
    name = F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull())
    keyed = docs.select("*", word_count(text).alias("__size"), name.alias("__name"), F.xxhash64(text).alias("__mark"))
    sizes = staged(keyed.select("doc_id", "source", F.col("__size").alias("size"), F.col("__mark").alias("mark")), "sizes")
    # 128 bits name a row; the window and the join deal the texts once
    shares = _shares(sizes, quality).where("taken > 0").groupBy(name.alias("__name"), F.col("mark").alias("__mark")).agg(
        F.sort_array(F.collect_list("taken"), asc=False).alias("__shares")
    )
    same = Window.partitionBy("__name", "__mark").orderBy(F.lit(1))
    joined = keyed.withColumn("__number", F.row_number().over(same)).join(shares, ["__name", "__mark"])
    joined = joined.withColumn("__taken", F.try_element_at("__shares", F.col("__number"))).where("__taken > 0")
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")))))
    words = F.least(F.col("__size"), F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words), " ")
    text = F.when(words == F.col("__size"), F.col("text")).otherwise(cut)
    mixed = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*[f"`{c}`" for c in docs.columns])


def quality_weights(labels: DataFrame) -> DataFrame:
    """``doc_id, weight`` of labelled documents: 1 for quality 1, ``LOW_WEIGHT`` for quality 0."""
    weight = F.when(F.col("quality") == 1, F.lit(1.0)).when(F.col("quality") == 0, F.lit(LOW_WEIGHT))
    return labels.select("doc_id", weight.alias("weight")).where("weight IS NOT NULL")
