"""Fusion of ranked lists: weighted reciprocal ranks, decay, importance, token budget."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit import config
from recallkit.config import SearchStrategy
from recallkit.functions import scalars

#: Where a row came from, in rising precedence.
SOURCES = ("vector", "keyword", "graph")


def ranked(hits: DataFrame, source: str) -> DataFrame:
    """``id, source, rank`` with ranks from 0 by falling score, then id; hits are a top-k list."""
    order = Window.orderBy(F.desc("score"), "id")
    return hits.select("id", F.lit(source).alias("source"), (F.row_number().over(order) - 1).alias("rank"))


def reciprocal(rank: Column) -> Column:
    return F.lit(1.0) / (F.lit(config.RRF_K + 1) + rank)


def composite(rrf: Column, accessed: Column, importance: Column, now: str, decay: bool = True) -> Column:
    freshness = scalars.time_decay(accessed, now) if decay else F.lit(1.0)
    return config.RRF_WEIGHT * rrf + config.DECAY_WEIGHT * freshness + config.IMPORTANCE_WEIGHT * importance


def fuse(lists: DataFrame, memories: DataFrame, strategy: SearchStrategy, now: str) -> DataFrame:
    """``id, rrf_score, final_score, source`` of ranked lists (``id, source, rank``).

    One shuffle gathers the lists by id; a source that lacks a row adds nothing, though its
    weight stays in the normaliser.
    """
    weights = {"vector": strategy.vector, "keyword": strategy.keyword, "graph": strategy.graph}
    gathered = lists.groupBy("id").agg(
        *[F.min(F.when(F.col("source") == s, F.col("rank"))).alias(s) for s in SOURCES]
    )
    total = reduce(add, [w / (config.RRF_K + 1) for w in weights.values()])
    terms = [F.coalesce(w * reciprocal(F.col(s)), F.lit(0.0)) for s, w in weights.items()]
    rrf = (terms[0] + terms[1] + terms[2]) / F.lit(total)
    label = F.when(F.col("graph").isNotNull(), "graph").when(F.col("keyword").isNotNull(), "keyword").otherwise("vector")
    score = composite(F.col("rrf"), F.col("last_accessed_at"), F.col("importance_score"), now, strategy.time_decay)
    return (
        memories.select("id", "project", "last_accessed_at", "importance_score")
        .join(gathered.select("id", rrf.alias("rrf"), label.alias("source")), "id")
        .select("id", "project", F.round("rrf", 6).alias("rrf_score"), F.round(score, 6).alias("final_score"), "source")
    )


def fuse_single(hits: DataFrame, memories: DataFrame, now: str, decay: bool = True) -> DataFrame:
    """``id, rrf_score, final_score`` of one ranked list."""
    rrf = F.lit(float(config.RRF_K + 1)) * reciprocal(F.col("rank"))
    score = composite(rrf, F.col("last_accessed_at"), F.col("importance_score"), now, decay)
    return (
        memories.select("id", "last_accessed_at", "importance_score")
        .join(ranked(hits, "vector"), "id")
        .select("id", F.round(rrf, 6).alias("rrf_score"), F.round(score, 6).alias("final_score"))
    )


def within_budget(results: DataFrame, memories: DataFrame, max_tokens: int | None) -> DataFrame:
    """The longest prefix of the results, a top-k list, whose texts fit a number of tokens."""
    if max_tokens is None:
        return results
    order = Window.orderBy(F.desc("final_score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    sized = F.broadcast(results).join(memories.select("id", scalars.token_estimate(F.col("content")).alias("tokens")), "id")
    return sized.withColumn("running", F.sum("tokens").over(order)).where(F.col("running") <= max_tokens)
