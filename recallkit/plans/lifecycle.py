"""Lifecycle jobs: archive what has decayed, consolidate near-duplicates, purge what is old."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallkit import config
from recallkit.functions import scalars
from recallkit.functions.lineage import cut
from recallkit.operators import dedup, graph


def scores(memories: DataFrame, now: str) -> DataFrame:
    value = scalars.lifecycle_score(
        F.col("semantic_relevance"), F.col("last_accessed_at"), F.col("importance_score"), now
    )
    return memories.select("id", F.round(value, 6).alias("score"))


def archive_candidates(
    memories: DataFrame, now: str, threshold: float = config.ARCHIVE_THRESHOLD, project: str | None = None
) -> DataFrame:
    """``id, score`` of active rows below the threshold."""
    rows = memories.where("archived_at IS NULL")
    if project is not None:
        rows = rows.where(F.col("project") == project)
    return scores(rows, now).where(F.col("score") < threshold)


def purge_candidates(
    memories: DataFrame, now: str, retention_days: int = config.RETENTION_DAYS, project: str | None = None
) -> DataFrame:
    """``id`` of rows archived longer ago than the retention; exactly as long is kept."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(retention_days))
    rows = memories.where(F.col("archived_at") < limit)
    if project is not None:
        rows = rows.where(F.col("project") == project)
    return rows.select("id", "archived_at")


@dataclass
class Page:
    """What one page of a consolidation archives (``id, survivor, stage``), and where the next one begins."""

    merged: DataFrame
    cursor: tuple
    last: bool


def consolidation_pages(
    memories: DataFrame, page_rows: int, cursor: tuple | None = None, **thresholds: float
) -> Iterator[Page]:
    """Consolidate rows after ``cursor`` (``created_at, id``) in pages of ``page_rows``, until none is left.

    A page is worked out when it is asked for, on what those before it left: whoever stops after a
    page and starts again from its cursor, with its rows archived, gets the rest of the same run.
    """
    gone = None
    while True:
        state = memories if gone is None else memories.join(gone, "id", "left_anti")
        rows = state.where("archived_at IS NULL AND embedding IS NOT NULL").select("created_at", "id")
        if cursor is not None:
            at = F.lit(cursor[0]).cast(memories.schema["created_at"].dataType)
            rows = rows.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > F.lit(cursor[1]))))
        page = cut(rows.orderBy("created_at", "id").limit(page_rows))
        about = page.agg(F.count("*").alias("n"), F.max(F.struct("created_at", "id")).alias("order")).first()
        if not about["n"]:
            return
        merged = cut(dedup.consolidate(state, visitors=page.select("id"), **thresholds))
        cursor = (str(about["order"]["created_at"]), about["order"]["id"])
        yield Page(merged, cursor, about["n"] < page_rows)
        if about["n"] < page_rows:
            return
        here = merged.select("id")
        gone = cut(here if gone is None else gone.unionByName(here))


@dataclass
class Cleanup:
    """What a clean-up leaves, and its counts."""

    memories: DataFrame
    edges: DataFrame
    new_edges: DataFrame
    counts: DataFrame
    survivors: DataFrame


def clean_up(
    memories: DataFrame,
    edges: DataFrame,
    now: str,
    archive_threshold: float = config.ARCHIVE_THRESHOLD,
    merge_threshold: float = config.MERGE_THRESHOLD,
    retention_days: int = config.RETENTION_DAYS,
) -> Cleanup:
    """Archive, consolidate and purge at one moment, in this order, each on what the last left.

    Nothing is written: the result is the new state and its counts, so a dry run is the counts alone.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    old = cut(archive_candidates(memories, now, archive_threshold).select(F.col("id").alias("old")))
    stage1 = memories.join(old, F.col("id") == F.col("old"), "left").withColumn(
        "archived_at", F.when(F.col("old").isNotNull(), moment).otherwise(F.col("archived_at"))
    )
    stage1 = cut(stage1.drop("old"))
    merged = cut(dedup.consolidate(stage1, merge=merge_threshold))
    gone = merged.select(F.col("id").alias("gone"))
    stage2 = stage1.join(gone, F.col("id") == F.col("gone"), "left").withColumn(
        "archived_at", F.when(F.col("gone").isNotNull(), moment).otherwise(F.col("archived_at"))
    )
    stage2 = stage2.drop("gone")
    purged = cut(purge_candidates(stage2, now, retention_days).select("id"))
    _, kept_edges = graph.delete_nodes(edges, memories.select("id"), purged)
    kept = stage2.join(purged, "id", "left_anti")
    links = merged.select(
        F.col("survivor").alias("from_id"), F.col("id").alias("to_id"), F.lit(config.FREE_EDGE).alias("edge_type"),
        F.create_map(F.lit("consolidated_at"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")).alias("props"),
    )
    counts = (
        memories.agg(F.count("*").alias("checked"))
        .crossJoin(old.agg(F.count("*").alias("archived")))  # one row each
        .crossJoin(merged.agg(F.count("*").alias("consolidated")))
        .crossJoin(purged.agg(F.count("*").alias("purged")))
    )
    survivors = merged.select(F.col("survivor").alias("id")).distinct()
    return Cleanup(kept, kept_edges, links, counts, survivors)


def due(saves: int, last_cleanup: str | None, now: str, every: int = 50, hours: int = 24) -> bool:
    """Whether a clean-up is to start: at each ``every``-th save, or ``hours`` after the last one."""
    if saves and saves % every == 0:
        return True
    if last_cleanup is None:
        return False
    gap = dt.datetime.fromisoformat(now) - dt.datetime.fromisoformat(last_cleanup)
    return gap >= dt.timedelta(hours=hours)
