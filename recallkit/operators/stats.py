"""Counts of the store, its log, and what the dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts() -> list:
    return [
        F.count_if(F.col("archived_at").isNull()).alias("active"),
        F.count_if(F.col("archived_at").isNotNull()).alias("archived"),
        F.count("*").alias("total"),
    ]


def overall(memories: DataFrame, project: str | None = None) -> DataFrame:
    rows = memories if project is None else memories.where(F.col("project") == project)
    return rows.agg(*_counts())


def by_project(memories: DataFrame) -> DataFrame:
    return memories.where("project IS NOT NULL AND project <> ''").groupBy("project").agg(*_counts())


def by_project_and_type(memories: DataFrame) -> DataFrame:
    """Counts and mean relevance rolled up over project and type; nulls mark totals."""
    grouped = memories.where("project IS NOT NULL").rollup("project", "memory_type")
    return grouped.agg(*_counts(), F.round(F.avg("importance_score"), 6).alias("avg_importance"))


def projects(memories: DataFrame) -> DataFrame:
    return memories.select("project").where("project IS NOT NULL AND project <> ''").distinct()


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"))


def summary(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, edges, and the number and sorted names of the projects."""
    named = F.when(F.col("project") != "", F.col("project"))
    rows = memories.agg(*_counts(), F.count_distinct(named).alias("projects"), F.array_sort(F.collect_set(named)).alias("names"))
    return rows.crossJoin(edge_count(edges))  # one row each


def merge_log(entries: DataFrame) -> DataFrame:
    """Log entries (``ts, level, logger, message``) once per time, logger and message: the last arrival (``seq``)."""
    return entries.groupBy("ts", "logger", "message").agg(
        F.max_by("level", "seq").alias("level"), F.max("seq").alias("seq")
    )


def search_log(entries: DataFrame, level: str | None = None, text: str | None = None) -> DataFrame:
    if level is not None:
        entries = entries.where(F.col("level") == level)
    if text:
        needle = F.lower(F.lit(text))
        entries = entries.where(F.contains(F.lower("message"), needle) | F.contains(F.lower("logger"), needle))
    return entries


def last_entries(entries: DataFrame, n: int) -> DataFrame:
    return entries.orderBy(F.desc("ts"), F.desc("seq")).limit(n)
