"""Adapters: what turns a source of some kind into raw texts (``id, text, source_type, project, metadata``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallkit.sources import responses
from recallkit.sources import text as texts

#: Takes the source's tables by name and gives raw texts, and the refused (``id, error``) or None.
Adapter = Callable[..., tuple[DataFrame, DataFrame | None]]
_ADAPTERS: dict[str, Adapter] = {}


def adapter(kind: str) -> Callable[[Adapter], Adapter]:
    """Register an adapter under a name; a later one of the same name takes its place."""

    def add(f: Adapter) -> Adapter:
        _ADAPTERS[kind] = f
        return f

    return add


def adapt(kind: str, **tables) -> tuple[DataFrame, DataFrame | None]:
    if kind not in _ADAPTERS:
        raise ValueError(f"INVALID_PARAMETER: source {kind!r}; there are {sorted(_ADAPTERS)}")
    return _ADAPTERS[kind](**tables)


def _raw(rows: DataFrame, identity: Column, source_type: str, project: str | None, metadata: Column) -> DataFrame:
    return rows.select(
        identity.cast("string").alias("id"), "text", F.lit(source_type).alias("source_type"),
        F.lit(project).cast("string").alias("project"), metadata.cast("map<string,string>").alias("metadata"),
    )


@adapter("manual")
def manual(notes: DataFrame, project: str | None = None) -> tuple[DataFrame, None]:
    """Notes (``id, text``) as they are."""
    return _raw(notes, F.col("id"), "manual", project, F.create_map()), None


@adapter("conversation")
def conversation(logs: DataFrame, project: str | None = None) -> tuple[DataFrame, None]:
    """Transcripts (``id, text``) by windows of turns."""
    windows = texts.windows_of(texts.turns_of(logs)).withColumn("text", F.col("content"))
    about = F.create_map(
        F.lit("session_id"), F.col("id").cast("string"), F.lit("turn_start"), F.col("turn_start").cast("string"),
        F.lit("turn_end"), F.col("turn_end").cast("string"),
    )
    return _raw(windows, F.concat_ws("|", "id", "turn_start"), "conversation", project, about), None


@adapter("url")
def url(requests: DataFrame, stored: DataFrame, project: str | None = None, **limits: int) -> tuple[DataFrame, DataFrame]:
    """Requests (``id, url``) answered from stored responses; see :mod:`recallkit.sources.responses`."""
    found = responses.fetched(requests, stored, **limits)
    about = F.create_map(
        F.lit("url"), F.col("url"), F.lit("final_url"), F.col("final_url"), F.lit("content_type"), F.col("content_type"),
    )
    kept = found.where("error IS NULL")
    return _raw(kept, F.concat_ws("|", "id", "url"), "url", project, about), found.where("error IS NOT NULL").select(
        F.concat_ws("|", "id", "url").alias("id"), "error"
    )
