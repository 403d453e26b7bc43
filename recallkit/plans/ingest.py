"""Ingestion: raw texts to classified, embedded, deduplicated and linked memories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallkit.functions import scalars
from recallkit.functions.classify import classify
from recallkit.functions.lineage import cut
from recallkit.operators import dedup, links
from recallkit.sources import text as texts
from recallkit.sources.embedders import Provider, embed, hash_vectors


@dataclass
class Batch:
    """What one batch adds: rows, decisions, edges, and rows that failed with their errors."""

    memories: DataFrame
    decisions: DataFrame
    edges: DataFrame
    failed: DataFrame


def usable(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to ingest, and those that cannot be (``id, error``).

    A text of an id counts once, however often the batch repeats it; of repeated ones that differ in
    source, project or metadata the last of these in order stays.  Other texts of an id are other rows.
    """
    blank = ~F.coalesce(F.trim("text") != "", F.lit(False))
    error = F.when(F.col("id").isNull(), "MISSING_ID").when(blank, "EMPTY_CONTENT")
    marked = raw.withColumn("error", error)
    entries = F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))  # maps have no order
    about = F.max(F.struct("source_type", "project", F.array_sort(entries).alias("entries"), "text")).alias("row")
    once = marked.where("error IS NULL").groupBy("id", F.sha2("text", 256).alias("digest")).agg(about)
    sound = once.select("id", "row.text", "row.source_type", "row.project", F.map_from_entries("row.entries").alias("metadata"))
    return sound, marked.where("error IS NOT NULL").select("id", "error")


def prepare(raw: DataFrame, now: str, provider: Provider = hash_vectors, promote_metadata: bool = False) -> DataFrame:
    """Chunks of raw texts (``id, text, source_type, project, metadata``) as rows of memories.

    Identifiers are hashes of document and place, so a repeated batch gives the same rows.
    """
    raw = raw.withColumn("document_id", texts.document_id())
    about = raw.select("document_id", "source_type", "project", "metadata")
    cut = texts.chunks(raw.select("id", "text")).join(about, "document_id")
    kind = classify(F.col("chunk"), F.col("source_type"))
    meta = F.map_concat(
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")),
        F.create_map(
            F.lit("document_id"), F.col("document_id"),
            F.lit("chunk_index"), F.col("chunk_index").cast("string"),
            F.lit("chunk_count"), F.col("chunk_count").cast("string"),
        ),
    )
    rows = cut.withColumn("kind", kind).select(
        F.sha2(F.concat_ws("|", "document_id", "chunk_index"), 256).alias("id"),
        F.col("chunk").alias("content"),
        F.col("kind.memory_type").alias("memory_type"),
        "source_type",
        meta.alias("source_metadata"),
        F.lit(0.5).alias("semantic_relevance"),
        F.col("kind.importance").alias("importance_score"),
        F.lit(0).cast("bigint").alias("access_count"),
        *[F.lit(now).cast("timestamp").alias(c) for c in ("last_accessed_at", "created_at", "updated_at")],
        F.lit(None).cast("timestamp").alias("archived_at"),
        F.array().cast("array<string>").alias("tags"),
        "project",
        "document_id",
        "chunk_index",
        F.concat_ws(
            "\t",
            F.lpad(F.coalesce(F.col("metadata")["turn_start"].try_cast("bigint"), F.lit(0)).cast("string"), 12, "0"),
            F.col("id").cast("string"),
            F.lpad(F.col("chunk_index").cast("string"), 9, "0"),
        ).alias("place"),
        scalars.content_hash(F.col("chunk")).alias("content_hash"),
    )
    if promote_metadata:
        listed = F.split(F.coalesce(F.col("source_metadata")["tags"], F.lit("")), ",")
        weight = F.col("source_metadata")["importance"].try_cast("double")
        rows = rows.withColumn("tags", F.filter(listed, lambda t: t != "")).withColumn(
            "importance_score", F.coalesce(weight, F.col("importance_score"))
        )
    return embed(rows, provider)


def ingest(
    raw: DataFrame,
    stored: DataFrame,
    now: str,
    provider: Provider = hash_vectors,
    promote_metadata: bool = False,
    check: Callable[[DataFrame], object] = lambda rows: None,
) -> Batch:
    """A batch against the active stored rows, its rows one after the other.

    Every chunk is saved; rows that a later one of the batch replaces are saved archived, stored
    ones are to be archived by the caller.  All five kinds of edges are built: chunks, sessions and
    projects in time, similar rows of a project, references and replacements.  Stored rows of the
    batch's ids are taken for an earlier try of it and left out of account.  ``check`` may refuse the
    rows, with their vectors, by an error.
    """
    sound, failed = usable(raw)
    rows = cut(prepare(sound, now, provider, promote_metadata))
    check(rows)
    active = stored.where("archived_at IS NULL").join(rows.select("id"), "id", "left_anti")
    decisions = cut(dedup.decide_batch(rows.select("id", "embedding", "project", "place"), active.select("id", "embedding", "project")))
    replaced = decisions.where("action = 'REPLACE'").select(F.col("existing_id").alias("id")).distinct()
    gone = replaced.withColumn("gone", F.lit(True))
    rows = cut(
        rows.join(gone, "id", "left")
        .withColumn("archived_at", F.when(F.col("gone"), F.lit(now).cast("timestamp")))
        .drop("gone")
    )
    none = F.create_map().cast("map<string,string>")
    chunk = links.chunk_edges(rows.select("id", "document_id", "chunk_index")).withColumn("props", none)
    session = F.col("source_metadata")["session_id"]
    timed = rows.select("id", session.alias("session_id"), "project", "created_at", "place")
    meta = F.col("source_metadata")
    spot = [F.coalesce(meta[k].try_cast("bigint"), F.lit(0)) for k in ("turn_start", "chunk_index")]
    last = links.last_of_sessions(
        active.select("id", session.alias("session_id"), "project", "created_at", F.struct(*spot).alias("place"))
    )
    last = last.withColumn("place", F.lit(None).cast(rows.schema["place"].dataType))
    time = links.temporal_edges(timed.unionByName(last)).withColumn("props", none)
    ends = [rows.select(F.col("id").alias(c)) for c in ("from_id", "to_id")]
    later = time.join(ends[0], "from_id", "left_anti").join(ends[1], "to_id", "left_semi")
    time = time.join(ends[0], "from_id", "left_semi").unionByName(later)
    names = ["id", "embedding", "project", "place"]
    places = rows.select("id", F.col("place").alias("until"))
    until = decisions.where("action = 'REPLACE'").join(places, "id").select(F.col("existing_id").alias("id"), "until")
    known = active.withColumn("place", F.lit(None).cast(rows.schema["place"].dataType)).select(*names)
    known = known.unionByName(rows.select(*names)).join(until, "id", "left")
    near = links.related_edges(rows.select(*names), known)
    similarity = F.create_map(F.lit("similarity"), F.col("similarity").cast("string"))
    near = near.select("from_id", "to_id", "edge_type", similarity.alias("props"))
    refs = links.reference_edges(rows).select("from_id", "to_id", "edge_type", none.alias("props"), "stub")
    plain = chunk.unionByName(time).unionByName(near).unionByName(links.supersedes_edges(decisions))
    return Batch(rows, decisions, plain.withColumn("stub", F.lit(False)).unionByName(refs), failed)
