"""Edge builders: neighbours in time, chunks, similarity, replacement and references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallkit import config
from recallkit.operators import cells


def _pairs(first: Column, second: Column, forward: str, backward: str) -> Column:
    """Two edges between a pair, one each way; none from a row to itself."""
    both = F.array(
        F.struct(first.alias("from_id"), second.alias("to_id"), F.lit(forward).alias("edge_type")),
        F.struct(second.alias("from_id"), first.alias("to_id"), F.lit(backward).alias("edge_type")),
    )
    return F.explode(F.when(first != second, both))


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """CHUNK_NEXT and CHUNK_PREV between neighbours of a document (``id, document_id, chunk_index``)."""
    order = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    following = chunks.select("id", F.lead("id").over(order).alias("after")).where("after IS NOT NULL")
    return following.select(_pairs(F.col("id"), F.col("after"), "CHUNK_NEXT", "CHUNK_PREV").alias("e")).select("e.*")


def temporal_edges(memories: DataFrame) -> DataFrame:
    """TEMPORAL_NEXT and TEMPORAL_PREV to the previous row (``id, session_id, project, created_at``).

    A row of a session follows the latest row of its session and project.  A row without one
    follows the latest row of its project, if that has no session either; rows with neither
    follow none.  ``place``, if there is such a column, orders rows of one time.
    """
    then = ["created_at", *(["place"] if "place" in memories.columns else []), "id"]
    session = Window.partitionBy("project", "session_id").orderBy(*then)
    project = Window.partitionBy("project").orderBy(*then)
    alone = memories.where("session_id IS NULL OR project IS NOT NULL")
    in_session = memories.where("session_id IS NOT NULL").select("id", F.lag("id").over(session).alias("before"))
    in_project = (
        alone.where("project IS NOT NULL")
        .select("id", "session_id", F.lag("id").over(project).alias("before"), F.lag("session_id").over(project).alias("other"))
        .where("session_id IS NULL AND other IS NULL")
        .select("id", "before")
    )
    linked = in_session.unionByName(in_project).where("before IS NOT NULL")
    pair = _pairs(F.col("before"), F.col("id"), "TEMPORAL_NEXT", "TEMPORAL_PREV")
    return linked.select(pair.alias("e")).select("e.*")


def last_of_sessions(memories: DataFrame) -> DataFrame:
    """The latest row (by ``created_at, place, id``) of each project and session: all that later rows can follow."""
    last = memories.groupBy("project", "session_id").agg(F.max(F.struct("created_at", "place", "id")).alias("last"))
    return last.select("last.id", "session_id", "project", "last.created_at")


def turn_edges(turns: DataFrame) -> DataFrame:
    """Temporal edges between consecutive turns of conversations (``conv_id, turn``)."""
    node = F.col("conv_id") * 100 + F.col("turn")
    rows = turns.select(
        node.alias("id"), F.col("conv_id").alias("session_id"), F.col("conv_id").alias("project"),
        F.col("turn").alias("created_at"),
    )
    return temporal_edges(rows)


def _semantic(near: DataFrame) -> DataFrame:
    return near.where("query_id <> id").select(
        F.col("query_id").alias("from_id"), F.col("id").alias("to_id"),
        F.lit("SEMANTICALLY_RELATED").alias("edge_type"), F.col("score").alias("similarity"),
    )


def semantic_edges(vectors: DataFrame, threshold: float = config.SEMANTIC_THRESHOLD, k: int = config.SEMANTIC_TOP_K) -> DataFrame:
    """SEMANTICALLY_RELATED to those of the ``k`` nearest of all rows (itself counted) that reach the threshold."""
    return _semantic(cells.near_rows(vectors, vectors, threshold, k))


def related_edges(
    new: DataFrame, known: DataFrame, threshold: float = config.SEMANTIC_THRESHOLD, k: int = config.SEMANTIC_TOP_K
) -> DataFrame:
    """SEMANTICALLY_RELATED from new rows to active rows of their project (of any, if it is null).

    ``new`` and ``known`` hold ``id, embedding, project`` and, if rows become known one after the
    other, ``place``: then a row sees those before it only (null: before all), and of these the ones
    that no row up to it has replaced (``until`` of ``known``: the place of the row that does).  Of
    the ``k`` nearest, itself counted if it is known, those that reach the threshold are linked.
    """
    placed = "place" in new.columns and "place" in known.columns
    names = ["id", "embedding", "project", *(["place"] if placed else [])]

    def seen(left: pd.DataFrame, right: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = left["q_place"].to_numpy()[i]
        since, until = (right[c].fillna("").astype(str).to_numpy()[j] for c in ("v_place", "v_until"))
        itself = left["q_id"].to_numpy()[i] == right["v_id"].to_numpy()[j]
        return ((since == "") | (since < at) | itself) & ((until == "") | (at < until))

    known = known.select(*names, *(["until"] if placed else []))
    met = cells.near_rows(new.select(*names), known, threshold, k, scope="project", allowed=seen if placed else None)
    return _semantic(met)


def text_digest(content: str = "content") -> Column:
    """What equal texts share."""
    return F.sha2(content, 256)


def equal_text_edges(memories: DataFrame) -> DataFrame:
    """SUPERSEDES from each row to the next lower id with the same text (``content``, or its ``digest``)."""
    order = Window.partitionBy("digest" if "digest" in memories.columns else text_digest()).orderBy("id")
    older = memories.select("id", F.lag("id").over(order).alias("older")).where("older IS NOT NULL")
    return older.select(
        F.col("id").alias("from_id"), F.col("older").alias("to_id"), F.lit(config.FREE_EDGE).alias("edge_type")
    )


def supersedes_edges(decisions: DataFrame) -> DataFrame:
    """SUPERSEDES from new rows to the rows they replace (``id, action, existing_id, similarity``)."""
    replaced = decisions.where("action = 'REPLACE'")
    return replaced.select(
        F.col("id").alias("from_id"), F.col("existing_id").alias("to_id"), F.lit(config.FREE_EDGE).alias("edge_type"),
        F.create_map(F.lit("similarity"), F.col("similarity").cast("string")).alias("props"),
    )


#: What counts as an address and as a path.
URL_FORM = r"(?i)(https?://[^\s\"'<>()\[\]{}]+)"
PATH_FORM = r"(?m)(?:^|[\s\"(])(/[A-Za-z0-9_\-./]+)"


def references(text: Column) -> Column:
    """Distinct ``url:`` and ``file:`` targets that a text mentions, closing punctuation trimmed."""
    urls = F.transform(
        F.regexp_extract_all(text, F.lit(URL_FORM), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,!?:;]+$", "")
    )
    paths = F.filter(
        F.regexp_extract_all(text, F.lit(PATH_FORM), F.lit(1)),
        lambda p: F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) >= 2,
    )
    named = F.concat(
        F.transform(urls, lambda u: F.concat(F.lit("url:"), u)), F.transform(paths, lambda p: F.concat(F.lit("file:"), p))
    )
    return F.array_distinct(named)


def reference_edges(memories: DataFrame) -> DataFrame:
    """REFERENCES stubs (``stub`` true): their targets are no nodes, so traversal does not follow them."""
    return memories.select(
        F.col("id").cast("string").alias("from_id"), F.explode(references(F.col("content"))).alias("to_id")
    ).select("from_id", "to_id", F.lit("REFERENCES").alias("edge_type"), F.lit(True).alias("stub"))
