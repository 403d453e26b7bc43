"""Filtered scans: predicates, keyset continuation, validated order, limit and offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallkit import config
from recallkit.config import ListFilter


def active() -> Column:
    return F.col("archived_at").isNull()


def _after(column: str, moment: str, id_after: object | None) -> Column:
    """Rows from a moment on, or beyond the (moment, id) of the last row seen; pushes down to scans."""
    c, at = F.col(column), F.lit(moment).cast("timestamp_ntz")
    if id_after is None:
        return c >= at
    return (c > at) | ((c == at) & (F.col("id") > F.lit(id_after)))


def predicate(f: ListFilter) -> Column:
    found = F.lit(True)
    if f.archived is None:
        found &= active()
    elif f.archived:
        found &= F.col("archived_at").isNotNull()
    if f.project is not None:
        found &= F.col("project") == f.project
    if f.memory_type is not None:
        found &= F.col("memory_type") == f.memory_type
    if f.tags:
        found &= F.arrays_overlap("tags", F.array(*map(F.lit, f.tags)))
    if f.session_id is not None:
        found &= F.get_json_object("source_metadata", "$.session_id") == f.session_id
    if f.min_importance is not None:
        found &= F.col("importance_score") >= f.min_importance
    if f.created_after is not None:
        found &= _after("created_at", f.created_after, f.id_after)
    if f.archived_after is not None:
        found &= _after("archived_at", f.archived_after, f.id_after)
    return found


def order_columns(order_by: str) -> list[Column]:
    """Columns of an ORDER BY text: listed names only, descending unless told otherwise."""
    found = []
    for part in order_by.split(","):
        words = part.split()
        if not 1 <= len(words) <= 2 or words[0] not in config.SORT_COLUMNS:
            raise ValueError(f"INVALID_PARAMETER: order_by {part.strip()!r}")
        way = words[1].upper() if len(words) == 2 else "DESC"
        if way not in ("ASC", "DESC"):
            raise ValueError(f"INVALID_PARAMETER: order_by {part.strip()!r}")
        found.append(F.col(words[0]).asc() if way == "ASC" else F.col(words[0]).desc())
    return found


def list_rows(memories: DataFrame, f: ListFilter) -> DataFrame:
    for value in (f.limit, f.offset):
        if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < 0):
            raise ValueError("INVALID_PARAMETER: limit and offset are integers from 0 on")
    found = memories.where(predicate(f)).orderBy(*order_columns(f.order_by))
    if f.offset:
        found = found.offset(f.offset)
    return found if f.limit is None else found.limit(f.limit)


def count_rows(memories: DataFrame, f: ListFilter) -> DataFrame:
    return memories.where(predicate(f)).agg(F.count("*").alias("n"))


def batch_get(memories: DataFrame, ids: Sequence) -> DataFrame:
    """Rows of a list of ids in the list's order, repeats and all; ids not found are left out."""
    spark = memories.sparkSession
    kind = memories.schema["id"].dataType.simpleString()
    wanted = spark.createDataFrame(list(enumerate(ids)), f"pos int, wanted {kind}")
    found = memories.where(F.col("id").isin(*set(ids))) if len(ids) <= 1000 else memories
    return found.join(wanted, F.col("id") == F.col("wanted")).drop("wanted").orderBy("pos")


def clamp_top_k(value: object) -> int:
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 1 else config.TOP_K


def clamp_max_tokens(value: int | None) -> int | None:
    return value if value is not None and value > 0 else None
