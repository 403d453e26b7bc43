"""The property graph: bounded traversal, induced edges, updates, layout."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallkit import config
from recallkit.functions.lineage import cut

#: Rows of a frontier that is sent to all edges.
SENT_ROWS = 100_000


def of_types(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """Edges of the types; none given means all, and only unknown ones means none."""
    return edges.where(F.col("edge_type").isin(*types)) if types else edges


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "edge_type")
    return edges.select("from_id", "to_id", "edge_type").unionByName(back).distinct()


def traverse(
    edges: DataFrame,
    nodes: DataFrame,
    seeds: Sequence,
    depth: int = 2,
    types: Sequence[str] | None = None,
    hops: int = config.MAX_HOPS,
    direction: str = "out",
) -> DataFrame:
    """Rows of all simple paths from the seeds: ``node_id, from_id, to_id, edge_type, logical_depth,
    physical_depth``.  SUPERSEDES edges cost no depth; depth is at most five.
    """
    return walk(edges, nodes, seeds, depth, types, hops, direction)[0]


def walk(
    edges: DataFrame,
    nodes: DataFrame,
    seeds: Sequence,
    depth: int = 2,
    types: Sequence[str] | None = None,
    hops: int = config.MAX_HOPS,
    direction: str = "out",
    deadline: float | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> tuple[DataFrame, bool]:
    """As :func:`traverse`, and whether ``deadline`` seconds cut it: the rows are those of the whole hops made.

    Paths are exact and as many as they are, so this is for bounded neighbourhoods; :func:`reachable`
    scales to the nodes of large ones.  Each hop is a join of the paths so far and is checkpointed.
    """
    step = of_types(edges, types).select("from_id", "to_id", "edge_type")
    step = cut(both_ways(step) if direction == "both" else step)  # each hop reads the edges
    start = nodes.select("id").where(F.col("id").isin(*set(seeds))) if seeds else nodes.select("id").where("false")
    kind = nodes.schema["id"].dataType
    paths = start.select(
        F.col("id").alias("node_id"), *[F.lit(None).cast(kind).alias(c) for c in ("from_id", "to_id")],
        F.lit(None).cast("string").alias("edge_type"), F.lit(0).alias("logical_depth"), F.lit(0).alias("physical_depth"),
        F.array("id").alias("seen"),
    )
    made, began, late = [cut(paths)], clock(), False
    cost = F.when(F.col("edge_type") == config.FREE_EDGE, 0).otherwise(1)
    for hop in range(1, hops + 1):
        if deadline is not None and clock() - began > deadline:
            late = True
            break
        last = made[-1].select("node_id", F.col("logical_depth").alias("from_depth"), "seen")
        further = last.join(step, last["node_id"] == step["from_id"]).select(
            F.col("to_id").alias("node_id"), "from_id", "to_id", "edge_type", (F.col("from_depth") + cost).alias("logical_depth"),
            F.lit(hop).alias("physical_depth"), F.array_append("seen", F.col("to_id")).alias("seen"),
            F.array_contains("seen", F.col("to_id")).alias("again"),
        )
        further = cut(further.where((F.col("logical_depth") <= min(depth, config.MAX_DEPTH)) & ~F.col("again")).drop("again"))
        if further.isEmpty():
            break
        made.append(further)
    rows = reduce(DataFrame.unionByName, made)
    return rows.drop("seen").distinct(), late


def with_metadata(found: DataFrame, memories: DataFrame) -> DataFrame:
    """Nodes of a traversal (``id`` and more) with what a graph shows of them; nodes that are no memories stay bare."""
    about = memories.select("id", "memory_type", "project", "importance_score", "created_at", F.col("archived_at").isNotNull().alias("archived"))
    return found.join(about, "id", "left")


def reachable(
    edges: DataFrame,
    nodes: DataFrame,
    seeds: Sequence,
    depth: int = 2,
    types: Sequence[str] | None = None,
    hops: int = config.MAX_HOPS,
    deadline: float | None = None,
) -> tuple[DataFrame, bool]:
    """``id, logical_depth, physical_depth`` (least of each) by frontier, and whether time ran out.

    Each hop is one join of the frontier; the set so far is checkpointed, so the plan stays short
    and the hops survive lost executors.  A frontier of at most ``SENT_ROWS`` rows goes to the edges,
    which stay where they are; a larger one meets them by a shuffle.
    """
    step = of_types(edges, types).select("from_id", "to_id", "edge_type")
    cost = F.when(F.col("edge_type") == config.FREE_EDGE, 0).otherwise(1)
    start = nodes.select("id").where(F.col("id").isin(*set(seeds))) if seeds else nodes.select("id").where("false")
    known = cut(start.select("id", F.lit(0).alias("logical_depth"), F.lit(0).alias("physical_depth"), F.lit(True).alias("fresh")))
    rows, began = len(set(seeds)), time.monotonic()
    for hop in range(1, hops + 1):
        if deadline is not None and time.monotonic() - began > deadline:
            return known.drop("fresh"), True
        frontier = known.where("fresh").select("id", "logical_depth")
        frontier = F.broadcast(frontier) if rows <= SENT_ROWS else frontier
        moved = (
            frontier.join(step, frontier["id"] == step["from_id"])
            .select(F.col("to_id").alias("id"), (F.col("logical_depth") + cost).alias("now"))
            .where(F.col("now") <= min(depth, config.MAX_DEPTH))
        )
        met = known.drop("fresh").unionByName(moved, allowMissingColumns=True).groupBy("id")
        least = met.agg(F.min("logical_depth").alias("was"), F.min("physical_depth").alias("at"), F.min("now").alias("now"))
        better = F.col("now").isNotNull() & (F.col("was").isNull() | (F.col("now") < F.col("was")))
        known = cut(
            least.select(
                "id", F.least("was", "now").alias("logical_depth"), F.coalesce("at", F.lit(hop)).alias("physical_depth"),
                better.alias("fresh"),
            )
        )
        rows = known.where("fresh").count()
        if not rows:
            break
    return known.drop("fresh"), False


def summary(walked: DataFrame, hops: int = config.MAX_HOPS) -> DataFrame:
    """Depth reached, and whether the hop limit may have cut paths."""
    return walked.agg(
        F.coalesce(F.max("logical_depth"), F.lit(0)).alias("depth"),
        F.coalesce(F.bool_or(F.col("physical_depth") >= hops), F.lit(False)).alias("at_limit"),
    )


def walk_nodes(walked: DataFrame) -> DataFrame:
    """Nodes of a traversal once each, with the least physical depth at which they were met."""
    return walked.groupBy(F.col("node_id").alias("id")).agg(F.min("physical_depth").alias("depth"))


def walk_edges(walked: DataFrame) -> DataFrame:
    return walked.where("edge_type IS NOT NULL").select("from_id", "to_id", "edge_type").distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (a frame with ``id``)."""
    ends = ids.select("id").distinct()
    return edges.join(ends, F.col("from_id") == F.col("id"), "left_semi").join(
        ends, F.col("to_id") == F.col("id"), "left_semi"
    )


def layout(memories: DataFrame, limit: int = 500, order_by: str = "importance", project: str | None = None) -> DataFrame:
    """``id, label, memory_type, project`` of the most important or most recent active rows."""
    if not 1 <= limit <= 2000:
        raise ValueError("INVALID_PARAMETER: limit is 1 to 2000")
    key = {"importance": "importance_score", "recency": "created_at"}[order_by]
    rows = memories.where("archived_at IS NULL")
    if project is not None:
        rows = rows.where(F.col("project") == project)
    top = rows.select("id", "content", "memory_type", "project", key).orderBy(F.desc(key), "id").limit(limit)
    return top.select("id", F.substring("content", 1, 80).alias("label"), "memory_type", "project")


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with ``changes`` (``id, version`` and more) merged in, the latest version winning."""
    both = nodes.unionByName(changes)
    rest = [c for c in both.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("row")).select("id", "row.*")


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges with ``new`` added: the first of a key stays; with ``nodes``, only edges between them."""
    if nodes is not None:
        new = induced(new, nodes)
    both = edges.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    key = Window.partitionBy("from_id", "to_id", "edge_type").orderBy("__new")
    return both.withColumn("__n", F.row_number().over(key)).where("__n = 1").drop("__n", "__new")


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with ``new`` merged in: properties of the same key are joined, new ones winning."""
    both = edges.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    held = F.array_sort(F.collect_list(F.struct("__new", F.map_entries("props").alias("entries"))))
    merged = F.aggregate(
        held, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, x: F.map_concat(
            F.map_filter(m, lambda k, _: ~F.map_contains_key(F.map_from_entries(x["entries"]), k)),
            F.map_from_entries(x["entries"]),
        ),
    )
    return both.groupBy("from_id", "to_id", "edge_type").agg(merged.alias("props"))


def delete_nodes(edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids in ``gone`` and the edges that touch them."""
    ids = gone.select(F.col("id").alias("gone"))
    kept = edges.join(ids, F.col("from_id") == F.col("gone"), "left_anti").join(
        ids, F.col("to_id") == F.col("gone"), "left_anti"
    )
    return nodes.join(ids, F.col("id") == F.col("gone"), "left_anti"), kept
