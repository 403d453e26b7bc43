"""Hybrid search: vector, keyword and graph hits in one plan, fused, filtered, cut."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from recallkit import config
from recallkit.config import SearchStrategy
from recallkit.functions.lineage import cut
from recallkit.operators import fusion, graph, keyword, vector
from recallkit.operators.filters import clamp_max_tokens, clamp_top_k
from recallkit.sources.index import Index

Policy = Callable[[str, SearchStrategy], SearchStrategy]


def graph_hits(
    memories: DataFrame, edges: DataFrame, seeds: Sequence, depth: int, types: Sequence[str] | None = None,
    seconds: float | None = None, flags: list[str] | None = None,
) -> DataFrame:
    """``id, source, rank`` of the nodes a traversal meets (seeds included), by depth, seed order and id.

    Nodes that are no memories are left out.  No hop starts after ``seconds``; what was met by then ranks.
    """
    step = cut(edges.select("from_id", "to_id", "edge_type"))  # each hop reads the edges
    found, late = graph.reachable(step, memories.select("id"), seeds, depth, types, deadline=seconds)
    if late and flags is not None:
        flags.append("graph:timed_out")
    met = found.select("id", F.col("physical_depth").alias("depth")).join(memories.select("id"), "id", "left_semi")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, seeds)), F.col("id")), F.lit(0)) if seeds else F.lit(0)
    order = Window.orderBy("depth", place, "id")
    return met.select("id", F.lit("graph").alias("source"), (F.row_number().over(order) - 1).alias("rank"))


def search(
    memories: DataFrame,
    edges: DataFrame,
    query: str,
    query_vector: Sequence[float],
    now: str,
    project: str | None = None,
    memory_type: str | None = None,
    top_k: int = config.TOP_K,
    max_tokens: int | None = None,
    strategy: SearchStrategy | None = None,
    policy: Policy | None = None,
    pushdown_project: bool = False,
    with_total: bool = False,
    index: Index | None = None,
    degrade: bool = False,
    graph_seconds: float | None = None,
    flags: list[str] | None = None,
    observed: dict[str, Observation] | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """``id, rrf_score, final_score, source`` of the best ``top_k`` rows.

    ``with_total`` adds ``total_count``, the fused rows that passed the filters before the cut.

    A source of weight 0 is not planned.  The project is tested after fusion unless
    ``pushdown_project`` asks for it within each source.  With ``index`` the keyword source reads
    stored postings.  With ``degrade`` a source that fails is logged and gives no hits.
    ``flags`` gets what was cut short: ``graph:timed_out``, and ``<source>:failed``.
    ``texts`` (``id, content``) holds the texts, if ``memories`` are a join that should not move them.
    ``observed`` gets an observation of each source's hits (``n``), filled as they are worked out.
    """
    strategy = strategy or SearchStrategy()
    if policy is not None:
        strategy = policy(query, strategy)
    if max(strategy.vector, strategy.keyword) <= 0:
        raise ValueError("a search needs a source of positive weight")
    k, scope = clamp_top_k(top_k), project if pushdown_project else None
    none = memories.select("id", F.lit("").alias("source"), F.lit(0).alias("rank")).where("false")

    def counted(name: str, found: DataFrame) -> DataFrame:
        if observed is None:
            return found
        observed[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return found.observe(observed[name], F.count(F.lit(1)).alias("n"))

    def hits(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not degrade:
            return counted(name, make())
        try:
            return cut(counted(name, make()))
        except Exception as error:
            if observed is not None:
                observed.pop(name, None)
            logging.getLogger(__name__).error("the %s source of a search failed: %s", name, error)
            if flags is not None:
                flags.append(f"{name}:failed")
            return none

    lists, seeds = [], []
    if strategy.vector > 0:
        # ten rows, read twice
        nearest = hits("vector", lambda: fusion.ranked(cut(vector.top_k(memories, query_vector, config.TOP_K, scope)), "vector"))
        lists.append(nearest)
        if strategy.graph > 0:
            seeds = [r["id"] for r in nearest.where(F.col("rank") < config.SEED_COUNT).orderBy("rank").collect()]  # three rows
    if strategy.keyword > 0:
        lists.append(hits("keyword", lambda: _keyword_ranks(memories, query, scope, index, texts)))
    if seeds:
        lists.append(hits("graph", lambda: graph_hits(memories, edges, seeds, strategy.depth, seconds=graph_seconds, flags=flags)))
    fused = fusion.fuse(reduce(DataFrame.unionByName, lists), memories, strategy, now)
    if project is not None:
        fused = fused.where(F.col("project") == project)
    if memory_type is not None:
        kinds = memories.where(F.col("memory_type") == memory_type).select("id")
        fused = fused.join(kinds, "id", "left_semi")
    best = fused.orderBy(F.desc("final_score"), "id").limit(k)
    best = fusion.within_budget(best, memories if texts is None else texts, clamp_max_tokens(max_tokens))
    names = ["id", "rrf_score", "final_score", "source"]
    if not with_total:
        return best.select(*names)
    return best.select(*names).crossJoin(fused.agg(F.count("*").alias("total_count")))  # one row


def _keyword_ranks(
    memories: DataFrame, query: str, project: str | None, index: Index | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Keyword hits with their rank; a blank query ranks by time."""
    if query.strip():
        if index is not None:
            return fusion.ranked(index.bm25(memories, query, config.TOP_K, project), "keyword")
        return fusion.ranked(keyword.bm25(memories, query, config.TOP_K, project, texts), "keyword")
    rows = keyword.all_rows(memories, config.TOP_K, project).join(memories.select("id", "created_at"), "id")
    order = Window.orderBy(F.desc("created_at"), F.desc("id"))
    return rows.select("id", F.lit("keyword").alias("source"), (F.row_number().over(order) - 1).alias("rank"))


def search_graph(
    memories: DataFrame,
    edges: DataFrame,
    query: str,
    query_vector: Sequence[float],
    now: str,
    edge_types: Sequence[str] | None = None,
    depth: int = 2,
    project: str | None = None,
    strict: bool = False,
    index: Index | None = None,
    degrade: bool = False,
) -> DataFrame:
    """Search for five rows; ``strict`` honours edge types and depth, which are ignored otherwise."""
    how = {"top_k": 5, "index": index, "degrade": degrade}
    if not strict:
        return search(memories, edges, query, query_vector, now, project, **how)
    chosen = graph.of_types(edges, edge_types)
    strategy = SearchStrategy(depth=depth)
    return search(memories, chosen, query, query_vector, now, project, strategy=strategy, **how)


def response(results: DataFrame, memories: DataFrame) -> DataFrame:
    """Rows as the tool returns them: ``memory_id, content, score, source_type, metadata``."""
    shown = memories.select("id", "content", F.col("source_metadata").alias("metadata"))
    rows = results.join(shown, "id").select(
        F.col("id").cast("string").alias("memory_id"), "content", F.col("final_score").alias("score"),
        F.col("source").alias("source_type"), "metadata",
    )
    return rows.orderBy(F.desc("score"), "memory_id")  # top_k rows


def answer(
    query: str, strategy: SearchStrategy, results: DataFrame, memories: DataFrame, flags: Sequence[str] = ()
) -> DataFrame:
    """One row: ``query, strategy, total_count, results, flags`` of a search made ``with_total``."""
    shown = response(results, memories)
    best_first = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(
        a["memory_id"] < b["memory_id"], -1
    ).otherwise(1)
    listed = shown.agg(F.array_sort(F.collect_list(F.struct(*shown.columns)), best_first).alias("results"))  # at most top_k rows
    total = results.agg(F.coalesce(F.max("total_count"), F.lit(0)).alias("total_count"))
    weights = F.struct(*[F.lit(getattr(strategy, n)).alias(n) for n in ("vector", "keyword", "graph", "depth", "time_decay")])
    return listed.crossJoin(total).select(F.lit(query).alias("query"), weights.alias("strategy"), "total_count", "results",
                                           F.array(*map(F.lit, flags)).cast("array<string>").alias("flags"))
