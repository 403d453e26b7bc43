"""Near-duplicate decisions: against what is stored, and as ordered folds.

A decision depends on those before it only through rows that are similar enough, so pairs
are found by a distributed similarity join and folded in order per connected component of
the pair graph; components never influence one another.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallkit import config
from recallkit.functions.lineage import cut
from recallkit.operators import cells, vector


def decide(
    new: DataFrame,
    stored: DataFrame,
    replace: float = config.REPLACE_THRESHOLD,
    merge: float = config.MERGE_THRESHOLD,
) -> DataFrame:
    """``id, action, existing_id, similarity`` of new rows against active stored ones.

    ``new`` and ``stored`` hold ``id, embedding, project``; a row with a project looks within it,
    one without looks at all rows; one without a vector is inserted.
    """
    near = vector.nearest(
        new.where("embedding IS NOT NULL AND project IS NULL").select("id", "embedding"),
        stored.where("embedding IS NOT NULL").select("id", "embedding"),
        1,
    )
    scoped = _nearest_in_project(new, stored)
    best = near.select("query_id", "id", "score").unionByName(scoped)
    best = best.select(F.col("query_id").alias("q"), F.col("id").alias("existing_id"), F.col("score").alias("similarity"))
    action = (
        F.when(F.col("similarity") >= replace, "REPLACE")
        .when(F.col("similarity") >= merge, "MERGE_CANDIDATE")
        .otherwise("INSERT")
    )
    joined = new.select("id").join(best, F.col("id") == F.col("q"), "left").withColumn("action", action)
    existing = F.when(F.col("action") != "INSERT", F.col("existing_id"))
    return joined.select("id", "action", existing.alias("existing_id"), "similarity")


def _nearest_in_project(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``query_id, id, score`` of the nearest stored row of each new row's project, whatever its score."""
    names = ["id", "embedding", "project"]
    new, stored = (x.where("project IS NOT NULL").select(*names) for x in (new, stored))
    return cells.near_rows(new, stored, -1.0, 1, scope="project")


def _components(pairs: DataFrame) -> DataFrame:
    """``id, root`` (the least id reachable) by least neighbours and doubling jumps along roots.

    Rounds grow with the logarithm of the longest path; each is checkpointed.
    """
    both = pairs.select("id_a", "id_b").unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    both = cut(both.distinct())
    roots = cut(both.select(F.col("id_a").alias("id")).distinct().withColumn("root", F.col("id")))
    while True:
        seen = both.join(roots.withColumnRenamed("id", "id_b"), "id_b").groupBy("id_a").agg(F.min("root").alias("near"))
        near = cut(
            roots.join(seen, F.col("id") == F.col("id_a")).select(
                "id", F.col("root").alias("was"), F.least("root", "near").alias("root")
            )
        )
        further = near.select(F.col("id").alias("over"), F.col("root").alias("next"))
        moved = cut(near.join(further, F.col("root") == F.col("over")).select("id", "was", F.least("root", "next").alias("root")))
        roots = moved.select("id", "root")
        if moved.where("was <> root").isEmpty():
            return roots


#: Rows of small components that one task folds, on average; pairs of a component that is folded in rounds.
GROUP_ROWS = 5_000
ROUND_PAIRS = 500_000


def _grouped(rows: DataFrame, root: str, groups: int) -> DataFrame:
    return rows.withColumn("group", F.pmod(F.xxhash64(root), F.lit(groups)).cast("int"))


def _fold(rows: DataFrame, replace: float, merge: float) -> DataFrame:
    """``id, action, existing_id, similarity`` of the new rows that have a similar row before them.

    ``rows``: ``id, embedding, place, project, is_new``, ids distinct.  New rows come in order of (place, id),
    after all others; each is compared with the rows before it that no replacement has archived,
    within its project if it has one, and a replacement archives its match.  Equal vectors of a project are
    one node of the pair graph, named by its least id, so a component costs its rows and the pairs of
    different vectors.  Small components are folded many a task; one of over ``ROUND_PAIRS`` pairs in rounds.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows = cut(rows.where("embedding IS NOT NULL"))
    # equal vectors once; a vector that no new row has or is near to takes no part
    named = rows.groupBy(cells.vector_key().alias("key"), "project").agg(
        F.min("id").alias("node"), F.first("embedding").alias("embedding"), F.bool_or("is_new").alias("fresh"), F.count("*").alias("n")
    )
    nodes = cut(named)
    keyed = rows.withColumn("key", cells.vector_key()).drop("embedding").alias("r").join(
        nodes.select("key", "project", "node", "n").alias("n"), (F.col("r.key") == F.col("n.key")) & F.col("r.project").eqNullSafe(F.col("n.project"))
    )
    keyed = cut(keyed.select("node", "n", "r.id", "r.place", "r.is_new"))
    apart = nodes.select(F.col("node").alias("id"), "embedding", "project", "fresh")
    met = cells.near_rows(apart.where("fresh").drop("fresh"), apart.drop("fresh"), merge, scope="project")
    met = cut(met.select(F.col("query_id").alias("node"), F.col("id").alias("other"), "score"))
    pairs = met.where("node <> other").select(F.least("node", "other").alias("id_a"), F.greatest("node", "other").alias("id_b"))
    rooted = _components(pairs).withColumnRenamed("id", "node")
    # a vector that stands alone in one row has nothing to be compared with
    members = cut(keyed.join(rooted, "node", "left").where("root IS NOT NULL OR n > 1").select("node", "id", "place", "is_new", F.coalesce("root", "node").alias("root")))
    roots = members.groupBy("node").agg(F.first("root").alias("root"))
    met = cut(met.join(roots, "node"))
    large = met.groupBy("root").agg(F.count("*").alias("pairs")).where(F.col("pairs") > ROUND_PAIRS).select("root")
    large = cut(large)
    found = _fold_small(members.join(large, "root", "left_anti"), met.join(large, "root", "left_anti"), replace, kind)
    if large.isEmpty():
        return found
    return found.unionByName(_fold_in_rounds(members.join(large, "root", "left_semi"), met.join(large, "root", "left_semi"), replace))


def _fold_small(members: DataFrame, met: DataFrame, replace: float, kind: str) -> DataFrame:
    """The fold of components (``root``) that each fit a task: rows by node, and what each node finds."""

    def run(part: pd.DataFrame, near_part: pd.DataFrame) -> list[tuple]:
        near: dict = {}
        for node, other, score in zip(near_part["node"], near_part["other"], near_part["score"]):
            near.setdefault(node, {}).setdefault(score, []).append(other)
        live: dict = {}  # least live ids of a node
        archived, found = set(), []

        def least(node):
            heap = live.get(node, [])
            while heap and heap[0] in archived:
                heapq.heappop(heap)
            return heap[0] if heap else None

        for row in part[~part["is_new"]].itertuples(index=False):
            heapq.heappush(live.setdefault(row.node, []), row.id)
        for row in part[part["is_new"]].sort_values(["place", "id"]).itertuples(index=False):
            levels = near.get(row.node, {})
            for score in sorted(levels, reverse=True):
                others = [o for o in map(least, levels[score]) if o is not None]
                if others:
                    other = min(others)
                    action = "REPLACE" if score >= replace else "MERGE_CANDIDATE"
                    if action == "REPLACE":
                        archived.add(other)
                    found.append((row.id, action, other, score))
                    break
            heapq.heappush(live.setdefault(row.node, []), row.id)
        return found

    def fold_all(part: pd.DataFrame, near_part: pd.DataFrame) -> pd.DataFrame:
        # components do not meet, so those of a task are folded as one
        return pd.DataFrame(run(part, near_part), columns=["id", "action", "existing_id", "similarity"])

    groups = max(1, members.count() // GROUP_ROWS)
    schema = f"id {kind}, action string, existing_id {kind}, similarity double"
    left, right = _grouped(members, "root", groups), _grouped(met, "root", groups)
    return left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(fold_all, schema)


def _fold_in_rounds(members: DataFrame, met: DataFrame, replace: float) -> DataFrame:
    """The fold of large components, as many rounds as replacements displace one another.

    Each new row has its list of rows before it, best first.  It asks for the first that no row before it
    is known to replace; of the rows that ask to replace one, the first in order holds it, and the others go on
    down their lists.  Holders only become earlier, so what is refused stays refused, and when none is
    refused every row has what it gets one after the other.
    """
    old = members.select(F.col("node").alias("other"), F.col("id").alias("existing_id"), F.col("place").alias("p"), F.col("is_new").alias("late"))
    own = members.where("is_new").select("node", "id", F.struct("place", "id").alias("turn"))
    lists = own.join(met.select("node", "other", "score"), "node").join(old, "other")
    lists = lists.where(~F.col("late") | (F.struct(F.col("p").alias("place"), F.col("existing_id").alias("id")) < F.col("turn")))
    lists = cut(lists.select("id", "turn", "score", "existing_id"))
    pick = F.min(F.struct((-F.col("score")).alias("worse"), "existing_id")).alias("pick")
    asked = cut(lists.groupBy("id").agg(F.first("turn").alias("turn"), pick))
    while True:
        wants = asked.select("id", "turn", F.col("pick.existing_id").alias("existing_id"), (-F.col("pick.worse")).alias("score"))
        held = cut(wants.where(F.col("score") >= replace).groupBy(F.col("existing_id").alias("of")).agg(F.min("turn").alias("holder")))
        refused = cut(wants.join(held, (F.col("existing_id") == F.col("of")) & (F.col("holder") < F.col("turn"))).select("id"))
        if refused.isEmpty():
            break
        free = lists.join(refused, "id", "left_semi").join(held, (F.col("existing_id") == F.col("of")) & (F.col("holder") < F.col("turn")), "left_anti")
        again = free.groupBy("id").agg(F.first("turn").alias("turn"), pick)
        asked = cut(asked.join(refused, "id", "left_anti").unionByName(again))
    action = F.when(F.col("score") >= replace, "REPLACE").otherwise("MERGE_CANDIDATE")
    return wants.select("id", action.alias("action"), "existing_id", F.col("score").alias("similarity"))


def _with_inserts(new: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` and an INSERT for each row of ``new`` that is not in it."""
    return new.select("id").join(found, "id", "left").withColumn("action", F.coalesce("action", F.lit("INSERT")))


def fold(
    memories: DataFrame,
    replace: float = config.REPLACE_THRESHOLD,
    merge: float = config.MERGE_THRESHOLD,
) -> DataFrame:
    """``id, action, existing_id`` of rows ingested in order of (created_at, id)."""
    rows = memories.select("id", "embedding", F.col("created_at").alias("place"), "project", F.lit(True).alias("is_new"))
    return _with_inserts(memories, _fold(rows, replace, merge).select("id", "action", "existing_id"))


def decide_batch(
    new: DataFrame,
    stored: DataFrame,
    replace: float = config.REPLACE_THRESHOLD,
    merge: float = config.MERGE_THRESHOLD,
) -> DataFrame:
    """As :func:`decide`, with the new rows taken one after the other in order of (place, id).

    ``new``: ``id, embedding, project, place``; ``stored``: ``id, embedding, project``.  A new row
    may replace one of its own batch, and nothing is replaced twice.
    """
    rows = new.select("id", "embedding", "place", "project", F.lit(True).alias("is_new"))
    before = F.lit(None).cast(new.schema["place"].dataType).alias("place")
    old = stored.select("id", "embedding", before, "project", F.lit(False).alias("is_new"))
    return _with_inserts(new, _fold(rows.unionByName(old), replace, merge))


def consolidate(
    memories: DataFrame,
    heal: float = config.REPLACE_THRESHOLD,
    merge: float = config.MERGE_THRESHOLD,
    k: int = config.DEDUP_TOP_K,
    visitors: DataFrame | None = None,
) -> DataFrame:
    """``id, survivor, stage``: rows that consolidation archives, and the newer row that stays.

    ``visitors`` (``id``) are the rows that look around, all by default: a page of them at a time,
    in order, each on what the pages before left, gives what one run gives.

    Rows are visited in order of (created_at, id); each looks at its ``k`` nearest active rows of
    all projects, itself among them, keeps those of its own project, and archives the older of
    each pair: first pairs at ``heal`` or more, then those at ``merge``.  Neighbours below
    ``merge`` only fill places among the ``k``; a row's list is cut again as rows are archived.
    """
    # equal vectors of a project once; rows without a project have one of their own
    of = F.coalesce(F.concat(F.lit("="), F.col("project").cast("string")), F.lit(""))
    active = memories.where("archived_at IS NULL AND embedding IS NOT NULL").select("id", "created_at", of.alias("of"), "embedding")
    if visitors is None:
        active = active.withColumn("visits", F.lit(True))
    else:
        own = visitors.select("id").distinct().withColumn("visits", F.lit(True))
        active = active.join(own, "id", "left").fillna(False, ["visits"])
    active = cut(active.withColumn("key", cells.vector_key()))
    turn = F.struct("created_at", "id")
    nodes = active.groupBy("key", "of").agg(
        F.min("id").alias("node"), F.first("embedding").alias("embedding"), F.count("*").alias("n"),
        F.max(turn).alias("last"), F.max(F.when(F.col("visits"), turn)).alias("seen"),
    )
    nodes = cut(nodes)
    rows = active.drop("embedding").join(nodes.select("key", "of", "node"), ["key", "of"]).drop("key")

    def newer(left: pd.DataFrame, right: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at, before = (x[c].to_numpy() for x, c in ((right, "v_at"), (left, "q_at")))
        tie, under = (x[c].to_numpy() for x, c in ((right, "v_last"), (left, "q_last")))
        after = (at[j] > before[i]) | ((at[j] == before[i]) & (tie[j] > under[i]))
        return after & (right["v_of"].to_numpy()[j] == left["q_of"].to_numpy()[i])

    def side(which: str) -> DataFrame:
        return nodes.select(F.col("node").alias("id"), "embedding", "of", F.col(f"{which}.created_at").alias("at"), F.col(f"{which}.id").alias("last"))

    looking = nodes.where("seen IS NOT NULL").select("node")
    asks = side("seen").join(looking, F.col("id") == F.col("node"), "left_semi")
    lists = cells.near_rows(asks, side("last"), merge, upto=newer).select(F.col("query_id").alias("node"), F.col("id").alias("other"), "score")
    # a vector that is near to none and stands alone in one row does nothing
    lists = lists.join(nodes.select("node", "n"), "node").where("node <> other OR n > 1").drop("n")
    return _consolidate_in_turns(rows, cut(lists), heal, k, memories.schema["id"].dataType.simpleString())


#: Entries of the lists that one task of a consolidation goes through, on average.
TURN_ENTRIES = 1_000_000


def _turns(rows: DataFrame, lists: DataFrame) -> tuple[DataFrame, int]:
    """Visiting rows in order of (created_at, id), dealt to ranges (``turn``) of some ``TURN_ENTRIES`` entries, and how many."""
    weights = lists.groupBy("node").agg(F.count("*").alias("entries"))
    visits = rows.where("visits").join(weights, "node")
    placed = visits.repartitionByRange("created_at", "id").withColumn("part", F.spark_partition_id())
    placed = cut(placed.select("part", "created_at", "id", "node", "entries"))
    sums = sorted(placed.groupBy("part").agg(F.sum("entries").alias("n")).collect())  # a row a partition
    before, total = {}, 0
    for part, n in sums:
        before[part] = total
        total += n
    if not total:
        return placed.select("id", "node", F.lit(0).alias("turn")), 0
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    order = Window.partitionBy("part").orderBy("created_at", "id")
    place = offset[F.col("part")] + F.sum("entries").over(order) - 1
    return placed.select("id", "node", F.floor(place / TURN_ENTRIES).cast("int").alias("turn")), int((total - 1) // TURN_ENTRIES) + 1


def _consolidate_in_turns(rows: DataFrame, lists: DataFrame, heal: float, k: int, kind: str) -> DataFrame:
    """The visits of a consolidation, range by range in order; each range is one task on what those before left.

    A visit archives older rows and the visiting row itself, so whoever is newer is alive, and a list that ends
    at the first newer row of the project holds all that a visit can come to.  ``rows``: ``id, created_at, of,
    visits, node``; ``lists``: ``node, other, score``.
    """
    dealt, turns = _turns(rows, lists)
    dealt, schema = cut(dealt), f"id {kind}, survivor {kind}, stage string"
    done = rows.sparkSession.createDataFrame([], schema)

    def run(part: pd.DataFrame, near_part: pd.DataFrame) -> pd.DataFrame:
        live: dict = {}  # heaps of the ids of a node
        about = {}
        for r in part.itertuples(index=False):
            about[r.id] = (r.created_at, r.id, r.of)
            live.setdefault(r.node, []).append(r.id)
        for ids in live.values():
            heapq.heapify(ids)
        near_part = near_part.sort_values(["node", "score"], ascending=[True, False])
        names, others, scores = (near_part[c].to_numpy() for c in ("node", "other", "score"))
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
        spans = {names[a]: (a, b) for a, b in zip(starts, [*starts[1:], len(names)])}
        gone: dict = {}

        def least(node: object) -> list:
            """The first rows of a node that are not archived: more than ``k`` cannot count."""
            heap, taken = live.get(node, []), []
            while heap and len(taken) <= k:
                first = heapq.heappop(heap)
                if first not in gone:
                    taken.append(first)
            for first in taken:
                heapq.heappush(heap, first)
            return taken

        visits = part[part["turns"]]
        for now, node in sorted(zip(visits["id"], visits["node"]), key=lambda v: about[v[0]][:2]):
            if now in gone:
                continue
            # itself takes a place among the k
            met, (a, b) = [(-1.0, now)], spans[node]
            while a < b and len(met) < k + 1:
                score = scores[a]
                while a < b and scores[a] == score:
                    met += [(-score, o) for o in least(others[a]) if o != now]
                    a += 1
            for s, other in sorted(met)[:k]:
                if other == now or about[other][2] != about[now][2]:
                    continue
                stage = "self-healing" if -s >= heal else "consolidation"
                if about[other][:2] > about[now][:2]:
                    gone[now] = (other, stage)
                    break
                gone[other] = (now, stage)
        found = [(old, new, stage) for old, (new, stage) in gone.items()]
        return pd.DataFrame(found, columns=["id", "survivor", "stage"])

    for turn in range(turns):
        here = dealt.where(F.col("turn") == turn)
        near = lists.join(here.select("node").distinct(), "node", "left_semi")
        ends = near.select("other").union(near.select("node")).distinct()
        alive = rows.join(ends, F.col("node") == F.col("other"), "left_semi").join(done.select("id"), "id", "left_anti")
        alive = alive.join(here.select("id", F.lit(True).alias("turns")), "id", "left").fillna(False, ["turns"])
        left, right = (x.withColumn("one", F.lit(0)) for x in (alive.drop("visits"), near))
        found = left.groupBy("one").cogroup(right.groupBy("one")).applyInPandas(run, schema)
        done = cut(done.unionByName(found))
    return done
