"""Similarity joins over cells: blocks of vectors that can hold no near pair never meet.

Vectors fall to the nearest of a few thousand centroids (fitted on a bounded sample; which ones
they are changes the work, not the result).  On the unit sphere angles obey the triangle
inequality, so a vector can only have a neighbour within an angle in the cells whose centroid
is nearer than that angle and the cell's radius.  Rows are sent to those cells alone, cells of
many rows are dealt in parts, and a pair of parts is one task's matrix products, tile by tile, that
give at most ``k`` rows of each query.  Where vectors have no clusters, and most cells are in
reach, there is one cell, and this is the join by blocks.

Tiles are multiplied in single precision; what may reach the threshold, with room for the error,
is worked out again in double precision, so results are those of double precision throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.functions.lineage import cut

#: Rows that the centroids are fitted on, at most; rows of a cell on average; cells, at most.
FIT_ROWS = 20_000
CELL_ROWS = 2048
MAX_CELLS = 4096
#: Rows of a part of a cell, on average; with ``k`` twice as many, and up to four times in tables of many parts.
PART_ROWS = 8192
#: Queries and vectors of one matrix product.
TILE = (1024, 2048)
#: Over this share of the cells in reach of a cell on average, cells are not worth their blocks.
MAX_REACH = 0.25
_SLACK = 1e-6

#: Of a tile's queries and vectors, which vectors each query may find (a matrix of truth).
Visible = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
#: Of a block's queries and vectors at two lists of positions, which pairs may be found.
Allowed = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]


def unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    return x / np.where(length == 0, 1, length)


def vector_key(embedding: str = "embedding") -> F.Column:
    """128 bits that equal vectors share."""
    halves = [F.hex(F.xxhash64(F.lit(seed), F.col(embedding))) for seed in (1, 2)]
    return F.concat_ws("-", *halves)


def fit(vectors: DataFrame, cells: int | None = None, seed: int = 7, rounds: int = 5) -> np.ndarray:
    """Unit centroids of ``vectors`` (``id, embedding``), from ``FIT_ROWS`` rows by hash at most."""
    n = vectors.count()
    cells = cells or min(MAX_CELLS, max(1, n // CELL_ROWS))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = vectors if n <= FIT_ROWS else vectors.where(draw < int(0.95 * FIT_ROWS / n * (1 << 30)))
    rows = sample.select("id", "embedding").limit(FIT_ROWS).toPandas().sort_values("id")
    if not len(rows):
        return np.zeros((1, 1))
    x = unit(rows["embedding"])
    start = np.random.default_rng(seed).choice(len(x), size=min(cells, len(x)), replace=False)
    centroids = x[np.sort(start)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length == 0, 1, length), centroids)
    return centroids


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def _sizes(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radius and number of rows of each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x = unit(rows["embedding"])
                angles = _angles(x, centroids)
                own = angles.argmin(axis=1)
                angle = np.where(np.abs(x).any(axis=1), angles[np.arange(len(x)), own], 0.0)
                yield pd.DataFrame({"cell": own.astype(np.int32), "angle": angle})

    found = vectors.select("embedding").mapInPandas(run, "cell int, angle double")
    radius, counts = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=int)
    for row in found.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # a row a cell
        radius[row["cell"]], counts[row["cell"]] = row["radius"], row["n"]
    return radius, counts


def _sent(
    rows: DataFrame, side: str, centroids: np.ndarray, reach: float, own_parts: np.ndarray, radius: np.ndarray, parts: np.ndarray
) -> DataFrame:
    """Rows with the blocks they go to: their own cell and part, and those of the other side in reach."""
    added = [T.StructField("own", T.IntegerType()), T.StructField("own_part", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*rows.schema, *added])
    filled = np.flatnonzero(parts).astype(np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            angles = _angles(unit(part["embedding"]), centroids)
            own = angles.argmin(axis=1)
            dealt = pd.util.hash_array(part["id"].to_numpy()) % np.maximum(own_parts[own], 1).astype(np.uint64)
            near = angles[:, filled] <= reach + radius[filled] + _SLACK
            yield part.assign(own=own.astype(np.int32), own_part=dealt.astype(np.int32), cells=[filled[x] for x in near])

    names = [F.col(c).alias(f"{side}_{c}") for c in rows.columns]
    own = [F.col("own").alias("own"), F.col("own_part").alias("own_part")]
    of = F.array(*[F.lit(int(n)) for n in parts])  # parts of each cell
    sent = rows.mapInPandas(run, schema).select(*names, *own, F.explode("cells").alias("far"))
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), of[F.col("far")] - 1)).alias("far_part"))
    first, second = ("own", "far") if side == "q" else ("far", "own")
    keys = [first, f"{first}_part", second, f"{second}_part"]
    return sent.select(*[f"{side}_{c}" for c in rows.columns], *[F.col(c).alias(f"{side}{i}") for i, c in enumerate(keys)])


def _dealt(queries: DataFrame, vectors: DataFrame, scope: str, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to the pairs of parts of each scope; scopes that only one side has meet nothing."""
    def sized(rows: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count("*") / part_rows).cast("int").alias(name)
        return rows.groupBy(F.col(scope).alias("__scope")).agg(n)

    parts = cut(sized(queries, "__q").join(sized(vectors, "__v"), "__scope"))  # a row a scope

    def side(rows: DataFrame, side: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col(f"__{side}")).cast("int")
        far = F.explode(F.sequence(F.lit(0), F.col(f"__{other}") - 1))
        names = [F.col(c).alias(f"{side}_{c}") for c in rows.columns]
        met = rows.join(parts, F.col(scope) == F.col("__scope")).select(*names, F.col("__scope").alias(f"{side}0"), part.alias("own"), far.alias("far"))
        first, second = ("own", "far") if side == "q" else ("far", "own")
        return met.select(*[f"{side}_{c}" for c in rows.columns], f"{side}0", F.col(first).alias(f"{side}1"), F.col(second).alias(f"{side}2"))

    return side(queries, "q", "v"), side(vectors, "v", "q")


def _part_rows(rows: int, k: int | None) -> int:
    """Rows of a part, of so many.  What is moved and ranked grows with their number, so with ``k`` there are fewer in large tables."""
    return PART_ROWS if k is None else PART_ROWS * min(4, max(2, rows // (8 * PART_ROWS)))


def _places(over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, in order; few are, so eight cells are looked at together."""
    flat = over.ravel()
    whole = flat.size - flat.size % 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (8 * words[:, None] + np.arange(8))[flat[:whole].reshape(-1, 8)[words]]
    return np.divmod(np.concatenate((at, whole + np.flatnonzero(flat[whole:]))), over.shape[1])


def _scores(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Scores of pairs of a tile's rows, in double precision."""
    if 16 * len(i) > most:
        return np.round((x @ y.T)[i, j], 6)
    return np.round(np.einsum("ij,ij->i", x[i], y[j]), 6)


def _best(held: tuple, found: tuple, floor: np.ndarray, k: int, slack: float) -> tuple:
    """The ``k`` best of each query of those held and those found (query, other, score); full lists raise the query's floor."""
    i, j, score = (np.concatenate(z) for z in zip(held, found))
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(floor)))[i]
    full = place == k - 1
    floor[i[full]] = np.maximum(floor[i[full]], score[full] - slack)
    return tuple(z[place < k] for z in (i, j, score))


def _found(
    left: pd.DataFrame, right: pd.DataFrame, threshold: float, k: int | None, visible: Visible | None, allowed: Allowed | None, upto: Allowed | None = None,
    mirror: bool = False,
):
    """Positions and scores of a block's pairs at the threshold, the ``k`` best of each query; ``right`` in order of id.

    With ``upto``, none worse than the best that ends its query's list, and a fourth array: which ones end it.
    With ``mirror``, and ``left`` in order of id too, what the rows of ``right`` find in ``left`` follows (three
    more arrays, of positions in ``right`` and ``left``): one product serves both sides.
    """
    x, y = unit(left["q_embedding"]), unit(right["v_embedding"])
    low, narrow = x.astype(np.float32), y.astype(np.float32)
    slack = 1e-5 + 2.4e-7 * x.shape[1]
    rows, columns, values, last = [], [], [], []
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    starts = range(0, len(y), TILE[1])
    back = {c: nothing for c in starts}
    back_floor = {c: np.full(min(TILE[1], len(y) - c), threshold - slack, np.float32) for c in starts}
    # every product is written to the same place: fresh memory for each costs more than the product
    most = min(TILE[0], len(x)) * min(TILE[1], len(y))
    products, truths = np.empty(most, np.float32), np.empty(most, bool)
    for a in range(0, len(x), TILE[0]):
        b = min(a + TILE[0], len(x))
        floor = np.full(b - a, threshold - slack, np.float32)
        end = np.full(b - a, -np.inf)
        held = nothing
        for c in starts:
            d = min(c + TILE[1], len(y))
            size, shape = (b - a) * (d - c), (b - a, d - c)
            about = np.matmul(low[a:b], narrow[c:d].T, out=products[:size].reshape(shape))
            if visible is not None:
                about[~visible(left.iloc[a:b], right.iloc[c:d])] = -np.inf
            over = truths[:size].reshape(shape)
            if mirror:
                np.greater_equal(about, back_floor[c], out=over)
                if k < b - a and np.count_nonzero(over) > 8 * k * (d - c):
                    back_floor[c] = np.maximum(back_floor[c], np.partition(about, -k, axis=0)[-k] - 2 * slack)
                    np.greater_equal(about, back_floor[c], out=over)
                i, j = _places(over)
                if len(i):
                    score = _scores(x[a:b], y[c:d], i, j, size)
                    keep = score >= threshold
                    back[c] = _best(back[c], (j[keep], i[keep] + a, score[keep]), back_floor[c], k, slack)
            np.greater_equal(about, floor[:, None], out=over)
            if k is not None and allowed is None and k < d - c and np.count_nonzero(over) > 8 * k * (b - a):
                floor = np.maximum(floor, np.partition(about, -k, axis=1)[:, -k] - 2 * slack)
                np.greater_equal(about, floor[:, None], out=over)
            i, j = _places(over)
            if not len(i):
                continue
            if allowed is not None:
                may = allowed(left, right, i + a, j + c)
                i, j = i[may], j[may]
            score = _scores(x[a:b], y[c:d], i, j, size)
            keep = score >= threshold
            i, j, score = i[keep], j[keep] + c, score[keep]
            if upto is not None:
                ends = upto(left, right, i + a, j)
                np.maximum.at(end, i[ends], score[ends])
                floor = np.maximum(floor, (end - slack).astype(np.float32))
                keep = score >= end[i]
                rows.append(i[keep] + a), columns.append(j[keep]), values.append(score[keep]), last.append(ends[keep])
                continue
            if k is None:
                rows.append(i + a), columns.append(j), values.append(score)
                continue
            held = _best(held, (i, j, score), floor, k, slack)
        if k is not None:
            rows.append(held[0] + a), columns.append(held[1]), values.append(held[2])
    none = [np.zeros(0, np.int64)]
    found = np.concatenate(rows or none), np.concatenate(columns or none), np.concatenate(values or [np.zeros(0)])
    if mirror:
        met = [(back[c][0] + c, back[c][1], back[c][2]) for c in starts]
        return (*found, *(np.concatenate(z) for z in zip(nothing, *met)))
    return found if upto is None else (*found, np.concatenate(last or [np.zeros(0, bool)]))


def near_rows(
    queries: DataFrame,
    vectors: DataFrame,
    threshold: float,
    k: int | None = None,
    visible: Visible | None = None,
    once: bool = False,
    centroids: np.ndarray | None = None,
    scope: str | None = None,
    allowed: Allowed | None = None,
    upto: Allowed | None = None,
) -> DataFrame:
    """``query_id, id, score`` of vectors at a cosine of ``threshold`` or more, the ``k`` best of each query.

    Exact.  Both sides hold ``id, embedding`` and what ``visible`` and ``allowed`` look at (their frames
    have the columns of the queries as ``q_*`` and of the vectors as ``v_*``): the first says for all pairs
    of a tile which may be found, the second for those that reach the threshold.  With ``scope``, a column
    of both, a query finds the vectors of its scope alone, one without finds all, and scopes do not meet.
    ``upto`` says of pairs which end a query's list: rows of a lower score than such a one are left out.
    ``once``: the sides are the same rows, and each pair is wanted one way, ``query_id < id``.  Where they are the
    same rows, a pair of blocks meets once in any case.  Scores have six places; ties go by id.  Rows without a vector find nothing; a null vector of zeros has score 0.
    """
    alike = queries is vectors
    queries = cut(queries.where("embedding IS NOT NULL"))
    vectors = queries if alike else cut(vectors.where("embedding IS NOT NULL"))
    if scope is not None:
        bound, free = (queries.where(F.col(scope).isNotNull()), queries.where(F.col(scope).isNull()))
        a, b = _dealt(bound, vectors.where(F.col(scope).isNotNull()), scope, _part_rows(0, k))
        found = _met(a, b, 3, threshold, k, visible, once, allowed, queries.schema["id"].dataType.simpleString())
        return found if free.isEmpty() else found.unionByName(near_rows(free, vectors, threshold, k, visible, False, centroids, None, allowed))
    if centroids is None:
        centroids = fit(vectors.select("id", "embedding"))
    reach = float(np.arccos(np.clip(threshold - _SLACK, -1, 1))) if threshold > 0 else np.pi
    two = _sizes(vectors, centroids)
    one = two if once or alike else _sizes(queries, centroids)
    if len(centroids) > 1 and (_angles(centroids, centroids) <= reach + two[0] + _SLACK).mean() > MAX_REACH:
        centroids = np.zeros((1, centroids.shape[1]))
        one, two = ((np.array([np.pi]), np.array([x[1].sum()])) for x in (one, two))
    kept = k or (upto and 1)  # lists are cut in either case
    one, two = ((x[0], -(-x[1] // _part_rows(0 if k is None else x[1].max(initial=0), kept))) for x in (one, two))
    a = _sent(queries, "q", centroids, reach, one[1], *two)
    b = _sent(vectors, "v", centroids, reach, two[1], *one)
    mirror = alike and k is not None and not once and visible is None and allowed is None and upto is None
    if once or mirror:
        a, b = a.where("(q0, q1) <= (q2, q3)"), b.where("(v0, v1) <= (v2, v3)")
    return _met(a, b, 4, threshold, k, visible, once, allowed, queries.schema["id"].dataType.simpleString(), upto, mirror)


def _met(
    a: DataFrame, b: DataFrame, n_keys: int, threshold: float, k: int | None, visible: Visible | None, once: bool, allowed: Allowed | None, kind: str,
    upto: Allowed | None = None, mirror: bool = False,
) -> DataFrame:
    """Pairs of two sides dealt to blocks, ``k`` of each query over all its blocks."""
    keys = [[f"{s}{i}" for i in range(n_keys)] for s in "qv"]
    half = n_keys // 2

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            ended = {} if upto is None else {"ended": np.zeros(0, bool)}
            return pd.DataFrame({"query_id": left["q_id"][:0], "id": right["v_id"][:0], "score": [], **ended})
        at = left[keys[0]].iloc[0].tolist()
        right = right.sort_values("v_id").reset_index(drop=True)
        if mirror and at[:half] != at[half:]:
            left = left.sort_values("q_id").reset_index(drop=True)
            i, j, score, back_i, back_j, back = _found(left, right, threshold, k, None, None, None, True)
            x, y = left["q_id"].to_numpy(), right["v_id"].to_numpy()
            return pd.DataFrame({"query_id": np.concatenate((x[i], y[back_i])), "id": np.concatenate((y[j], x[back_j])), "score": np.concatenate((score, back))})
        i, j, score, *ended = _found(left, right, threshold, k, visible, allowed, upto)
        x, y = left["q_id"].to_numpy()[i], right["v_id"].to_numpy()[j]
        if upto is not None:
            return pd.DataFrame({"query_id": x, "id": y, "score": score, "ended": ended[0]})
        if once:
            keep = x < y if n_keys == 3 or at[:half] == at[half:] else x != y
            x, y, score = np.where(x < y, x, y)[keep], np.where(x < y, y, x)[keep], score[keep]
        return pd.DataFrame({"query_id": x, "id": y, "score": score})

    schema = f"query_id {kind}, id {kind}, score double{'' if upto is None else ', ended boolean'}"
    found = a.groupBy(*keys[0]).cogroup(b.groupBy(*keys[1])).applyInPandas(meet, schema)
    if upto is not None:
        end = F.max(F.when(F.col("ended"), F.col("score"))).over(Window.partitionBy("query_id"))
        return found.withColumn("end", end).where("end IS NULL OR score >= end").select("query_id", "id", "score")
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``id_a < id_b, score`` of all pairs at a cosine of ``threshold`` or more."""
    found = near_rows(vectors, vectors, threshold, once=True)
    return found.select(F.col("query_id").alias("id_a"), F.col("id").alias("id_b"), "score")
