"""Vector search: exact cosine top-k, many queries at once, similarity joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallkit import config
from recallkit.functions import scalars
from recallkit.operators import cells
from recallkit.operators.filters import active

BLOCK_ROWS = 4096
#: Rows of a bucket of sign bits on average, and the parts one side of a bucket is dealt in.
BUCKET_ROWS = 256
PARTS = 4


def top_k(memories: DataFrame, query: Sequence[float], k: int = config.TOP_K, project: str | None = None) -> DataFrame:
    """``id, score`` of the active rows nearest to a vector; an empty query finds nothing.

    One scan of ids and vectors; partitions keep ``k`` rows each (TakeOrderedAndProject).
    """
    rows = memories.where(active() & F.col("embedding").isNotNull())
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if not query:
        rows = rows.where(F.lit(False))
    score = F.round(scalars.cosine_to(F.col("embedding"), query), 6)
    best = rows.select("id", score.alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(k)
    return best.where("score IS NOT NULL")  # after the cut, so that each score is computed once


def _blocks(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def _block_count(vectors: DataFrame) -> int:
    return max(1, -(-vectors.count() // BLOCK_ROWS))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    return x / np.where(length == 0, 1, length)


def _pairs_of_blocks(left: DataFrame, right: DataFrame, triangle: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt so that every pair of blocks meets once, in tasks of bounded size."""
    n, m = _block_count(left), _block_count(right)
    a = _blocks(left, n).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    b = _blocks(right, m).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = a.select(
        F.col("block").alias("qi"), F.col("other").alias("qj"),
        F.col("id").alias("query_id"), F.col("embedding").alias("query"),
    )
    b = b.select(
        F.col("other").alias("vi"), F.col("block").alias("vj"),
        F.col("id").alias("vector_id"), F.col("embedding").alias("vector"),
    )
    return (a.where("qi <= qj"), b.where("vi <= vj")) if triangle else (a, b)


def _meet(a: DataFrame, b: DataFrame, together, schema: str) -> DataFrame:
    return a.groupBy("qi", "qj").cogroup(b.groupBy("vi", "vj")).applyInPandas(together, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` nearest vectors of each query (itself included).

    Blocks of queries meet blocks of vectors as matrix products; each pair of blocks gives ``k``
    rows a query, and a window merges them.
    """
    a, b = _pairs_of_blocks(queries, vectors, False)
    kind = queries.schema["id"].dataType.simpleString()

    def block_top(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "id": right["vector_id"][:0], "score": []})
        right = right.sort_values("vector_id")
        scores = np.round(_unit(left["query"]) @ _unit(right["vector"]).T, 6)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(left)), best.shape[1])
        return pd.DataFrame(
            {
                "query_id": left["query_id"].to_numpy()[rows],
                "id": right["vector_id"].to_numpy()[best.ravel()],
                "score": scores[rows, best.ravel()],
            }
        )

    found = _meet(a, b, block_top, f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``id_a < id_b, score`` of all pairs at a cosine of ``threshold`` or more (exact, by blocks)."""
    a, b = _pairs_of_blocks(vectors, vectors, True)
    kind = vectors.schema["id"].dataType.simpleString()

    def block_pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id_a": left["query_id"][:0], "id_b": right["vector_id"][:0], "score": []})
        scores = np.round(_unit(left["query"]) @ _unit(right["vector"]).T, 6)
        i, j = np.nonzero(scores >= threshold)
        x, y = left["query_id"].to_numpy()[i], right["vector_id"].to_numpy()[j]
        keep = x < y if left["qi"].iloc[0] == left["qj"].iloc[0] else x != y
        low, high = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
        return pd.DataFrame({"id_a": low, "id_b": high, "score": scores[i, j][keep]})

    return _meet(a, b, block_pairs, f"id_a {kind}, id_b {kind}, score double")


def tables_for(threshold: float, planes: int, recall: float) -> int:
    """How many tables of so many planes find a pair at ``threshold`` with probability ``recall``."""
    together = (1 - np.arccos(threshold) / np.pi) ** planes
    return int(np.ceil(np.log(1 - recall) / np.log(1 - together)))


def similar_pairs_by_planes(
    vectors: DataFrame,
    threshold: float,
    tables: int | None = None,
    planes: int | None = None,
    seed: int = 7,
    recall: float = 0.95,
) -> DataFrame:
    """As :func:`similar_pairs` among vectors that share the signs of ``planes`` random projections
    in one of ``tables`` tables, by default as many as ``recall`` takes.

    ``planes`` grows with the logarithm of the number of vectors, so buckets hold some
    ``BUCKET_ROWS`` rows on average; crowded ones are dealt in parts.  The lower the threshold the
    more tables it takes: where these would move more bytes than the exact join (far below 0.7), the
    exact join is made, unless ``tables`` or ``planes`` are given.  A pair is compared in the first
    table that brings it together only.
    """
    about = vectors.agg(F.max(F.size("embedding")).alias("dimension"), F.count("*").alias("n")).first()
    if not about["n"]:
        return similar_pairs(vectors, threshold)
    given = tables or planes
    planes = planes or max(4, int(np.ceil(np.log2(max(1, about["n"] / BUCKET_ROWS)))))
    tables = tables or tables_for(threshold, planes, recall)
    width = 4 * about["dimension"]
    if not given and tables * (PARTS + 1) * (width + 8 * tables) > 2 * width * max(1, about["n"] / cells.PART_ROWS):
        return cells.similar_pairs(vectors, threshold)
    normals = np.random.default_rng(seed).normal(size=(tables * planes, about["dimension"]))
    kind = vectors.schema["id"].dataType.simpleString()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                signs = (_unit(rows["embedding"]) @ normals.T > 0).reshape(len(rows), tables, planes)
                code = signs @ (1 << np.arange(planes)) + (np.arange(tables) << planes)
                yield pd.DataFrame({"id": rows["id"], "embedding": rows["embedding"], "keys": list(code.astype(np.int64))})

    keyed = vectors.select("id", "embedding").mapInPandas(keys, f"id {kind}, embedding array<float>, keys array<bigint>")
    a = keyed.select("id", "embedding", "keys", F.explode("keys").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    b = keyed.select("id", "embedding", "keys", F.explode("keys").alias("key")).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    )
    a, b = a.alias("a"), b.alias("b")
    first = F.element_at(F.filter(F.zip_with("a.keys", "b.keys", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1)
    score = F.round(scalars.cosine(F.col("a.embedding"), F.col("b.embedding")), 6)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id")))
    return (
        pairs.where(F.col("a.key") == first)
        .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), score.alias("score"))
        .where(F.col("score") >= threshold)
    )
