"""Clustering of vectors around centroids, with annulus search for the nearest one.

A vector's distance to a centroid is at least the difference of their norms.  Centroids are
sorted by norm; the one of the nearest norm gives an upper bound, binary search finds those
whose norms lie in the annulus of that bound, and only these are compared, in exact integers.
The annulus shrinks as nearer centroids are met; its edges belong to it, so ties are seen, and
go to the smaller number.  (Drake, "Faster k-means clustering", 2013.)

Every round is one scan of the staged integer points: tasks add up the vectors of each
centroid, and ``k * dim`` sums reach the driver, whatever the input.

Cases: a vector of another length, or with a null or non-finite component, is not clustered;
scaled components beyond ``±LIMIT`` count as that bound, so that squared distances fit a long;
repeated rows and ids are rows of their own; a null id sorts last among the first centroids,
equal ids by their vectors; fewer than ``k`` vectors give as many centroids; no vectors, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.llm.common import discard, map_arrow, staged

#: Largest magnitude of a scaled component: 2 ** 62 bounds a squared distance in 64 dimensions.
LIMIT = 1 << 27
_MOST = (1 << 63) - 1
#: Points that are compared at once.
SLICE = 8192


def integer_points(vectors: DataFrame, vec_col: str, dim: int, scale: int) -> DataFrame:
    """Rows with ``__point``: ``floor(scale * x)`` of each component of the usable vectors."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(
        vec, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * scale))).cast("int")
    )
    return vectors.where(F.coalesce((F.size(vec) == dim) & sound, F.lit(False))).withColumn("__point", scaled)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest row of ``centroids`` for each point, and the squared distance."""
    square = (centroids * centroids).sum(axis=1)
    order = np.lexsort((np.arange(len(centroids)), square))
    sorted_centroids, norms = centroids[order], np.sqrt(square[order].astype(float))
    own = np.sqrt((points * points).sum(axis=1).astype(float))
    right = np.clip(np.searchsorted(norms, own), 1, max(1, len(norms) - 1))
    left = right - 1
    right = np.minimum(right, len(norms) - 1)
    first = np.where(own - norms[left] <= norms[right] - own, left, right)
    gap = points - sorted_centroids[first]
    best = (gap * gap).sum(axis=1)
    who = order[first]
    reach = _radius(best)
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    for j in range(int(low.min()), int(high.max())):
        rows = np.flatnonzero((low <= j) & (j < high) & (first != j) & (np.abs(norms[j] - own) <= _radius(best)))
        gap = points[rows] - sorted_centroids[j]
        found = (gap * gap).sum(axis=1)
        nearer = (found < best[rows]) | ((found == best[rows]) & (order[j] < who[rows]))
        best[rows[nearer]], who[rows[nearer]] = found[nearer], order[j]
    return who, best


def _radius(squares: np.ndarray) -> np.ndarray:
    """Upper bounds of the roots; the slack covers the rounding of roots and norms, edges stay inside."""
    return np.sqrt(squares.astype(float)) * (1 + 1e-12) + 1e-5


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            flat = part.column(at).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(-1, dim).astype(np.int64)


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids of the next round: floors of means; one without vectors stays."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for _, block in _blocks(batches, 0, dim):
            who, _ = nearest(block, centroids)
            for j in np.unique(who):
                sums[j] += block[who == j].sum(axis=0)
            counts += np.bincount(who, minlength=len(centroids))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = map_arrow(points.select("__point"), run, "cluster int, n bigint, sums array<bigint>")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    wide = "decimal(38,0)"
    totals = flat.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast(wide)).alias("total"))
    moved = centroids.copy()
    for row in totals.collect():  # k * dim rows at most
        moved[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return moved


def _assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of ``points`` with ``cluster, distance`` in place of ``__point``."""
    at, dim = points.columns.index("__point"), centroids.shape[1]
    fields = [f for f in points.schema if f.name != "__point"]
    schema = T.StructType([*fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, at, dim):
            who, best = nearest(block, centroids)
            kept = [part.column(i) for i in range(part.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(who, pa.int32()), pa.array(best)], names=schema.fieldNames()
            )

    return map_arrow(points, run, schema)


def cluster_vectors(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    seed: int = 1,
    dim: int = 64,
    scale: int = 64,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    keep: list[str] | None = None,
) -> DataFrame:
    """``cluster, distance, cluster_inertia, inertia, centroid_sha256`` beside the kept columns.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:id``.  ``keep``
    names the columns to carry (by default all but the vector); one of an added column's name is
    dropped in favour of the added one.
    """
    spark = vectors.sparkSession
    added = {"cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "__point"}
    names = [c for c in (keep or [c for c in vectors.columns if c != vec_col]) if c.lower() not in added]
    points = integer_points(vectors, vec_col, dim, scale)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256).alias("__mark")
    points = staged(points.select(*[F.col(f"`{c}`") for c in names], "__point", mark), "points")
    first = points.orderBy(F.col("__mark").asc_nulls_last(), "__point").limit(k).select("__point").collect()
    points = points.drop("__mark")
    centroids = np.array([row[0] for row in first], dtype=np.int64).reshape(-1, dim)
    for _ in range(rounds if len(first) else 0):
        centroids = _moved(points, centroids)
    if not len(first):
        empty = points.drop("__point").withColumn("cluster", F.lit(None).cast("int"))
        return empty.withColumns({"distance": F.lit(None).cast("bigint"), "cluster_inertia": F.lit(None).cast("bigint"),
                                  "inertia": F.lit(None).cast("bigint"), "centroid_sha256": F.lit(None).cast("string")})
    found = staged(_assigned(points, centroids), "assigned")
    discard(points)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total = min(_MOST, sum(int(row["s"]) for row in sums))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = [(row["cluster"], min(_MOST, int(row["s"])), total, digests[row["cluster"]]) for row in sums]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return found.join(F.broadcast(spark.createDataFrame(about, schema)), "cluster").select(
        *found.columns, "cluster_inertia", "inertia", "centroid_sha256"
    )
