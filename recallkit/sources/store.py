"""The store: a log of rows bucketed by id, and the current rows as a view of it.

Parquet has no row updates, so a write adds a batch of whole rows or tombstones to the log.  All
batches share one bucketing by id: the last version of each id is found bucket by bucket from ids
alone, and meets its row without any exchange.  Accesses are a log of their own (``id, n, at``),
added up on reading, so counting one writes no text.  Readers see the batches of the manifest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.functions import scalars
from recallkit.sources.manifest import Manifest, new_batch, numbers

SCHEMA_VERSION = 2
_TEXT, _NUMBER, _TIME = T.StringType(), T.DoubleType(), T.TimestampType()
_COLUMNS = {
    "id": _TEXT,
    "content": _TEXT,
    "memory_type": _TEXT,
    "source_type": _TEXT,
    "source_metadata": T.MapType(_TEXT, _TEXT),
    "embedding": T.ArrayType(T.FloatType()),
    "semantic_relevance": _NUMBER,
    "importance_score": _NUMBER,
    "access_count": T.LongType(),
    "last_accessed_at": _TIME,
    "created_at": _TIME,
    "updated_at": _TIME,
    "archived_at": _TIME,
    "tags": T.ArrayType(_TEXT),
    "project": _TEXT,
}
MEMORY = T.StructType([T.StructField(name, kind) for name, kind in _COLUMNS.items()])
UPDATABLE = frozenset(MEMORY.fieldNames()) - {"id", "created_at"}
_TOUCH = "id string, n bigint, at timestamp"


class ReadOnly(RuntimeError):
    """A write to a store opened for reading."""


class Store:
    """Memories under a path; ``read_only`` refuses writes.

    ``buckets`` (by default the session's shuffle partitions) holds from the first write on; it
    should be such that the ids of a bucket fit a task.  ``manifest`` may be one that other parts share.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        read_only: bool = False,
        unique_content: bool = False,
        manifest: Manifest | None = None,
        buckets: int | None = None,
    ):
        self.spark, self.path, self.read_only, self.unique_content = spark, path.rstrip("/"), read_only, unique_content
        self.manifest = manifest or Manifest(spark, f"{self.path}/manifest")
        self._asked = buckets

    def _buckets(self) -> int:
        held = self.manifest.latest("buckets")
        return int(held or self._asked or self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _log(self, upto: int | None = None) -> DataFrame | None:
        """All rows of the listed batches with their ``version``, in buckets; nothing if there are none."""
        listed = self.manifest.visible("rows", upto)
        if not listed:
            return None
        digest = hashlib.sha256(self.path.encode()).hexdigest()[:24]
        table = f"recallkit_{digest}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MEMORY)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}, op STRING, counted BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (id) INTO {self._buckets()} BUCKETS LOCATION '{self.path}/rows'"
        )
        parts = " ".join(f"PARTITION (batch='{b}') LOCATION '{self.path}/rows/batch={b}'" for b in listed)
        self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
        return self.spark.table(table).where(F.col("batch").isin(*listed)).withColumn("version", numbers(listed))

    def _versions(self, upto: int | None = None) -> DataFrame:
        """The last version of each id that is there, with ``op, counted`` and the row."""
        log = self._log(upto)
        if log is None:
            empty = self.spark.createDataFrame([], MEMORY)
            return empty.withColumns({"op": F.lit(""), "counted": F.lit(0).cast("bigint"), "version": F.lit(0).cast("bigint")})
        last = log.groupBy("id").agg(F.max("version").alias("__last")).withColumnRenamed("id", "__id")
        # the version is no key of the join: with the id alone both sides keep their buckets
        met = log.join(last.hint("shuffle_hash"), (F.col("id") == F.col("__id")) & (F.col("version") >= F.col("__last")))
        return met.where("op <> 'delete'").drop("__id", "__last", "batch")

    def current(self, upto: int | None = None) -> DataFrame:
        """The rows as of a number of the manifest (by default the last), accesses added up."""
        rows = self._versions(upto)
        names = MEMORY.fieldNames()
        if not self.manifest.visible("touches", upto):
            return rows.select(*names)
        touches = self.manifest.read(self.path, "touches", _TOUCH, upto).withColumnsRenamed({"id": "__id", "version": "__seen"})
        marks = self._versions(upto).select("id", "counted")
        met = marks.join(touches, (F.col("id") == F.col("__id")) & (F.col("__seen") > F.col("counted")))
        sums = met.groupBy("id").agg(F.sum("n").alias("__n"), F.max("at").alias("__at")).withColumnRenamed("id", "__id")
        joined = rows.join(sums.hint("shuffle_hash"), F.col("id") == F.col("__id"), "left")
        shown = {
            "access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)),
            "last_accessed_at": F.coalesce("__at", "last_accessed_at"),
        }
        return joined.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in names])

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnly(self.path)

    def write_rows(self, batch: str, rows: DataFrame, op: str = "put", counted: int = 0) -> None:
        """The rows as files of a batch that is not listed yet."""
        self._writable()
        n, table = self._buckets(), f"recallkit_{batch}"
        shown = [F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORY]
        if op == "delete":
            shown = [F.col("id").cast("string").alias("id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in MEMORY[1:]]]
        marks = [F.lit(op).alias("op"), F.lit(counted).cast("bigint").alias("counted")]
        writer = rows.select(*shown, *marks).repartition(n, "id").write.format("parquet").bucketBy(n, "id")
        try:
            writer.option("path", f"{self.path}/rows/batch={batch}").saveAsTable(table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay

    def _append(self, rows: DataFrame, op: str = "put", counted: int = 0, **about) -> None:
        batch = new_batch()
        self.write_rows(batch, rows, op, counted)
        self.manifest.commit(batch, ["rows"], buckets=self._buckets(), **about)

    def dimension(self) -> int | None:
        """That of the last vectors written."""
        return self.manifest.latest("dimension")

    def checked(self, rows: DataFrame, dimension: int | None = None) -> int | None:
        """The dimension of the rows' vectors; all must be finite and have that of the store (or the one given)."""
        size, vec = F.size("embedding"), F.col("embedding")
        sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        about = rows.where(vec.isNotNull()).agg(
            F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(~sound).alias("bad")
        ).first()
        wanted = dimension or self.dimension()
        if about["least"] is None:
            return wanted
        if about["bad"] or not about["least"]:
            raise ValueError("INVALID_EMBEDDING: vectors are finite and not empty")
        if about["least"] != about["most"] or wanted not in (None, about["most"]):
            found = sorted({about["least"], about["most"]})
            raise ValueError(f"INVALID_EMBEDDING: DIMENSION_MISMATCH: stored {wanted}, given {found}")
        return about["most"]

    def _distinct_ids(self, rows: DataFrame) -> None:
        if not rows.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
            raise ValueError("DUPLICATE_ID: ids are not null and occur once in a batch")

    def _new_content(self, rows: DataFrame) -> None:
        digest = scalars.content_hash(F.col("content"))
        held = self.current().select(digest.alias("held"))
        new = rows.select(digest.alias("digest"))
        if not new.join(held, F.col("digest") == F.col("held"), "left_semi").isEmpty():
            raise ValueError("DUPLICATE_CONTENT")
        if not new.groupBy("digest").count().where("count > 1").isEmpty():
            raise ValueError("DUPLICATE_CONTENT")

    def save(self, rows: DataFrame) -> None:
        """Insert rows of the schema; vectors must be finite and of the store's dimension."""
        self.commit(rows, None, "")

    def commit(
        self,
        rows: DataFrame | None,
        archived: DataFrame | None,
        now: str,
        batch: str | None = None,
        parts: list[str] | None = None,
        **about,
    ) -> None:
        """One batch at once: new rows, and the rows they replace (``id``) archived.

        ``batch`` and ``parts`` name other parts already written, which are listed with the rows;
        ``about`` is noted in the manifest.
        """
        self._writable()
        rows = self.spark.createDataFrame([], MEMORY) if rows is None else rows
        dimension = self.checked(rows)
        self._distinct_ids(rows)
        if self.unique_content:
            self._new_content(rows)
        columns, at = MEMORY.fieldNames(), self.manifest.last()
        new = rows.select(*columns)
        if archived is not None:
            old = self.current(at).join(archived.select("id").distinct(), "id", "left_semi").join(rows.select("id"), "id", "left_anti")
            new = new.unionByName(old.withColumn("archived_at", F.lit(now).cast("timestamp")).select(*columns))
        batch = batch or new_batch()
        self.write_rows(batch, new, counted=at)
        self.manifest.commit(batch, ["rows", *(parts or [])], buckets=self._buckets(), dimension=dimension, **about)

    def update(self, changes: DataFrame) -> None:
        """Replace the given columns of existing rows (``changes``: ``id`` and columns to set).

        Vectors of another dimension are taken if no other row keeps one of the old.
        """
        names = [c for c in changes.columns if c != "id"]
        if not set(names) <= UPDATABLE:
            raise ValueError(f"INVALID_PARAMETER: {sorted(set(names) - UPDATABLE)}")
        self._writable()
        self._distinct_ids(changes)
        at = self.manifest.last()
        about = {}
        if "embedding" in names:
            given = changes.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
            dimension = given["n"] if given else None
            if dimension not in (None, self.dimension()):
                kept = self.current(at).where("embedding IS NOT NULL").join(changes.select("id"), "id", "left_anti")
                dimension = dimension if kept.isEmpty() else None
            about["dimension"] = self.checked(changes, dimension)
        new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in names])
        joined = self.current(at).join(new, "id")
        rows = joined.select(*[F.col(f"__{f}").alias(f) if f in names else F.col(f) for f in MEMORY.fieldNames()])
        self._append(rows, counted=at, **about)

    def touch(self, ids: DataFrame, now: str) -> None:
        """Count an access of each id as often as it is listed, and note the time."""
        self._writable()
        batch = new_batch()
        rows = ids.groupBy(F.col("id").cast("string").alias("id")).agg(F.count("*").alias("n"))
        rows.withColumn("at", F.lit(now).cast("timestamp")).write.parquet(f"{self.path}/touches/batch={batch}")
        self.manifest.commit(batch, ["touches"])

    def delete(self, ids: DataFrame) -> None:
        """Tombstones of the ids; rows that are not there may be named."""
        self._append(ids.select("id").where("id IS NOT NULL").distinct(), "delete")

    def compact(self, path: str | None = None) -> None:
        """Write the current rows as one batch that replaces all before it, here or as a store of its own."""
        at = self.manifest.last()
        if path is not None:
            Store(self.spark, path, buckets=self._buckets())._append(self.current(at), dimension=self.dimension())
        else:
            self._append(self.current(at), counted=at, base=["rows", "touches"], upto=at, dimension=self.dimension())


def check_dimension(store: Store, dimension: int) -> None:
    stored = store.dimension()
    if stored is not None and stored != dimension:
        raise ValueError(f"DIMENSION_MISMATCH: stored {stored}, provider {dimension}")
