"""Helpers shared by the operators: staging tables, Arrow plumbing, word boundaries.

A *word* is a maximal run of characters other than the six ASCII blanks
(space and U+0009 to U+000D).  ``bytes.split()`` uses exactly that set, so words
are taken from the UTF-8 form of a text.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a session in local mode (as in tests) may name none; it gets a folder beside its
    warehouse.  On a cluster that would be a folder of one machine, so it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends at files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A key with over one in so many rows is a heavy one; there are fewer of them than this.
HEAVY_KEYS = 2000


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (one row a key, ``count`` rows of ``left`` each) whatever the skew.

    Keys with over ``1 / HEAVY_KEYS`` of all rows are fewer than ``HEAVY_KEYS``, so their side is
    broadcast; the rows of all other keys meet by a shuffle, and none of them is large.  Keys
    compare null-safe.  Both sides should be staged or cheap: each is read twice.
    """
    bounds = right.agg(F.sum(count).alias("total")).first()
    heavy_at = (bounds["total"] or 0) / HEAVY_KEYS
    names = [f"__key{i}" for i in range(len(keys))]
    renamed = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    heavy = renamed.where(F.col(count) > heavy_at)
    light = renamed.where(F.col(count) <= heavy_at)
    few = F.broadcast(heavy.limit(HEAVY_KEYS))
    rest = left.join(F.broadcast(heavy.select(*names).limit(HEAVY_KEYS)), on, "left_anti")
    return left.join(few, on).drop(*names).unionByName(rest.join(light, on, how).drop(*names))


def bounded_labels(labels: DataFrame, column: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``column`` (0 or 1, the largest of an id) of at most ``limit`` ids, by hash."""
    usable = labels.where(F.col(column).isin(0, 1)).groupBy(id_col).agg(F.max(column).alias(column))
    n = usable.count()
    if n > limit:
        draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(column)), F.lit(1 << 30))
        usable = usable.where(draw < int(0.97 * limit / n * (1 << 30)))
    return usable.limit(limit)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and a worker; some more if its last row is long.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH_BYTES``.

    By default a batch may hold 64 MB of long texts, and the JVM and the worker of each core hold one.
    The bound is a setting of the session: one that names its own keeps it, others get ours.
    """
    conf = df.sparkSession.conf
    if _BATCH_SETTING not in conf.getAll:
        conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


#: Bytes of text that a worker turns into Python objects at once.
SLICE_BYTES = 2 << 20


def give_back() -> None:
    """Return what a worker has freed to the system; workers outlive stages, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others return memory by themselves
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of about ``limit`` bytes of a text column (at least one row each)."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + limit)))
            yield batch.slice(first, last - first)
            first = last
        give_back()


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def add_columns(
    df: DataFrame,
    text_col: str,
    added: T.StructType,
    compute: Callable[[list[bytes]], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns that ``compute`` derives from the texts of a batch.

    ``keep`` names the input columns to carry (all by default).  A carried column whose
    name an added one takes is dropped in favour of the added one.
    """
    names = {f.name.lower() for f in added}
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([source.schema[i] for i in range(len(carried))] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(carried)):
            new = compute(texts_of(batch.column(len(carried))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(carried))] + new, names=schema.fieldNames()
            )

    return map_arrow(source, run, schema)


def filter_rows(df: DataFrame, text_col: str, accept: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """Rows of ``df``, columns unchanged, whose text ``accept`` approves."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(accept(texts_of(batch.column(at))), pa.bool_()))

    return map_arrow(df, run, df.schema)
