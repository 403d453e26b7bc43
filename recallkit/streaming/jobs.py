"""Structured Streaming: ingestion, sessions, failure windows, counters and redelivery.

A stream of the engine is a directory of Parquet files; batch twins of the stateful jobs are
beside them, and both give the same rows once a stream is drained.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallkit.functions.lineage import cut, shared_folder
from recallkit.sources.manifest import Manifest, new_batch

FAILURES = 5
FAILURE_SECONDS = 600
FAILURE_RUN = 3
FAILURE_BYTES = 100 << 20
IDLE = "30 minutes"
EVERY = 50


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream; ``ts`` as a timestamp with a zone, as watermarks need it."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(sf_dir)
    )
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is and return its result from a memory table."""
    checkpoint = checkpoint or f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint).start().awaitTermination()
    return stream.sparkSession.table(name)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Ingest micro-batches: ``write`` gets each with its number and appends it at once."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def replay(pieces: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """The rows that a stream in append mode gives for pieces that arrive one after the other.

    Each piece is written to ``folder``, which driver and executors share, and the stream is started
    anew from its checkpoint; its result is appended to files.
    """
    spark = None
    for piece in pieces:
        spark = piece.sparkSession
        piece.write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(piece.schema).parquet(f"{folder}/in"))
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
        writer = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def replay_updates(pieces: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], folder: str, key: str) -> DataFrame:
    """As :func:`replay` in update mode: of each key the rows of the last micro-batch that gave any."""
    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes the same folder
        batch.write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    spark = None
    for piece in pieces:
        spark = piece.sparkSession
        piece.write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(piece.schema).parquet(f"{folder}/in"))
        writer = stream.writeStream.foreachBatch(keep).outputMode("update")
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    given = spark.read.parquet(f"{folder}/out")
    last = given.groupBy(key).agg(F.max("number").alias("last")).withColumnRenamed(key, "__key")
    return given.join(last, (F.col(key) == F.col("__key")) & (F.col("number") == F.col("last"))).select(*stream.columns)


class Ledger:
    """What a sink has taken, by source and offset, listed in one step with the rows themselves.

    A micro-batch that is run again, and rows that are delivered again however late, add nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = Manifest(spark, f"{path}/manifest")

    def taken(self) -> DataFrame:
        return self.manifest.read(self.path, "taken", "source string, `offset` bigint").drop("version")

    def rows(self, schema: T.StructType) -> DataFrame:
        return self.manifest.read(self.path, "rows", schema).drop("version")

    def writer(self, stream: str, source: Column, offset: Column) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``; ``stream`` names the query, whose batches are numbered."""

        def write(batch: DataFrame, number: int) -> None:
            if any((e.get("stream"), e.get("run")) == (stream, number) for e in self.manifest.entries()):
                return
            marked = batch.withColumns({"__source": source.cast("string"), "__offset": offset.cast("bigint")})
            once = marked.dropDuplicates(["__source", "__offset"])
            known = self.taken().select(F.col("source").alias("__source"), F.col("offset").alias("__offset"))
            fresh = cut(once.join(known, ["__source", "__offset"], "left_anti"))
            name = new_batch()
            fresh.drop("__source", "__offset").write.parquet(f"{self.path}/rows/batch={name}")
            keys = fresh.select(F.col("__source").alias("source"), F.col("__offset").alias("offset"))
            keys.write.parquet(f"{self.path}/taken/batch={name}")
            self.manifest.commit(name, ["rows", "taken"], stream=stream, run=number)

        return write


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Events by window and type; events later than the watermark are dropped, like rows behind a cursor.

    ``late`` is None for a stream that has its watermark already.
    """
    if events.isStreaming and late:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts" if events.isStreaming else F.col("ts").cast("timestamp"), size).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, idle: str = IDLE, late: str | None = "1 hour") -> DataFrame:
    """``user_id, session_start, session_end, n``: activity without a gap of ``idle``; each event prolongs it."""
    if events.isStreaming and late:
        events = events.withWatermark("ts", late)
    time = "ts" if events.isStreaming else F.col("ts").cast("timestamp")  # a cast would lose the watermark
    grouped = events.groupBy("user_id", F.session_window(time, idle).alias("w"))
    found = grouped.agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def failure_windows(events: DataFrame, seconds: int = FAILURE_SECONDS, least: int = FAILURES) -> DataFrame:
    """Errors with at least ``least`` errors of the same user in the ``seconds`` up to them (batch)."""
    errors = events.where("event_type = 'error'")
    span = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    counted = errors.select("event_id", "user_id", "ts", F.count("*").over(span).alias("failures"))
    return counted.where(F.col("failures") >= least)


def failure_alerts(
    events: DataFrame, seconds: int = FAILURE_SECONDS, least: int = FAILURES, run: int = FAILURE_RUN,
    size_col: str | None = None, least_size: float = FAILURE_BYTES,
) -> DataFrame:
    """Errors that raise an alarm: ``least`` of the user's within ``seconds``, or ``run`` in a row (batch).

    With ``size_col`` only those whose size is ``least_size`` or more; a null size raises none.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    failed = F.col("event_type") == "error"
    breaks = events.withColumn("broken", F.sum((~failed).cast("int")).over(order))
    span = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    streak = Window.partitionBy("user_id", "broken").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = breaks.where(failed).select(
        "event_id", "user_id", F.count("*").over(span).alias("failures"), F.count("*").over(streak).alias("in_a_row"),
        (F.lit(True) if size_col is None else F.col(size_col) >= least_size).alias("large"),
    )
    counted = counted.where("large").drop("large")
    return counted.where((F.col("failures") >= least) | (F.col("in_a_row") >= run))


def failure_counts(events: DataFrame, size: str = "600 seconds", slide: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    """Errors in sliding windows (stream or batch)."""
    errors = events.where("event_type = 'error'")
    if errors.isStreaming:
        errors = errors.withWatermark("ts", late)
    grouped = errors.groupBy(F.window(F.col("ts").cast("timestamp"), size, slide).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def every_nth(events: DataFrame, n: int = EVERY) -> DataFrame:
    """``user_id, event_id, nth``: each ``n``-th event of a user by time and id (batch)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    counted = events.select("user_id", "event_id", F.row_number().over(order).cast("bigint").alias("nth"))
    return counted.where(F.col("nth") % n == 0)


def every_nth_stream(events: DataFrame, n: int = EVERY, ttl: str | None = None) -> DataFrame:
    """As :func:`every_nth`, with a counter of each user as state; order counts within a micro-batch.

    With ``ttl``, a delay of the watermark, the counter of a user without events for as long is dropped
    and begins anew.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        nth = seen + 1 + pd.RangeIndex(len(rows))
        state.update((seen + len(rows),))
        if ttl is not None:
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        hit = nth % n == 0
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy()[hit], "nth": nth[hit]})

    kind = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
    rows = events if ttl is None else events.withWatermark("ts", ttl)
    return rows.groupBy("user_id").applyInPandasWithState(
        count, "user_id bigint, event_id bigint, nth bigint", "seen bigint", "append", kind
    )


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark: protection against redelivery."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
