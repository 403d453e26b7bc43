"""What an engine did and how it was received: a row for each action, and rewards of what it returned."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallkit.sources.manifest import Manifest, new_batch

ACTION = "action_id string, action string, at timestamp, about string, counts map<string,bigint>, seconds double, flags array<string>"
REWARD = "memory_id string, action_id string, signal double, at timestamp"


class ActionLog:
    """Actions and rewards as parts of a manifest; each record is a batch, ``compact`` makes one of many."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = manifest or Manifest(spark, f"{self.path}/manifest")

    def _write(self, part: str, rows: DataFrame, **about) -> None:
        batch = new_batch()
        rows.write.parquet(f"{self.path}/{part}/batch={batch}")
        self.manifest.commit(batch, [part], **about)

    def record(self, action: str, now: str, about: dict, counts: dict[str, int], seconds: float, flags: list[str]) -> str:
        """One row; gives its id.  ``about`` is kept as JSON."""
        name = uuid.uuid4().hex
        row = (name, action, None, json.dumps(about, sort_keys=True), counts, seconds, flags)
        rows = self.spark.createDataFrame([row], ACTION).withColumn("at", F.lit(now).cast("timestamp"))
        self._write("actions", rows)
        return name

    def reward(self, signals: DataFrame, now: str) -> None:
        """Signals (``memory_id, action_id, signal``) that say how good a returned row was."""
        rows = signals.select(
            F.col("memory_id").cast("string").alias("memory_id"), F.col("action_id").cast("string").alias("action_id"),
            F.col("signal").cast("double").alias("signal"), F.lit(now).cast("timestamp").alias("at"),
        )
        self._write("rewards", rows)

    def actions(self) -> DataFrame:
        return self.manifest.read(self.path, "actions", ACTION).drop("version")

    def rewards(self) -> DataFrame:
        return self.manifest.read(self.path, "rewards", REWARD).drop("version")

    def by_strategy(self) -> DataFrame:
        """``about, searches, rewarded, signal``: how the searches of each strategy were received."""
        given = self.rewards().groupBy("action_id").agg(F.avg("signal").alias("signal"))
        rows = self.actions().where("action = 'search'").join(given, "action_id", "left")
        strategy = F.get_json_object("about", "$.strategy").alias("strategy")
        return rows.groupBy(strategy).agg(
            F.count("*").alias("searches"), F.count("signal").alias("rewarded"), F.avg("signal").alias("signal")
        )

    def compact(self) -> None:
        for part, rows in (("actions", self.actions), ("rewards", self.rewards)):
            at = self.manifest.last()
            if self.manifest.visible(part):
                self._write(part, rows(), base=[part], upto=at)
