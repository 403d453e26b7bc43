from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recallkit.streaming import jobs, state


@pytest.mark.parametrize("ttl", [None, "1 day"])
def test_rings_and_counters_are_dropped_after_their_time(spark, tmp_path, ttl):
    """A user comes back long after the watermark has passed their last event: ring and counter begin anew."""
    days = [[(1, 1, 1), (2, 1, 2)], [(3, 10, 1), (4, 10, 1)], [(5, 20, 1)], [(6, 30, 2)]]
    schema = "event_id long, day int, user_id long"
    pieces = [
        spark.createDataFrame(rows, schema).withColumn("ts", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))
        for rows in days
    ]
    found = jobs.replay_updates(pieces, lambda s: state.rings(s, 2, ttl), str(tmp_path / "ring"), "user_id").collect()
    rings = {u: sorted(r.event_id for r in found if r.user_id == u) for u in (1, 2)}
    assert rings == {1: [4, 5], 2: [2, 6] if ttl is None else [6]}
    nth = jobs.replay(pieces, lambda s: jobs.every_nth_stream(s, 2, ttl), str(tmp_path / "nth")).collect()
    assert sorted((r.user_id, r.event_id, r.nth) for r in nth) == [(1, 3, 2), (1, 5, 4)] + ([(2, 6, 2)] if ttl is None else [])


def test_each_batch_ingests_every_row_once(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    stream = jobs.events_stream(spark, sf_dir)

    def write(batch, number):
        batch.select("event_id").write.mode("append").parquet(out)

    for _ in range(2):  # the second run finds nothing new
        jobs.each_batch(stream, write, str(tmp_path / "check"))
    found = spark.read.parquet(out)
    expected = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert found.count() == found.distinct().count() == expected


def test_sliding_windows_stream_as_in_batch(spark, sf_dir):
    batch = jobs.failure_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 day", "6 hours")
    stream = jobs.failure_counts(jobs.events_stream(spark, sf_dir), "1 day", "6 hours")
    drained = jobs.drain(stream, "failure_counts", "complete")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, drained.collect()))


def test_users_of_a_bucket_have_their_own_sessions(spark, tmp_path):
    """Few states for many users, a null one among them; events come out of order within the watermark."""
    draw = random.Random(3)
    events = [(None if i % 17 == 0 else i % 23, draw.randrange(0, 40_000)) for i in range(900)] + [(5, None)]
    expected = []
    for user in {u for u, _ in events}:
        first = last = n = None
        for at in sorted(a for u, a in events if u == user and a is not None) + [10**6]:
            if n and (at - last >= 600 or at - first >= 3000):
                expected.append((user, first, min(last + 600, first + 3000), n))
                n = None
            first, last, n = (first if n else at), at, (n or 0) + 1
    rows = spark.createDataFrame(events, "user_id long, at long").withColumn("ts", F.timestamp_seconds("at"))
    arrives = F.col("at") - F.col("at") % 7 * 60
    pieces = [rows.where("at IS NULL"), *[rows.where((arrives >= a) & (arrives < b)) for a, b in ((-1000, 15_000), (15_000, 30_000), (30_000, 50_000))]]
    pieces.append(spark.createDataFrame([(-1, 10**6)], "user_id long, at long").withColumn("ts", F.timestamp_seconds("at")))
    found = jobs.replay(pieces, lambda s: state.limited_sessions(s, 600, 3000, "1 hour", buckets=3), str(tmp_path / "sessions"))
    found = found.where("user_id IS NULL OR user_id >= 0").select("user_id", F.unix_seconds("session_start"), F.unix_seconds("session_end"), "n")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    # one row of state for a bucket, and one for null, not one for each user
    query = state.limited_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "sessions/in")), 600, 3000, "1 hour", buckets=3)
    run = query.writeStream.format("memory").queryName("bucketed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "again")).start()
    run.awaitTermination()
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in run.recentProgress) <= 4
