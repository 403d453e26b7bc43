"""Stateful operators with a timer and eviction: sessions with a hard limit, rings of the last rows.

The state of a key, or of a bucket of keys, is one row of ``applyInPandasWithState``.  A state has one timer, which is
set to the earliest of the times that something is due at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RING = 1000
#: States that the users of a stream are dealt to.
BUCKETS = 256
_US = 1000  # microseconds of a millisecond


def limited_sessions(
    events: DataFrame, idle_seconds: int, hard_seconds: int, late: str | None = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """``user_id, session_start, session_end, n`` of sessions that end ``idle_seconds`` after their last
    event or ``hard_seconds`` after their first, whichever comes first (stream, append).

    An event at or after the end opens the next one.  Events wait in the state until the watermark
    has passed them, so they are taken in order whatever their arrival; later ones are dropped.
    Users are dealt to ``buckets``, fixed by the first checkpoint: a state is that of a bucket's users, as a call
    of Python for each user costs far more than its events.  A user's part is gone when its session has ended, so
    users that stay away cost nothing.  ``late`` is None for a stream that has its watermark already.
    """
    idle, hard = idle_seconds * 1_000_000, hard_seconds * 1_000_000

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held = state.get if state.exists else (b"", b"")
        waiting = np.frombuffer(waiting, np.int64).reshape(-1, 2)  # user, time
        sessions = {user: rest for user, *rest in np.frombuffer(held, np.int64).reshape(-1, 4).tolist()}  # first, last, n
        passed, done = state.getCurrentWatermarkMs() * _US, []
        rows = np.concatenate([waiting, *[part.loc[part["at"] > passed, ["user_id", "at"]].to_numpy(np.int64) for part in batches]])
        ready, left = rows[rows[:, 1] <= passed], rows[rows[:, 1] > passed]
        for user, at in ready[np.lexsort((ready[:, 0], ready[:, 1]))].tolist():
            first, last, n = sessions.get(user, (at, at, 0))
            if n and (at - last >= idle or at - first >= hard):
                done.append((user, first, last, n))
                first, n = at, 0
            sessions[user] = (first, at, n + 1)
        for user, (first, last, n) in list(sessions.items()):
            if passed >= min(last + idle, first + hard):
                done.append((user, first, last, n))
                del sessions[user]
        ends = [min(last + idle, first + hard) for first, last, _ in sessions.values()]
        if len(left):
            ends.append(int(left[:, 1].min()))
        if ends:
            kept = np.array([(user, *rest) for user, rest in sessions.items()], np.int64)
            state.update((left.tobytes(), kept.tobytes()))
            state.setTimeoutTimestamp(-(-min(ends) // _US))
        elif state.exists:
            state.remove()
        if done:
            found = pd.DataFrame(done, columns=["user_id", "first", "last", "n"])
            yield found if key[0] >= 0 else found.assign(user_id=pd.Series([None] * len(found), dtype="Int64"))

    marked = (events.withWatermark("ts", late) if late else events).where("ts IS NOT NULL")
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets))).cast("int")
    marked = marked.select(bucket.alias("bucket"), F.coalesce("user_id", F.lit(0)).cast("bigint").alias("user_id"), "ts", F.unix_micros("ts").alias("at"))
    found = marked.groupBy("bucket").applyInPandasWithState(
        advance, "user_id bigint, first bigint, last bigint, n bigint", "waiting binary, held binary", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    end = F.least(F.col("last") + idle, F.col("first") + hard)
    return found.select("user_id", F.timestamp_micros("first").alias("session_start"), F.timestamp_micros(end).alias("session_end"), "n")


def rings(events: DataFrame, size: int = RING, ttl: str | None = None) -> DataFrame:
    """``user_id, at, event_id`` of the last ``size`` events of each user met in a micro-batch (update).

    The oldest fall out as the ring fills, and an event that is delivered again takes no place.  With
    ``ttl``, a delay of the watermark, the ring of a user without events for as long is dropped.
    """

    def turn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ats, ids = state.get if state.exists else ([], [])
        held = sorted(zip(ats, ids))
        for part in batches:
            held = sorted({*held, *zip(part["at"].tolist(), part["event_id"].tolist())})[-size:]
        ats, ids = [a for a, _ in held], [e for _, e in held]
        state.update((ats, ids))
        if ttl is not None:
            state.setTimeoutTimestamp(max(ats[-1] // _US, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": key[0], "at": ats, "event_id": ids})

    rows = events if ttl is None else events.withWatermark("ts", ttl)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id")
    kind = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("user_id").applyInPandasWithState(
        turn, "user_id bigint, at bigint, event_id bigint", "ats array<bigint>, ids array<bigint>", "update", kind
    )
