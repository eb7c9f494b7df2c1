"""The rate limiter as a stream: attempts are judged as they arrive, by identifier and action, with a watermark for late ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from locusmith.functions.hashing import pseudonym
from locusmith.operators.ratelimit import Limit

OUT = "event_id bigint, identifier string, action string, us bigint, allowed boolean"
STATE = "times array<bigint>"


def limited(stream: DataFrame, limit: Limit, identifier: str, action: str, at: str = "ts", key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Every attempt of a stream with allowed; only allowed attempts are remembered, at most `attempts` times per group.

    Within a micro-batch attempts are judged in order of time and key. State is dropped once the watermark has passed the
    last remembered attempt by the length of the window. Attempts without an identifier or time are left out.
    """
    window, most = limit.seconds * 1_000_000, limit.attempts
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).where(F.col(identifier).isNotNull() & F.col("_at").isNotNull())
    rows = rows.withWatermark("_at", late).select(F.col(key).cast("bigint").alias("event_id"), pseudonym(F.col(identifier)).alias("identifier"), F.col(action).alias("action"), "_at", F.unix_micros("_at").alias("us"))

    def judge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times: list[int] = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["us", "event_id"])  # one group's attempts of one micro-batch
        verdicts = []
        for us in frame.us.tolist():
            times = [t for t in times if t >= us - window]
            verdicts.append(len(times) < most)
            if verdicts[-1]:
                times.append(us)
        yield pd.DataFrame({"event_id": frame.event_id, "identifier": group[0], "action": group[1], "us": frame.us, "allowed": verdicts})
        state.update((times,))
        last = (max(times) + window) // 1000 if times else 0
        if last > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last)

    return rows.groupBy("identifier", "action").applyInPandasWithState(judge, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, action: str, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Attempts by action and tumbling window, with a watermark: (window_start, action, attempts)."""
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    per = rows.groupBy(F.window("_at", width), F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("attempts"))
    return per.select(F.col("window.start").alias("window_start"), "action", "attempts")
