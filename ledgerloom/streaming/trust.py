"""Trust in each user's choices over a stream, kept in state until the user has been still for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELAY = "2 days"
#: A run of choices ends so many days after its last one.
EXPIRY_DAYS = 30
#: The state: open runs of a user, in order of time (micros), with their choices.
RUNS = "starts array<bigint>, lasts array<bigint>, accepted array<bigint>, overridden array<bigint>"
CLOSED = "user_id bigint, start_us bigint, last_us bigint, accepted bigint, overridden bigint"


class Runs(StatefulProcessor):
    """Holds the open runs of one user. A row joins the runs within the gap of it, and may join two of them; a timer at the end of the earliest run closes
    those that the watermark has passed and removes them, so users who stay away take no state."""

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", RUNS)

    def held(self) -> list[list[int]]:
        if not self.state.exists():
            return []
        return [list(run) for run in zip(*self.state.get(), strict=True)]

    def keep(self, runs: list[list[int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not runs:
            self.state.clear()
            return
        self.state.update(tuple(list(column) for column in zip(*runs, strict=True)))
        self.handle.registerTimer(-(-(min(r[1] for r in runs) + self.gap) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = self.held()
        for frame in rows:
            runs += [[at, at, int(ok), int(not ok)] for at, ok in zip(frame["us"].tolist(), frame["ok"].tolist(), strict=True)]
        merged: list[list[int]] = []
        for run in sorted(runs):
            if merged and run[0] <= merged[-1][1] + self.gap:
                last = merged[-1]
                merged[-1] = [last[0], max(last[1], run[1]), last[2] + run[2], last[3] + run[3]]
            else:
                merged.append(run)
        self.keep(merged)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        runs = self.held()
        done = [r for r in runs if r[1] + self.gap <= now]
        self.keep([r for r in runs if r[1] + self.gap > now])
        yield pd.DataFrame([(key[0], *r) for r in done], columns=["user_id", "start_us", "last_us", "accepted", "overridden"])

    def close(self) -> None:
        pass


def shown(runs: DataFrame) -> DataFrame:
    total = F.col("accepted") + F.col("overridden")
    return runs.select("user_id", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("last_us").alias("last"), "accepted", "overridden", F.round(F.col("accepted") / total, 6).alias("trust"))


def trusted(events: DataFrame, accepted: list[str], days: int = EXPIRY_DAYS) -> DataFrame:
    """(user_id, start, last, accepted, overridden, trust) of every run of a user's choices, which ends when no other follows within ``days``. A batch gives all runs; a stream gives a run once
    the watermark (``DELAY`` behind) has passed its end, drops later rows, and needs the RocksDB state store. Null users and times take no part."""
    rows = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("event_type").isin(*accepted), F.lit(False)).alias("ok"))
    if not events.isStreaming:
        runs = rows.groupBy("user_id", F.session_window("ts", f"{days} days")).agg(F.min("us").alias("start_us"), F.max("us").alias("last_us"), F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("overridden"))
        return shown(runs)
    kept = rows.withWatermark("ts", DELAY).groupBy("user_id")
    return shown(kept.transformWithStateInPandas(statefulProcessor=Runs(days * 86_400_000_000), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime"))
