"""The sliding rate limit as a stateful processor: list state, and timers in event time.

Calls wait in state until the watermark has passed them, so that late ones take their place in time before anything is decided; then they
are decided in order of time and id, and equal times give the same answer however they arrive. A user's state is the calls that wait and
the recorded times of the last window, `limit` at most; a timer clears it once both are over. Calls behind the watermark are dropped.

State lives in RocksDB: set spark.sql.streaming.stateStore.providerClass to PROVIDER.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marigold.streaming.messages import AFTER_START, WINDOW_SECONDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = "spark.sql.streaming.stateStore.providerClass"


class SlidingWindow(StatefulProcessor):
    """Decides a user's calls in order of event time."""

    def __init__(self, limit: int, seconds: float, columns: tuple[str, str, str], id_type: str) -> None:
        self.limit, self.seconds, self.columns, self.id_type = limit, seconds, columns, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t double, call {self.id_type}")
        self.recorded = handle.getListState("recorded", "t double")

    def _ms(self, t: float) -> int:
        return math.ceil((t + AFTER_START) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            calls = list(zip(pdf[self.columns[2]].tolist(), pdf[self.columns[1]].tolist(), strict=True))
            if calls:
                self.waiting.appendList(calls)
                self.handle.registerTimer(self._ms(min(t for t, _ in calls)))  # decides all that the watermark has passed by then
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [c for c in waiting if self._ms(c[0]) <= now], [c for c in waiting if self._ms(c[0]) > now]
        times = [t for (t,) in self.recorded.get()] if self.recorded.exists() else []
        allowed = []
        for t, _ in due:
            times = [x for x in times if x >= t - self.seconds]
            allowed.append(len(times) < self.limit)
            if allowed[-1]:
                times.append(t)
        times = [x for x in times if self._ms(x + self.seconds) >= now]
        self._keep(self.waiting, later)
        self._keep(self.recorded, [(t,) for t in times])
        upcoming = [self._ms(t) for t, _ in later[:1]] + [self._ms(t + self.seconds) + 1 for t in times[-1:]]
        if upcoming:
            self.handle.registerTimer(min(upcoming))
        if due:
            user, call, time = self.columns
            yield pd.DataFrame({user: [key[0]] * len(due), call: [c for _, c in due], time: [t for t, _ in due], "allowed": allowed})

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def rate_limited_in_order(calls: DataFrame, limit: int, *, seconds: float = WINDOW_SECONDS, user_col: str = "user_id", time_col: str = "t", tie_col: str = "call_id", late: str = "10 minutes") -> DataFrame:
    """calls with `allowed`, as messages.rate_limited gives them, for each call that the watermark (`late` behind the latest) has passed."""
    if calls.sparkSession.conf.get(_CONF, "").rpartition(".")[2] != "RocksDBStateStoreProvider":
        raise RuntimeError(f"set {_CONF} to {PROVIDER}")
    kinds = dict(calls.dtypes)
    at = F.timestamp_micros(((F.col(time_col) + AFTER_START) * 1_000_000).cast("long")).alias("_at")
    picked = calls.where(F.col(user_col).isNotNull() & F.col(time_col).isNotNull()).select(user_col, tie_col, F.col(time_col).cast("double").alias(time_col), at).withWatermark("_at", late)
    processor = SlidingWindow(limit, seconds, (user_col, tie_col, time_col), kinds[tie_col])
    schema = f"{user_col} {kinds[user_col]}, {tie_col} {kinds[tie_col]}, {time_col} double, allowed boolean"
    return picked.groupBy(user_col).transformWithStateInPandas(processor, schema, "append", "eventTime")
