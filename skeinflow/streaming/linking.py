"""Links between two streams, and what is known across runs, as state that event time bounds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def unique_links(
    left: DataFrame, right: DataFrame, key: str, left_id: str, left_time: str, right_id: str, right_time: str, before: str, after: str, delay: str
) -> DataFrame:
    """(left id, left time, right id) of the rows of left that have exactly one row of right under their key, between
    `before` earlier and `after` later. Both are streams with event times; rows later than `delay` may be dropped.

    A match is final when no further row of right can come for it, which is when the watermark has passed the end of
    its interval; that it is the only one is decided then. A row of right that comes within the delay still counts, and
    undoes a match that would have been the only one. Rows without key or time match nothing; names of columns other
    than the key must differ.
    """
    a = left.where(F.col(key).isNotNull()).select(F.col(key).alias("_ka"), left_id, left_time).withWatermark(left_time, delay)
    b = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_kb"), right_id, right_time).withWatermark(right_time, delay)
    near = (F.col(right_time) >= F.col(left_time) - F.expr(f"INTERVAL {before}")) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {after}"))
    pairs = a.join(b, (F.col("_ka") == F.col("_kb")) & near)
    counted = pairs.groupBy(left_time, left_id).agg(F.count("*").alias("_n"), F.min(right_id).alias(right_id))
    return counted.where("_n = 1").select(left_id, left_time, right_id)


class FirstWithin(StatefulProcessor):
    """The first row of a key passes; later ones do until the key has not been seen for `days`."""

    def __init__(self, days: int, time: str, order: str, columns: list[str]):
        self.days, self.time, self.order, self.columns = days, time, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.time, self.order])
        last = self.seen.get()[0] if self.seen.exists() else None
        keep = []
        for at in batch[self.time]:
            at = at.to_pydatetime()
            keep.append(last is None or abs(at - last) > dt.timedelta(days=self.days))
            last = at if last is None else max(last, at)
        self.seen.update((last,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((last + dt.timedelta(days=self.days)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000) + 1)
        yield batch.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_seen(source: DataFrame, key: str, time: str, order: str, days: int = 30, delay: str = "1 day") -> DataFrame:
    """The rows of a stream whose key was not seen in the `days` before, across restarts: a key's state is one time, and
    goes by a timer when the watermark passes its last row by `days`. Rows of one batch count in the order of time and
    `order`. Keys are text; null keys are one key. Needs the RocksDB state store."""
    rows = source.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(""))).withWatermark(time, delay)
    kept = rows.groupBy("_key").transformWithStateInPandas(FirstWithin(days, time, order, source.columns), source.schema, "Append", "EventTime")
    return kept.select(source.columns)
