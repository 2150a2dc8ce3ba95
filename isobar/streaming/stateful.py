"""State by key over a stream: months that are complete, and runs of exceedance.

Columns have no leading underscore, as Spark hands the rows over as named tuples.
Both use Spark's ``transformWithStateInPandas`` with event-time timers, which
needs the RocksDB state store (``stateful_session``).  Rows may come in any order
and more than once inside of the watermark; results are those of the batch side.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return spark


class _Month(StatefulProcessor):
    """Holds a month's values by step until all are there, or its time is over."""

    def __init__(self, keys: list[str], per_day: int, wait_ms: int) -> None:
        self.keys, self.per_day, self.wait_ms = keys, per_day, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.month = handle.getValueState("month", "held array<double>, known array<boolean>, done boolean")

    def _row(self, key: tuple, held: list, known: list, complete: bool) -> pd.DataFrame:
        values = [v for v, k in zip(held, known, strict=True) if k]
        mean = sum(values) / len(values) if values else None
        out = dict(zip(self.keys, key, strict=False)) | {"year": key[-2], "month": key[-1], "n": len(values), "expected": len(held), "mean": mean, "most": max(values, default=None), "complete": complete}
        return pd.DataFrame([out])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        year, month = int(key[-2]), int(key[-1])
        days = calendar.monthrange(year, month)[1]
        if self.month.exists():
            held, known, done = self.month.get()
            held, known = list(held), list(known)
        else:
            held, known, done = [0.0] * (days * self.per_day), [False] * (days * self.per_day), False
            end = pd.Timestamp(year, month, days) + pd.Timedelta(days=1)
            self.handle.registerTimer(int(end.value // 1_000_000) + self.wait_ms)
        for part in rows:
            for at, value in zip(part["row_step"], part["row_value"], strict=True):
                if not known[int(at)]:
                    held[int(at)], known[int(at)] = float(value), True
        now = not done and all(known)
        self.month.update((held, known, done or now))
        if now:
            yield self._row(key, held, known, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.month.exists():
            held, known, done = self.month.get()
            self.month.clear()
            if not done:
                yield self._row(key, list(held), list(known), False)

    def close(self) -> None:
        pass


def complete_months(rows: DataFrame, ts: str, value: str, keys: list[str], hours: int = 6, late: str = "2 days", wait_hours: int = 48) -> DataFrame:
    """One row a key and month, as soon as all its steps of ``hours`` are in: n, expected, mean, most, complete.

    A month that lacks steps ``wait_hours`` after its end (by the watermark) is
    given then with complete = false.  Of repeated steps the first counts; null
    values and times between steps are left out.
    """
    own = rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    step = (F.dayofmonth("_ts") - 1) * (24 // hours) + F.floor(F.hour("_ts") / hours)
    own = own.where(F.col(value).isNotNull() & (F.hour("_ts") % hours == 0) & (F.minute("_ts") == 0) & (F.second("_ts") == 0))
    own = own.select(*keys, F.year("_ts").alias("year"), F.month("_ts").alias("month"), "_ts", step.cast("int").alias("row_step"), F.col(value).cast("double").alias("row_value"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + (", " if keys else "") + "year int, month int, n int, expected int, mean double, most double, complete boolean"
    made = _Month(keys, 24 // hours, wait_hours * 3_600_000)
    return own.groupBy(*keys, "year", "month").transformWithStateInPandas(statefulProcessor=made, outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _Runs(StatefulProcessor):
    """Holds rows until the watermark has passed them, then the run that they lengthen or end."""

    def __init__(self, keys: list[str], gap_ms: int) -> None:
        self.keys, self.gap_ms = keys, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "value double")
        self.run = handle.getValueState("run", "first long, last long, n int, total double, most double")

    def _ended(self, key: tuple) -> pd.DataFrame:
        first, last, n, total, most = self.run.get()
        stamp = lambda ms: pd.Timestamp(int(ms), unit="ms")
        return pd.DataFrame([dict(zip(self.keys, key, strict=True)) | {"start_time": stamp(first), "end_time": stamp(last), "n": int(n), "mean_intensity": total / n, "max_intensity": most}])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, value in zip(part["row_at"], part["row_value"], strict=True):
                own = (int(at),)
                if not self.waiting.containsKey(own):
                    self.waiting.updateValue(own, (float(value),))
                    self.handle.registerTimer(int(at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = int(expiredTimerInfo.getExpiryTimeInMs())
        if self.waiting.containsKey((at,)):
            (value,) = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            if self.run.exists() and at - self.run.get()[1] > self.gap_ms:
                yield self._ended(key)
                self.run.clear()
            first, _, n, total, most = self.run.get() if self.run.exists() else (at, at, 0, 0.0, value)
            self.run.update((first, at, int(n) + 1, total + value, max(most, value)))
            if timerValues.getCurrentWatermarkInMs() <= at + self.gap_ms:
                self.handle.registerTimer(at + self.gap_ms + 1)
            elif not any(at < k[0] <= at + self.gap_ms for k in self.waiting.keys()):  # a timer in the past would wait for another batch
                yield self._ended(key)
                self.run.clear()
        elif self.run.exists() and at - self.run.get()[1] > self.gap_ms:
            yield self._ended(key)
            self.run.clear()

    def close(self) -> None:
        pass


def exceedance_runs(rows: DataFrame, ts: str, value: str, limit: float, keys: list[str], hours: int = 6, late: str = "1 day") -> DataFrame:
    """Runs of values above ``limit`` by key, steps no further apart than ``hours``: start, end, n, mean and largest value.

    A run is given once, when the watermark has passed its end by more than a
    step.  Of repeated times the first counts.
    """
    own = rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).where(F.col(value) > limit)
    own = own.select(*keys, "_ts", F.unix_millis("_ts").alias("row_at"), F.col(value).cast("double").alias("row_value"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema = f"{kinds}, start_time timestamp, end_time timestamp, n int, mean_intensity double, max_intensity double"
    return own.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Runs(keys, hours * 3_600_000), outputStructType=schema, outputMode="Append", timeMode="EventTime")
