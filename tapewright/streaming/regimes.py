"""A monitor of a stream of outcomes that tells when the market turns."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tapewright.operators.regimes import BEAR, BULL, LEAST, TARGETS

DAY_MS = 86_400_000
STATE = "waiting array<struct<day: long, mark: string, label: int>>, recent array<int>, regime string"
ALERT = "key string, day date, before string, regime string, n long, danger double, target double, trading string"


class RegimeMonitor(StatefulProcessor):
    """By key the labels of the last ``most`` outcomes, those that wait for their day's end, and the market so far.

    A day is taken up when the watermark has passed its end, by a timer, so that outcomes may come in any order until
    then. Of a waiting day only the last ``most`` outcomes are kept, as no others count: the state is bounded.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("market", STATE)

    def read(self) -> tuple[dict[int, list], list[int], str | None]:
        row = self.state.get() if self.state.exists() else None
        waiting: dict[int, list] = {}
        for day, mark, label in row[0] if row else ():
            waiting.setdefault(day, []).append((mark, label))
        return waiting, list(row[1]) if row else [], row[2] if row else None

    def write(self, waiting: dict[int, list], recent: list[int], regime: str | None) -> None:
        self.state.update(([(day, mark, label) for day, rows in waiting.items() for mark, label in rows], recent, regime))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, recent, regime = self.read()
        for r in rows:
            day = r.known_day
            if day not in waiting:
                self.handle.registerTimer((day + 1) * DAY_MS)
            kept = waiting.setdefault(day, [])
            kept.append((hashlib.md5((r.pattern_id or "").encode()).hexdigest(), r.label))
            if len(kept) > 2 * self.most:
                waiting[day] = sorted(kept, key=lambda x: x[0])[-self.most :]
        self.write(waiting, recent, regime)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting, recent, regime = self.read()
        alerts = []
        for day in sorted(d for d in waiting if (d + 1) * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs()):
            recent = [*recent, *[label for _, label in sorted(waiting.pop(day), key=lambda x: x[0])]][-self.most :]
            n = len(recent)
            danger, target = recent.count(0) / n, recent.count(2) / n
            now = "UNKNOWN" if n < LEAST else "BULL" if danger < BULL and target > TARGETS else "BEAR" if danger > BEAR else "SIDEWAYS"
            if regime is not None and now != regime:
                trading = "OPEN" if now == "BULL" and regime in ("BEAR", "SIDEWAYS") else "CLOSED" if regime == "BULL" and now in ("BEAR", "SIDEWAYS") else None
                alerts.append(Row(key=key[0], day=dt.date(1970, 1, 1) + dt.timedelta(days=day), before=regime, regime=now, n=n, danger=danger, target=target, trading=trading))
            regime = now
        self.write(waiting, recent, regime)
        return iter(alerts)

    def close(self) -> None:
        pass


def regime_alerts(outcomes: DataFrame, key: str, lag_days: int = 60, most: int = 100, label: str = "label", late: str = "1 day") -> DataFrame:
    """A stream of patterns' outcomes (pattern_id, end_date, ``key``, ``label``) as alerts when a key's market turns.

    The alerts are those of the operator of this name on tables, if no outcome comes more than ``late`` after later days'
    ones. State is kept by key in RocksDB and survives a restart from the query's checkpoint.
    """
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = F.date_add("end_date", lag_days + 1)
    rows = outcomes.select(F.col(key).alias("key"), F.col("pattern_id").cast("string").alias("pattern_id"), F.col(label).cast("int").alias("label"), F.unix_date(known).cast("long").alias("known_day"), known.cast("timestamp").alias("known"))
    found = rows.withWatermark("known", late).groupBy("key").transformWithState(RegimeMonitor(most), ALERT, "Append", "EventTime")
    return found.withColumnRenamed("key", key)
