"""Health of feeds by timers: a feed that goes silent turns delayed, stale or missed without a row arriving.

State is one row per feed: the published day, its settled slots, the latest
slot's end, the last update, and the class given out last. The class is a
function of that state and the clock that can only change at a few moments
(limits running out, the trading window opening and closing, midnight, the hour
of the daily run), so a timer waits for the next of them. Rows and timers are
replayed in order of arrival, so the log of changes does not depend on how the
rows were cut into micro-batches.

The clock is the watermark (``EventTime``: replays, drains) or the wall clock
(``ProcessingTime``: a query that runs on).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slotwise.operators.monitor import DELAY_MIN, MISSED_HOUR, STALE_MIN, WINDOW
from slotwise.streaming.corrector import ROCKSDB

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
FEED = "day INT, state_day INT, slots ARRAY<INT>, last_end BIGINT, updated BIGINT, clock BIGINT, health STRING"
CHANGES = "series STRING, at BIGINT, day INT, n_actual INT, last_sp INT, health STRING, silent BOOLEAN"


@dataclass(frozen=True)
class Limits:
    """When a feed is late; minutes can be shortened for trials."""

    stale: int = STALE_MIN
    delayed: int = DELAY_MIN
    window: tuple[int, int] = WINDOW
    missed_hour: int = MISSED_HOUR
    minute: int = MINUTE


@dataclass
class Feed:
    day: int | None = None
    state_day: int | None = None
    slots: list[int] = field(default_factory=list)
    last_end: int = 0
    updated: int | None = None
    clock: int = 0
    health: str | None = None

    def take(self, day: int, period: int | None, slot_end: int | None, at: int) -> None:
        """A row without a period publishes a day; one with a period settles a slot of the published day."""
        if period is None:
            if self.day is None or day > self.day:
                self.day, self.slots, self.last_end = day, [], 0
        elif day == self.day:
            if period not in self.slots:
                self.slots.append(period)
            self.last_end = max(self.last_end, slot_end)
            self.state_day, self.updated = day, at

    def class_at(self, now: int, limits: Limits) -> str:
        today, hour = now // DAY, now // HOUR % 24
        active = limits.window[0] <= hour < limits.window[1]
        if self.day is None and self.updated is None:
            return "unknown"
        if self.day is not None and self.day < today and hour >= limits.missed_hour:
            return "daily_missed"
        if self.state_day == today and active and (now - self.updated) // limits.minute > limits.stale:
            return "stale"
        if self.day == today and active and self.slots and (now - self.last_end) // limits.minute > limits.delayed:
            return "delayed"
        return "ok"

    def next_change(self, now: int, limits: Limits) -> int:
        """The next moment after ``now`` at which the class can be another one without a row."""
        midnight = now // DAY * DAY
        moments = [midnight + h * HOUR for h in (*limits.window, limits.missed_hour, 24)]
        if self.slots:
            moments.append(self.last_end + (limits.delayed + 1) * limits.minute)
        if self.updated is not None:
            moments.append(self.updated + (limits.stale + 1) * limits.minute)
        return min(m for m in moments if m > now)


class FeedWatch(StatefulProcessor):
    """Class changes of each feed. Rows: series, settlement_period, day, slot_end, arrived_ms (times in milliseconds, day as number)."""

    def __init__(self, limits: Limits = Limits(), wall_clock: bool = False):
        self.limits, self.wall_clock = limits, wall_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", FEED)

    def _load(self) -> Feed:
        if not self.feed.exists():
            return Feed()
        day, state_day, slots, *rest = self.feed.get()
        return Feed(day, state_day, list(slots), *rest)

    def _say(self, out: list, key: Any, feed: Feed, at: int, silent: bool) -> None:
        now = feed.class_at(at, self.limits)
        if now != feed.health:
            feed.health = now
            out.append((key[0], at, feed.day, len(feed.slots), max(feed.slots, default=0), now, silent))

    def _silence(self, out: list, key: Any, feed: Feed, until: int) -> None:
        """Changes that come with the clock alone."""
        while feed.health is not None and (at := feed.next_change(feed.clock, self.limits)) <= until:
            self._say(out, key, feed, at, True)
            feed.clock = at
        feed.clock = max(feed.clock, until)

    def _keep(self, feed: Feed) -> None:
        self.feed.update(tuple(asdict(feed).values()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(feed.next_change(feed.clock, self.limits))

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # One feed has at most 50 rows a day.
        batch = pd.concat(list(rows), ignore_index=True)
        # A clock row has no series: it moves the watermark and nothing else.
        if key[0] is None:
            return
        feed, out = self._load(), []
        if self.wall_clock:
            batch["arrived_ms"] = timerValues.getCurrentProcessingTimeInMs()
        batch = batch.sort_values(["arrived_ms", "settlement_period"], na_position="first")
        for at, part in batch.groupby("arrived_ms", sort=True):
            at = max(int(at), feed.clock)
            self._silence(out, key, feed, at - 1)
            for day, period, end in zip(part["day"], part["settlement_period"], part["slot_end"]):
                feed.take(int(day), None if pd.isna(period) else int(period), None if pd.isna(end) else int(end), at)
            feed.clock = at
            self._say(out, key, feed, at, False)
        self._keep(feed)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        feed, out = self._load(), []
        now = timerValues.getCurrentProcessingTimeInMs() if self.wall_clock else timerValues.getCurrentWatermarkInMs()
        self._silence(out, key, feed, max(now, expiredTimerInfo.getExpiryTimeInMs()))
        self._keep(feed)
        yield self._frame(out)

    def close(self) -> None:
        pass


def watch_feeds(rows: DataFrame, late: str = "1 hour", limits: Limits = Limits(), wall_clock: bool = False) -> DataFrame:
    """Changes of class: series, at, settlement_date, n_actual, last_sp, health, and whether the clock alone brought it.

    ``rows``: series, settlement_date, settlement_period (none: the day is
    published), slot_end and arrived (timestamps). Rows without a series move
    the clock. ``late`` is how long arrivals may come out of order.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    r = rows.select("series", "settlement_period", F.unix_date("settlement_date").alias("day"), F.unix_millis("slot_end").alias("slot_end"),
                    F.unix_millis("arrived").alias("arrived_ms"), "arrived")
    if not wall_clock:
        r = r.withWatermark("arrived", late)
    found = r.groupBy("series").transformWithStateInPandas(statefulProcessor=FeedWatch(limits, wall_clock), outputStructType=CHANGES, outputMode="Append",
                                                           timeMode="ProcessingTime" if wall_clock else "EventTime")
    return found.select("series", F.timestamp_millis("at").alias("at"), F.date_from_unix_date("day").alias("settlement_date"), "n_actual", "last_sp", "health", "silent")
