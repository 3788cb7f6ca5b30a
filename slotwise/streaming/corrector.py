"""Keyed bias filter on a stream of settled slots: the streaming twin of the batch fold.

State lives per (series, forecast day): the errors of the settled slots and
the filter's (x, P). A new day is a new key, so the daily reset needs no code.
A finished day is closed by an event-time timer, or dropped by a time-to-live
where no event time is at hand. An update happens only when a slot not seen
before arrives, which makes re-delivery harmless and out-of-order or holey
feeds correct. The batch fold can hand its states over to a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slotwise.operators.correct import GAMMA, GUARDRAIL, Q_NOISE, SIGMA_SP, corrected, day_observations, filter_path, settled_until

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = ("series STRING, settlement_date DATE, run INT, n INT, z DOUBLE, x DOUBLE, p DOUBLE, last_sp INT, updated BOOLEAN, "
         "settled ARRAY<INT>")
COLUMNS = [c.split()[0] for c in STATE.split(", ")]
KEEP_MS = 3 * 24 * 3600 * 1000
DAY_MS = 24 * 3600 * 1000
EPOCH = pd.Timestamp(0).toordinal()


def advance(x: float, p: float, z: float, n: int, q: float = Q_NOISE, sigma: float = SIGMA_SP) -> tuple[float, float, bool]:
    """One transition; an anomalous observation leaves the state as it was."""
    if n == 0 or abs(z) > GUARDRAIL:
        return x, p, False
    prior = p + q
    gain = prior / (prior + sigma * sigma / n)
    return x + gain * (z - x), (1 - gain) * prior, True


class BiasTracker(StatefulProcessor):
    def __init__(self, q: float = Q_NOISE, sigma: float = SIGMA_SP, keep_ms: int | None = None):
        self.q, self.sigma, self.keep_ms = q, sigma, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.errors = handle.getMapState("errors", "settlement_period INT", "err DOUBLE", self.keep_ms)
        self.filter = handle.getValueState("filter", "x DOUBLE, p DOUBLE", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A day has at most 50 slots, so its rows and its map are small.
        batch = pd.concat(list(rows), ignore_index=True)
        seen = {k[0]: v[0] for k, v in self.errors.iterator()}
        x, p = self.filter.get() if self.filter.exists() else (0.0, self.sigma * self.sigma)
        out = []
        for run, part in batch.sort_values(["run", "settlement_period"]).groupby("run", sort=True):
            arrived = dict(zip(part["settlement_period"].astype(int), (part["actual"] - part["q50"]).astype(float)))
            news = any(sp not in seen for sp in arrived)
            seen.update(arrived)
            n, z = len(seen), sum(seen.values()) / len(seen)
            moved = False
            if news:
                x, p, moved = advance(x, p, z, n, self.q, self.sigma)
            out.append((key[0], key[1], int(run), n, z, x, p, max(seen), moved, sorted(seen)))
        for sp, err in seen.items():
            self.errors.updateValue((sp,), (err,))
        self.filter.update((x, p))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """A day that another run has begun: its slots' errors and the filter's state."""
        for row in initialState.itertuples():
            for sp, err in zip(row.slots, row.errs):
                self.errors.updateValue((int(sp),), (float(err),))
            self.filter.update((float(row.x), float(row.p)))

    def close(self) -> None:
        pass


class DayTracker(BiasTracker):
    """The same filter, whose days end: a timer clears a day ``grace_ms`` after its midnight and gives out its last state."""

    def __init__(self, q: float = Q_NOISE, sigma: float = SIGMA_SP, grace_ms: int = 0):
        super().__init__(q, sigma)
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def _closing(self, key: Any) -> int:
        return (pd.Timestamp(key[1]).toordinal() - EPOCH + 1) * DAY_MS + self.grace_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for out in super().handleInputRows(key, rows, timerValues):
            yield out.assign(closed=False)
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(self._closing(key))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        super().handleInitialState(key, initialState, timerValues)
        self.handle.registerTimer(self._closing(key))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        seen = {k[0]: v[0] for k, v in self.errors.iterator()}
        x, p = self.filter.get()
        z = sum(seen.values()) / len(seen)
        self.errors.clear()
        self.filter.clear()
        yield pd.DataFrame([(key[0], key[1], -1, len(seen), z, x, p, max(seen), False, sorted(seen), True)], columns=[*COLUMNS, "closed"])


def track_bias(settled: DataFrame, q: float = Q_NOISE, sigma: float = SIGMA_SP, continuous: bool = False) -> DataFrame:
    """Filter states after every run. ``settled``: series, settlement_date, settlement_period, run, actual, q50.

    ``continuous`` queries drop the state of finished days after a time-to-live.
    That needs processing time, whose batches never end, so a query that drains
    what has landed and stops runs without it.
    """
    settled.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return settled.groupBy("series", "settlement_date").transformWithStateInPandas(
        statefulProcessor=BiasTracker(q, sigma, KEEP_MS if continuous else None), outputStructType=STATE, outputMode="Append",
        timeMode="ProcessingTime" if continuous else "None")


def track_days(settled: DataFrame, late: str = "1 hour", grace_ms: int = 0, q: float = Q_NOISE, sigma: float = SIGMA_SP, initial: DataFrame | None = None) -> DataFrame:
    """Filter states after every run and at the close of each day (``closed``, run -1), whose state is then gone.

    ``settled`` has ``run_time`` (timestamp) besides the columns of
    :func:`track_bias`; a day closes when the runs' clock, less ``late``, has passed its
    midnight by ``grace_ms``. ``initial``: states of :func:`handed_over`.
    """
    settled.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    key = ["series", "settlement_date"]
    return settled.withWatermark("run_time", late).groupBy(*key).transformWithStateInPandas(
        statefulProcessor=DayTracker(q, sigma, grace_ms), outputStructType=f"{STATE}, closed BOOLEAN", outputMode="Append", timeMode="EventTime",
        initialState=None if initial is None else initial.groupBy(*key))


def handed_over(df: DataFrame, until: int, q: float = Q_NOISE, sigma: float = SIGMA_SP) -> DataFrame:
    """The batch fold's state of each day after run ``until``: series, settlement_date, slots, errs, x, p.

    A run that brings no slot is no update, as on the stream.
    """
    key = ["series", "settlement_date"]
    obs = day_observations(df, key)
    news = F.filter("obs", lambda o, i: (o["h"] <= until) & (o["n"] > F.coalesce(F.get("obs", i - 1)["n"], F.lit(0))))
    last = F.element_at(filter_path(news, F.lit(q), F.lit(sigma)), -1)
    mine = df.where((F.col("settlement_period") <= settled_until(until)) & (F.col("actual") - F.col("q50")).isNotNull())
    slots = mine.groupBy(*key).agg(F.collect_list(F.struct("settlement_period", (F.col("actual") - F.col("q50")).alias("err"))).alias("e"))
    return obs.where(F.size(news) > 0).select(*key, last.alias("s")).join(slots, key).select(
        *key, F.col("e.settlement_period").alias("slots"), F.col("e.err").alias("errs"), F.col("s.x").alias("x"), F.col("s.p").alias("p"))


def kept_state(spark: SparkSession, checkpoint: str, variable: str, flat: bool = True) -> DataFrame:
    """A state variable of a stopped or running query, read from its checkpoint: key, value, partition."""
    return (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
            .option("flattenCollectionTypes", str(flat).lower()).load())


def emit_horizon(states: DataFrame, forecast: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """Corrected bands of the slots still open after each run (stream-static join on the published forecast)."""
    f = forecast.select("series", "settlement_date", "settlement_period", "q10", "q50", "q90")
    j = states.join(f, ["series", "settlement_date"]).where(~F.array_contains("settled", F.col("settlement_period")))
    # Slots after the latest settled one decay with distance; an interior hole gets the full correction.
    pos = F.greatest(F.col("settlement_period") - F.col("last_sp") - 1, F.lit(0))
    cols = corrected("q10", "q50", "q90", F.col("x"), F.col("p"), pos, gamma)
    return j.select("series", "settlement_date", "run", "settlement_period", *[c.alias(n) for n, c in cols.items()])
