"""Streams over their life: timers, restarts, hand-over, late rows, rules on what is stored."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from slotwise.plans.catalog import QUERIES
from slotwise.session import fresh_path
from slotwise.streaming import corrector, feeds, health

FOLDER = "/root/testdata/sf0.01"
UTC = dt.timezone.utc


def ms(*at):
    return int(dt.datetime(*at, tzinfo=UTC).timestamp() * 1000)


def test_class_follows_the_clock_alone():
    limits, day = health.Limits(), ms(2024, 1, 15) // health.DAY
    feed = health.Feed()
    assert feed.class_at(ms(2024, 1, 15), limits) == "unknown"
    feed.take(day, None, None, ms(2024, 1, 15))
    for period in (15, 16, 17):
        feed.take(day, period, ms(2024, 1, 15) + period * 1800000, ms(2024, 1, 15, 8, 40))
    feed.take(day, 17, ms(2024, 1, 15, 8, 30), ms(2024, 1, 15, 8, 40))
    feed.take(day + 1, 3, ms(2024, 1, 16, 1, 30), ms(2024, 1, 15, 8, 41))
    assert feed.slots == [15, 16, 17] and feed.updated == ms(2024, 1, 15, 8, 40)
    clock, seen = ms(2024, 1, 15, 8, 41), []
    feed.health = feed.class_at(clock, limits)
    while clock < ms(2024, 1, 17, 15):
        clock = feed.next_change(clock, limits)
        if feed.class_at(clock, limits) != feed.health:
            feed.health = feed.class_at(clock, limits)
            seen.append((dt.datetime.fromtimestamp(clock / 1000, UTC).strftime("%d %H:%M"), feed.health))
    # Delayed 151 minutes after the last slot, stale 361 after the last update, quiet at night, missed from 14:00 of the next day.
    assert seen == [("15 11:01", "delayed"), ("15 14:41", "stale"), ("15 22:00", "ok"), ("16 14:00", "daily_missed"), ("17 00:00", "ok"), ("17 14:00", "daily_missed")]


def test_wall_clock_timers_fire_without_rows(spark):
    now = dt.datetime.now(UTC).replace(tzinfo=None)
    path, out = fresh_path(spark, "rows"), fresh_path(spark, "changes")
    schema = "series string, settlement_date date, settlement_period int, slot_end timestamp, arrived timestamp"
    rows = spark.createDataFrame([("a", now.date(), None, None, now), ("a", now.date(), 1, now, now)], schema)
    rows.coalesce(1).write.parquet(path)
    # One "minute" lasts 10 ms; no trading window, no daily run.
    limits = health.Limits(stale=600, delayed=200, window=(0, 24), missed_hour=24, minute=10)
    changes = health.watch_feeds(feeds.landed_stream(spark, path, rows.schema), limits=limits, wall_clock=True)
    q = (changes.writeStream.outputMode("append").option("checkpointLocation", f"{out}-checkpoint").trigger(processingTime="300 milliseconds")
         .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start())
    try:
        end, got = time.time() + 90, []
        while time.time() < end and "stale" not in [r.health for r in got]:
            time.sleep(1)
            try:
                got = sorted(spark.read.parquet(out).collect(), key=lambda r: r["at"])
            except Exception as e:
                assert "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e)
    finally:
        q.stop()
    assert [r.health for r in got if r.silent][-1] == "stale"
    assert all(r.n_actual == 1 for r in got) and (got[-1]["at"] - got[0]["at"]).total_seconds() > 1


def test_silent_feeds_turn_without_rows(spark):
    got = QUERIES["silent_feeds"].run(spark, FOLDER).collect()
    classes = {r.health for r in got}
    assert classes == {"ok", "delayed", "stale", "daily_missed"}
    last = max(r.settlement_date for r in got)
    assert {r.health for r in got if r.since.date() > last} == {"ok", "daily_missed"}


def test_planted_faults_break_both_rules_and_clear(spark):
    got = QUERIES["streamed_consistency"].run(spark, FOLDER).collect()
    assert {r.inconsistency for r in got if r.phase == 0} == {"A", "B", "none"}
    assert {r.inconsistency for r in got if r.phase == 1} == {"none"}


def test_late_rows_are_counted_and_merged(spark):
    got = QUERIES["streamed_late_rows"].run(spark, FOLDER).collect()
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert sum(r.n_late for r in got) > 100 and sum(r.n + r.n_late for r in got) == events.count()


def settled(spark, rows):
    day = dt.date(2024, 1, 5)
    full = [("s", day + dt.timedelta(days=d), sp, run, a, q, dt.datetime(2024, 1, 5 + d, 9) + dt.timedelta(hours=run)) for d, sp, run, a, q in rows]
    return spark.createDataFrame(full, "series string, settlement_date date, settlement_period int, run int, actual double, q50 double, run_time timestamp")


def states(spark, rows, path=None, out=None, **more):
    path, out = path or fresh_path(spark, "in"), out or fresh_path(spark, "out")
    df = settled(spark, rows)
    df.coalesce(1).write.mode("append").parquet(path)
    feeds.run_updates(corrector.track_days(feeds.landed_stream(spark, path, df.schema), **more), f"{out}/rows", f"{out}/checkpoint", mode="append")
    got = spark.read.schema(f"{corrector.STATE}, closed BOOLEAN").parquet(f"{out}/rows").collect()
    return path, out, sorted((r.settlement_date.day, r.run, r.n, round(r.x, 9), round(r.p, 9), r.closed) for r in got)


def test_holey_unordered_and_repeated_rows_over_restarts(spark):
    rows = [(0, 3, 0, 20.0, 10.0), (0, 1, 0, 14.0, 10.0), (0, 7, 1, 50.0, 20.0), (0, 3, 1, 99.0, 10.0), (0, 7, 2, 50.0, 20.0), (0, 5, 2, 30.0, 20.0)]
    whole = states(spark, rows)[2]
    path = out = None
    for part in (rows[:2], rows[2:4], rows[4:]):
        path, out, got = states(spark, part, path, out)
    assert got == whole and [g[2] for g in got] == [2, 3, 4]


def test_days_close_once_and_leave_no_state(spark):
    path, out, got = states(spark, [(0, 1, 0, 14.0, 10.0), (1, 1, 0, 16.0, 10.0)])
    # The clock stands at 08:00 of the second day: the first is closed.
    assert [(d, run, closed) for d, run, *_, closed in got] == [(5, -1, True), (5, 0, False), (6, 0, False)]
    assert got[0][2:5] == got[1][2:5]
    assert [r.key.settlement_date.day for r in corrector.kept_state(spark, f"{out}/checkpoint", "errors").collect()] == [6]
    assert corrector.kept_state(spark, f"{out}/checkpoint", "filter").count() == 1
    _, _, got = states(spark, [(4, 1, 0, 16.0, 10.0)], path, out)
    assert [(d, run) for d, run, *_, closed in got if closed] == [(5, -1), (6, -1)]
    # A row of a closed day is late and opens nothing.
    _, _, again = states(spark, [(0, 2, 1, 16.0, 10.0)], path, out)
    assert again == got


def test_first_batch_of_a_gate_has_nothing_late(spark):
    path, out = fresh_path(spark, "gate"), fresh_path(spark, "split")
    schema = "k int, ts timestamp_ntz"
    end = F.window(F.col("ts").cast("timestamp"), "30 minutes")["end"]

    def deliver(*rows):
        df = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for k, h in rows], schema)
        df.coalesce(1).write.mode("append").parquet(path)
        feeds.split_late(feeds.landed_stream(spark, path, df.schema), out, f"{out}-checkpoint", end, "ts", "2 hours")
        return {late: sorted(r.k for r in feeds.split_rows(spark, out, df.schema, late, stream=False).collect()) for late in (False, True)}

    assert deliver((1, 5), (2, 0)) == {False: [1, 2], True: []}
    # The mark is 03:00 now; a half hour that ends on it is behind it.
    assert deliver((3, 2.5), (4, 2.6), (5, 3), (6, 9)) == {False: [1, 2, 5, 6], True: [3, 4]}
    assert deliver((7, 6.4), (8, 6.5), (9, 7)) == {False: [1, 2, 5, 6, 9], True: [3, 4, 7, 8]}
    marks = spark.read.parquet(f"{out}/marks").collect()
    assert sum(r.n for r in marks) == 9 and sum(r.n_late for r in marks) == 4


@pytest.mark.parametrize("name", ["streamed_filter_restart", "streamed_filter_handover"])
def test_restart_equals_unbroken_run(spark, name):
    unbroken = {(r.settlement_date, r.run): (r.n, r.x, r.p) for r in QUERIES["streamed_filter_states"].run(spark, FOLDER).collect()}
    got = {(r.settlement_date, r.run): (r.n, r.x, r.p) for r in QUERIES[name].run(spark, FOLDER).collect() if r.run >= 0}
    assert got == {k: v for k, v in unbroken.items() if name == "streamed_filter_restart" or k[1] > 4}


def test_freshness_tells_inconsistent_state(spark):
    """The day that is open at the query's clock has rows that the rule of settled against corrected slots tells apart."""
    rows = QUERIES["streamed_freshness"].run(spark, FOLDER).collect()
    found = {(r.series, r.fc_date): r.inconsistency for r in rows}
    assert found == {(r.series, r.fc_date): r.inconsistency for r in QUERIES["feed_freshness"].run(spark, FOLDER).collect()}
    assert {d for (_, d), x in found.items() if x == "B"} == {dt.date(2024, 1, 15)}
