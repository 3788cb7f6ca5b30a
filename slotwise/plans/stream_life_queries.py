"""Streams over their life: feeds that fall silent, rules on what is stored, days that close, restarts, rows that come late."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.plans import inputs as I
from slotwise.plans.registry import query
from slotwise.plans.stream_queries import _RUNS, KEY, _land, _settled_runs
from slotwise.session import Tables, fresh_path
from slotwise.sources.increments import empty_table
from slotwise.streaming import corrector as SC
from slotwise.streaming import feeds as SF
from slotwise.streaming import health as SH

DAY_KEY = ["series", "settlement_date"]


def _arrivals(t: Tables):
    """Publications and settled slots of each feed with the time they arrive.

    A day is published at midnight, every fifth day at 15:00 only. Slots arrive
    when they end, but not before their day is published; on every third day
    those of 10:00 to 17:00 arrive together at 17:00.
    """
    p = I.panel(t, by_type=True).select("series", *KEY, "day_ix")
    hours = lambda h: F.col("settlement_date").cast("timestamp") + F.expr(f"interval {h} hours")
    published = F.when(F.col("day_ix") % 5 == 0, hours(15)).otherwise(hours(0))
    days = p.select("series", "settlement_date", "day_ix").distinct().select(
        "series", "settlement_date", F.lit(None).cast("int").alias("settlement_period"), F.lit(None).cast("timestamp").alias("slot_end"), published.alias("arrived"))
    end = F.col("settlement_date").cast("timestamp") + F.make_dt_interval(mins=F.col("settlement_period") * 30)
    held = (F.col("day_ix") % 3 == 0) & F.col("settlement_period").between(20, 33)
    slots = p.select("series", *KEY, end.alias("slot_end"), F.greatest(F.when(held, hours(17)).otherwise(end), published).alias("arrived"))
    return days.unionByName(slots)


# One row per minute and feed, the class of that minute, and of these the minutes at which the class changes.
_SILENT = """
WITH p AS (SELECT series, settlement_date, settlement_period, day_ix FROM c_panel_type),
days AS (SELECT DISTINCT series, settlement_date, CAST(settlement_date AS TIMESTAMP) + INTERVAL 1 HOUR * (CASE WHEN day_ix % 5 = 0 THEN 15 ELSE 0 END) AS arrived FROM p),
slots AS (SELECT p.series, p.settlement_date, settlement_period, CAST(p.settlement_date AS TIMESTAMP) + INTERVAL 30 MINUTE * settlement_period AS slot_end,
    greatest(days.arrived, CASE WHEN day_ix % 3 = 0 AND settlement_period BETWEEN 20 AND 33 THEN CAST(p.settlement_date AS TIMESTAMP) + INTERVAL 17 HOUR
      ELSE CAST(p.settlement_date AS TIMESTAMP) + INTERVAL 30 MINUTE * settlement_period END) AS arrived FROM p JOIN days USING (series, settlement_date)),
ends AS (SELECT max(arrived) + INTERVAL '2 days 610 minutes' AS final FROM slots),
grid AS (SELECT series, unnest(generate_series(first, final, INTERVAL 1 MINUTE)) AS since FROM (SELECT series, min(arrived) AS first FROM days GROUP BY 1), ends),
pub AS (SELECT g.series, g.since, d.settlement_date AS day FROM grid g ASOF JOIN days d ON g.series = d.series AND g.since >= d.arrived),
seen AS (SELECT series, settlement_date, arrived, count(*) OVER w AS n_actual, max(settlement_period) OVER w AS last_sp, max(slot_end) OVER w AS last_end
    FROM slots WINDOW w AS (PARTITION BY series, settlement_date ORDER BY arrived)),
mine AS (SELECT pub.*, n_actual, last_sp, last_end FROM pub ASOF LEFT JOIN (SELECT DISTINCT * FROM seen) s ON pub.series = s.series AND pub.day = s.settlement_date AND pub.since >= s.arrived),
touched AS (SELECT mine.*, s.settlement_date AS state_day, s.arrived AS updated FROM mine ASOF LEFT JOIN (SELECT DISTINCT series, settlement_date, arrived FROM seen) s ON mine.series = s.series AND mine.since >= s.arrived),
classed AS (SELECT *, CASE WHEN day < CAST(since AS DATE) AND hour(since) >= 14 THEN 'daily_missed'
    WHEN state_day = CAST(since AS DATE) AND hour(since) BETWEEN 7 AND 21 AND datediff('minute', updated, since) > 360 THEN 'stale'
    WHEN day = CAST(since AS DATE) AND hour(since) BETWEEN 7 AND 21 AND n_actual > 0 AND datediff('minute', last_end, since) > 150 THEN 'delayed' ELSE 'ok' END AS health FROM touched),
turned AS (SELECT *, lag(health) OVER (PARTITION BY series ORDER BY since) AS before FROM classed)
SELECT series, since, day AS settlement_date, CAST(coalesce(n_actual, 0) AS INTEGER) AS n_actual, CAST(coalesce(last_sp, 0) AS INTEGER) AS last_sp, health FROM turned WHERE before IS DISTINCT FROM health"""


@query("I8", sql=_SILENT)
def silent_feeds(t: Tables):
    """Changes of each feed's class: while rows arrive, and after the last of them while only the clock goes on."""
    spark = t.spark
    rows = _arrivals(t)
    path, schema = _land(rows, "arrivals")
    out = fresh_path(spark, "health")

    def drain():
        SF.run_updates(SH.watch_feeds(SF.landed_stream(spark, path, schema)), f"{out}/changes", f"{out}/checkpoint", mode="append")

    drain()
    # Two days later nothing has come but the time; the watermark is an hour behind it.
    last = spark.read.schema(schema).parquet(path).agg((F.max("arrived") + F.expr("interval 2 days 670 minutes")).alias("arrived"))
    clock = last.select(*[(F.col(f.name) if f.name == "arrived" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    clock.write.mode("append").parquet(path)
    drain()
    found = spark.read.schema("series STRING, at TIMESTAMP, settlement_date DATE, n_actual INT, last_sp INT, health STRING, silent BOOLEAN").parquet(f"{out}/changes")
    return found.select("series", F.col("at").cast("timestamp_ntz").alias("since"), "settlement_date", "n_actual", "last_sp", "health")


# Faults of the first phase: on every seventh day no outcome is published, on another seventh the correction stops after run 5.
_HELD_BACK, _STOPPED, _LAST_RUN = "day_ix % 7 = 3", "day_ix % 7 = 5", 5


@query("I9 I13", sql=f"""
WITH r AS (SELECT *, CAST(greatest(ceil((settlement_period - 17) / 2.0), 0) AS INTEGER) AS run FROM c_wf),
d AS (SELECT settlement_date, any_value(day_ix) AS day_ix, count(*) AS n, count(*) FILTER (WHERE run < 10) AS n_run, count(*) FILTER (WHERE run <= {_LAST_RUN}) AS n_first FROM r GROUP BY 1),
f AS (SELECT settlement_date, n, g.phase, CASE WHEN g.phase = 0 AND {_HELD_BACK} THEN 0 ELSE n_run END AS n_actual, CASE WHEN g.phase = 0 AND {_STOPPED} THEN n_first ELSE n_run END AS n_corrected
  FROM d, (VALUES (0), (1)) g(phase) WHERE n_run > 0)
SELECT CAST(phase AS BIGINT) AS phase, settlement_date, n_actual, n_corrected, CASE WHEN n_corrected > 0 THEN n - n_corrected ELSE 0 END AS n_open,
  CASE WHEN n_corrected > 0 AND n_actual = 0 THEN 'A' WHEN n_actual > n_corrected + 3 THEN 'B' ELSE 'none' END AS inconsistency
FROM f WHERE n_actual + n_corrected > 0""")
def streamed_consistency(t: Tables):
    """Published outcomes against what the filter's state and its stored corrections really hold, with faults planted and then mended."""
    spark = t.spark
    f = I.forecasts(t)
    runs = _settled_runs(t).join(f.select(*DAY_KEY, "settlement_period", "day_ix"), [*DAY_KEY, "settlement_period"])
    pub, pub_schema = _land(f.select("series", *KEY, "q10", "q50", "q90"), "published")
    columns, outcome = ["series", *KEY, "run", "actual", "q50"], ["series", *KEY]
    stopped, held = F.expr(f"{_STOPPED} AND run > {_LAST_RUN}"), F.expr(_HELD_BACK)
    feed, schema = _land(runs.where(~stopped).select(*columns), "runs")
    shown, shown_schema = _land(runs.where(~held).select(*outcome), "shown")
    out = fresh_path(spark, "consistency")

    def both():
        states = SC.track_bias(SF.landed_stream(spark, feed, schema))
        corrected = SC.emit_horizon(states, spark.read.schema(pub_schema).parquet(pub))
        SF.run_updates(corrected, f"{out}/corrected", f"{out}/tracker", mode="append")
        SF.watch_consistency(SF.feed_status(SF.landed_stream(spark, shown, shown_schema), DAY_KEY), f"{out}/watch", f"{out}/checkpoint", DAY_KEY,
                             lambda: SC.kept_state(spark, f"{out}/tracker", "errors").select("key.*"),
                             lambda: spark.read.schema(corrected.schema).parquet(f"{out}/corrected"))

    both()
    runs.where(stopped).select(*columns).write.mode("append").parquet(feed)
    runs.where(held).select(*outcome).write.mode("append").parquet(shown)
    both()
    status = spark.read.option("basePath", f"{out}/watch/status").schema(
        "series STRING, settlement_date DATE, n_actual BIGINT, n_corrected BIGINT, n_open BIGINT, inconsistency STRING, batch BIGINT").parquet(f"{out}/watch/status")
    return status.select(F.col("batch").alias("phase"), "settlement_date", "n_actual", "n_corrected", "n_open", "inconsistency")


def _timed_runs(t: Tables):
    """The settled runs with the time of each: 08:30 and every hour after."""
    at = F.col("settlement_date").cast("timestamp") + F.make_dt_interval(mins=F.lit(510) + F.col("run") * 60)
    return _settled_runs(t).withColumn("run_time", at)


_MIDDLE = "(SELECT settlement_date FROM (SELECT DISTINCT settlement_date FROM a) ORDER BY 1 LIMIT 1 OFFSET (SELECT count(DISTINCT settlement_date) // 2 FROM a))"
# The last state of a day is given out again when the runs' clock, an hour back, has passed its midnight.
_CLOSED = """
, clock AS (SELECT max(CAST(settlement_date AS TIMESTAMP) + INTERVAL 1 MINUTE * (510 + 60 * run)) - INTERVAL 1 HOUR AS now_ FROM a),
l AS (SELECT f.* FROM f JOIN (SELECT settlement_date, max(k) AS k FROM f GROUP BY 1) USING (settlement_date, k)),
closed AS (SELECT l.*, CAST(settlement_date AS TIMESTAMP) + INTERVAL 1 DAY < now_ AS closed FROM l, clock)
"""


@query("I5 I13 I4", rnd="z x p", sql=_RUNS + _CLOSED + """
SELECT settlement_date, run, n, z, x, p, last_sp, 0 AS closed FROM f WHERE k > 0
UNION ALL SELECT settlement_date, -1, n, z, x, p, last_sp, 1 FROM closed WHERE closed""")
def streamed_filter_restart(t: Tables):
    """The filter stopped after run 4 of a day and started again from its checkpoint; finished days give out their last state."""
    spark = t.spark
    path, out, _ = _restarted(t)
    found = spark.read.schema(f"{SC.STATE}, closed BOOLEAN").parquet(f"{out}/states")
    return found.select("settlement_date", "run", "n", "z", "x", "p", "last_sp", F.col("closed").cast("int").alias("closed"))


def _restarted(t: Tables):
    spark = t.spark
    runs = _timed_runs(t)
    days = runs.select("settlement_date").distinct()
    middle = days.orderBy("settlement_date").offset(days.count() // 2).limit(1)
    runs = runs.join(F.broadcast(middle.withColumnRenamed("settlement_date", "middle")))
    first = F.expr("settlement_date < middle OR (settlement_date = middle AND run <= 4)")
    path, schema = _land(runs.where(first).drop("middle"), "runs")
    out = fresh_path(spark, "filter")

    def go():
        # A new query object each time: what it knows comes from the checkpoint.
        SF.run_updates(SC.track_days(SF.landed_stream(spark, path, schema)), f"{out}/states", f"{out}/checkpoint", mode="append")

    go()
    runs.where(~first).drop("middle").write.mode("append").parquet(path)
    go()
    return path, out, schema


@query("I5", sql=_RUNS + _CLOSED + """
SELECT l.settlement_date, e.n AS n_slots FROM closed l JOIN (SELECT settlement_date, count(*) AS n FROM a GROUP BY 1) e USING (settlement_date) WHERE NOT closed""")
def state_of_open_days(t: Tables):
    """What the restarted filter still holds: the days that have not ended, read from its checkpoint."""
    _, out, _ = _restarted(t)
    held = SC.kept_state(t.spark, f"{out}/checkpoint", "errors").select("key.*")
    return held.groupBy("settlement_date").agg(F.count("*").alias("n_slots"))


@query("I5 I13 J9", rnd="z x p", sql=_RUNS + "SELECT settlement_date, run, n, z, x, p, last_sp FROM f WHERE run > 4")
def streamed_filter_handover(t: Tables):
    """The batch fold up to run 4 is the stream's initial state; the later runs give the states of an unbroken run."""
    spark = t.spark
    begun, begun_schema = _land(SC.handed_over(I.forecasts(t), 4), "begun")
    path, schema = _land(_timed_runs(t).where("run > 4"), "runs")
    out = SC.track_days(SF.landed_stream(spark, path, schema), initial=spark.read.schema(begun_schema).parquet(begun), late="60 days")
    s = SF.drain(out, ["series", "settlement_date", "run"], "handover", mode="append")
    return s.where("NOT closed").select("settlement_date", "run", "n", "z", "x", "p", "last_sp")


# Deliveries: an event arrives with its third of the days, every eleventh one a third later.
_THIRD = "least(CAST(floor(({day} - 1) / 10) AS INT), 2)"
_LATE = "4 hours"


@query("I7 I2 A17", rnd="total late_total", sql=f"""
WITH e AS (SELECT *, least(CAST(floor((day(ts) - 1) / 10) AS INTEGER), 2) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS phase FROM c_ev),
m AS (SELECT phase + 1 AS phase, max(max(ts)) OVER (ORDER BY phase) - INTERVAL {_LATE} AS mark FROM e GROUP BY phase),
s AS (SELECT e.*, coalesce(time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE <= mark, false) AS late FROM e LEFT JOIN m USING (phase))
SELECT event_type AS series, settlement_date, settlement_period, CAST(coalesce(sum(dval) FILTER (WHERE NOT late), 0) AS DOUBLE) AS total, count(*) FILTER (WHERE NOT late) AS n,
  CAST(coalesce(sum(dval) FILTER (WHERE late), 0) AS DOUBLE) AS late_total, count(*) FILTER (WHERE late) AS n_late FROM s GROUP BY 1, 2, 3""")
def streamed_late_rows(t: Tables):
    """On-time sums behind a watermark of hours; rows behind it are kept apart, counted and merged into the table."""
    spark = t.spark
    events = t.events.select("event_id", "event_type", "ts", "value")
    phase = F.expr(_THIRD.format(day="day(ts)")) + (F.col("event_id") % 11 == 0).cast("int")
    feed, table, out = fresh_path(spark, "deliveries"), fresh_path(spark, "slots"), fresh_path(spark, "late")
    empty_table(spark, table, SF.SLOT_TABLE, "settlement_date")
    schema = events.schema
    events = events.withColumn("phase", phase)
    window_end = F.window(F.col("ts").cast("timestamp"), "30 minutes")["end"]

    def sums(rows):
        return SF.event_slots(rows, F.col("event_type"), None)

    for p in range(4):
        events.where(F.col("phase") == p).drop("phase").write.mode("append").parquet(feed)
        SF.split_late(SF.landed_stream(spark, feed, schema), out, f"{out}-gate", window_end, "ts", _LATE)
        SF.publish_slots(SF.event_slots(SF.split_rows(spark, out, schema, False), F.col("event_type"), _LATE), table, f"{out}-on-time")
        SF.correct_slots(SF.split_rows(spark, out, schema, True), sums, lambda: SF.split_rows(spark, out, schema, True, stream=False), table, f"{out}-late")
    return spark.read.schema(SF.SLOT_TABLE).parquet(table).select("series", *KEY, "total", "n", "late_total", "n_late")
