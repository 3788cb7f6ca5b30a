"""Scans, nested feeds, archives, incremental loads, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise import schemas as X
from slotwise.operators.joins import vwap
from slotwise.plans import inputs as I
from slotwise.plans.registry import query
from slotwise.session import Tables, fresh_path
from slotwise.sources import files as FS
from slotwise.sources import increments as INC
from slotwise.sources import layout as LY
from slotwise.sources import payloads as PL

KEY = ["settlement_date", "settlement_period"]
#: Buckets of the slot tables at this scale; grows with the tables.
BUCKETS = 8


@query("A1 A18 A23", rnd="ssp net_imbalance_volume", sql="""
SELECT settlement_date, settlement_period, ssp, net_imbalance_volume, price_derivation_code FROM c_panel""")
def prices_through_csv(t: Tables):
    path = fresh_path(t.spark, "prices")
    FS.write_csv(I.panel(t).select(*X.PRICES.names), path)
    return FS.read_prices(t.spark, path)


@query("A2", rnd="ssp", sql="""
SELECT settlement_date, settlement_period, ssp FROM c_panel WHERE price_derivation_code IS NOT NULL""")
def lenient_price_scan(t: Tables):
    """Prices landed as text, unreadable where the code is missing."""
    text = F.when(F.col("price_derivation_code").isNotNull(), F.col("ssp").cast("string")).otherwise("n/a")
    return FS.numeric_scan(I.panel(t).withColumn("ssp", text), [*KEY, "ssp"], ["ssp"])


@query("A4 A5 H10", rnd="ssp net_imbalance_volume replacement_price", sql="""
SELECT settlement_date, settlement_period, ssp, net_imbalance_volume, price_derivation_code, replacement_price FROM c_panel""")
def price_payloads(t: Tables):
    """Daily payloads in the four wrappings a feed uses, parsed back to rows."""
    p = I.panel(t)
    fields = {k: v for k, v in X.PRICE_FIELDS.items() if v in p.columns}
    rec = F.struct(*[F.col(v).alias(k) for k, v in fields.items()])
    # A day has at most 50 records, so its payload is bounded.
    day = p.groupBy("settlement_date").agg(F.to_json(F.collect_list(rec)).alias("j"))
    wrap = F.element_at(F.array(*map(F.lit, ("", "data", "items", "results"))), F.dayofmonth("settlement_date") % 4 + 1)
    text = F.when(wrap == "", F.col("j")).otherwise(F.concat(F.lit('{"'), wrap, F.lit('":'), F.col("j"), F.lit("}")))
    return PL.price_records(day.select(text.alias("payload"))).select(
        *KEY, "ssp", "net_imbalance_volume", "price_derivation_code", "replacement_price")


@query("A6 H10", rnd="wind_pct gas_pct", sql="""
SELECT settlement_date, settlement_period,
  CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) * 100 / count(*) AS wind_pct,
  CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) * 100 / count(*) AS gas_pct FROM c_ev GROUP BY 1, 2""")
def generation_payloads(t: Tables):
    """Nested fuel arrays; fuels that did not run are absent from the array."""
    fuel = F.when(F.col("event_type") == "view", "wind").when(F.col("event_type") == "click", "gas").otherwise(F.col("event_type"))
    e = I.slot_events(t).groupBy(*KEY, fuel.alias("fuel")).agg(F.count("*").alias("n"))
    slot = e.groupBy(*KEY).agg(F.sum("n").alias("all_n"), F.collect_list(F.struct("fuel", "n")).alias("m"))
    start = F.date_format(F.col("settlement_date").cast("timestamp_ntz")
                          + F.make_dt_interval(mins=(F.col("settlement_period") - 1) * 30), "yyyy-MM-dd'T'HH:mm:ss")
    mix = F.transform("m", lambda g: F.struct(g["fuel"].alias("fuel"), (g["n"] * 100.0 / F.col("all_n")).alias("perc")))
    day = slot.groupBy("settlement_date").agg(
        F.to_json(F.collect_list(F.struct(start.alias("from"), mix.alias("generationmix")))).alias("payload"))
    return PL.generation_mix(day)


@query("A7", rnd="temp_c wind_ms solar_wm2 precip_mm", sql="SELECT * FROM c_weather")
def weather_payloads(t: Tables):
    w = I.weather(t)
    rows = F.array_sort(F.collect_list(F.struct("datetime_utc", "temp_c", "wind_ms", "solar_wm2", "precip_mm")))
    day = w.groupBy(F.to_date("datetime_utc").alias("d")).agg(rows.alias("r"))
    hourly = F.struct(
        F.transform("r", lambda x: F.date_format(x["datetime_utc"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("r", lambda x: x["temp_c"]).alias("temperature_2m"),
        F.transform("r", lambda x: x["wind_ms"]).alias("windspeed_10m"),
        F.transform("r", lambda x: x["solar_wm2"]).alias("shortwave_radiation"),
        F.transform("r", lambda x: x["precip_mm"]).alias("precipitation"))
    return PL.weather_hours(day.select(F.to_json(F.struct(hourly.alias("hourly"))).alias("payload")))


@query("A8", rnd="cpi_index", sql="SELECT * FROM c_cpi")
def cpi_payload(t: Tables):
    """One document of a few hundred months, some of them unreadable."""
    c = I.cpi(t)
    good = F.struct(F.upper(F.date_format("year_month", "yyyy MMM")).alias("date"), F.col("cpi_index").cast("string").alias("value"))
    bad = F.struct(F.lit("2024 Q1").alias("date"), F.lit("x").alias("value"))
    doc = c.agg(F.collect_list(good).alias("m")).select(
        F.to_json(F.struct(F.concat("m", F.array(bad)).alias("months"))).alias("payload"))
    return PL.cpi_months(doc)


@query("A9 E18", rnd="windfor_fc_mw", sql="""
SELECT CAST(datetime_utc AS DATE) AS settlement_date, CAST(hour(datetime_utc) * 2 + o AS INTEGER) AS settlement_period,
       wind_ms * 100 AS windfor_fc_mw FROM c_weather CROSS JOIN (VALUES (1), (2)) AS g(o)""")
def hourly_to_half_hours(t: Tables):
    h = I.weather(t).select("datetime_utc", (F.col("wind_ms") * 100).alias("windfor_fc_mw"))
    return PL.half_hours(h, "datetime_utc", ["windfor_fc_mw"])


def _archive(t: Tables):
    """Forecasts written as dated folders: two schemas, two models, production and shadow."""
    f = I.forecasts(t)
    root = fresh_path(t.spark, "archive")
    name = F.concat(F.lit("forecast_"), F.col("settlement_date").cast("string"))
    dom = F.dayofmonth("settlement_date")
    base = ["settlement_date", "settlement_period", "q10", "q50", "q90"]
    FS.write_csv(f.where(dom % 2 == 0).select(*base, name.alias("file")), f"{root}/v1", ["file"])
    new = F.concat(F.lit("forecast_phase3_"), F.col("settlement_date").cast("string"),
                   F.when(dom % 3 == 0, "_shadow").otherwise(""))
    shifted = f.where(dom % 3 != 1).withColumn("q50", F.col("q50") + 1)
    FS.write_csv(shifted.select(*base, F.when(F.col("settlement_period") <= 4, "True").otherwise("False").alias("is_actual"),
                                new.alias("file")), f"{root}/v2", ["file"])
    return FS.merge_archives([FS.scan_archive(t.spark, f"{root}/v1", X.FORECAST_V1),
                              FS.scan_archive(t.spark, f"{root}/v2", X.FORECAST_V2)])


_ARCHIVE_SQL = """
WITH a AS (
  SELECT settlement_date, settlement_period, q10, q50, q90, 'prod' AS source, 'legacy' AS model FROM c_wf
  WHERE day(settlement_date) % 2 = 0
  UNION ALL
  SELECT settlement_date, settlement_period, q10, q50 + 1, q90,
         CASE WHEN day(settlement_date) % 3 = 0 THEN 'shadow' ELSE 'prod' END, 'phase3' FROM c_wf
  WHERE day(settlement_date) % 3 <> 1 AND settlement_period > 4)
"""


@query("A10 C11", rnd="mae", sql=_ARCHIVE_SQL + """
SELECT a.settlement_date AS target_date, source, model, count(*) AS n, avg(abs(p.ssp - a.q50)) AS mae
FROM a JOIN c_panel p USING (settlement_date, settlement_period) GROUP BY 1, 2, 3""")
def archive_scored(t: Tables):
    a = _archive(t).join(I.panel(t).select(*KEY, "ssp"), KEY)
    return a.groupBy("target_date", "source", "model").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("ssp") - F.col("q50"))).alias("mae"))


@query("A12", rnd="q50", sql=_ARCHIVE_SQL + """
SELECT settlement_date AS target_date, settlement_period, source, model, q50 FROM (
  SELECT *, CASE WHEN model = 'phase3' THEN 2 ELSE 0 END + CASE WHEN source = 'prod' THEN 1 ELSE 0 END AS rk,
    max(CASE WHEN model = 'phase3' THEN 2 ELSE 0 END + CASE WHEN source = 'prod' THEN 1 ELSE 0 END)
      OVER (PARTITION BY settlement_date) AS best FROM a) WHERE rk = best""")
def best_archived_forecast(t: Tables):
    return FS.best_archive(_archive(t)).select("target_date", "settlement_period", "source", "model", "q50")


@query("A11", rnd="ssp", sql="""
SELECT settlement_date, settlement_period, ssp, source_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY settlement_date, settlement_period ORDER BY source_rank) AS rn FROM (
    SELECT settlement_date, settlement_period, ssp, 0 AS source_rank FROM c_panel_type WHERE series = 'view'
    UNION ALL SELECT settlement_date, settlement_period, ssp, 1 FROM c_panel_type WHERE series = 'click'
    UNION ALL SELECT settlement_date, settlement_period, ssp, 2 FROM c_panel)) WHERE rn = 1""")
def preferred_source(t: Tables):
    p = I.panel(t, by_type=True).select("series", *KEY, "ssp")
    sources = [p.where("series = 'view'").drop("series"), p.where("series = 'click'").drop("series"),
               I.panel(t).select(*KEY, "ssp")]
    return INC.first_source_wins(sources, KEY)


@query("A13", sql="""
WITH m AS (SELECT series, max(settlement_date) AS last_date FROM c_panel_type WHERE settlement_date < DATE '2024-01-21' GROUP BY 1)
SELECT p.series, count(*) AS n_new, min(settlement_date) AS first_new FROM c_panel_type p JOIN m USING (series)
WHERE settlement_date > last_date GROUP BY 1""")
def increment_after_mark(t: Tables):
    p = I.panel(t, by_type=True)
    new = INC.after_mark(p.where("settlement_date < date'2024-01-21'"), p, ["series"])
    return new.groupBy("series").agg(F.count("*").alias("n_new"), F.min("settlement_date").alias("first_new"))


@query("A14 C18 G4", sql="""
SELECT DISTINCT settlement_date FROM c_panel WHERE settlement_date NOT IN (
  SELECT settlement_date FROM c_weather JOIN c_panel ON CAST(datetime_utc AS DATE) = settlement_date
  WHERE day(settlement_date) % 3 <> 0)""")
def backfill_dates(t: Tables):
    done = I.weather(t).select(F.to_date("datetime_utc").alias("settlement_date"),
                               F.when(F.dayofmonth("datetime_utc") % 3 != 0, F.col("temp_c")).alias("v"))
    return INC.dates_to_do(I.panel(t).select("settlement_date").distinct(), done, "v")


@query("A15", sql="""
WITH m AS (SELECT max(settlement_date) AS last FROM c_panel WHERE settlement_date < DATE '2024-01-21')
SELECT settlement_date, count(*) AS n FROM c_panel, m WHERE settlement_date > last - INTERVAL 2 DAY GROUP BY 1""")
def overlap_reread(t: Tables):
    p = I.panel(t)
    new = INC.after_mark(p.where("settlement_date < date'2024-01-21'"), p, ["series"], overlap_days=2)
    return new.groupBy("settlement_date").agg(F.count("*").alias("n"))


def _old_new(t: Tables):
    p = I.panel(t).select(*KEY, "ssp")
    return p.where("settlement_date < date'2024-01-21'"), p.where("settlement_date >= date'2024-01-18'").withColumn(
        "ssp", F.col("ssp") + 1)


@query("A16 G1 G2", rnd="ssp", sql="""
SELECT settlement_date, settlement_period, CASE WHEN settlement_date < DATE '2024-01-21' THEN ssp ELSE ssp + 1 END AS ssp FROM c_panel""")
def append_keeps_first(t: Tables):
    return INC.append_first_wins(*_old_new(t), KEY)


@query("A17 G2", rnd="ssp", sql="""
SELECT settlement_date, settlement_period, CASE WHEN settlement_date < DATE '2024-01-18' THEN ssp ELSE ssp + 1 END AS ssp FROM c_panel""")
def upsert_keeps_last(t: Tables):
    return INC.upsert_last_wins(*_old_new(t), KEY)


@query("A16 A17 A18", rnd="ssp", sql="""
SELECT settlement_date, settlement_period, CASE WHEN settlement_date < DATE '2024-01-18' THEN ssp ELSE ssp + 1 END AS ssp FROM c_panel""")
def partitions_merged_on_disk(t: Tables):
    old, new = _old_new(t)
    path = fresh_path(t.spark, "history")
    FS.write_table(old, path, ["settlement_date"])
    INC.merge_into(t.spark, path, new, KEY, "settlement_date", [F.col("ssp")])
    return t.spark.read.parquet(path).select(*KEY, "ssp")


@query("A19", rnd="mae", sql="""
SELECT fold, count(*) AS n, avg(abs(actual - q50)) AS mae FROM c_wf GROUP BY 1
UNION ALL SELECT 'all', count(*), avg(abs(actual - q50)) FROM c_wf""")
def appended_metrics_log(t: Tables):
    f = I.forecasts(t)
    path = fresh_path(t.spark, "log")
    err = F.avg(F.abs(F.col("actual") - F.col("q50"))).alias("mae")
    FS.append_log(f.groupBy("fold").agg(F.count("*").alias("n"), err), path)
    FS.append_log(f.agg(F.count("*").alias("n"), err).select(F.lit("all").alias("fold"), "n", "mae"), path)
    return t.spark.read.parquet(path)


@query("A20", sql="""
SELECT 'clean' AS forecast, CAST(1 AS INTEGER) AS archived, count(*) AS n FROM c_wf
UNION ALL SELECT 'spliced', 0, 0""")
def archive_guard(t: Tables):
    """A forecast with settled rows is not archived; the clean one is."""
    f = I.forecasts(t).select(*KEY, "q50")
    out = None
    for name, flag in (("clean", F.lit(False)), ("spliced", F.col("settlement_period") <= 10)):
        path = fresh_path(t.spark, "guard")
        ok = FS.write_if_clean(f.withColumn("is_actual", flag), path)
        n = t.spark.read.parquet(path).agg(F.count("*").alias("n")) if ok else f.limit(0).agg(F.count("*").alias("n"))
        row = n.select(F.lit(name).alias("forecast"), F.lit(int(ok)).alias("archived"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("A21", rnd="delta", sql="""
SELECT settlement_period, greatest(quantile_cont(greatest(q10 - actual, actual - q90), 0.8), 0) AS delta FROM c_wf GROUP BY 1""")
def params_through_json(t: Tables):
    from slotwise.operators.calibrate import conformal_delta
    delta = conformal_delta(I.forecasts(t), ["settlement_period"])
    path = fresh_path(t.spark, "params")
    FS.params_to_json(delta, "settlement_period", "delta").write.text(path)
    doc = t.spark.read.schema("document STRING").text(path)
    return FS.params_from_json(doc, "settlement_period", "delta")


@query("A22", sql="""
SELECT settlement_date, count(*) AS n_slots, max(settlement_period) AS max_sp, DATE '2024-01-31' AS fetched_on FROM c_panel GROUP BY 1""")
def fetch_heartbeats(t: Tables):
    h = FS.heartbeat(I.panel(t), ["settlement_date"], F.lit("2024-01-31 09:00:00").cast("timestamp_ntz"))
    return h.select("settlement_date", "n_slots", "max_sp", F.to_date("fetched_at").alias("fetched_on"))


@query("A22 B2 I10", sql="""
SELECT feed, count(*) AS n_rows, count(DISTINCT settlement_date) AS n_days, 48 * count(DISTINCT settlement_date) - count(*) AS n_missing,
  max(settlement_date) AS last_date, arg_max(settlement_period, slot_ix) AS last_sp, 48 * count(DISTINCT settlement_date) > count(*) AS gaps
FROM (SELECT *, CASE WHEN settlement_date < DATE '2024-01-18' THEN 'backfill' ELSE 'daily' END AS feed FROM c_panel) GROUP BY 1""")
def observed_heartbeats(t: Tables):
    """Two fetches appended to one table, their heartbeats and gap warnings counted while they are written."""
    path, log = fresh_path(t.spark, "landed"), fresh_path(t.spark, "heartbeats")
    p, cut = I.panel(t).select(*KEY, "ssp"), F.lit("2024-01-18").cast("date")
    for feed, rows in (("backfill", p.where(F.col("settlement_date") < cut)), ("daily", p.where(F.col("settlement_date") >= cut))):
        FS.land_observed(rows, path, log, feed, F.lit("2024-01-31 09:00:00").cast("timestamp_ntz"))
    return t.spark.read.parquet(log).select("feed", "n_rows", "n_days", "n_missing", "last_date", "last_sp", (F.col("n_missing") > 0).alias("gaps"))


@query("A18 C2 C4 C5 C10", rnd="ssp wind_pct gas_pct mid_price margin_fc_mw q50", sql="""
SELECT p.series, p.settlement_date, p.settlement_period, p.ssp, g.wind_pct, g.gas_pct, mid_price, tsdf_fc_mw - windfor_fc_mw AS margin_fc_mw, q50
FROM c_panel_type p LEFT JOIN c_panel g USING (settlement_date, settlement_period) LEFT JOIN c_mid USING (settlement_date, settlement_period)
LEFT JOIN c_vintage USING (settlement_date, settlement_period) LEFT JOIN c_wf USING (settlement_date, settlement_period)""")
def slot_tables_joined_on_layout(t: Tables):
    """Prices of several series with four slot tables, all bucketed by slot: a chain of joins without an exchange."""
    sides = [I.panel(t).select(*KEY, "wind_pct", "gas_pct"), vwap(I.provider_trades(t), KEY).select(*KEY, "mid_price"),
             I.vintages(t).select(*KEY, (F.col("tsdf_fc_mw") - F.col("windfor_fc_mw")).alias("margin_fc_mw")), I.forecasts(t).select(*KEY, "q50")]
    base, *stored = [LY.write_bucketed(d, KEY, BUCKETS) for d in (I.panel(t, by_type=True).select("series", *KEY, "ssp"), *sides)]
    return LY.join_on_layout(base, stored, KEY)


@query("G3 C12 C17", sql="""
SELECT settlement_date, settlement_period FROM c_panel_type WHERE series = 'view'
INTERSECT SELECT settlement_date, settlement_period FROM c_panel_type WHERE series = 'click'""")
def common_slots(t: Tables):
    p = I.panel(t, by_type=True)
    return p.where("series = 'view'").select(*KEY).intersect(p.where("series = 'click'").select(*KEY))


@query("G4", sql="""
SELECT settlement_date, settlement_period FROM c_panel_type WHERE series = 'view'
EXCEPT SELECT settlement_date, settlement_period FROM c_panel_type WHERE series = 'click'""")
def slots_of_one_source_only(t: Tables):
    p = I.panel(t, by_type=True)
    return p.where("series = 'view'").select(*KEY).exceptAll(p.where("series = 'click'").select(*KEY))


@query("G5 G1", rnd="coverage", sql="""
SELECT period, count(*) AS n, avg(CASE WHEN actual BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END) * 100 AS coverage FROM (
  SELECT 'backtest' AS period, actual, q10, q90 FROM c_wf WHERE settlement_date < DATE '2024-01-20'
  UNION ALL SELECT 'live', actual, q10, q90 FROM c_wf WHERE settlement_date >= DATE '2024-01-20') GROUP BY 1""")
def backtest_and_live(t: Tables):
    from slotwise.functions.scoring import coverage_pct
    f = I.forecasts(t)
    back = f.where("settlement_date < date'2024-01-20'").withColumn("period", F.lit("backtest"))
    live = f.where("settlement_date >= date'2024-01-20'").withColumn("period", F.lit("live"))
    return back.unionByName(live).groupBy("period").agg(
        F.count("*").alias("n"), coverage_pct("actual", "q10", "q90").alias("coverage"))


@query("D4", rnd="mid_price mid_volume", sql="SELECT * FROM c_mid")
def provider_vwap(t: Tables):
    return vwap(I.provider_trades(t), KEY)


@query("D4", rnd="vwap volume", sql="""
SELECT CAST(l_shipdate AS DATE) AS ship_date,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS vwap,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem GROUP BY 1""")
def shipment_vwap(t: Tables):
    q = F.sum(F.col("l_quantity").cast(I.MONEY)).cast("double")
    return t.lineitem.groupBy(F.to_date("l_shipdate").alias("ship_date")).agg(
        (F.sum(F.col("l_extendedprice").cast(I.MONEY)).cast("double") / F.nullif(q, F.lit(0.0))).alias("vwap"), q.alias("volume"))


@query("D5", rnd="temp_c wind_ms", sql="""
WITH h AS (SELECT date_trunc('hour', ts) AS datetime_utc, event_type, CAST(sum(k) AS DOUBLE) / count(*) / 4 AS temp_c, CAST(sum(dval) AS DOUBLE) / count(*) / 5 AS wind_ms FROM c_ev GROUP BY 1, 2),
w AS (SELECT *, CASE event_type WHEN 'view' THEN 0.6 WHEN 'click' THEN 0.2 WHEN 'signup' THEN 0.2 END AS wt FROM h)
SELECT datetime_utc, sum(temp_c * wt) AS temp_c, sum(wind_ms * wt) AS wind_ms FROM w GROUP BY 1""")
def location_blend(t: Tables):
    from slotwise.operators.joins import blend
    h = I.slot_events(t).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime_utc"), "event_type").agg(
        (F.sum("k") / F.count("*") / 4).alias("temp_c"), (F.sum("dval").cast("double") / F.count("*") / 5).alias("wind_ms"))
    return blend(h, ["datetime_utc"], "event_type", {"view": 0.6, "click": 0.2, "signup": 0.2}, ["temp_c", "wind_ms"])


@query("F1 A18", rnd="ssp", sql="SELECT series, settlement_date, settlement_period, ssp FROM c_panel_type ORDER BY settlement_date, settlement_period, series")
def chronological_table(t: Tables):
    path = fresh_path(t.spark, "sorted")
    order = ["settlement_date", "settlement_period", "series"]
    FS.write_sorted(I.panel(t, by_type=True).select("series", *KEY, "ssp"), path, order)
    return t.spark.read.parquet(path).orderBy(*order)
