"""Lags, rolling windows, same-slot statistics, fills, daily features, feed joins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from slotwise.functions.calendar import bank_holidays
from slotwise.operators import clean as C
from slotwise.operators import daily as DY
from slotwise.operators import features as FT
from slotwise.operators import series as SR
from slotwise.operators.joins import vwap
from slotwise.plans import inputs as I
from slotwise.plans.registry import QUERIES, query
from slotwise.session import Tables

KEY = ["settlement_date", "settlement_period"]
SID = ["series", *KEY]


# -- SQL text for the same frames -------------------------------------------------
def at(c: str, n: int, w: str = "w") -> str:
    part = {"w": "PARTITION BY series ORDER BY slot_ix", "d": "PARTITION BY series ORDER BY day_ix",
            "s": "PARTITION BY series, settlement_period ORDER BY day_ix"}[w]
    return f"max({c}) OVER ({part} RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)"


def roll(c: str, width: int, stat: str, w: str = "w", min_n: int = 1) -> str:
    part = {"w": "PARTITION BY series ORDER BY slot_ix", "d": "PARTITION BY series ORDER BY day_ix",
            "s": "PARTITION BY series, settlement_period ORDER BY day_ix"}[w]
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum", "count": "count"}[stat]
    over = f"OVER ({part} RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
    text = f"{fn}({c}) {over}"
    return text if min_n == 1 else f"CASE WHEN count({c}) {over} >= {min_n} THEN {text} END"


def select_sql(cols: dict[str, str], source: str, ids: str = "series, settlement_date, settlement_period") -> str:
    return f"SELECT {ids}, " + ",\n".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {source}"


NIV = FT.NIV
_LAGS = {f"ssp_lag_{n}": at("ssp", n) for n in FT.SSP_LAGS}
_LAGS |= {f"{NIV}_lag_{n}": at(NIV, n) for n in FT.NIV_LAGS}
_LAGS |= {f"ssp_raw_lag_{n}": at("ssp_raw", n) for n in (48, 96, 336)}
_LAGS |= {"ssp_diff_1_48": f"{at('ssp', 1)} - {at('ssp', 48)}", "ssp_diff_48_336": f"{at('ssp', 48)} - {at('ssp', 336)}"}
_RAMPS = {"ssp_ramp_48": f"{at('ssp', 48)} - {at('ssp', 49)}", "ssp_ramp_336": f"{at('ssp', 336)} - {at('ssp', 337)}",
          "ssp_raw_ramp_48": f"{at('ssp_raw', 48)} - {at('ssp_raw', 49)}", "niv_ramp_48": f"{at(NIV, 48)} - {at(NIV, 49)}"}
_ROLL = {f"ssp_roll_{s}_{w}": roll("ssp", w, s) for w in FT.SSP_WINDOWS for s in FT.STATS}
_VROLL = {f"{NIV}_roll_{s}_{w}": roll(NIV, w, s) for w in FT.NIV_WINDOWS for s in FT.STATS}
_VROLL |= {f"abs_niv_roll_mean_{w}": roll(f"abs({NIV})", w, "mean") for w in FT.NIV_WINDOWS}


def _clean(t: Tables):
    return C.winsorise(I.panel(t))


@query("E1 E2 E5 E6", rnd=" ".join(_LAGS), sql=select_sql(_LAGS, "c_clean"))
def price_lags(t: Tables):
    return FT.slot_history(_clean(t), [FT.price_lags]).select(*SID, *_LAGS)


@query("E8", rnd=" ".join(_RAMPS), sql=select_sql(_RAMPS, "c_clean"))
def price_ramps(t: Tables):
    return FT.slot_history(_clean(t), [FT.ramps]).select(*SID, *_RAMPS)


@query("E3", rnd=" ".join(_ROLL), sql=select_sql(_ROLL, "c_clean"))
def price_rolling(t: Tables):
    return FT.slot_history(_clean(t), [FT.price_rolling]).select(*SID, *_ROLL)


@query("E4", rnd=" ".join(_VROLL), sql=select_sql(_VROLL, "c_panel_type"))
def volume_rolling(t: Tables):
    """Five series at once, cut into chunks of 512 slots."""
    return FT.slot_history(I.panel(t, by_type=True), [FT.volume_rolling]).select(*SID, *_VROLL)


@query("E7", sql=select_sql(
    {f"is_spike_lag_{n}": at("CAST(is_spike AS INTEGER)", n) for n in (48, 336)}
    | {f"is_negative_lag_{n}": at("CAST(ssp_raw < 0 AS INTEGER)", n) for n in (48, 336)}
    | {"spike_count_roll_48": f"CAST({roll('CAST(is_spike AS INTEGER)', 48, 'sum')} AS BIGINT)",
       "neg_count_roll_48": f"CAST({roll('CAST(ssp_raw < 0 AS INTEGER)', 48, 'sum')} AS BIGINT)"}, "c_clean"))
def spike_memory(t: Tables):
    cols = [f"is_{k}_lag_{n}" for k in ("spike", "negative") for n in (48, 336)] + ["spike_count_roll_48", "neg_count_roll_48"]
    return FT.slot_history(_clean(t), [FT.spike_memory]).select(*SID, *cols)


_SAME = {"same_sp_mean_7d": roll("ssp", 7, "mean", "s"), "same_sp_std_7d": roll("ssp", 7, "std", "s"),
         "same_sp_range_7d": f"{roll('ssp', 7, 'max', 's')} - {roll('ssp', 7, 'min', 's')}",
         "ssp_sp_deviation": f"{at('ssp', 1, 's')} - {roll('ssp', 7, 'mean', 's')}",
         "ssp_sp_trend_7d": f"{at('ssp', 1, 's')} - {at('ssp', 7, 's')}",
         "niv_same_sp_mean_7d": roll(NIV, 7, "mean", "s"), "niv_same_sp_std_7d": roll(NIV, 7, "std", "s")}


@query("E9", rnd=" ".join(_SAME), sql=select_sql(_SAME, "c_clean"))
def same_slot_week(t: Tables):
    return FT.same_slot_week(_clean(t)).select(*SID, *_SAME)


_GEN = {f"{c}_lag_{n}": at(c, n) for c in ("wind_pct", "gas_pct") for n in (48, 336)}


@query("E10 C2", rnd=" ".join(_GEN), sql=select_sql(_GEN, "c_panel"))
def generation_lags(t: Tables):
    p = I.panel(t)
    gen = p.select(*KEY, "wind_pct", "gas_pct")
    joined = FT.join_slot_table(p.drop("wind_pct", "gas_pct"), gen)
    return FT.slot_history(joined, [FT.generation_lags]).select(*SID, *_GEN)


_MID = {f"mid_price_lag_{n}": at("mid_price", n) for n in (48, 96, 336)}
_MID |= {"ssp_mid_spread_lag_48": f"{at('ssp_raw', 48)} - {at('mid_price', 48)}"}


@query("E12 C4", rnd=" ".join(_MID), sql="WITH j AS (SELECT c.*, mid_price FROM c_clean c LEFT JOIN c_mid USING "
       "(settlement_date, settlement_period)) " + select_sql(_MID, "j"))
def market_index_lags(t: Tables):
    j = FT.join_slot_table(_clean(t), vwap(I.provider_trades(t), KEY).drop("mid_volume"))
    return FT.slot_history(j, [FT.market_lags]).select(*SID, *_MID)


_WX = {f"{c}_lag_{n}": at(c, n) for c in FT.WEATHER for n in (1, 48, 336)}
_WX |= {f"{c}_roll_{s}_{w}": roll(c, w, s) for c in FT.WEATHER[:3] for w in (6, 48) for s in ("mean", "std")}
_WX |= {"wind_ramp_6": f"{at('wind_ms', 1)} - {at('wind_ms', 7)}"}
_T48 = at("temp_c", 48)
_WX |= {"heating_degree": f"CASE WHEN {_T48} IS NOT NULL THEN greatest(15.5 - {_T48}, 0) END",
        "cooling_degree": f"CASE WHEN {_T48} IS NOT NULL THEN greatest({_T48} - 22, 0) END"}
_WX_JOIN = """
WITH h AS (SELECT CAST(epoch(datetime_utc) AS BIGINT) // 1800 + o AS slot_ix, temp_c, wind_ms, solar_wm2, precip_mm
           FROM c_weather CROSS JOIN (VALUES (0), (1)) AS g(o)),
j0 AS (SELECT p.series, p.settlement_date, p.settlement_period, p.slot_ix, h.temp_c, h.wind_ms, h.solar_wm2, h.precip_mm
       FROM c_panel p LEFT JOIN h USING (slot_ix)),
j AS (SELECT series, settlement_date, settlement_period, slot_ix, """ + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY slot_ix ROWS BETWEEN UNBOUNDED PRECEDING "
    f"AND CURRENT ROW) AS {c}" for c in FT.WEATHER) + " FROM j0)\n"


@query("C1 E16 E18", rnd=" ".join(FT.WEATHER), sql=_WX_JOIN + "SELECT series, settlement_date, settlement_period, "
       + ", ".join(FT.WEATHER) + " FROM j")
def weather_on_slots(t: Tables):
    return FT.join_weather(I.panel(t), I.weather(t)).select(*SID, *FT.WEATHER)


@query("E11 H8", rnd=" ".join(_WX), sql=_WX_JOIN + select_sql(_WX, "j"))
def weather_history(t: Tables):
    j = FT.join_weather(I.panel(t), I.weather(t))
    return FT.slot_history(j, [FT.weather_history]).select(*SID, *_WX)


@query("C5 H8", rnd="margin_fc_mw wind_pen_fc", sql="""
SELECT p.settlement_date, p.settlement_period, tsdf_fc_mw - windfor_fc_mw AS margin_fc_mw,
       100.0 * windfor_fc_mw / nullif(tsdf_fc_mw, 0) AS wind_pen_fc
FROM c_panel p LEFT JOIN c_vintage USING (settlement_date, settlement_period)""")
def vintage_margin(t: Tables):
    j = FT.vintage_columns(FT.join_slot_table(I.panel(t), I.vintages(t)))
    return j.select(*KEY, "margin_fc_mw", "wind_pen_fc")


_CPI = """
WITH RECURSIVE m AS (SELECT CAST(unnest(generate_series(min(year_month), max(year_month), INTERVAL 1 MONTH)) AS DATE) AS year_month FROM c_cpi),
f AS (SELECT m.year_month, last_value(cpi_index IGNORE NULLS) OVER (ORDER BY m.year_month) AS cpi_index
      FROM m LEFT JOIN c_cpi c ON c.year_month = m.year_month),
y AS (SELECT a.year_month, a.cpi_index, (a.cpi_index - b.cpi_index) / b.cpi_index * 100 AS cpi_yoy,
             (SELECT max_by(cpi_index, year_month) FROM f) / a.cpi_index AS cpi_deflator
      FROM f a LEFT JOIN f b ON b.year_month = CAST(a.year_month - INTERVAL 12 MONTH AS DATE))
"""


@query("C3 E16 H9", rnd="cpi_index cpi_yoy cpi_deflator", sql=_CPI + "SELECT * FROM y")
def price_index_months(t: Tables):
    return FT.price_index_months(I.cpi(t))


@query("C3", rnd="cpi_index cpi_yoy cpi_deflator", sql=_CPI + """
SELECT p.settlement_date, p.settlement_period, y.cpi_index, y.cpi_yoy, y.cpi_deflator
FROM c_panel p LEFT JOIN y ON y.year_month = CAST(date_trunc('month', p.settlement_date) AS DATE)""")
def price_index_joined(t: Tables):
    return FT.join_price_index(I.panel(t), I.cpi(t)).select(*KEY, "cpi_index", "cpi_yoy", "cpi_deflator")


_CYC = [f"{f}_{n}" for n in ("sp", "hour", "dow", "month", "half_year") for f in ("sin", "cos")]
_HOL = """
WITH y AS (SELECT * FROM (VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'),
  (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15')) AS v(yr, easter)),
b AS (SELECT yr, easter, make_date(yr, 1, 1) AS ny, make_date(yr, 12, 25) AS xm, make_date(yr, 5, 1) AS m1,
             make_date(yr, 5, 31) AS m31, make_date(yr, 8, 31) AS a31 FROM y),
hol AS (
  SELECT ny AS d FROM b UNION SELECT xm FROM b UNION SELECT xm + 1 FROM b
  UNION SELECT ny + CAST(CASE dayofweek(ny) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS INTEGER) FROM b
  UNION SELECT easter - 2 FROM b UNION SELECT easter + 1 FROM b
  UNION SELECT CASE WHEN yr = 1995 THEN DATE '1995-05-08' ELSE m1 + CAST((8 - dayofweek(m1)) % 7 AS INTEGER) END FROM b
  UNION SELECT m31 - CAST((dayofweek(m31) + 6) % 7 AS INTEGER) FROM b
  UNION SELECT a31 - CAST((dayofweek(a31) + 6) % 7 AS INTEGER) FROM b
  UNION SELECT xm + CAST(CASE dayofweek(xm) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS INTEGER) FROM b
  UNION SELECT xm + CAST(CASE dayofweek(xm) WHEN 5 THEN 3 WHEN 6 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS INTEGER) FROM b
  UNION SELECT DATE '1999-12-31')
"""


@query("H1 H2 H3", rnd=" ".join(_CYC), sql="""
WITH x AS (SELECT *, (dayofweek(settlement_date) + 6) % 7 AS dw, (settlement_period - 1) // 2 AS hr FROM c_panel)
SELECT settlement_date, settlement_period, hr AS hour, dw AS day_of_week, month(settlement_date) AS month,
  weekofyear(settlement_date) AS week_of_year, quarter(settlement_date) AS quarter, dayofyear(settlement_date) AS day_of_year,
  sin(2 * pi() * (settlement_period - 1) / 48) AS sin_sp, cos(2 * pi() * (settlement_period - 1) / 48) AS cos_sp,
  sin(2 * pi() * hr / 24) AS sin_hour, cos(2 * pi() * hr / 24) AS cos_hour,
  sin(2 * pi() * dw / 7) AS sin_dow, cos(2 * pi() * dw / 7) AS cos_dow,
  sin(2 * pi() * (month(settlement_date) - 1) / 12) AS sin_month, cos(2 * pi() * (month(settlement_date) - 1) / 12) AS cos_month,
  sin(2 * pi() * (month(settlement_date) - 1) / 6) AS sin_half_year, cos(2 * pi() * (month(settlement_date) - 1) / 6) AS cos_half_year,
  CAST(dw >= 5 AS INTEGER) AS is_weekend, CAST(settlement_period BETWEEN 13 AND 36 AS INTEGER) AS is_peak,
  CAST(settlement_period BETWEEN 33 AND 40 AS INTEGER) AS is_evening_peak,
  CAST(settlement_date = DATE '2024-01-01' AS INTEGER) AS is_holiday,
  CAST(dw < 5 AND settlement_date <> DATE '2024-01-01' AS INTEGER) AS is_business_day FROM x""")
def calendar_features(t: Tables):
    return FT.add_calendar(I.panel(t)).select(*KEY, *FT.CALENDAR)


@query("H4 H3", sql=_HOL + """
SELECT settlement_date, CAST(d IS NOT NULL AS INTEGER) AS is_holiday,
       CAST(d IS NULL AND dayofweek(settlement_date) BETWEEN 1 AND 5 AS INTEGER) AS is_business_day
FROM c_daily LEFT JOIN hol ON d = settlement_date""")
def holidays_flagged(t: Tables):
    days = I.daily_orders(t)
    h = F.broadcast(bank_holidays(days).withColumn("h", F.lit(1)))
    d = days.join(h, F.col("settlement_date") == F.col("holiday_date"), "left")
    return d.select("settlement_date", F.coalesce("h", F.lit(0)).alias("is_holiday"),
                    (F.col("h").isNull() & (F.weekday("settlement_date") < 5)).cast("int").alias("is_business_day"))


# -- fills, interpolation, islands, frontier --------------------------------------
_GRID = """
WITH g AS (SELECT CAST(d AS DATE) AS settlement_date, CAST(unnest(range(1, 49)) AS INTEGER) AS settlement_period
  FROM (SELECT unnest(generate_series(min(settlement_date), max(settlement_date), INTERVAL 1 DAY)) AS d FROM c_vintage)),
v AS (SELECT g.settlement_date, g.settlement_period, windfor_fc_mw AS x FROM g LEFT JOIN c_vintage USING (settlement_date, settlement_period)),
n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN settlement_period END) OVER p AS i0,
             min(CASE WHEN x IS NOT NULL THEN settlement_period END) OVER f AS i1,
             last_value(x IGNORE NULLS) OVER p AS v0, first_value(x IGNORE NULLS) OVER f AS v1 FROM v
      WINDOW p AS (PARTITION BY settlement_date ORDER BY settlement_period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY settlement_date ORDER BY settlement_period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query("E17 C24", rnd="wind_mw", sql=_GRID + """
SELECT settlement_date, settlement_period, CASE WHEN x IS NOT NULL THEN x WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) / (i1 - i0) * (settlement_period - i0) END AS wind_mw FROM n""")
def interpolated_wind(t: Tables):
    v = I.vintages(t).withColumn("series", F.lit("all"))
    g = SR.slot_grid(v, ["series"]).join(v, ["series", *KEY], "left")
    return SR.interpolate_in_day(g, ["settlement_date"], "settlement_period", "windfor_fc_mw", "wind_mw").select(*KEY, "wind_mw")


@query("E31 E16", rnd="ssp", sql="""
WITH g AS (SELECT series, CAST(d AS DATE) AS settlement_date, CAST(unnest(range(1, 49)) AS INTEGER) AS settlement_period
  FROM (SELECT series, unnest(generate_series(min(settlement_date), max(settlement_date), INTERVAL 1 DAY)) AS d FROM c_panel_type GROUP BY 1))
SELECT g.series, g.settlement_date, g.settlement_period, last_value(ssp IGNORE NULLS) OVER (PARTITION BY g.series
  ORDER BY g.settlement_date, g.settlement_period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ssp
FROM g LEFT JOIN c_panel_type p ON p.series = g.series AND p.settlement_date = g.settlement_date
  AND p.settlement_period = g.settlement_period""")
def days_padded_forward(t: Tables):
    p = I.panel(t, by_type=True)
    g = SR.slot_grid(p, ["series"]).join(p.select(*SID, "ssp"), SID, "left").withColumn(
        "slot_ix", F.datediff("settlement_date", F.lit("1970-01-01").cast("date")).cast("long") * 48 + F.col("settlement_period") - 1)
    return SR.fill_forward(g, ["series"], "slot_ix", ["ssp"]).select(*SID, "ssp")


@query("E16 D33", rnd="mid_price", sql="""
WITH g AS (SELECT CAST(d AS DATE) AS settlement_date, CAST(unnest(range(1, 49)) AS INTEGER) AS settlement_period
  FROM (SELECT unnest(generate_series(min(settlement_date), max(settlement_date), INTERVAL 1 DAY)) AS d FROM c_panel))
SELECT g.settlement_date, g.settlement_period, first_value(mid_price IGNORE NULLS) OVER (ORDER BY g.settlement_date,
  g.settlement_period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mid_price
FROM g LEFT JOIN c_mid m USING (settlement_date, settlement_period)""")
def slots_filled_backward(t: Tables):
    g = SR.slot_grid(I.panel(t), ["series"]).join(vwap(I.provider_trades(t), KEY), KEY, "left").withColumn(
        "slot_ix", F.datediff("settlement_date", F.lit("1970-01-01").cast("date")).cast("long") * 48 + F.col("settlement_period") - 1)
    return SR.fill_forward(g, ["series"], "slot_ix", ["mid_price"], backward=True).select(*KEY, "mid_price")


_RUNS = """
WITH x AS (SELECT series, slot_ix, coalesce(price_derivation_code, 'N') AS code FROM c_panel),
g AS (SELECT *, slot_ix - row_number() OVER (PARTITION BY series, code ORDER BY slot_ix) AS grp FROM x)
"""


@query("E19", sql=_RUNS + """
SELECT series, code AS price_derivation_code, min(slot_ix) AS run_start, max(slot_ix) AS run_end,
       max(slot_ix) - min(slot_ix) + 1 AS run_length FROM g GROUP BY series, code, grp""")
def regime_runs(t: Tables):
    """Runs of one derivation code, cut into small chunks so that merging is exercised."""
    return SR.runs(C.default_code(I.panel(t)), ["series"], "slot_ix", "price_derivation_code")


@query("D45", rnd="median_run mean_run", sql=_RUNS + """
, r AS (SELECT code, count(*) AS n FROM g GROUP BY series, code, grp)
SELECT code AS price_derivation_code, count(*) AS n_runs, quantile_cont(n, 0.5) AS median_run, avg(n) AS mean_run, max(n) AS max_run
FROM r GROUP BY 1""")
def regime_run_lengths(t: Tables):
    r = SR.runs(C.default_code(I.panel(t)), ["series"], "slot_ix", "price_derivation_code")
    # Run lengths are small integers, so percentile's value table stays small.
    return r.groupBy("price_derivation_code").agg(
        F.count("*").alias("n_runs"), F.percentile("run_length", F.lit(0.5)).alias("median_run"),
        F.avg("run_length").alias("mean_run"), F.max("run_length").alias("max_run"))


@query("E20", sql="""
SELECT series, settlement_date, CAST(coalesce(max(CASE WHEN settlement_period = rn THEN rn END), 0) AS INTEGER) AS frontier,
       max(settlement_period) AS latest, count(*) AS n_settled FROM (
  SELECT *, row_number() OVER (PARTITION BY series, settlement_date ORDER BY settlement_period) AS rn FROM c_panel_type) GROUP BY 1, 2""")
def settled_frontier(t: Tables):
    from slotwise.operators.monitor import contiguous_frontier
    return contiguous_frontier(I.panel(t, by_type=True), ["series", "settlement_date"])


# -- daily ------------------------------------------------------------------------
_DCOLS = ["ssp_raw_daily_mean", "ssp_raw_daily_max", "ssp_raw_daily_min", "ssp_raw_daily_std", "ssp_daily_mean",
          "niv_daily_mean", "niv_daily_std", "wind_pct_daily_mean", "gas_pct_daily_mean", "mid_daily_mean",
          "windfor_fc_daily_mean", "tsdf_fc_daily_max", "margin_fc_daily_min", "wind_pen_fc_daily_mean", "surplus_fc"]
_DAILY = """
WITH j AS (SELECT c.*, mid_price, windfor_fc_mw, tsdf_fc_mw, surplus_fc_mw, tsdf_fc_mw - windfor_fc_mw AS margin_fc_mw,
                  100.0 * windfor_fc_mw / nullif(tsdf_fc_mw, 0) AS wind_pen_fc
  FROM c_clean c LEFT JOIN c_mid USING (settlement_date, settlement_period) LEFT JOIN c_vintage USING (settlement_date, settlement_period)),
dd AS (SELECT series, settlement_date, any_value(day_ix) AS day_ix, count(ssp_raw) AS n_slots, avg(ssp_raw) AS ssp_raw_daily_mean,
  max(ssp_raw) AS ssp_raw_daily_max, min(ssp_raw) AS ssp_raw_daily_min, stddev_samp(ssp_raw) AS ssp_raw_daily_std,
  avg(ssp) AS ssp_daily_mean, avg(net_imbalance_volume) AS niv_daily_mean, stddev_samp(net_imbalance_volume) AS niv_daily_std,
  CAST(sum(CAST(is_spike AS INTEGER)) AS BIGINT) AS is_spike_count, CAST(sum(CAST(ssp_raw < 0 AS INTEGER)) AS BIGINT) AS neg_sp_daily_count,
  avg(wind_pct) AS wind_pct_daily_mean, avg(gas_pct) AS gas_pct_daily_mean, avg(mid_price) AS mid_daily_mean,
  avg(windfor_fc_mw) AS windfor_fc_daily_mean, max(tsdf_fc_mw) AS tsdf_fc_daily_max, min(margin_fc_mw) AS margin_fc_daily_min,
  avg(wind_pen_fc) AS wind_pen_fc_daily_mean, min_by(surplus_fc_mw, settlement_period) FILTER (WHERE settlement_period = first_sp) AS surplus_fc
  FROM (SELECT *, min(settlement_period) OVER (PARTITION BY series, settlement_date) AS first_sp FROM j) GROUP BY 1, 2)
"""


def _daily(t: Tables):
    j = FT.join_slot_table(_clean(t), vwap(I.provider_trades(t), KEY))
    j = FT.vintage_columns(FT.join_slot_table(j, I.vintages(t)))
    return DY.daily_rollup(j)


@query("D1", rnd=" ".join(_DCOLS), sql=_DAILY + "SELECT series, settlement_date, n_slots, is_spike_count, neg_sp_daily_count, "
       + ", ".join(_DCOLS) + " FROM dd")
def daily_rollup(t: Tables):
    return _daily(t).select("series", "settlement_date", "n_slots", "is_spike_count", "neg_sp_daily_count", *_DCOLS)


@query("D2", sql="SELECT series, settlement_date, count(*) AS n_slots FROM c_panel GROUP BY 1, 2 HAVING count(*) = 48")
def complete_days(t: Tables):
    return DY.complete_days(DY.daily_rollup(_clean(t))).select("series", "settlement_date", "n_slots")


_DL = {f"{c}_lag{n}d": at(c, n, "d") for n in (1, 2, 7, 14, 28)
       for c in ("ssp_daily_mean", "ssp_raw_daily_max", "ssp_raw_daily_min")}
_DR = {f"ssp_daily_roll_{s}_{w}d": roll("ssp_daily_mean", w, s, "d", 3) for w in (7, 14, 28) for s in ("mean", "std", "max", "min")}
_DR |= {f"ssp_raw_max_roll_mean_{w}d": roll("ssp_raw_daily_max", w, "mean", "d", 3) for w in (7, 14, 28)}
_DD = {f"niv_daily_mean_lag{n}d": at("niv_daily_mean", n, "d") for n in (1, 7)}
_DD |= {f"{o}_lag{n}d": at(c, n, "d") for n in (1, 7) for o, c in (("spike_count", "is_spike_count"), ("neg_sp_count", "neg_sp_daily_count"))}
_DD |= {f"niv_daily_roll_{s}_{w}d": roll("niv_daily_mean", w, s, "d", 3) for w in (7, 14) for s in ("mean", "std")}
_DD |= {"spike_count_roll_7d": roll("is_spike_count", 7, "sum", "d"), "neg_sp_count_roll_7d": roll("neg_sp_daily_count", 7, "sum", "d")}
_DD |= {f"{c}_daily_mean_lag{n}d": at(f"{c}_daily_mean", n, "d") for c in ("wind_pct", "gas_pct") for n in (1, 7)}
_DD |= {f"{c}_daily_roll_mean_7d": roll(f"{c}_daily_mean", 7, "mean", "d", 3) for c in ("wind_pct", "gas_pct")}
_DD |= {f"mid_daily_mean_lag{n}d": at("mid_daily_mean", n, "d") for n in (1, 7)}
_DD |= {"mid_daily_roll_mean_7d": roll("mid_daily_mean", 7, "mean", "d", 3),
        "ssp_mid_spread_lag1d": f"{at('ssp_daily_mean', 1, 'd')} - {at('mid_daily_mean', 1, 'd')}"}
_DID = "series, settlement_date"


@query("E13", rnd=" ".join(_DL), sql=_DAILY + select_sql(_DL, "dd", _DID))
def daily_level_lags(t: Tables):
    return DY.daily_features(_daily(t)).select("series", "settlement_date", *_DL)


@query("E14", rnd=" ".join(_DR), sql=_DAILY + select_sql(_DR, "dd", _DID))
def daily_level_rolling(t: Tables):
    return DY.daily_features(_daily(t)).select("series", "settlement_date", *_DR)


@query("E15", rnd=" ".join(_DD), sql=_DAILY + select_sql(_DD, "dd", _DID))
def daily_driver_lags(t: Tables):
    return DY.daily_features(_daily(t)).select("series", "settlement_date", *_DD)


_ORD = {f"price_lag{n}d": at("price", n, "d") for n in (1, 2, 7, 14, 28)}
_ORD |= {f"price_roll_{s}_{w}d": roll("price", w, s, "d", 3) for w in (7, 28) for s in ("mean", "std")}


@query("E13 E14", rnd=" ".join(_ORD), sql=select_sql(_ORD, "c_daily_prio", _DID))
def daily_price_history(t: Tables):
    """Years of daily prices of five series."""
    f = SR.frames_by(["series"], "day_ix")
    cols = {f"price_lag{n}d": f.lag("price", n) for n in (1, 2, 7, 14, 28)}
    cols |= {f"price_roll_{s}_{w}d": f.rolling("price", w, s, min_periods=3) for w in (7, 28) for s in ("mean", "std")}
    return I.daily_orders(t, by_priority=True).withColumns(cols).select("series", "settlement_date", *cols)


@query("D3 E24", rnd="lag48_max lag48_sum lag48_mean lag48_first", sql=f"""
WITH l AS (SELECT *, {at('ssp_raw', 48)} AS lag48 FROM c_clean),
s AS (SELECT *, min(settlement_period) FILTER (WHERE lag48 IS NOT NULL) OVER (PARTITION BY series, settlement_date) AS fsp FROM l),
g AS (SELECT series, settlement_date, day_ix, max(CAST(ssp_raw > 150 AS INTEGER)) AS spike_day, max(lag48) AS lag48_max, sum(lag48) AS lag48_sum,
  avg(lag48) AS lag48_mean, max(CASE WHEN settlement_period = first_sp THEN lag48 END) AS lag48_first,
  CAST(sum(CAST(lag48 > 150 AS INTEGER)) AS BIGINT) AS lag48_spikes
  FROM (SELECT *, min(settlement_period) OVER (PARTITION BY series, settlement_date) AS first_sp FROM s) GROUP BY 1, 2, 3)
SELECT settlement_date, spike_day, lag48_max, lag48_sum, lag48_mean, lag48_first, lag48_spikes,
  CAST(sum(lag48_spikes) OVER (PARTITION BY series ORDER BY day_ix RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS spike_days_7d FROM g""")
def spike_day_features(t: Tables):
    h = FT.slot_history(_clean(t), [FT.price_lags])
    return DY.spike_day_features(h).select("settlement_date", "spike_day", "lag48_max", "lag48_sum", "lag48_mean",
                                           "lag48_first", "lag48_spikes", "spike_days_7d")


_SHAPE = """
, sl AS (SELECT *, {l48} AS ssp_lag_48, {l96} AS ssp_lag_96, {l336} AS ssp_lag_336 FROM c_clean),
dl AS (SELECT series, settlement_date, ssp_raw_daily_mean, {m1} AS m1, {m2} AS m2, {m7} AS m7, {x1} AS x1, {x2} AS x2,
       {k7} AS spike_count_roll_7d FROM dd)
""".format(l48=at("ssp", 48), l96=at("ssp", 96), l336=at("ssp", 336), m1=at("ssp_daily_mean", 1, "d"),
           m2=at("ssp_daily_mean", 2, "d"), m7=at("ssp_daily_mean", 7, "d"), x1=at("ssp_raw_daily_max", 1, "d"),
           x2=at("ssp_raw_daily_max", 2, "d"), k7=roll("is_spike_count", 7, "sum", "d"))


@query("C6 J5", rnd="ssp_shape_target ssp_lag48_deviation ssp_lag336_deviation ssp_raw_daily_max_lag1d spike_count_roll_7d",
       sql=_DAILY + _SHAPE + """
SELECT s.settlement_date, s.settlement_period, ssp_raw - ssp_raw_daily_mean AS ssp_shape_target, ssp_lag_48 - m1 AS ssp_lag48_deviation,
  ssp_lag_336 - m7 AS ssp_lag336_deviation, x1 AS ssp_raw_daily_max_lag1d, spike_count_roll_7d
FROM sl s LEFT JOIN dl USING (series, settlement_date)""")
def next_day_shape_table(t: Tables):
    s = FT.shape_table(FT.slot_history(_clean(t), [FT.price_lags]), DY.daily_features(_daily(t)), 1)
    return s.select(*KEY, "ssp_shape_target", "ssp_lag48_deviation", "ssp_lag336_deviation", "ssp_raw_daily_max_lag1d", "spike_count_roll_7d")


@query("C7", rnd="ssp_shape_target ssp_lag96_deviation ssp_lag336_deviation ssp_raw_daily_max_lag2d", sql=_DAILY + _SHAPE + """
SELECT s.settlement_date, s.settlement_period, ssp_raw - ssp_raw_daily_mean AS ssp_shape_target, ssp_lag_96 - m2 AS ssp_lag96_deviation,
  ssp_lag_336 - m7 AS ssp_lag336_deviation, x2 AS ssp_raw_daily_max_lag2d FROM sl s LEFT JOIN dl USING (series, settlement_date)""")
def two_day_shape_table(t: Tables):
    s = FT.shape_table(FT.slot_history(_clean(t), [FT.price_lags]), DY.daily_features(_daily(t)), 2)
    return s.select(*KEY, "ssp_shape_target", "ssp_lag96_deviation", "ssp_lag336_deviation", "ssp_raw_daily_max_lag2d")


def full_feature_table(t: Tables):
    """Every slot feature family and feed join: the table the models train on."""
    p = C.base_columns(_clean(t))
    p = FT.join_slot_table(p, vwap(I.provider_trades(t), KEY))
    p = FT.vintage_columns(FT.join_slot_table(p, I.vintages(t)))
    p = FT.join_price_index(p, I.cpi(t))
    p = FT.join_weather(p, I.weather(t))
    p = FT.slot_history(p, [FT.price_lags, FT.ramps, FT.price_rolling, FT.volume_rolling, FT.spike_memory,
                            FT.generation_lags, FT.market_lags, FT.weather_history])
    return FT.add_calendar(FT.same_slot_week(p))


@query("C1 C2 C3 C4 C5 B27", sql="""
SELECT settlement_date, count(*) AS n, count(l48) AS has_lag_48, count(l336) AS has_lag_336, count(r) AS has_roll_std_6 FROM (
  SELECT settlement_date, """ + at("ssp", 48) + " AS l48, " + at("ssp", 336) + " AS l336, " + roll("ssp", 6, "std") + """ AS r
  FROM c_clean) GROUP BY 1""")
def full_feature_fill(t: Tables):
    f = full_feature_table(t)
    return f.groupBy("settlement_date").agg(
        F.count("*").alias("n"), F.count("ssp_lag_48").alias("has_lag_48"), F.count("ssp_lag_336").alias("has_lag_336"),
        F.count("ssp_roll_std_6").alias("has_roll_std_6"))


def _selected(t: Tables, slots_back: int, horizon: int):
    s = FT.shape_table(full_feature_table(t), DY.daily_features(_daily(t)), horizon)
    return s, FT.features_known(s.columns, slots_back)


def _core_counts(t: Tables, slots_back: int, horizon: int, core: list[str]):
    s, names = _selected(t, slots_back, horizon)
    core = [c for c in core if c in names]
    return C.complete_cases(s.select(*KEY, *names), core).groupBy("settlement_date").agg(
        F.count("*").alias("n_complete"), F.lit(len(core)).alias("n_core"))


@query("B12 B15", sql="""
SELECT settlement_date, count(*) AS n_complete, 2 AS n_core FROM (SELECT settlement_date, """
       + at("ssp", 48) + " AS a, " + at("ssp", 336) + """ AS b FROM c_clean) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def next_day_complete_cases(t: Tables):
    """lag_1 is asked for too, but the selector knows it is unavailable a day ahead."""
    return _core_counts(t, 48, 1, ["ssp_lag_1", "ssp_lag_48", "ssp_lag_336"])


@query("B13 B15", sql="""
SELECT settlement_date, count(*) AS n_complete, 2 AS n_core FROM (SELECT settlement_date, """
       + at("ssp", 96) + " AS a, " + at("ssp", 336) + """ AS b FROM c_clean) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def two_day_complete_cases(t: Tables):
    return _core_counts(t, 96, 2, ["ssp_lag_48", "ssp_lag_96", "ssp_lag_336"])


@query("B14 B15", sql="""
SELECT settlement_date, count(*) AS n_complete, 2 AS n_core FROM (SELECT settlement_date, """
       + at("ssp", 1) + " AS a, " + at("ssp", 336) + """ AS b FROM c_clean) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def direct_complete_cases(t: Tables):
    return _core_counts(t, 1, 1, ["ssp_lag_1", "ssp_lag_336", "ssp_raw"])


@query("B11 B16", sql="""
SELECT count(*) AS n_days, CAST(sum(CAST(m1 IS NOT NULL AND m7 IS NOT NULL AS INTEGER)) AS BIGINT) AS n_complete FROM (SELECT """
       + at("ssp", 1, "d") + " AS m1, " + at("ssp", 7, "d") + """ AS m7 FROM (
  SELECT series, settlement_date, day_ix, avg(ssp) AS ssp FROM c_clean GROUP BY 1, 2, 3))""")
def level_complete_days(t: Tables):
    """Level-model columns, those without any value dropped, then complete days counted."""
    d = DY.daily_features(_daily(t))
    names = DY.level_feature_names(d.columns)
    kept = C.drop_all_null(d.select("settlement_date", *names), names)
    ok = F.col("ssp_daily_mean_lag1d").isNotNull() & F.col("ssp_daily_mean_lag7d").isNotNull()
    return kept.agg(F.count("*").alias("n_days"), F.count_if(ok).alias("n_complete"))


@query("B21", sql="""
SELECT settlement_date, count(*) AS n, 0 AS has_temp, 0 AS has_wind, count(l) AS has_lag FROM (
  SELECT settlement_date, """ + at("ssp", 48) + """ AS l FROM c_clean) GROUP BY 1""")
def without_weather(t: Tables):
    f = C.null_features(full_feature_table(t), ["temp_c_lag_48", "wind_ms_lag_48", "solar_wm2_lag_48"])
    return f.groupBy("settlement_date").agg(
        F.count("*").alias("n"), F.count("temp_c_lag_48").cast("int").alias("has_temp"),
        F.count("wind_ms_lag_48").cast("int").alias("has_wind"), F.count("ssp_lag_48").alias("has_lag"))


# -- whole feature tables, every column compared -----------------------------------
_SPIKES = {f"is_spike_lag_{n}": at("CAST(is_spike AS INTEGER)", n) for n in (48, 336)}
_SPIKES |= {f"is_negative_lag_{n}": at("CAST(ssp_raw < 0 AS INTEGER)", n) for n in (48, 336)}
_SPIKES |= {"spike_count_roll_48": roll("CAST(is_spike AS INTEGER)", 48, "sum"), "neg_count_roll_48": roll("CAST(ssp_raw < 0 AS INTEGER)", 48, "sum")}
_VINTAGE = {"windfor_fc_mw": "windfor_fc_mw", "tsdf_fc_mw": "tsdf_fc_mw", "surplus_fc_mw": "surplus_fc_mw", "margin_fc_mw": "tsdf_fc_mw - windfor_fc_mw",
            "wind_pen_fc": "100.0 * windfor_fc_mw / nullif(tsdf_fc_mw, 0)"}
_OWN = _LAGS | _RAMPS | _ROLL | _VROLL | _SPIKES | _GEN | _MID | _WX | _SAME | _VINTAGE
_OF_DAY = {c: (_DL | _DR | _DD)[c] for c in (
    "ssp_daily_mean_lag1d", "ssp_daily_mean_lag2d", "ssp_daily_mean_lag7d", "ssp_raw_daily_max_lag1d", "ssp_raw_daily_max_lag2d", "niv_daily_mean_lag1d", "spike_count_lag1d",
    "spike_count_lag7d", "spike_count_roll_7d", "ssp_daily_roll_mean_7d", "ssp_daily_roll_std_7d")}
_DEVIATIONS = {"ssp_lag48_deviation": "ssp_lag_48 - ssp_daily_mean_lag1d", "ssp_lag96_deviation": "ssp_lag_96 - ssp_daily_mean_lag2d",
               "ssp_lag336_deviation": "ssp_lag_336 - ssp_daily_mean_lag7d"}
_AHEAD = [*FT.CALENDAR, "cpi_index", "cpi_yoy"]
_SLOT_COLUMNS = [*_OWN, *_AHEAD]
#: Columns of the shape table for the next day and for the day after.
_NEXT = [*_SLOT_COLUMNS, *[c for c in _OF_DAY if not c.endswith("lag2d") and c not in ("spike_count_lag7d", "ssp_daily_mean_lag7d")], "ssp_daily_mean_lag7d",
         "ssp_lag48_deviation", "ssp_lag336_deviation"]
_AFTER = [*_SLOT_COLUMNS, "ssp_daily_mean_lag2d", "ssp_daily_mean_lag7d", "ssp_raw_daily_max_lag2d", "spike_count_lag7d", "ssp_lag96_deviation", "ssp_lag336_deviation"]
# The same selection by names: what a day-ahead model must not see, and what the day after may.
_TOO_NEW = re.compile(r"_lag_[12]$|^(ssp|net_imbalance_volume|abs_niv|temp_c|wind_ms|solar_wm2)_roll_|_count_roll_48$|^ssp_diff_1_48$|^wind_ramp_6$")
_OLD_ENOUGH = re.compile(r"_lag_(96|336)$|_ramp_336$|_lag[27]d$|_lag(96|336)_deviation$")
_NEXT_DAY = [c for c in _NEXT if not _TOO_NEW.search(c)]
_TWO_DAY = [c for c in _AFTER if c in _AHEAD or _OLD_ENOUGH.search(c)]


def _after_with(text: str) -> str:
    return re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", text).strip()


_FULL = "WITH RECURSIVE " + ",\n".join([_after_with(_CPI), _after_with(_WX_JOIN).replace("\nj AS (", "\nwx AS ("), _after_with(_DAILY)]) + f""",
cal AS ({QUERIES["calendar_features"].body}),
src AS (SELECT c.*, {", ".join(FT.WEATHER)}, mid_price, windfor_fc_mw, tsdf_fc_mw, surplus_fc_mw
  FROM c_clean c LEFT JOIN wx USING (series, settlement_date, settlement_period) LEFT JOIN c_mid USING (settlement_date, settlement_period)
  LEFT JOIN c_vintage USING (settlement_date, settlement_period)),
own AS ({select_sql(_OWN, "src")}),
of_day AS ({select_sql(_OF_DAY, "dd", _DID)}),
wide AS (SELECT own.*, cal.* EXCLUDE (settlement_date, settlement_period), cpi_index, cpi_yoy, of_day.* EXCLUDE (series, settlement_date), {", ".join(f"{e} AS {n}" for n, e in _DEVIATIONS.items())}
  FROM own LEFT JOIN cal USING (settlement_date, settlement_period) LEFT JOIN of_day USING (series, settlement_date)
  LEFT JOIN y ON y.year_month = CAST(date_trunc('month', own.settlement_date) AS DATE))
"""


def _full_sql(names: list[str], where: str = "TRUE") -> str:
    return _FULL + f"SELECT series, settlement_date, settlement_period, {', '.join(names)} FROM wide WHERE {where}"


def _complete(t: Tables, slots_back: int, horizon: int, core: list[str]):
    s, names = _selected(t, slots_back, horizon)
    return C.complete_cases(s.select(*SID, *names), [c for c in core if c in names])


@query("C1 C2 C3 C4 C5 B27 E1 E3 E4 E9 E11 H1", rnd=" ".join(_SLOT_COLUMNS), sql=_full_sql(_SLOT_COLUMNS))
def slot_features(t: Tables):
    """The whole slot feature table: every family and feed, every row."""
    return full_feature_table(t).select(*SID, *_SLOT_COLUMNS)


@query("B12 B15 C6", rnd=" ".join(_NEXT_DAY), sql=_full_sql(_NEXT_DAY, "ssp_lag_48 IS NOT NULL AND ssp_lag_336 IS NOT NULL"))
def next_day_features(t: Tables):
    """What the next-day shape model trains on."""
    return _complete(t, 48, 1, ["ssp_lag_1", "ssp_lag_48", "ssp_lag_336"])


@query("B13 B15 C7", rnd=" ".join(_TWO_DAY), sql=_full_sql(_TWO_DAY, "ssp_lag_96 IS NOT NULL AND ssp_lag_336 IS NOT NULL"))
def two_day_features(t: Tables):
    """What the shape model of the day after trains on."""
    return _complete(t, 96, 2, ["ssp_lag_48", "ssp_lag_96", "ssp_lag_336"])


@query("B14 B15", rnd=" ".join(_NEXT), sql=_full_sql(_NEXT, "ssp_lag_1 IS NOT NULL AND ssp_lag_336 IS NOT NULL"))
def direct_features(t: Tables):
    """What the direct model trains on: short lags as well."""
    return _complete(t, 1, 1, ["ssp_lag_1", "ssp_lag_336", "ssp_raw"])


_NO_WEATHER = ["temp_c_lag_48", "wind_ms_lag_48", "solar_wm2_lag_48"]


@query("B21", rnd=" ".join(_SLOT_COLUMNS), sql=_full_sql([f"CAST(NULL AS DOUBLE) AS {c}" if c in _NO_WEATHER else c for c in _SLOT_COLUMNS]))
def slot_features_without_weather(t: Tables):
    """The whole table with a list of inputs taken away, the others untouched."""
    return C.null_features(full_feature_table(t).select(*SID, *_SLOT_COLUMNS), _NO_WEATHER)
