"""Cleaning, keys, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import scoring as S
from slotwise.functions.keys import (
    ahead_date, ahead_period, clock_label, local_clock, local_date, ordinal_period, periods_in_day, slot_start,
)
from slotwise.operators import clean as C
from slotwise.operators import features as FT
from slotwise.operators.ordered import exact_quantiles
from slotwise.plans import inputs as I
from slotwise.plans.registry import query
from slotwise.session import Tables


@query("D6 J1 B5 E1 D1", rnd="mae", sql="""
SELECT a.settlement_date, count(*) AS n, avg(abs(a.ssp_raw - b.ssp)) AS mae
FROM c_clean a JOIN c_clean b ON b.slot_ix = a.slot_ix - 48 AND a.series = b.series GROUP BY 1""")
def daily_naive_error(t: Tables):
    p = C.winsorise(I.panel(t))
    prev = p.select("series", (F.col("slot_ix") + 48).alias("slot_ix"), F.col("ssp").alias("yhat"))
    return p.join(prev, ["series", "slot_ix"]).groupBy("settlement_date").agg(
        F.count("*").alias("n"), S.mae("ssp_raw", "yhat").alias("mae")
    )


@query("B1 G2", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn
  FROM lineitem) WHERE rn = 1""")
def repeated_keys_first_kept(t: Tables):
    cols = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    li = t.lineitem.select("l_orderkey", "l_linenumber", *cols)
    kept = C.drop_repeats(li, ["l_orderkey", "l_linenumber"], [F.col(c) for c in cols])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("B2 C24", sql="""
SELECT series, settlement_date, settlement_period FROM (
  SELECT series, CAST(d AS DATE) AS settlement_date, CAST(unnest(range(1, 49)) AS INTEGER) AS settlement_period
  FROM (SELECT series, unnest(generate_series(min(settlement_date), max(settlement_date), INTERVAL 1 DAY)) AS d
        FROM c_panel_type GROUP BY 1)) g
WHERE NOT EXISTS (SELECT 1 FROM c_panel_type p WHERE p.series = g.series
  AND p.settlement_date = g.settlement_date AND p.settlement_period = g.settlement_period)""")
def gap_report(t: Tables):
    return C.missing_slots(I.panel(t, by_type=True))


@query("B2", sql="""
SELECT series, (datediff('day', min(settlement_date), max(settlement_date)) + 1) * 48 AS expected, count(*) AS present,
       (datediff('day', min(settlement_date), max(settlement_date)) + 1) * 48 - count(*) AS missing
FROM c_panel_type GROUP BY 1""")
def slot_coverage(t: Tables):
    return C.coverage(I.panel(t, by_type=True))


@query("B3 H9", sql="""
SELECT series, settlement_date, settlement_period,
       CAST(settlement_date AS TIMESTAMP) + to_minutes((settlement_period - 1) * 30) AS settlement_datetime,
       lpad(CAST((settlement_period - 1) // 2 AS VARCHAR), 2, '0')
         || CASE WHEN settlement_period % 2 = 1 THEN ':00' ELSE ':30' END AS slot_label FROM c_panel_type""")
def slot_clock_times(t: Tables):
    return I.panel(t, by_type=True).select(
        "series", "settlement_date", "settlement_period",
        slot_start().alias("settlement_datetime"), clock_label().alias("slot_label"),
    )


_LOCAL = """
WITH i AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_minutes((o_orderkey % 48) * 30) AS utc_ts FROM orders),
y AS (SELECT *, year(utc_ts) AS yr FROM i),
b AS (SELECT *,
  CAST(make_date(yr, 3, 31) - to_days(CAST(dayofweek(make_date(yr, 3, 31)) AS INTEGER)) AS TIMESTAMP)
    + INTERVAL 1 HOUR AS bst_on,
  CASE WHEN yr = 1995 THEN TIMESTAMP '1995-10-22 01:00:00'
       ELSE CAST(make_date(yr, 10, 31) - to_days(CAST(dayofweek(make_date(yr, 10, 31)) AS INTEGER)) AS TIMESTAMP)
    + INTERVAL 1 HOUR END AS bst_off FROM y),
l AS (SELECT *, CASE WHEN utc_ts >= bst_on AND utc_ts < bst_off THEN utc_ts + INTERVAL 1 HOUR ELSE utc_ts END AS loc FROM b)
"""


@query("B4 H5", sql=_LOCAL + """
SELECT o_orderkey, CAST(loc AS DATE) AS settlement_date, loc AS local_ts,
  CAST(hour(loc) * 2 + minute(loc) // 30 + 1
    + CASE WHEN CAST(loc AS DATE) = CAST(bst_on AS DATE) AND utc_ts >= bst_on THEN -2
           WHEN CAST(loc AS DATE) = CAST(bst_off AS DATE) AND utc_ts >= bst_off THEN 2 ELSE 0 END AS INTEGER)
    AS settlement_period,
  CASE WHEN CAST(loc AS DATE) = CAST(bst_on AS DATE) THEN 46 WHEN CAST(loc AS DATE) = CAST(bst_off AS DATE) THEN 50
       ELSE 48 END AS periods FROM l""")
def utc_to_local_slot(t: Tables):
    """Local date and ordinal period of UTC instants, including 46- and 50-slot days."""
    utc = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 48).cast("int") * 30)
    d = t.orders.select("o_orderkey", utc.alias("utc_ts"))
    return d.select(
        "o_orderkey", local_date("utc_ts").alias("settlement_date"), local_clock("utc_ts").alias("local_ts"),
        ordinal_period("utc_ts").alias("settlement_period"), periods_in_day(local_date("utc_ts")).alias("periods"),
    )


@query("B5", rnd="ssp ssp_raw", sql="""
SELECT series, settlement_date, settlement_period, ssp, ssp_raw, CAST(is_spike AS INTEGER) AS is_spike FROM c_clean""")
def tukey_winsorise(t: Tables):
    return C.winsorise(I.panel(t)).select(
        "series", "settlement_date", "settlement_period", "ssp", "ssp_raw", F.col("is_spike").cast("int").alias("is_spike"))


@query("B5 B8", rnd="lo hi", sql="""
SELECT series, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (
  SELECT series, quantile_cont(ssp, 0.25) AS q1, quantile_cont(ssp, 0.75) AS q3 FROM c_panel_type GROUP BY 1)""")
def fence_per_series(t: Tables):
    return C.fit_fence(I.panel(t, by_type=True))


@query("B6 G1", rnd="ssp ssp_raw", sql="""
WITH h AS (SELECT * FROM c_panel WHERE settlement_date < DATE '2024-01-21'),
f AS (SELECT quantile_cont(ssp, 0.25) AS q1, quantile_cont(ssp, 0.75) AS q3, max(settlement_date) AS last FROM h),
g AS (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi, last FROM f)
SELECT settlement_date, settlement_period, least(greatest(ssp, lo), hi) AS ssp, ssp AS ssp_raw,
       CAST(ssp > hi AS INTEGER) AS is_spike FROM c_panel CROSS JOIN g WHERE settlement_date > last""")
def winsorise_new_rows(t: Tables):
    p = I.panel(t)
    out = C.extend_clean(p.where("settlement_date < date'2024-01-21'"), p)
    return out.select("settlement_date", "settlement_period", "ssp", "ssp_raw", F.col("is_spike").cast("int").alias("is_spike"))


@query("B7", rnd="abs_imbalance_volume replacement_price", sql="""
SELECT settlement_date, settlement_period, abs(net_imbalance_volume) AS abs_imbalance_volume,
       CASE WHEN price_derivation_code = 'P' THEN 1 ELSE 0 END AS price_derivation_code_P,
       coalesce(replacement_price, ssp) AS replacement_price FROM c_clean""")
def base_price_columns(t: Tables):
    return C.base_columns(C.winsorise(I.panel(t))).select(
        "settlement_date", "settlement_period", "abs_imbalance_volume", "price_derivation_code_P", "replacement_price")


@query("B8", rnd="lo hi", sql="""
WITH f AS (SELECT quantile_cont(ssp, 0.02) AS a, quantile_cont(ssp, 0.98) AS b FROM c_panel)
SELECT series, min(CASE WHEN ssp < a THEN a END) AS lo, max(CASE WHEN ssp > b THEN b END) AS hi
FROM c_panel CROSS JOIN f GROUP BY 1""")
def fence_recovered(t: Tables):
    """Narrow 2 / 98 % fence so that rows are clipped, then read back from the data."""
    p = I.panel(t)
    fence = exact_quantiles(p, ["series"], "ssp", {"lo": 0.02, "hi": 0.98})
    return C.recover_fence(C.apply_fence(p, fence))


@query("B9 A3", rnd="ssp ssp_winsorised", sql="""
SELECT settlement_date, settlement_period, coalesce(ssp_raw, ssp) AS ssp, ssp AS ssp_winsorised,
       lpad(CAST((settlement_period - 1) // 2 AS VARCHAR), 2, '0')
         || CASE WHEN settlement_period % 2 = 1 THEN ':00' ELSE ':30' END AS slot_label FROM c_clean""")
def real_price_view(t: Tables):
    return C.winsorise(I.panel(t)).select(
        "settlement_date", "settlement_period", F.coalesce("ssp_raw", "ssp").alias("ssp"),
        F.col("ssp").alias("ssp_winsorised"), clock_label().alias("slot_label"))


@query("B10 A23", rnd="ssp", sql="""
SELECT settlement_date, settlement_period, ssp FROM c_panel
WHERE settlement_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def date_range_rows(t: Tables):
    return I.panel(t, since="2024-01-10", until="2024-01-21").select("settlement_date", "settlement_period", "ssp")


@query("B17 J23", rnd="ssp_real asinh_target", sql="""
SELECT p.settlement_date, p.settlement_period, p.ssp * (l.latest / c.cpi_index) AS ssp_real,
       asinh(p.ssp * (l.latest / c.cpi_index) / 50) AS asinh_target
FROM c_panel p LEFT JOIN (
  SELECT m.year_month, last_value(cpi_index IGNORE NULLS) OVER (ORDER BY m.year_month) AS cpi_index
  FROM (SELECT CAST(unnest(generate_series(min(year_month), max(year_month), INTERVAL 1 MONTH)) AS DATE) AS year_month FROM c_cpi) m
  LEFT JOIN c_cpi c ON c.year_month = m.year_month) c ON c.year_month = date_trunc('month', p.settlement_date)
CROSS JOIN (SELECT max_by(cpi_index, year_month) AS latest FROM c_cpi) l""")
def deflated_target(t: Tables):
    """Target in latest-month money, and its asinh(y / 50) form; an unpublished month takes the index of the one before."""
    p = FT.join_price_index(I.panel(t), I.cpi(t))
    real = F.col("ssp") * F.col("cpi_deflator")
    return p.select(
        "settlement_date", "settlement_period", real.alias("ssp_real"), F.asinh(real / 50).alias("asinh_target"))


@query("B18", sql="""
SELECT CASE WHEN ssp <= 85 THEN '<=85' WHEN ssp <= 120 THEN '85-120' WHEN ssp <= 150 THEN '120-150'
            WHEN ssp <= 250 THEN '150-250' ELSE '>250' END AS bucket, count(*) AS n FROM c_panel GROUP BY 1""")
def price_buckets(t: Tables):
    return I.panel(t).groupBy(S.price_bucket("ssp").alias("bucket")).agg(F.count("*").alias("n"))


@query("B19 H6", rnd="q10 q50 q90", sql="""
SELECT settlement_date, settlement_period, least(q90, q50 - 5) AS q10, q50 - 5 AS q50, greatest(q10, q50 - 5) AS q90 FROM c_wf""")
def quantiles_in_order(t: Tables):
    """Bands swapped on purpose, then repaired around a shifted median."""
    f = I.forecasts(t).withColumns({"a": F.col("q90"), "b": F.col("q50") - 5, "c": F.col("q10")})
    return f.select("settlement_date", "settlement_period",
                    *[v.alias(k) for k, v in S.ordered_band("a", "b", "c").items()])


@query("B20 D14", rnd="win_mean median lo hi", sql="""
WITH r AS (SELECT fold, actual - q50 AS e FROM c_wf),
q AS (SELECT fold, quantile_cont(e, 0.05) AS lo, quantile_cont(e, 0.95) AS hi, quantile_cont(e, 0.5) AS median FROM r GROUP BY 1)
SELECT r.fold, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi,
       avg(least(greatest(e, lo), hi)) AS win_mean, any_value(median) AS median FROM r JOIN q USING (fold) GROUP BY 1""")
def winsorised_residuals(t: Tables):
    r = I.forecasts(t).select("fold", (F.col("actual") - F.col("q50")).alias("e"))
    q = exact_quantiles(r, ["fold"], "e", {"lo": 0.05, "hi": 0.95, "median": 0.5})
    clipped = F.least(F.greatest("e", "lo"), "hi")
    # q holds one row per fold, so the join is broadcast at run time and no fold is shuffled whole.
    return r.join(q, "fold").groupBy("fold").agg(
        F.count("*").alias("n"), F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi"),
        F.avg(clipped).alias("win_mean"), F.any_value("median").alias("median"))


@query("B22 C19", rnd="temp_c", sql="""
WITH n AS (SELECT datetime_utc, temp_c + 1 AS new_temp FROM c_weather)
SELECT w.datetime_utc, CASE WHEN CAST(w.datetime_utc AS DATE) = DATE '2024-01-15' THEN coalesce(n.new_temp, w.temp_c)
       ELSE w.temp_c END AS temp_c FROM c_weather w LEFT JOIN n USING (datetime_utc)""")
def slice_replaced_for_day(t: Tables):
    """Readings of one date replaced by a second source; every other row untouched."""
    w = I.weather(t)
    day = F.to_date("datetime_utc") == F.lit("2024-01-15").cast("date")
    new = w.where(day).select("datetime_utc", (F.col("temp_c") + 1).alias("_new"))
    return w.join(new, "datetime_utc", "left").select(
        "datetime_utc", F.when(day, F.coalesce("_new", "temp_c")).otherwise(F.col("temp_c")).alias("temp_c"))


@query("B23 F6", rnd="price", sql="""
SELECT series, settlement_date, price FROM (
  SELECT *, max(day_ix) OVER (PARTITION BY series) AS last FROM c_daily_prio) WHERE day_ix > last - 40""")
def history_tail(t: Tables):
    """The last 40 days of each series; the cut-off is an aggregate, not a sort."""
    d = I.daily_orders(t, by_priority=True)
    last = d.groupBy("series").agg(F.max("day_ix").alias("_last"))
    return d.join(last, "series").where(F.col("day_ix") > F.col("_last") - 40).select("series", "settlement_date", "price")


@query("B24 A20", sql="""
SELECT settlement_date, CAST(sum(CASE WHEN k % 5 IN (0, 1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS n_actual, count(*) AS n
FROM c_ev GROUP BY 1""")
def flags_from_text(t: Tables):
    """Settled flags written as True, 1, ' true ', False or nothing."""
    k = F.col("k") % 5
    text = F.when(k == 0, "True").when(k == 1, "1").when(k == 2, " true ").when(k == 3, "False")
    e = I.slot_events(t).select("settlement_date", text.alias("is_actual"))
    return e.groupBy("settlement_date").agg(F.count_if(C.parse_flag("is_actual")).alias("n_actual"), F.count("*").alias("n"))


@query("B25", sql="""
SELECT coalesce(price_derivation_code, 'N') AS price_derivation_code, count(*) AS n FROM c_panel_type GROUP BY 1""")
def code_defaults(t: Tables):
    return C.default_code(I.panel(t, by_type=True)).groupBy("price_derivation_code").agg(F.count("*").alias("n"))


@query("B26", sql="""
SELECT fold, count(*) AS n, 0 AS n_risk, count(*) AS n_default FROM c_wf GROUP BY 1""")
def missing_columns_defaulted(t: Tables):
    f = C.ensure_columns(I.forecasts(t).drop("price_derivation_code"), {
        "spike_risk_flag": F.lit(False), "price_derivation_code": F.lit("N"), "fold": F.lit("none")})
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("spike_risk_flag").alias("n_risk"),
                                 F.count_if(F.col("price_derivation_code") == "N").alias("n_default"))


@query("B27", rnd="pct_present", sql="""
WITH j AS (SELECT p.ssp, p.replacement_price, p.price_derivation_code, v.windfor_fc_mw, m.mid_price FROM c_panel p
  LEFT JOIN c_vintage v USING (settlement_date, settlement_period) LEFT JOIN c_mid m USING (settlement_date, settlement_period)),
n AS (SELECT count(*) AS n_rows, count(ssp) AS a, count(replacement_price) AS b, count(price_derivation_code) AS c,
             count(windfor_fc_mw) AS d, count(mid_price) AS e FROM j)
SELECT u.column_name, u.n_present, n_rows, u.n_present * 100.0 / n_rows AS pct_present FROM n,
  LATERAL (VALUES ('ssp', a), ('replacement_price', b), ('price_derivation_code', c), ('windfor_fc_mw', d),
           ('mid_price', e)) AS u(column_name, n_present)""")
def feature_fill_rates(t: Tables):
    from slotwise.operators.joins import vwap
    key = ["settlement_date", "settlement_period"]
    j = I.panel(t).join(I.vintages(t), key, "left").join(vwap(I.provider_trades(t), key), key, "left")
    return C.fill_rates(j, ["ssp", "replacement_price", "price_derivation_code", "windfor_fc_mw", "mid_price"])


@query("E30", sql="""
SELECT settlement_date, settlement_period, h,
       CAST(settlement_date + to_days(CAST((settlement_period + h - 1) // 48 AS INTEGER)) AS DATE) AS target_date,
       CAST((settlement_period + h - 1) % 48 + 1 AS INTEGER) AS target_period
FROM c_panel CROSS JOIN (VALUES (1), (2), (3)) AS g(h)""")
def slot_rollover(t: Tables):
    p = I.panel(t).select("settlement_date", "settlement_period", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("h"))
    return p.select("*", ahead_date("settlement_date", "settlement_period", "h").alias("target_date"),
                    ahead_period("settlement_period", "h").alias("target_period"))
