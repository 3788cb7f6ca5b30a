"""Correctors, analyses, dashboards and monitoring reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from slotwise.functions import scoring as S
from slotwise.functions.keys import clock_label, ratio
from slotwise.operators import analysis as A
from slotwise.operators import clean as C
from slotwise.operators import correct as K
from slotwise.operators import joins as J
from slotwise.operators import metrics as M
from slotwise.operators import monitor as MO
from slotwise.operators import series as SR
from slotwise.operators.ordered import exact_quantiles
from slotwise.plans import inputs as I
from slotwise.plans.feature_queries import at, roll
from slotwise.plans.fragments import least_squares, predicted
from slotwise.plans.registry import query
from slotwise.plans.score_queries import COV, ISC, MAE, RAW, _MODELS, model_table
from slotwise.session import Tables

KEY = ["settlement_date", "settlement_period"]

# -- correctors -------------------------------------------------------------------
_KAL = """
WITH RECURSIVE st AS (
  SELECT settlement_date, fold, h, avg(actual - q50) FILTER (WHERE settlement_period <= least(17 + 2 * h, 48)) AS z,
    count(*) FILTER (WHERE settlement_period <= least(17 + 2 * h, 48)) AS n,
    max(settlement_period) FILTER (WHERE settlement_period <= least(17 + 2 * h, 48)) AS last_sp
  FROM c_wf CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS h) g GROUP BY 1, 2, 3),
k AS (
  SELECT settlement_date, fold, -1 AS h, CAST(0 AS DOUBLE) AS x, CAST({s} * {s} AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS nis
  FROM (SELECT DISTINCT settlement_date, fold FROM c_wf)
  UNION ALL
  SELECT k.settlement_date, k.fold, st.h,
    CASE WHEN st.n > 0 AND abs(st.z) <= 500 THEN k.x + (k.p + {q}) / (k.p + {q} + {s} * {s} / st.n) * (st.z - k.x) ELSE k.x END,
    CASE WHEN st.n > 0 AND abs(st.z) <= 500 THEN (1 - (k.p + {q}) / (k.p + {q} + {s} * {s} / st.n)) * (k.p + {q}) ELSE k.p END,
    CASE WHEN st.n >= 3 THEN (st.z - k.x) * (st.z - k.x) / (k.p + {q} + {s} * {s} / st.n) END
  FROM k JOIN st ON st.settlement_date = k.settlement_date AND st.fold = k.fold AND st.h = k.h + 1)
"""
_K5 = _KAL.format(q="5.0", s="20.0")
_SIM = _K5 + """
, o AS (SELECT w.*, st.h, st.z, st.last_sp, k.x, k.p, pow(0.98, w.settlement_period - coalesce(st.last_sp, 0) - 1) AS dk
  FROM c_wf w JOIN st ON st.settlement_date = w.settlement_date AND st.fold = w.fold
  JOIN k ON k.settlement_date = w.settlement_date AND k.fold = w.fold AND k.h = st.h
  WHERE w.settlement_period > least(17 + 2 * st.h, 48)),
sh AS (SELECT *, CASE WHEN abs(coalesce(0.4 * z, 0)) > 0.5 THEN 0.4 * z ELSE 0 END AS s FROM o),
sim AS (
  SELECT 'static' AS corrector, settlement_date, fold, h, settlement_period, actual, q10 AS pred_q10, q50 AS pred_q50, q90 AS pred_q90 FROM sh
  UNION ALL SELECT 'alpha', settlement_date, fold, h, settlement_period, actual, q10 + s, q50 + s, q90 + s FROM sh
  UNION ALL SELECT 'kalman', settlement_date, fold, h, settlement_period, actual,
    least(q10 + x * dk - 1.28 * sqrt(p) * dk, q50 + x * dk), q50 + x * dk, greatest(q90 + x * dk + 1.28 * sqrt(p) * dk, q50 + x * dk) FROM sh)
"""


@query("J9 I4", rnd="z x p nis", sql=_K5 + """
SELECT k.settlement_date, k.h, st.n, st.z, k.x, k.p, k.nis FROM k JOIN st USING (settlement_date, fold, h)""")
def filter_states(t: Tables):
    s = K.filter_states(I.forecasts(t), ["settlement_date", "fold"])
    return s.select("settlement_date", F.inline("path")).select("settlement_date", "h", "n", "z", "x", "p", "nis")


@query("J9 J10 I6 E22", rnd="pred_q10 pred_q50 pred_q90", sql=_SIM + """
SELECT corrector, settlement_date, h, settlement_period, pred_q10, pred_q50, pred_q90 FROM sim""")
def corrector_replay(t: Tables):
    return K.replay(I.forecasts(t)).select("corrector", "settlement_date", "h", "settlement_period", "pred_q10", "pred_q50", "pred_q90")


@query("D8 J9 J10", rnd="mae rmse coverage bias", sql=_SIM + """
SELECT coalesce(corrector, 'all') AS corrector, coalesce(fold, 'all') AS fold, count(*) AS n, avg(abs(actual - pred_q50)) AS mae,
  sqrt(avg((actual - pred_q50) * (actual - pred_q50))) AS rmse,
  avg(CASE WHEN actual >= pred_q10 AND actual <= pred_q90 THEN 100.0 ELSE 0.0 END) AS coverage, avg(actual - pred_q50) AS bias
FROM sim GROUP BY ROLLUP (corrector, fold)""")
def corrector_scores(t: Tables):
    return K.replay_scores(K.replay(I.forecasts(t)))


_GRID = """
WITH RECURSIVE g AS (SELECT CAST(q AS DOUBLE) AS q, CAST(s AS DOUBLE) AS s FROM (VALUES (5), (10), (21), (35), (50), (100)) AS a(q) CROSS JOIN (VALUES (20), (28), (35), (45), (55)) AS b(s)),
st AS (
  SELECT settlement_date, fold, h, avg(actual - q50) FILTER (WHERE settlement_period <= least(17 + 2 * h, 48)) AS z,
    count(*) FILTER (WHERE settlement_period <= least(17 + 2 * h, 48)) AS n
  FROM c_wf CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS h) hh GROUP BY 1, 2, 3),
k AS (
  SELECT g.q, g.s, settlement_date, fold, -1 AS h, CAST(0 AS DOUBLE) AS x, s * s AS p, CAST(NULL AS DOUBLE) AS nis
  FROM (SELECT DISTINCT settlement_date, fold FROM c_wf) CROSS JOIN g
  UNION ALL
  SELECT k.q, k.s, k.settlement_date, k.fold, st.h,
    CASE WHEN st.n > 0 AND abs(st.z) <= 500 THEN k.x + (k.p + q) / (k.p + q + s * s / st.n) * (st.z - k.x) ELSE k.x END,
    CASE WHEN st.n > 0 AND abs(st.z) <= 500 THEN (1 - (k.p + q) / (k.p + q + s * s / st.n)) * (k.p + q) ELSE k.p END,
    CASE WHEN st.n >= 3 THEN (st.z - k.x) * (st.z - k.x) / (k.p + q + s * s / st.n) END
  FROM k JOIN st ON st.settlement_date = k.settlement_date AND st.fold = k.fold AND st.h = k.h + 1),
c AS (SELECT q AS q_noise, s AS sigma_sp, fold, count(nis) AS n, avg(nis) AS mean_nis, sum(nis) AS sum_nis FROM k GROUP BY 1, 2, 3 HAVING count(nis) > 0)
"""


@query("D29", rnd="q_noise sigma_sp mean_nis", sql=_GRID + "SELECT q_noise, sigma_sp, fold, n, mean_nis FROM c")
def innovation_grid(t: Tables):
    return K.nis_grid(I.forecasts(t)).select("q_noise", "sigma_sp", "fold", "n", "mean_nis")


@query("D29 F5 D54", rnd="mean_nis lowest highest", sql=_GRID + """
, b AS (SELECT q_noise, sigma_sp FROM c GROUP BY 1, 2 ORDER BY abs(sum(sum_nis) / sum(n) - 1), 1, 2 LIMIT 1)
SELECT sum(sum_nis) / sum(n) AS mean_nis, min(mean_nis) AS lowest, max(mean_nis) AS highest,
  CASE WHEN min(mean_nis) > 1.15 THEN 'over-confident' WHEN max(mean_nis) < 0.85 THEN 'under-confident'
       WHEN sum(sum_nis) / sum(n) BETWEEN 0.85 AND 1.15 THEN 'well-calibrated' ELSE 'mixed' END AS verdict FROM c JOIN b USING (q_noise, sigma_sp)""")
def best_filter_parameters(t: Tables):
    g = K.nis_grid(I.forecasts(t))
    return K.nis_verdict(g, K.best_filter(g))


@query("J11 D19", rnd="swing_before swing_after", sql="""
WITH lo AS (SELECT f.fold, w.settlement_period, quantile_cont(actual - q50, 0.5) AS b
  FROM (SELECT DISTINCT fold FROM c_wf) f JOIN c_wf w ON w.fold <> f.fold GROUP BY 1, 2),
a AS (SELECT settlement_period, avg(actual - q50) AS e0, avg(actual - q50 - coalesce(b, 0)) AS e1 FROM c_wf LEFT JOIN lo USING (fold, settlement_period) GROUP BY 1)
SELECT max(e0) - min(e0) AS swing_before, max(e1) - min(e1) AS swing_after FROM a""")
def slot_bias_removed(t: Tables):
    f = I.forecasts(t)
    adj = K.slot_bias_removed(f, M.leave_one_out_bias(f), ["fold", "settlement_period"])
    after = M.diurnal_swing(adj).select("swing").scalar()
    return M.diurnal_swing(f).select(F.col("swing").alias("swing_before"), after.alias("swing_after"))


@query("D54 D17", rnd="mae_static mae_alpha mae_kalman gain_pct", sql=_SIM + """
SELECT avg(abs(actual - pred_q50)) FILTER (WHERE corrector = 'static') AS mae_static, avg(abs(actual - pred_q50)) FILTER (WHERE corrector = 'alpha') AS mae_alpha,
  avg(abs(actual - pred_q50)) FILTER (WHERE corrector = 'kalman') AS mae_kalman,
  (avg(abs(actual - pred_q50)) FILTER (WHERE corrector = 'alpha') - avg(abs(actual - pred_q50)) FILTER (WHERE corrector = 'kalman')) * 100
    / avg(abs(actual - pred_q50)) FILTER (WHERE corrector = 'alpha') AS gain_pct,
  CASE WHEN avg(abs(actual - pred_q50)) FILTER (WHERE corrector = 'kalman') < avg(abs(actual - pred_q50)) FILTER (WHERE corrector = 'alpha')
    THEN 'ship' ELSE 'hold' END AS decision FROM sim""")
def corrector_gate(t: Tables):
    sim = K.replay(I.forecasts(t)).withColumn("e", F.abs(F.col("actual") - F.col("pred_q50")))
    g = sim.agg(*[F.avg(F.when(F.col("corrector") == c, F.col("e"))).alias(f"mae_{c}") for c in ("static", "alpha", "kalman")])
    return g.withColumns({"gain_pct": (F.col("mae_alpha") - F.col("mae_kalman")) * 100 / F.col("mae_alpha"),
                          "decision": F.when(F.col("mae_kalman") < F.col("mae_alpha"), "ship").otherwise("hold")})


# -- baselines and splits ---------------------------------------------------------
_BASE = f"""
WITH f AS (SELECT *, {at('ssp', 48)} AS naive, {at('ssp', 336)} AS seasonal, {roll('ssp', 48, 'mean')} AS roll24 FROM c_clean),
d AS (SELECT series, day_ix + 1 AS day_ix, avg(ssp) AS yday FROM c_clean GROUP BY 1, 2),
j AS (SELECT f.*, d.yday, max(f.day_ix) OVER () AS last_day FROM f LEFT JOIN d USING (series, day_ix)),
t AS (SELECT * FROM j WHERE day_ix > last_day - 7)
"""


def _baseline_sql(name: str) -> str:
    e = f"abs(ssp_raw - {name})"
    return (f"SELECT '{name}' AS baseline, count({name}) AS n, avg({e}) AS mae, sqrt(avg({e} * {e})) AS rmse, "
            f"avg(CASE WHEN {name} IS NOT NULL THEN CASE WHEN abs(ssp_raw) + abs({name}) = 0 THEN 0 ELSE {e} / ((abs(ssp_raw) + abs({name})) / 2) END END) * 100 AS smape FROM t")


@query("J1 J2 D6", rnd="mae rmse smape", sql=_BASE + " UNION ALL ".join(_baseline_sql(n) for n in ("naive", "seasonal", "roll24", "yday")))
def baseline_holdout(t: Tables):
    """Four baselines on the last seven days, side by side in one pass."""
    p = C.winsorise(I.panel(t))
    d = SR.with_frames(p, ["series"], "slot_ix", lambda f: {
        "naive": f.lag("ssp", 48), "seasonal": f.lag("ssp", 336), "roll24": f.rolling("ssp", 48, "mean")}, back=336)
    y = p.groupBy("series", (F.col("day_ix") + 1).alias("day_ix")).agg(F.avg("ssp").alias("yday"))
    d = d.join(y, ["series", "day_ix"], "left")
    test = d.where(F.col("day_ix") > p.agg(F.max("day_ix")).scalar() - 7)
    rows = [F.struct(F.lit(n).alias("baseline"), F.count(n).alias("n"), S.mae("ssp_raw", n).alias("mae"),
                     S.rmse("ssp_raw", n).alias("rmse"), S.smape("ssp_raw", n).alias("smape"))
            for n in ("naive", "seasonal", "roll24", "yday")]
    return test.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query("J2", sql="""
SELECT CASE WHEN day_ix <= last - 14 THEN 'train' WHEN day_ix <= last - 7 THEN 'val' ELSE 'test' END AS part, count(*) AS n,
  min(settlement_date) AS first_date, max(settlement_date) AS last_date FROM c_panel, (SELECT max(day_ix) AS last FROM c_panel) GROUP BY 1""")
def time_split(t: Tables):
    from slotwise.operators.learn import time_split as split
    return split(I.panel(t), val_days=7, test_days=7).groupBy("part").agg(
        F.count("*").alias("n"), F.min("settlement_date").alias("first_date"), F.max("settlement_date").alias("last_date"))


@query("J3", sql="""
WITH f AS (SELECT * FROM (VALUES ('w2', DATE '2024-01-08', DATE '2024-01-14'), ('w3', DATE '2024-01-15', DATE '2024-01-21'),
  ('w4', DATE '2024-01-22', DATE '2024-01-28'), ('w9', DATE '2024-03-01', DATE '2024-03-07')) AS v(fold, a, b)),
x AS (SELECT fold, CASE WHEN settlement_date < a - 3 THEN 'train' WHEN settlement_date < a THEN 'val' ELSE 'predict' END AS part
  FROM c_panel JOIN f ON settlement_date <= b WHERE a <= (SELECT max(settlement_date) FROM c_panel))
SELECT fold, part, count(*) AS n FROM x GROUP BY 1, 2""")
def walk_forward_folds(t: Tables):
    from slotwise.operators.learn import fold_parts
    folds = [("w2", "2024-01-08", "2024-01-14"), ("w3", "2024-01-15", "2024-01-21"), ("w4", "2024-01-22", "2024-01-28"),
             ("w9", "2024-03-01", "2024-03-07")]
    return fold_parts(I.panel(t), folds, val_days=3).groupBy("fold", "part").agg(F.count("*").alias("n"))


@query("E29", rnd="weight", sql="""
SELECT series, settlement_date, pow(0.5, (max(day_ix) OVER (PARTITION BY series) - day_ix) / 90.0) AS weight FROM c_daily_prio""")
def recency_weights(t: Tables):
    d = I.daily_orders(t, by_priority=True)
    last = d.groupBy("series").agg(F.max("day_ix").alias("_last"))
    return d.join(last, "series").select("series", "settlement_date",
                                         A.recency_weight(F.col("_last") - F.col("day_ix"), 90.0).alias("weight"))


@query("E27", rnd="mae_07 mae_05", sql="""
WITH RECURSIVE o AS (SELECT ssp, row_number() OVER (ORDER BY slot_ix) AS rn FROM c_panel),
s AS (SELECT CAST(1 AS BIGINT) AS rn, ssp AS e7, ssp AS e5 FROM o WHERE rn = 1
  UNION ALL SELECT o.rn, s.e7 * 0.3 + o.ssp * 0.7, s.e5 * 0.5 + o.ssp * 0.5 FROM s JOIN o ON o.rn = s.rn + 1)
SELECT count(*) AS n, avg(abs(o.ssp - s.e7)) AS mae_07, avg(abs(o.ssp - s.e5)) AS mae_05 FROM s JOIN o ON o.rn = s.rn + 1""")
def exponential_smoothing(t: Tables):
    p = I.panel(t)
    d = A.smoothed(A.smoothed(p, 0.7, out="e7"), 0.5, out="e5")
    return d.agg(F.count("e7").alias("n"), S.mae("ssp", "e7").alias("mae_07"), S.mae("ssp", "e5").alias("mae_05"))


@query("E27", rnd="mae", sql=f"""
WITH l AS (SELECT *, {at('ssp', 1)} AS a, {at('ssp', 2)} AS b FROM c_panel),
k AS (SELECT * FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
fit AS (SELECT d.day_ix, count(*) AS n, covar_pop(k.a, k.a) AS vaa, covar_pop(k.b, k.b) AS vbb, covar_pop(k.a, k.b) AS vab,
   covar_pop(k.a, k.ssp) AS vay, covar_pop(k.b, k.ssp) AS vby, avg(k.a) AS ma, avg(k.b) AS mb, avg(k.ssp) AS my
  FROM (SELECT DISTINCT day_ix FROM k) d JOIN k ON k.day_ix BETWEEN d.day_ix - 28 AND d.day_ix - 1 GROUP BY 1),
c AS (SELECT *, (vay * vbb - vby * vab) / (vaa * vbb - vab * vab) AS p1, (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) AS p2 FROM fit)
SELECT settlement_date, count(p1) AS n, avg(abs(ssp - (my - p1 * ma - p2 * mb + p1 * a + p2 * b))) AS mae FROM k LEFT JOIN c USING (day_ix) GROUP BY 1""")
def rolling_ar2(t: Tables):
    return A.rolling_ar2(I.panel(t)).groupBy("settlement_date").agg(F.count("ar2").alias("n"), S.mae("ssp", "ar2").alias("mae"))


# -- analyses ---------------------------------------------------------------------
@query("D41", rnd=" ".join(f"m{m}" for m in range(1, 13)), sql="SELECT year(settlement_date) AS year, " + ", ".join(
    f"avg(CASE WHEN month(settlement_date) = {m} THEN price END) AS m{m}" for m in range(1, 13)) + " FROM c_daily GROUP BY 1")
def year_month_means(t: Tables):
    return A.year_month_table(I.daily_orders(t), "price")


@query("D41", rnd="mean", sql="SELECT month(settlement_date) AS month, avg(price) AS mean, count(*) AS n FROM c_daily GROUP BY 1")
def month_means(t: Tables):
    return A.month_means(I.daily_orders(t), "price")


@query("D41", rnd="h_statistic", sql="""
WITH r AS (SELECT month(settlement_date) AS g, price, rank() OVER (ORDER BY price) AS r0, count(*) OVER (PARTITION BY price) AS c FROM c_daily_prio),
a AS (SELECT g, price, c, r0 + (c - 1) / 2.0 AS rk FROM r),
s AS (SELECT g, sum(rk) AS rs, count(*) AS k FROM a GROUP BY 1),
tt AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT price, count(*) AS c FROM a GROUP BY 1)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM a)
SELECT CAST(any_value(n.n) AS BIGINT) AS n, count(*) AS n_groups,
  (12.0 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(rs * rs / k) - 3 * (any_value(n.n) + 1))
   / (1 - any_value(ties) / (any_value(n.n) * any_value(n.n) * any_value(n.n) - any_value(n.n))) AS h_statistic FROM s, n, tt""")
def kruskal_wallis_months(t: Tables):
    d = I.daily_orders(t, by_priority=True).withColumn("month", F.month("settlement_date"))
    return A.kruskal_wallis(d, "month", "price")


_WAVES = [f"{f}(dayofyear(settlement_date) * {2 * math.pi / 365.25!r} * {k})" for k in (1, 2) for f in ("sin", "cos")]


@query("D42", rnd="amplitude peak_day r2", sql=f"""
WITH q AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM c_daily),
d AS (SELECT 1 AS one, least(greatest(price, lo), hi) AS y, {", ".join(f"{w} AS x{i}" for i, w in enumerate(_WAVES, 1))} FROM c_daily, q),
{least_squares("ls", "d", ["x1", "x2", "x3", "x4"], "y", ["one"])},
r AS (SELECT 1 - sum(power(y - {predicted(["x1", "x2", "x3", "x4"], "ls")}, 2)) / (var_pop(y) * count(*)) AS r2 FROM d JOIN ls USING (one))
SELECT 0 AS harmonic, b0 AS amplitude, NULL AS peak_day, r2 FROM ls, r
UNION ALL SELECT 1, sqrt(b1 * b1 + b2 * b2), fmod(atan2(b1, b2) + {2 * math.pi!r}, {2 * math.pi!r}) * 365.25 / {2 * math.pi!r}, NULL FROM ls
UNION ALL SELECT 2, sqrt(b3 * b3 + b4 * b4), fmod(atan2(b3, b4) + {2 * math.pi!r}, {2 * math.pi!r}) * 365.25 / {2 * math.pi!r} / 2, NULL FROM ls""")
def fourier_season(t: Tables):
    return A.fourier_fit(I.daily_orders(t), "price")


_LAGCOLS = ", ".join(f"{at('ssp', n)} AS h{n}" for n in range(1, 7))
_ACF = f"WITH l AS (SELECT *, {_LAGCOLS} FROM c_panel), a AS (SELECT " + ", ".join(
    f"corr(ssp, h{n}) AS r{n}" for n in range(1, 7)) + " FROM l)\n"


@query("D43", rnd="acf", sql=_ACF + " UNION ALL ".join(f"SELECT {n} AS lag, r{n} AS acf FROM a" for n in range(1, 7)))
def price_autocorrelation(t: Tables):
    return A.autocorrelation(I.panel(t), "ssp", range(1, 7))


def _pacf_sql(k: int) -> str:
    steps = ["p1 AS (SELECT *, r1 AS f1_1 FROM a)"]
    for j in range(2, k + 1):
        num = " - ".join([f"r{j}"] + [f"f{j-1}_{i} * r{j-i}" for i in range(1, j)])
        den = " - ".join(["1"] + [f"f{j-1}_{i} * r{i}" for i in range(1, j)])
        steps.append(f"q{j} AS (SELECT *, ({num}) / ({den}) AS f{j}_{j} FROM p{j-1})")
        rest = ", ".join(f"f{j-1}_{i} - f{j}_{j} * f{j-1}_{j-i} AS f{j}_{i}" for i in range(1, j))
        steps.append(f"p{j} AS (SELECT *, {rest} FROM q{j})")
    return ", " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {n} AS lag, f{n}_{n} AS pacf FROM p{k}" for n in range(1, k + 1))


@query("D43", rnd="pacf", sql=_ACF + _pacf_sql(6))
def price_partial_autocorrelation(t: Tables):
    return A.partial_autocorrelation(A.autocorrelation(I.panel(t), "ssp", range(1, 7)), 6)


@query("D43", rnd="corr", sql="WITH l AS (SELECT *, CASE WHEN price_derivation_code = 'N' THEN 'NP' ELSE 'EN' END AS regime, "
       + ", ".join(f"{at('net_imbalance_volume', n)} AS x{n}" for n in (1, 2, 3)) + " FROM c_panel) " + " UNION ALL ".join(
           f"SELECT regime, {n} AS h, corr(x{n}, ssp) AS corr FROM l GROUP BY 1" for n in (1, 2, 3)))
def volume_price_correlation(t: Tables):
    regime = F.when(F.col("price_derivation_code") == "N", "NP").otherwise("EN")
    return A.cross_correlation(I.panel(t).withColumn("regime", regime), "net_imbalance_volume", "ssp", (1, 2, 3), by=["regime"])


@query("D43", rnd="acf", sql=f"SELECT block, 1 AS lag, corr(ssp, h1) AS acf FROM (SELECT ssp, (settlement_period - 1) // 12 AS block, {at('ssp', 1)} AS h1 FROM c_panel) GROUP BY 1")
def autocorrelation_by_time_of_day(t: Tables):
    p = I.panel(t).withColumn("block", F.floor((F.col("settlement_period") - 1) / 12))
    return A.autocorrelation(p, "ssp", [1], by=["block"])


_PR2 = f"""
WITH l AS (SELECT *, {at('ssp', 1)} AS y0, {at('ssp', 1)} - {at('ssp', 2)} AS momentum, {at('net_imbalance_volume', 1)} AS niv1,
  {roll('ssp', 12, 'std')} AS vol12 FROM c_panel),
u AS (SELECT 'momentum' AS signal, ssp - y0 AS r, y0, momentum AS s FROM l UNION ALL SELECT 'niv1', ssp - y0, y0, niv1 FROM l
  UNION ALL SELECT 'vol12', ssp - y0, y0, vol12 FROM l),
c AS (SELECT signal, count(*) AS n, corr(r, s) AS a, corr(r, y0) AS b, corr(s, y0) AS c FROM u
  WHERE r IS NOT NULL AND y0 IS NOT NULL AND s IS NOT NULL GROUP BY 1)
SELECT signal, n, (a - b * c) * (a - b * c) / ((1 - b * b) * (1 - c * c)) AS partial_r2 FROM c"""


@query("D44", rnd="partial_r2", sql=_PR2)
def partial_r2_signals(t: Tables):
    d = SR.with_frames(I.panel(t), ["series"], "slot_ix", lambda f: {
        "y0": f.lag("ssp", 1), "momentum": f.lag("ssp", 1) - f.lag("ssp", 2), "niv1": f.lag("net_imbalance_volume", 1),
        "vol12": f.rolling("ssp", 12, "std")}, back=12)
    d = d.withColumn("r", F.col("ssp") - F.col("y0"))
    return A.partial_r2(d, "r", "y0", ["momentum", "niv1", "vol12"])


_HOR = list(range(1, 49))


@query("D46 C25", rnd="mae rmse", sql="""
SELECT h, count(*) AS n, avg(abs(a.ssp - b.ssp)) AS mae, sqrt(avg((a.ssp - b.ssp) * (a.ssp - b.ssp))) AS rmse
FROM c_panel a CROSS JOIN (SELECT CAST(unnest(range(1, 49)) AS INTEGER) AS h) g JOIN c_panel b ON b.series = a.series AND b.slot_ix = a.slot_ix - h GROUP BY 1""")
def persistence_decay(t: Tables):
    return A.persistence_decay(I.panel(t), _HOR)


@query("D46", rnd="mae rmse", sql="""
SELECT series, h, count(*) AS n, avg(abs(a.ssp - b.ssp)) AS mae, sqrt(avg((a.ssp - b.ssp) * (a.ssp - b.ssp))) AS rmse
FROM c_panel_type a CROSS JOIN (VALUES (1), (2), (3), (6), (48)) AS g(h) JOIN c_panel_type b USING (series) WHERE b.slot_ix = a.slot_ix - h GROUP BY 1, 2""")
def persistence_decay_by_series(t: Tables):
    return A.persistence_decay(I.panel(t, by_type=True), (1, 2, 3, 6, 48), by=["series"])


_BH = list(range(1, 9))


def _blend_input(t: Tables):
    h = J.horizon_columns(I.panel(t), _BH).select("series", "slot_ix", *[f"h{n}" for n in _BH])
    return I.forecasts(t).join(h, ["series", "slot_ix"])


_BLEND = """
WITH l AS (SELECT g.h, w.actual, w.q50, p.ssp AS pers, (w.settlement_period - 1) // 12 AS block FROM c_wf w
  CROSS JOIN (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS h) g JOIN c_panel p ON p.slot_ix = w.slot_ix - g.h)
"""


@query("D47", rnd="alpha mae mae_persistence mae_forecast gain_pct", sql=_BLEND + """
, m AS (SELECT h, i / 20.0 AS alpha, count(*) AS n, round(avg(abs(actual - (i / 20.0) * q50 - (1 - i / 20.0) * pers)), 9) AS mae
  FROM l CROSS JOIN (SELECT unnest(range(0, 21)) AS i) g2 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY mae, alpha) AS rn, max(CASE WHEN alpha = 0 THEN mae END) OVER (PARTITION BY h) AS mae_persistence,
   max(CASE WHEN alpha = 1 THEN mae END) OVER (PARTITION BY h) AS mae_forecast FROM m)
SELECT h, n, alpha, mae, mae_persistence, mae_forecast, (1 - mae / least(mae_persistence, mae_forecast)) * 100 AS gain_pct,
  CAST((1 - mae / least(mae_persistence, mae_forecast)) * 100 >= 5 AS INTEGER) AS ship FROM b WHERE rn = 1""")
def blend_weights(t: Tables):
    return A.blend_weights(_blend_input(t), _BH).withColumn("ship", F.col("ship").cast("int"))


@query("D48", rnd="best_ratio", sql=_BLEND + """
, g AS (SELECT block, h, avg(abs(actual - q50)) AS f, avg(abs(actual - pers)) AS p FROM l GROUP BY 1, 2)
SELECT block, min(CASE WHEN f < p THEN h END) AS crossover_h, min(f / p) AS best_ratio FROM g GROUP BY 1""")
def crossover_by_block(t: Tables):
    d = _blend_input(t).withColumn("block", F.floor((F.col("settlement_period") - 1) / 12))
    return A.crossover(d, _BH, ["block"])


@query("E26", rnd="corr", sql=f"""
WITH l AS (SELECT {roll('ssp', 6, 'std')} AS v6, {roll('ssp', 12, 'std')} AS v12, abs(ssp - {at('ssp', 1)}) AS step FROM c_panel)
SELECT 6 AS width, corr(v6, step) AS corr FROM l UNION ALL SELECT 12, corr(v12, step) FROM l""")
def volatility_signal(t: Tables):
    return A.volatility_signal(I.panel(t))


_SPF = ["ssp_lag_48", "ssp_lag_336", "niv_lag_48", "wind_lag_48"]
_SPSQL = f"""
WITH l AS (SELECT ssp AS y, {at('ssp', 48)} AS ssp_lag_48, {at('ssp', 336)} AS ssp_lag_336, {at('net_imbalance_volume', 48)} AS niv_lag_48,
  {at('wind_pct', 48)} AS wind_lag_48 FROM c_panel),
u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, y, {c} AS x FROM l WHERE {c} IS NOT NULL" for c in _SPF)}),
r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM u)
SELECT feature, count(*) AS n, abs(corr(rx, ry)) AS abs_rho FROM r GROUP BY 1"""


def _ranked_features(t: Tables):
    d = SR.with_frames(I.panel(t), ["series"], "slot_ix", lambda f: {
        "ssp_lag_48": f.lag("ssp", 48), "ssp_lag_336": f.lag("ssp", 336), "niv_lag_48": f.lag("net_imbalance_volume", 48),
        "wind_lag_48": f.lag("wind_pct", 48)}, back=336)
    return A.spearman(d, "ssp", _SPF)


@query("D30 J21", rnd="abs_rho", sql=_SPSQL)
def spearman_importance(t: Tables):
    return _ranked_features(t)


@query("F2", rnd="abs_rho", sql=_SPSQL + " ORDER BY round(abs_rho, 6) DESC, feature LIMIT 2")
def top_features(t: Tables):
    return _ranked_features(t).orderBy(F.round("abs_rho", 6).desc(), "feature").limit(2)


@query("H7 J16", rnd="median scale", sql="""
WITH m AS (SELECT series, quantile_cont(ssp, 0.5) AS median FROM c_panel_type GROUP BY 1)
SELECT series, median, CASE WHEN mad = 0 THEN 1 ELSE 1.4826 * mad END AS scale FROM (
  SELECT p.series, any_value(median) AS median, quantile_cont(abs(ssp - median), 0.5) AS mad FROM c_panel_type p JOIN m USING (series) GROUP BY 1)""")
def robust_scale(t: Tables):
    from slotwise.operators.learn import robust_scale as fit
    return fit(I.panel(t, by_type=True), ["series"], "ssp")


@query("D49 D59", rnd="morning midday afternoon evening", sql="SELECT fold, " + ", ".join(
    f"avg(CASE WHEN settlement_period BETWEEN {a} AND {b} THEN CASE WHEN actual > 150 THEN 100.0 ELSE 0.0 END END) AS {n}"
    for n, a, b in (("morning", 1, 16), ("midday", 17, 32), ("afternoon", 33, 40), ("evening", 41, 48))) + " FROM c_wf GROUP BY 1")
def spike_rate_by_block(t: Tables):
    sp = F.col("settlement_period")
    block = F.when(sp <= 16, "morning").when(sp <= 32, "midday").when(sp <= 40, "afternoon").otherwise("evening")
    f = I.forecasts(t).select("fold", block.alias("block"), (F.when(F.col("actual") > 150, 100.0).otherwise(0.0)).alias("s"))
    return f.groupBy("fold").pivot("block", ["morning", "midday", "afternoon", "evening"]).agg(F.avg("s"))


@query("D59", rnd="spike_rate mean_spike mean_q50 mean_residual under_q90 width_spike_days width_other_days mean_rows_per_day max_actual", sql="""
WITH w AS (SELECT *, max(CAST(actual > 150 AS INTEGER)) OVER (PARTITION BY settlement_date) AS sd FROM c_wf),
d AS (SELECT settlement_date, count(*) FILTER (WHERE actual > 150) AS k FROM c_wf GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (WHERE actual > 150) AS n_spikes, count(*) FILTER (WHERE actual > 150) * 1.0 / count(*) AS spike_rate,
  (SELECT count(*) FROM d WHERE k > 0) AS spike_days, (SELECT avg(k) FROM d WHERE k > 0) AS mean_rows_per_day, (SELECT max(k) FROM d) AS max_rows_per_day,
  avg(actual) FILTER (WHERE actual > 150) AS mean_spike, max(actual) AS max_actual, avg(q50) FILTER (WHERE actual > 150) AS mean_q50,
  avg(actual - q50) FILTER (WHERE actual > 150) AS mean_residual, avg(CASE WHEN actual <= q90 THEN 1.0 ELSE 0.0 END) FILTER (WHERE actual > 150) AS under_q90,
  avg(q90 - q10) FILTER (WHERE sd = 1) AS width_spike_days, avg(q90 - q10) FILTER (WHERE sd = 0) AS width_other_days FROM w""")
def spike_profile(t: Tables):
    f = I.forecasts(t)
    s = F.col("actual") > 150
    day = f.groupBy("settlement_date").agg(
        F.count("*").alias("n"), F.count_if(s).alias("k"), F.sum(F.when(s, F.col("actual"))).alias("a"), F.max("actual").alias("m"),
        F.sum(F.when(s, F.col("q50"))).alias("q"), F.count_if(s & (F.col("actual") <= F.col("q90"))).alias("u"),
        F.sum(F.col("q90") - F.col("q10")).alias("w"))
    hit = F.col("k") > 0
    return day.agg(
        F.sum("n").alias("n"), F.sum("k").alias("n_spikes"), ratio(F.sum("k").cast("double"), F.sum("n")).alias("spike_rate"),
        F.count_if(hit).alias("spike_days"), F.avg(F.when(hit, F.col("k"))).alias("mean_rows_per_day"), F.max("k").alias("max_rows_per_day"),
        ratio(F.sum("a"), F.sum("k")).alias("mean_spike"), F.max("m").alias("max_actual"), ratio(F.sum("q"), F.sum("k")).alias("mean_q50"),
        ratio(F.sum("a") - F.sum("q"), F.sum("k")).alias("mean_residual"), ratio(F.sum("u").cast("double"), F.sum("k")).alias("under_q90"),
        ratio(F.sum(F.when(hit, F.col("w"))), F.sum(F.when(hit, F.col("n")))).alias("width_spike_days"),
        ratio(F.sum(F.when(~hit, F.col("w"))), F.sum(F.when(~hit, F.col("n")))).alias("width_other_days"))


# -- dashboards -------------------------------------------------------------------
@query("D31 F4", rnd="mean_price max_price min_price last_price", sql="""
SELECT series, count(*) AS n, avg(ssp) AS mean_price, max(ssp) AS max_price, min(ssp) AS min_price, max_by(ssp, slot_ix) AS last_price,
  min(settlement_period) FILTER (WHERE ssp = mx) AS max_period, max(settlement_date) AS last_date
FROM (SELECT *, max(ssp) OVER (PARTITION BY series) AS mx FROM c_panel_type) GROUP BY 1""")
def headline_prices(t: Tables):
    return I.panel(t, by_type=True).groupBy("series").agg(
        F.count("*").alias("n"), F.avg("ssp").alias("mean_price"), F.max("ssp").alias("max_price"), F.min("ssp").alias("min_price"),
        F.max_by("ssp", "slot_ix").alias("last_price"),
        F.max_by("settlement_period", F.struct("ssp", -F.col("settlement_period"))).alias("max_period"),
        F.max("settlement_date").alias("last_date"))


@query("D32", rnd="mean_price mean_niv", sql="SELECT settlement_date, avg(ssp) AS mean_price, avg(net_imbalance_volume) AS mean_niv FROM c_panel GROUP BY 1")
def daily_means(t: Tables):
    return I.panel(t).groupBy("settlement_date").agg(F.avg("ssp").alias("mean_price"), F.avg("net_imbalance_volume").alias("mean_niv"))


_DAYS = [f"2024-01-{d:02d}" for d in range(1, 31)]


@query("D33 E16", sql="""
WITH g AS (SELECT CAST(d AS DATE) AS settlement_date, CAST(unnest(range(1, 49)) AS INTEGER) AS settlement_period
  FROM (SELECT unnest(generate_series(min(settlement_date), max(settlement_date), INTERVAL 1 DAY)) AS d FROM c_panel)),
j AS (SELECT g.*, p.ssp FROM g LEFT JOIN c_panel p USING (settlement_date, settlement_period)),
f AS (SELECT settlement_date, settlement_period, coalesce(last_value(ssp IGNORE NULLS) OVER (PARTITION BY settlement_period ORDER BY settlement_date
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(ssp IGNORE NULLS) OVER (PARTITION BY settlement_period ORDER BY settlement_date
   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM j)
SELECT settlement_period, """ + ", ".join(f"round(max(CASE WHEN settlement_date = DATE '{d}' THEN v END) + 1.3e-8, 6) + 0 AS \"{d}\"" for d in _DAYS)
    + " FROM f GROUP BY 1")
def price_heat_map(t: Tables):
    """Slots x the last 90 days, holes filled along each slot; the date list is one aggregate row."""
    p = I.panel(t)
    span = p.agg(F.min("settlement_date").alias("a"), F.max("settlement_date").alias("b")).first()
    days = [r["d"] for r in t.spark.range(1).select(F.explode(F.sequence(
        F.greatest(F.lit(span["a"]), F.date_sub(F.lit(span["b"]), 89)), F.lit(span["b"]))).alias("d")).collect()]
    g = SR.slot_grid(p, ["series"]).where(F.col("settlement_date") >= F.lit(days[0])).join(
        p.select("series", *KEY, "ssp"), ["series", *KEY], "left")
    f = SR.frames_by(["settlement_period"], "settlement_date").spec
    v = F.coalesce(F.last("ssp", ignorenulls=True).over(f.rowsBetween(SR.W.unboundedPreceding, 0)),
                   F.first("ssp", ignorenulls=True).over(f.rowsBetween(0, SR.W.unboundedFollowing)))
    t2 = g.withColumn("v", F.round(v + 1.3e-8, 6)).groupBy("settlement_period").pivot("settlement_date", days).agg(F.max("v"))
    return t2


@query("D34", rnd="mean_price pct_p", sql="""
SELECT settlement_period, lpad(CAST((settlement_period - 1) // 2 AS VARCHAR), 2, '0') || CASE WHEN settlement_period % 2 = 1 THEN ':00' ELSE ':30' END AS slot_label,
  avg(ssp) AS mean_price, avg(CASE WHEN price_derivation_code = 'P' THEN 100.0 ELSE 0.0 END) AS pct_p FROM c_panel GROUP BY 1, 2""")
def slot_profile(t: Tables):
    code = F.coalesce(F.when(F.col("price_derivation_code") == "P", 100.0).otherwise(0.0), F.lit(0.0))
    return I.panel(t).groupBy("settlement_period", clock_label().alias("slot_label")).agg(
        F.avg("ssp").alias("mean_price"), F.avg(code).alias("pct_p"))


@query("D35", rnd="mean_price", sql="""
WITH x AS (SELECT *, weekofyear(settlement_date) AS week, isoyear(settlement_date) AS iso FROM c_daily
  WHERE settlement_date > (SELECT max(settlement_date) FROM c_daily) - INTERVAL 3 YEAR)
SELECT iso AS year, week, avg(price) AS mean_price, count(*) AS n FROM x WHERE week <= 52 GROUP BY 1, 2""")
def week_profile(t: Tables):
    d = I.daily_orders(t)
    d = d.where(F.col("settlement_date") > F.add_months(d.agg(F.max("settlement_date")).scalar(), -36))
    return d.groupBy(F.extract(F.lit("YEAROFWEEK"), "settlement_date").alias("year"), F.weekofyear("settlement_date").alias("week")).agg(
        F.avg("price").alias("mean_price"), F.count("*").alias("n")).where("week <= 52")


@query("D36", sql="SELECT settlement_date, coalesce(price_derivation_code, 'none') AS code, count(*) AS n FROM c_panel GROUP BY 1, 2")
def daily_code_counts(t: Tables):
    return I.panel(t).groupBy("settlement_date", F.coalesce("price_derivation_code", F.lit("none")).alias("code")).agg(F.count("*").alias("n"))


@query("D37", rnd="mean median std min max", sql="""
SELECT coalesce(price_derivation_code, 'none') AS code, count(*) AS n, avg(ssp) AS mean, quantile_cont(ssp, 0.5) AS median,
  stddev_samp(ssp) AS std, min(ssp) AS min, max(ssp) AS max FROM c_panel GROUP BY 1""")
def code_summary(t: Tables):
    p = I.panel(t).withColumn("code", F.coalesce("price_derivation_code", F.lit("none")))
    g = p.groupBy("code").agg(F.count("*").alias("n"), F.avg("ssp").alias("mean"), F.stddev_samp("ssp").alias("std"),
                              F.min("ssp").alias("min"), F.max("ssp").alias("max"))
    return g.join(exact_quantiles(p, ["code"], "ssp", {"median": 0.5}), "code")


@query("D39", rnd="left_edge", sql="""
WITH e AS (SELECT CASE WHEN actual - q50 < -120 THEN 0 WHEN actual - q50 >= 120 THEN 25 ELSE CAST(floor((actual - q50 + 120) / 10) AS INTEGER) + 1 END AS bin FROM c_wf)
SELECT bin, count(*) AS n, (bin - 1) * 10.0 - 120 AS left_edge FROM e GROUP BY 1""")
def error_histogram(t: Tables):
    return M.histogram(I.forecasts(t), F.col("actual") - F.col("q50"), -120.0, 120.0, 24)


# -- monitoring -------------------------------------------------------------------
_YEARS = """
WITH d AS (SELECT settlement_date, year(settlement_date) AS year, month(settlement_date) IN (9, 10, 11) AS autumn, max(CAST(price > 150 AS INTEGER)) AS spike
  FROM c_daily GROUP BY 1, 2, 3),
a AS (SELECT year, count(*) AS n_days, avg(spike) AS annual_rate FROM d GROUP BY 1),
b AS (SELECT year, count(*) AS n_autumn, avg(spike) AS autumn_rate FROM d WHERE autumn GROUP BY 1),
y AS (SELECT coalesce(a.year, b.year) AS year, n_days, coalesce(annual_rate, 0) AS annual_rate, coalesce(n_autumn, 0) AS n_autumn, coalesce(autumn_rate, 0) AS autumn_rate
  FROM a FULL OUTER JOIN b ON a.year = b.year),
s AS (SELECT *, CASE WHEN n_autumn = 0 THEN 'pending' WHEN year IN (1995, 1996) THEN 'crisis' WHEN year = 1997 THEN 'transition'
  WHEN annual_rate < 0.1 THEN 'quiet' ELSE 'usable' END AS status FROM y)
"""


def _years(t: Tables):
    return MO.spike_autumns(I.daily_orders(t), crisis=(1995, 1996), transition=(1997,))


@query("D25 C23 H12", rnd="annual_rate autumn_rate", sql=_YEARS + "SELECT * FROM s")
def spike_autumns(t: Tables):
    return _years(t)


@query("D25 D54", sql=_YEARS + "SELECT count(*) FILTER (WHERE status = 'usable') AS n_usable, CAST(count(*) FILTER (WHERE status = 'usable') >= 2 AS INTEGER) AS green FROM s")
def autumn_gate(t: Tables):
    return MO.autumn_gate(_years(t)).withColumn("green", F.col("green").cast("int"))


@query("D26", sql="""
SELECT min(settlement_date) AS first_date, max(settlement_date) AS last_date, count(DISTINCT date_trunc('month', settlement_date)) AS n_months,
  CAST(count(DISTINCT date_trunc('month', settlement_date)) >= 6 AS INTEGER) AS green FROM c_daily""")
def archive_readiness(t: Tables):
    return MO.archive_readiness(I.daily_orders(t), "settlement_date", 6).withColumn("green", F.col("green").cast("int"))


_PS = """
WITH s AS (SELECT series, settlement_date, CAST(price > 150 AS INTEGER) AS y, round(avg(CAST(price > 150 AS INTEGER)) OVER (PARTITION BY series ORDER BY day_ix
   RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING) + 1.3e-8, 6) AS p FROM c_daily_prio), k AS (SELECT * FROM s WHERE p IS NOT NULL)
"""


def _spike_scores(t: Tables):
    d = I.daily_orders(t, by_priority=True).withColumn("y", (F.col("price") > 150).cast("int"))
    f = SR.frames_by(["series"], "day_ix")
    return d.withColumn("p", I.r6(f.rolling("y", 28, "mean"))).where("p IS NOT NULL")


@query("D27", rnd="tau precision recall f1", sql=_PS + """
, g AS (SELECT CAST(tau AS DOUBLE) AS tau, count(*) FILTER (WHERE p > tau) AS n_flagged, count(*) FILTER (WHERE p > tau AND y = 1) AS hit, sum(y) AS pos
  FROM k CROSS JOIN (VALUES (0.05), (0.1), (0.15), (0.2), (0.3)) AS v(tau) GROUP BY 1),
r AS (SELECT tau, n_flagged, hit * 1.0 / nullif(n_flagged, 0) AS precision, hit * 1.0 / nullif(pos, 0) AS recall FROM g)
SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM r""")
def threshold_sweep(t: Tables):
    return M.threshold_sweep(_spike_scores(t), "p", "y", [0.05, 0.1, 0.15, 0.2, 0.3])


@query("D28", rnd="brier base_rate base_brier skill", sql=_PS + """
SELECT count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(y) AS base_rate, avg(y) * (1 - avg(y)) AS base_brier,
  1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))) AS skill FROM k""")
def brier_scores(t: Tables):
    return M.brier(_spike_scores(t), "p", "y")


@query("D28", rnd="average_precision", sql=_PS + """
, v AS (SELECT p, sum(y) AS pos, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS nn FROM v)
SELECT sum(CAST(pos AS DOUBLE) / (SELECT sum(y) FROM k) * CAST(tp AS DOUBLE) / CAST(nn AS DOUBLE)) AS average_precision,
  CAST((SELECT sum(y) FROM k) AS BIGINT) AS n_pos, (SELECT count(*) FROM k) AS n FROM c""")
def average_precision(t: Tables):
    return M.average_precision(_spike_scores(t), "p", "y")


_PAIR = """
WITH pr AS (SELECT w.settlement_date, w.settlement_period, w.actual, s.q10 AS s10, s.q50 AS s50, s.q90 AS s90,
  CASE WHEN day(w.settlement_date) % 5 <> 0 THEN w.q10 END AS p10, CASE WHEN day(w.settlement_date) % 5 <> 0 THEN w.q50 END AS p50,
  CASE WHEN day(w.settlement_date) % 5 <> 0 THEN w.q90 END AS p90 FROM c_wf w JOIN c_wf3 s USING (settlement_date, settlement_period)),
g AS (SELECT settlement_date, count(*) AS n_sps, avg(abs(actual - s50)) AS shadow_mae, avg(abs(actual - p50)) AS prod_mae,
  avg(CASE WHEN actual >= s10 AND actual <= s90 THEN 1.0 ELSE 0.0 END) AS shadow_cov,
  avg(CASE WHEN p50 IS NOT NULL THEN CASE WHEN actual >= p10 AND actual <= p90 THEN 1.0 ELSE 0.0 END END) AS prod_cov,
  avg(s90 - s10) AS shadow_width, avg(p90 - p10) AS prod_width, CAST(count(p50) = 0 AS INTEGER) AS shadow_only FROM pr GROUP BY 1)
"""


@query("D50 C12", rnd="shadow_mae prod_mae mae_delta shadow_cov prod_cov cov_delta_pp shadow_width prod_width", sql=_PAIR + """
SELECT *, shadow_mae - prod_mae AS mae_delta, (shadow_cov - prod_cov) * 100 AS cov_delta_pp,
  CAST(coalesce(abs(shadow_mae - prod_mae) <= 0.5, FALSE) AS INTEGER) AS pass_mae,
  CAST(coalesce(abs((shadow_cov - prod_cov) * 100) <= 3, FALSE) AS INTEGER) AS pass_cov FROM g""")
def shadow_log(t: Tables):
    m = model_table(t).where("b50 IS NOT NULL")
    prod = F.dayofmonth("settlement_date") % 5 != 0
    pair = m.select(*KEY, "actual", F.col("b10").alias("s10"), F.col("b50").alias("s50"), F.col("b90").alias("s90"),
                    *[F.when(prod, F.col(f"a{q}")).alias(f"p{q}") for q in (10, 50, 90)])
    out = MO.shadow_log(pair)
    return out.withColumns({c: F.col(c).cast("int") for c in ("shadow_only", "pass_mae", "pass_cov")})


def _scen_sql() -> str:
    groups = {"all": "TRUE", "spike": "actual > 150", "non_spike": "actual <= 150",
              "code_p": "coalesce(price_derivation_code = 'P', FALSE)", "normal": "actual <= 150 AND NOT coalesce(price_derivation_code = 'P', FALSE)"}
    parts = []
    for g, cond in groups.items():
        for v in ("a", "b"):
            parts.append(f"SELECT '{g}' AS \"group\", '{'full' if v == 'a' else 'early'}' AS variant, count(*) AS n, avg(abs(actual - {v}50)) AS mae, "
                         f"avg(CASE WHEN actual >= {v}10 AND actual <= {v}90 THEN 1.0 ELSE 0.0 END) AS coverage, avg({v}90 - {v}10) AS mean_width, "
                         f"{ISC.format(lo=v + '10', hi=v + '90')} AS is_score FROM x WHERE {cond} HAVING count(*) > 0")
    return _MODELS.replace("w.actual,", "w.actual, w.price_derivation_code,") + ", x AS (SELECT * FROM m WHERE b50 IS NOT NULL), sc AS (" + " UNION ALL ".join(parts) + """),
tb AS (SELECT s.*, s.mae - f.mae AS mae_penalty, s.coverage - f.coverage AS coverage_delta, s.is_score - f.is_score AS is_delta
  FROM sc s JOIN sc f ON f."group" = s."group" AND f.variant = 'full')
"""


def _scenarios(t: Tables):
    m = model_table(t).where("b50 IS NOT NULL").join(I.panel(t).select("slot_ix", "price_derivation_code"), "slot_ix")
    spike = F.col("actual") > 150
    code_p = F.coalesce(F.col("price_derivation_code") == "P", F.lit(False))
    return MO.scenario_table(m, {"full": ("a10", "a50", "a90"), "early": ("b10", "b50", "b90")}, "full", {
        "all": F.lit(True), "spike": spike, "non_spike": ~spike, "code_p": code_p, "normal": ~spike & ~code_p})


@query("D51 B21", rnd="mae coverage mean_width is_score mae_penalty coverage_delta is_delta", sql=_scen_sql() + "SELECT * FROM tb")
def scenario_table(t: Tables):
    return _scenarios(t)


@query("D51 D54", rnd="mae_penalty coverage_delta", sql=_scen_sql() + """
SELECT variant, mae_penalty, coverage_delta, CASE WHEN mae_penalty <= 1.5 AND abs(coverage_delta) <= 0.05 THEN 'ship' ELSE 'hold' END AS decision
FROM tb WHERE "group" = 'all' AND variant = 'early'""")
def early_run_gate(t: Tables):
    return MO.ship_gate(_scenarios(t), "all", "early")


@query("D52 C27", rnd="mae_7 mae_30 coverage_7 coverage_30 mae_delta", sql=_MODELS.replace("w.actual,", "w.actual, w.fold,") + """
SELECT coalesce(fold, 'total') AS fold, count(*) AS n, avg(abs(actual - b50)) AS mae_7, avg(abs(actual - a50)) AS mae_30,
  avg(CASE WHEN actual >= b10 AND actual <= b90 THEN 1.0 ELSE 0.0 END) AS coverage_7, avg(CASE WHEN actual >= a10 AND actual <= a90 THEN 1.0 ELSE 0.0 END) AS coverage_30,
  avg(abs(actual - b50)) - avg(abs(actual - a50)) AS mae_delta,
  CAST(avg(abs(actual - b50)) - avg(abs(actual - a50)) <= 2.5 AS INTEGER) AS pass FROM m WHERE b50 IS NOT NULL GROUP BY ROLLUP (fold)""")
def staleness_table(t: Tables):
    m = model_table(t).where("b50 IS NOT NULL")
    g = m.rollup("fold").agg(
        F.count("*").alias("n"), S.mae("actual", "b50").alias("mae_7"), S.mae("actual", "a50").alias("mae_30"),
        F.avg(S.covered("actual", "b10", "b90")).alias("coverage_7"), F.avg(S.covered("actual", "a10", "a90")).alias("coverage_30"))
    d = F.col("mae_7") - F.col("mae_30")
    return g.withColumns({"fold": F.coalesce("fold", F.lit("total")), "mae_delta": d, "pass": (d <= 2.5).cast("int")})


@query("D53", rnd="mae level_mae coverage width", sql=f"""
WITH d AS (SELECT settlement_date, abs(avg(q50) - avg(actual)) AS le FROM c_wf GROUP BY 1)
SELECT CASE WHEN w.settlement_date < DATE '2024-01-16' THEN 'before' ELSE 'after' END AS period, count(*) AS n, {MAE} AS mae,
  (SELECT avg(le) FROM d WHERE (d.settlement_date < DATE '2024-01-16') = (max(w.settlement_date) < DATE '2024-01-16')) AS level_mae,
  {COV.format(**RAW)} * 100 AS coverage, avg(q90 - q10) AS width FROM c_wf w GROUP BY 1""")
def error_autopsy(t: Tables):
    f = I.forecasts(t).withColumn("period", F.when(F.col("settlement_date") < F.lit("2024-01-16").cast("date"), "before").otherwise("after"))
    level = M.decomposition(f, ["period"], ["settlement_date"]).select("period", "level_mae")
    g = f.groupBy("period").agg(F.count("*").alias("n"), S.mae("actual", "q50").alias("mae"),
                                S.coverage_pct("actual", "q10", "q90").alias("coverage"), F.avg(F.col("q90") - F.col("q10")).alias("width"))
    return g.join(level, "period")


@query("D56", rnd="spread", sql="""
SELECT series, settlement_date, stddev_pop(b.q50 - a.q50) AS spread, count(*) AS n, CAST(stddev_pop(b.q50 - a.q50) > 0.5 AS INTEGER) AS diverged
FROM c_wf a JOIN c_wf3 b USING (series, settlement_date, settlement_period) GROUP BY 1, 2""")
def published_against_live(t: Tables):
    return MO.divergence(I.forecasts(t), I.short_forecasts(t), ["series", "settlement_date"]).withColumn("diverged", F.col("diverged").cast("int"))


@query("D57 F4", rnd="min_q50 mean_q50 max_q50 peak_q90", sql="""
SELECT settlement_date, min(q50) AS min_q50, avg(q50) AS mean_q50, max(q50) AS max_q50, max(q90) AS peak_q90, min(settlement_period) FILTER (WHERE q90 = mq) AS peak_period
FROM (SELECT *, max(q90) OVER (PARTITION BY settlement_date) AS mq FROM c_wf) GROUP BY 1""")
def published_summary(t: Tables):
    return I.forecasts(t).groupBy("settlement_date").agg(
        F.min("q50").alias("min_q50"), F.avg("q50").alias("mean_q50"), F.max("q50").alias("max_q50"), F.max("q90").alias("peak_q90"),
        F.max_by("settlement_period", F.struct("q90", -F.col("settlement_period"))).alias("peak_period"))


@query("D58", rnd="mae actual_level predicted_level", sql=f"""
SELECT fold, settlement_date, count(*) AS n, {MAE} AS mae, avg(actual) AS actual_level, avg(q50) AS predicted_level FROM c_wf GROUP BY 1, 2""")
def fold_day_levels(t: Tables):
    return I.forecasts(t).groupBy("fold", "settlement_date").agg(
        F.count("*").alias("n"), S.mae("actual", "q50").alias("mae"), F.avg("actual").alias("actual_level"), F.avg("q50").alias("predicted_level"))


@query("D60 I7", rnd="pct_big median_move p95_move", sql="""
WITH r AS (SELECT coalesce(p.price_derivation_code, 'none') AS price_derivation_code, abs(p.ssp - v.ssp) AS move
  FROM c_panel_type v JOIN c_panel p USING (settlement_date, settlement_period) WHERE v.series = 'view')
SELECT price_derivation_code, count(*) AS n, count(*) FILTER (WHERE move > 2) * 100.0 / count(*) AS pct_big, quantile_cont(move, 0.5) AS median_move,
  quantile_cont(move, 0.95) AS p95_move FROM r GROUP BY 1""")
def revision_size(t: Tables):
    """The partial (view-only) price as first version, the full price as final one, by final code."""
    p = I.panel(t)
    first = I.panel(t, by_type=True).where("series = 'view'").select(*KEY, "ssp")
    return MO.revision_size(p.select(*KEY, "ssp", "price_derivation_code"), first, KEY, "ssp", "price_derivation_code")


@query("D63", rnd="mae_delta spike_share", sql=_MODELS + """
SELECT settlement_period, avg(abs(actual - b50) - abs(actual - a50)) AS mae_delta, avg(CASE WHEN actual > 150 THEN 1.0 ELSE 0.0 END) AS spike_share
FROM m WHERE b50 IS NOT NULL GROUP BY 1""")
def slot_error_delta(t: Tables):
    m = model_table(t).where("b50 IS NOT NULL")
    return m.groupBy("settlement_period").agg(
        F.avg(F.abs(F.col("actual") - F.col("b50")) - F.abs(F.col("actual") - F.col("a50"))).alias("mae_delta"),
        F.avg((F.col("actual") > 150).cast("double")).alias("spike_share"))


@query("D64 D14 H12", rnd="coverage win_mean median", sql=f"""
WITH x AS (SELECT *, actual - q50 AS e FROM c_wf WHERE settlement_date > (SELECT max(settlement_date) FROM c_wf) - 14),
q AS (SELECT quantile_cont(e, 0.05) AS a, quantile_cont(e, 0.95) AS b, quantile_cont(e, 0.5) AS median FROM x)
SELECT count(*) AS n, {COV.format(**RAW)} * 100 AS coverage, avg(least(greatest(e, a), b)) AS win_mean, any_value(median) AS median,
  CASE WHEN count(*) < 200 THEN 'low-n' WHEN {COV.format(**RAW)} < 0.72 THEN 'red' WHEN {COV.format(**RAW)} > 0.92 THEN 'amber' ELSE 'green' END AS coverage_status,
  CASE WHEN count(*) < 200 THEN 'low-n' WHEN abs(avg(least(greatest(e, a), b))) >= 20 THEN 'red' WHEN abs(avg(least(greatest(e, a), b))) >= 10 THEN 'amber' ELSE 'green' END AS residual_status
FROM x, q""")
def recent_weeks_status(t: Tables):
    f = I.forecasts(t)
    x = f.where(F.col("settlement_date") > F.date_sub(f.agg(F.max("settlement_date")).scalar(), 14))
    w = M.winsorised_residual(x, [])
    cov = x.agg(F.avg(S.covered("actual", "q10", "q90"))).scalar()
    return w.withColumn("coverage", cov * 100).select(
        "n", "coverage", "win_mean", "median", S.range_status(F.col("coverage") / 100, 0.72, 0.92, "n", 200).alias("coverage_status"),
        S.residual_status("win_mean", 10.0, 20.0, "n", 200).alias("residual_status"))


_STATUS = """
WITH r AS (SELECT series, settlement_date, count(*) AS n_actual, max(settlement_period) AS last_sp FROM c_panel_type GROUP BY 1, 2),
n AS (SELECT *, TIMESTAMP '2024-01-15 16:00:00' AS now_, CAST(settlement_date AS TIMESTAMP) + to_minutes(CAST(last_sp * 30 AS BIGINT)) AS upd FROM r),
b AS (SELECT *, datediff('minute', upd, now_) AS lag_min, CASE WHEN settlement_date < DATE '2024-01-15' THEN 'daily_missed'
   WHEN settlement_date = DATE '2024-01-15' AND datediff('minute', upd, now_) > 360 THEN 'stale' ELSE 'ok' END AS base FROM n),
h AS (SELECT *, CASE WHEN base = 'ok' AND settlement_date = DATE '2024-01-15' AND lag_min > 150 THEN 'delayed' ELSE base END AS health FROM b)
"""


def _status(t: Tables):
    """Each (series, day) as one published forecast with its settled rows and filter state, seen on 15 January."""
    return I.panel(t, by_type=True).groupBy("series", "settlement_date").agg(
        F.count("*").alias("n_actual"), F.max("settlement_period").alias("last_sp")).select(
        "series", F.col("settlement_date").alias("fc_date"), "n_actual", "last_sp", F.col("settlement_date").alias("state_date"),
        (F.col("settlement_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("last_sp") * 30)).alias("state_update"),
        (F.col("n_actual") - F.col("last_sp") % 7).alias("n_corrected"))


@query("I8 I9 E20", sql=_STATUS + """
SELECT series, settlement_date AS fc_date, health, CASE WHEN health IN ('daily_missed', 'unknown') OR settlement_date <> DATE '2024-01-15' THEN 'none'
  WHEN n_actual - last_sp % 7 > 0 AND n_actual = 0 THEN 'A' WHEN n_actual > n_actual - last_sp % 7 + 3 THEN 'B' ELSE 'none' END AS inconsistency FROM h""")
def feed_freshness(t: Tables):
    now = F.lit("2024-01-15 16:00:00").cast("timestamp_ntz")
    return MO.freshness(_status(t), now).select("series", "fc_date", "health", "inconsistency")


@query("I10", rnd="age_hours", sql=_STATUS + """
SELECT series, settlement_date AS fc_date, datediff('minute', upd, now_) / 60.0 AS age_hours, CASE WHEN datediff('minute', upd, now_) / 60.0 <= 4 THEN 'ok'
  WHEN settlement_date = DATE '2024-01-15' THEN 'stale' WHEN settlement_date < DATE '2024-01-15' THEN 'daily_missed' ELSE 'morning_gap' END AS status FROM h""")
def report_status(t: Tables):
    now = F.lit("2024-01-15 16:00:00").cast("timestamp_ntz")
    return MO.report_status(_status(t), now).select("series", "fc_date", "age_hours", "status")


@query("I14 J30", sql="""
SELECT max(settlement_date) AS fitted_on, datediff('day', max(settlement_date), DATE '2024-03-15') AS age_days,
  CAST(datediff('day', max(settlement_date), DATE '2024-03-15') > 31 AS INTEGER) AS expired FROM c_wf""")
def parameter_age(t: Tables):
    return MO.parameter_age(I.forecasts(t), "settlement_date", F.lit("2024-03-15").cast("date")).withColumn(
        "expired", F.col("expired").cast("int"))


# -- inference helpers ------------------------------------------------------------
@query("J27", rnd="mean_price mean_niv pct_p", sql="""
SELECT settlement_date, avg(ssp) AS mean_price, avg(net_imbalance_volume) AS mean_niv, count(*) AS n,
  avg(CASE WHEN price_derivation_code = 'P' THEN 100.0 ELSE 0.0 END) AS pct_p FROM c_panel WHERE settlement_period <= 25 GROUP BY 1""")
def partial_day_anchors(t: Tables):
    p = I.panel(t).where("settlement_period <= 25")
    code = F.coalesce(F.when(F.col("price_derivation_code") == "P", 100.0).otherwise(0.0), F.lit(0.0))
    return p.groupBy("settlement_date").agg(F.avg("ssp").alias("mean_price"), F.avg("net_imbalance_volume").alias("mean_niv"),
                                            F.count("*").alias("n"), F.avg(code).alias("pct_p"))


@query("J24", rnd="wind", sql=f"""
SELECT p.settlement_date, p.settlement_period, coalesce(v.windfor_fc_mw / 100, p.lagged) AS wind FROM (SELECT *, {at('wind_pct', 48)} AS lagged FROM c_panel) p
LEFT JOIN c_vintage v USING (settlement_date, settlement_period)""")
def forecast_replaces_lag(t: Tables):
    p = SR.with_frames(I.panel(t), ["series"], "slot_ix", lambda f: {"lagged": f.lag("wind_pct", 48)}, back=48)
    j = p.join(I.vintages(t), KEY, "left")
    return j.select(*KEY, F.coalesce(F.col("windfor_fc_mw") / 100, "lagged").alias("wind"))


_WP = """
WITH g AS (SELECT CAST(d AS DATE) AS settlement_date, CAST(unnest(range(1, 49)) AS INTEGER) AS settlement_period
  FROM (SELECT unnest(generate_series(min(settlement_date), max(settlement_date), INTERVAL 1 DAY)) AS d FROM c_vintage)),
v AS (SELECT g.settlement_date, g.settlement_period, windfor_fc_mw AS x, CASE WHEN day(g.settlement_date) % 10 <> 0 THEN tsdf_fc_mw END AS y
  FROM g LEFT JOIN c_vintage USING (settlement_date, settlement_period)),
""" + ", ".join(f"""{c}n AS (SELECT settlement_date, settlement_period, {c}, max(CASE WHEN {c} IS NOT NULL THEN settlement_period END) OVER p AS i0,
  min(CASE WHEN {c} IS NOT NULL THEN settlement_period END) OVER f AS i1, last_value({c} IGNORE NULLS) OVER p AS v0, first_value({c} IGNORE NULLS) OVER f AS v1 FROM v
  WINDOW p AS (PARTITION BY settlement_date ORDER BY settlement_period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY settlement_date ORDER BY settlement_period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{c}i AS (SELECT settlement_date, settlement_period, CASE WHEN {c} IS NOT NULL THEN {c} WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) / (i1 - i0) * (settlement_period - i0) END AS {c} FROM {c}n)""" for c in ("x", "y"))


@query("J28 E17", rnd="wind_pct", sql=_WP + """
SELECT settlement_date, settlement_period, CASE WHEN ny = 0 THEN x / 32000 * 100 WHEN y > 0 THEN x / y * 100 END AS wind_pct
FROM xi JOIN yi USING (settlement_date, settlement_period) JOIN (SELECT settlement_date, count(y) AS ny FROM v GROUP BY 1) USING (settlement_date)""")
def wind_share_forecast(t: Tables):
    """Wind over demand on the full slot grid; installed capacity only on days without any demand forecast."""
    v = I.vintages(t).withColumn("series", F.lit("all")).withColumn(
        "tsdf_fc_mw", F.when(F.dayofmonth("settlement_date") % 10 != 0, F.col("tsdf_fc_mw")))
    from slotwise.operators.learn import wind_share
    return wind_share(SR.slot_grid(v, ["series"]).join(v, ["series", *KEY], "left")).select(*KEY, "wind_pct")
