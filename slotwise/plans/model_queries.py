"""Model fits and applications as distributed jobs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from slotwise.functions import scoring as S
from slotwise.operators import clean as C
from slotwise.operators import daily as DY
from slotwise.operators import features as FT
from slotwise.operators import learn as L
from slotwise.operators import metrics as M
from slotwise.operators import series as SR
from slotwise.operators.joins import vwap
from slotwise.plans import inputs as I
from slotwise.plans.feature_queries import at, roll
from slotwise.plans.fragments import least_squares, predicted, reweighted
from slotwise.plans.registry import query
from slotwise.session import Tables, materialise

KEY = ["settlement_date", "settlement_period"]
DAILY_FEATURES = ["price_lag1", "price_lag2", "price_lag7", "price_lag28", "roll_mean_7", "roll_std_7", "roll_mean_28",
                  "day_of_week", "month", "sin_annual", "cos_annual"]


def daily_model_table(t: Tables):
    """Years of daily prices of five series with leakage-safe features."""
    f = SR.frames_by(["series"], "day_ix")
    cols = {f"price_lag{n}": f.lag("price", n) for n in (1, 2, 7, 28)}
    cols |= {"roll_mean_7": f.rolling("price", 7, "mean", 3), "roll_std_7": f.rolling("price", 7, "std", 3),
             "roll_mean_28": f.rolling("price", 28, "mean", 3), "spikes_28": f.rolling((F.col("price") > 150).cast("int"), 28, "mean")}
    d = I.daily_orders(t, by_priority=True).withColumns(cols | DY.day_calendar())
    return d.withColumns({"spike_day": (F.col("price") > 150).cast("int"), "low_day": (F.col("price") < 40).cast("int")})


def _split(d, cut="2000-07-01"):
    c = F.col("settlement_date") < F.lit(cut).cast("date")
    return d.where(c), d.where(~c)


def _with_held_out(d, cut, days):
    """Rows before, on and after the last ``days`` days before the cut-off: to fit, to judge the fit, to forecast."""
    before, after = _split(d, cut)
    early = F.col("settlement_date") < F.date_sub(F.lit(cut).cast("date"), days)
    return before.where(early), before.where(~early), after


@query("J4", rnd="mae coverage")
def level_quantiles(t: Tables):
    d = materialise(daily_model_table(t), "daily")
    train, val, test = _with_held_out(d, "2000-07-01", 180)
    p = L.quantile_forest(train, test, DAILY_FEATURES, "price", rounds=10, depth=3, held_out=val)
    return p.groupBy("series").agg(F.count("*").alias("n"), S.mae("price", "q50").alias("mae"),
                                   S.coverage_pct("price", "q10", "q90").alias("coverage"))


SHAPE_FEATURES = ["ssp_lag_48", "ssp_lag_336", "same_sp_mean_7d", "same_sp_std_7d", "sin_sp", "cos_sp", "is_weekend"]


def slot_model_table(t: Tables):
    p = C.winsorise(I.panel(t))
    p = FT.same_slot_week(FT.slot_history(p, [FT.price_lags]))
    p = FT.add_calendar(p)
    day = p.groupBy("series", "settlement_date").agg(F.avg("ssp_raw").alias("day_mean"))
    return p.join(day, ["series", "settlement_date"]).withColumn("deviation_true", F.col("ssp_raw") - F.col("day_mean"))


@query("J5", rnd="mae")
def shape_median(t: Tables):
    d = materialise(slot_model_table(t), "slots")
    train, test = _split(d, "2024-01-22")
    p = L.quantile_forest(train, test, SHAPE_FEATURES, "deviation_true", rounds=8, depth=3)
    return p.groupBy("settlement_date").agg(F.count("*").alias("n"), S.mae("deviation_true", "q50").alias("mae"))


@query("J6 J25 J26", rnd="q10 q50 q90", sql="""
WITH lv AS (SELECT series, settlement_date, avg(q10) AS a, avg(q50) AS b, avg(q90) AS c FROM c_wf GROUP BY 1, 2),
sh AS (SELECT w.*, w.q50 - lv.b AS dev FROM c_wf w JOIN lv USING (series, settlement_date))
SELECT sh.settlement_date, sh.settlement_period, least(a, b) + dev AS q10, b + dev AS q50, greatest(c, b) + dev AS q90
FROM sh JOIN lv USING (series, settlement_date)""")
def level_plus_shape(t: Tables):
    f = I.forecasts(t)
    level = f.groupBy("series", "settlement_date").agg(F.avg("q10").alias("q10"), F.avg("q50").alias("q50"), F.avg("q90").alias("q90"))
    shape = f.join(level.select("series", "settlement_date", F.col("q50").alias("_l")), ["series", "settlement_date"]).select(
        "series", *KEY, (F.col("q50") - F.col("_l")).alias("deviation"))
    return L.two_stage(level, shape).select(*KEY, "q10", "q50", "q90")


@query("J4 J5 J6 J3", rnd="mae rmse coverage")
def two_stage_forecast(t: Tables):
    """Level and shape models fitted before a cut-off and combined after it."""
    slots = materialise(slot_model_table(t), "slots")
    train, test = _split(slots, "2024-01-22")
    daily = slots.groupBy("series", "settlement_date", "day_ix").agg(F.avg("ssp_raw").alias("level"))
    fr = SR.frames_by(["series"], "day_ix")
    daily = daily.withColumns({"level_lag1": fr.lag("level", 1), "level_lag7": fr.lag("level", 7), "level_roll7": fr.rolling("level", 7, "mean", 3),
                               "dow": F.weekday("settlement_date")})
    dtr, dte = _split(daily, "2024-01-22")
    fit, val, _ = _with_held_out(dtr, "2024-01-22", 7)
    level = L.quantile_forest(fit, dte, ["level_lag1", "level_lag7", "level_roll7", "dow"], "level", rounds=8, depth=2, held_out=val)
    shape = L.quantile_forest(train, test, SHAPE_FEATURES, "deviation_true", rounds=8, depth=3).select(
        "series", *KEY, F.col("ssp_raw").alias("actual"), F.col("q50").alias("deviation"))
    return M.score(L.two_stage(level, shape), ["settlement_date"], {
        "mae": S.mae("actual", "q50"), "rmse": S.rmse("actual", "q50"), "coverage": S.coverage_pct("actual", "q10", "q90")})


# Fixed dates of the test data's folds.
FOLDS = [("w3", "2024-01-15", "2024-01-21"), ("w4", "2024-01-22", "2024-01-28"), ("w9", "2024-03-01", "2024-03-07")]
FOLD_VAL_DAYS = 3
_SCORE = ["low_lag1", "wind_lag1"]
_LEVEL = ["level_lag1", "level_roll7"]
_SHAPE = ["ssp_lag_48", "same_sp_mean_7d", "sin_sp", "cos_sp"]
_DAILY_LAGS = {"low_lag1": at("n_low", 1, "d"), "wind_lag1": at("wind", 1, "d"), "level_lag1": at("level", 1, "d"),
               "level_roll7": roll("level", 7, "mean", "d", 3)}
_PARTS = "CASE WHEN settlement_date < a - 3 THEN 'train' WHEN settlement_date < a THEN 'val' ELSE 'predict' END AS part"
_WF2 = f"""
WITH f AS (SELECT * FROM (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in FOLDS)}) AS v(fold, a, b)),
y0 AS (SELECT series, settlement_date, day_ix, avg(ssp_raw) AS level, count(*) FILTER (WHERE ssp_raw < 20) AS n_low, avg(wind_pct) AS wind
  FROM c_clean GROUP BY 1, 2, 3),
y1 AS (SELECT *, CAST(n_low >= 4 AS INTEGER) AS low_day, {", ".join(f"{e} AS {n}" for n, e in _DAILY_LAGS.items())} FROM y0),
y2 AS (SELECT *, {_PARTS} FROM y1 JOIN f ON settlement_date <= b WHERE a <= (SELECT max(settlement_date) FROM y1)),
yt AS (SELECT * FROM y2 WHERE part = 'train'),
{least_squares("sc", "yt", _SCORE, "low_day", ["series", "fold"])},
y3 AS (SELECT y2.*, {predicted(_SCORE, "sc")} AS low_score FROM y2 JOIN sc USING (series, fold)),
y3t AS (SELECT * FROM y3 WHERE part = 'train'),
{least_squares("lv", "y3t", [*_LEVEL, "low_score"], "level", ["series", "fold"])},
ahead AS (SELECT series, fold, part, settlement_date, {predicted([*_LEVEL, "low_score"], "lv")} AS lvl FROM y3 JOIN lv USING (series, fold)),
s0 AS (SELECT *, {at("ssp", 48)} AS ssp_lag_48, {roll("ssp", 7, "mean", "s")} AS same_sp_mean_7d,
  sin(2 * pi() * (settlement_period - 1) / 48) AS sin_sp, cos(2 * pi() * (settlement_period - 1) / 48) AS cos_sp,
  ssp_raw - avg(ssp_raw) OVER (PARTITION BY series, settlement_date) AS deviation_true FROM c_clean),
s1 AS (SELECT *, {_PARTS} FROM s0 JOIN f ON settlement_date <= b WHERE a <= (SELECT max(settlement_date) FROM s0)),
st AS (SELECT * FROM s1 WHERE part = 'train'),
{least_squares("sh", "st", _SHAPE, "deviation_true", ["series", "fold"])},
p0 AS (SELECT s1.*, lvl + {predicted(_SHAPE, "sh")} AS q50 FROM s1 JOIN sh USING (series, fold) JOIN ahead USING (series, fold, part, settlement_date)),
p AS (SELECT * FROM p0 WHERE q50 IS NOT NULL),
band AS (SELECT series, fold, quantile_cont(ssp_raw - q50, 0.1) AS r10, quantile_cont(ssp_raw - q50, 0.9) AS r90 FROM p WHERE part = 'val' GROUP BY 1, 2),
wf AS (SELECT fold, series, settlement_date, settlement_period, ssp_raw AS actual, least(q50 + r10, q50) AS q10, q50, greatest(q50 + r90, q50) AS q90
  FROM p JOIN band USING (series, fold) WHERE part = 'predict')
"""


def _walk_forward(t: Tables):
    slots = materialise(slot_model_table(t), "slots")
    days = slots.groupBy("series", "settlement_date", "day_ix").agg(
        F.avg("ssp_raw").alias("level"), F.count_if(F.col("ssp_raw") < 20).alias("n_low"), F.avg("wind_pct").alias("wind"))
    f = SR.frames_by(["series"], "day_ix")
    days = days.withColumns({"low_day": (F.col("n_low") >= 4).cast("int"), "low_lag1": f.lag("n_low", 1), "wind_lag1": f.lag("wind", 1),
                             "level_lag1": f.lag("level", 1), "level_roll7": f.rolling("level", 7, "mean", 3)})
    p = L.walk_forward_two_stage(slots, days, FOLDS, FOLD_VAL_DAYS, _SCORE, _LEVEL, _SHAPE)
    return materialise(p, "walk_forward")


@query("J3 J4 J5 J6 J7", rnd="actual q10 q50 q90", sql=_WF2 + "SELECT * FROM wf")
def walk_forward_two_stage(t: Tables):
    """Both stages fitted anew per fold, the low-day score a feature of the level, bands from unseen days."""
    return _walk_forward(t)


@query("J3 J4 J6", rnd="mae rmse coverage", sql=_WF2 + """
SELECT fold, count(*) AS n, avg(abs(actual - q50)) AS mae, sqrt(avg(power(actual - q50, 2))) AS rmse,
  avg(CASE WHEN actual >= q10 AND actual <= q90 THEN 1.0 ELSE 0.0 END) * 100 AS coverage FROM wf GROUP BY fold""")
def walk_forward_scores(t: Tables):
    return _walk_forward(t).groupBy("fold").agg(F.count("*").alias("n"), S.mae("actual", "q50").alias("mae"), S.rmse("actual", "q50").alias("rmse"),
                                                S.coverage_pct("actual", "q10", "q90").alias("coverage"))


@query("J7", rnd="mean_low mean_other")
def low_price_day_score(t: Tables):
    """Probability of a low-price day as a feature; higher on days that turn out low."""
    d = materialise(daily_model_table(t), "daily")
    train, test = _split(d)
    s = L.day_probability(train, test, ["price_lag1", "price_lag7", "roll_mean_7", "is_weekend", "month"], "low_day", "p_low")
    return s.groupBy("series").agg(F.count("*").alias("n"), F.avg(F.when(F.col("low_day") == 1, F.col("p_low"))).alias("mean_low"),
                                   F.avg(F.when(F.col("low_day") == 0, F.col("p_low"))).alias("mean_other"))


@query("J8 D28", rnd="brier base_rate base_brier skill")
def spike_day_probability(t: Tables):
    d = materialise(daily_model_table(t), "daily")
    train, later = _split(d)
    s = L.calibrated_spike_scores(train, later, ["series", "settlement_date"], ["price_lag1", "price_lag2", "price_lag7", "roll_mean_28", "spikes_28", "month"], "spike_day")
    return M.brier(materialise(s, "scores"), "p", "spike_day")


_PROFILE = {f"p_lag{n}d_sp{s}": (n, s) for n in (1, 2, 7) for s in range(1, 49)}


@query("J15 H4", rnd=" ".join(_PROFILE) + " dmean_lag1 dmean_lag7 dmin_lag1 dmax_lag1 mid_lag1 ssp_mid_spread_lag1", sql="""
WITH d AS (SELECT series, settlement_date, day_ix, avg(ssp) AS dm, min(ssp) AS dn, max(ssp) AS dx, """ + ", ".join(
    f"max(CASE WHEN settlement_period = {s} THEN ssp END) AS v{s}" for s in range(1, 49)) + """ FROM c_panel GROUP BY 1, 2, 3 HAVING count(*) = 48),
m AS (SELECT settlement_date, avg(mid_price) AS mm FROM c_mid GROUP BY 1)
SELECT d.settlement_date, """ + ", ".join(f"{'abc'[(1, 2, 7).index(n)]}.v{s} AS {c}" for c, (n, s) in _PROFILE.items()) + """,
  a.dm AS dmean_lag1, c.dm AS dmean_lag7, a.dn AS dmin_lag1, a.dx AS dmax_lag1, m.mm AS mid_lag1, a.dm - m.mm AS ssp_mid_spread_lag1, """
    + ", ".join(f"CAST((dayofweek(d.settlement_date) + 6) % 7 = {i} AS INTEGER) AS dow_{i}" for i in range(7)) + """,
  CAST(d.settlement_date = DATE '2024-01-01' AS INTEGER) AS is_holiday
FROM d JOIN d a ON a.day_ix = d.day_ix - 1 JOIN d b ON b.day_ix = d.day_ix - 2 JOIN d c ON c.day_ix = d.day_ix - 7
LEFT JOIN m ON m.settlement_date = CAST(d.settlement_date - INTERVAL 1 DAY AS DATE)""")
def lagged_day_profiles(t: Tables):
    return _design(t).select(
        "settlement_date", *[F.element_at(f"profile_lag{n}d", s).alias(c) for c, (n, s) in _PROFILE.items()],
        "dmean_lag1", "dmean_lag7", "dmin_lag1", "dmax_lag1", "mid_lag1", "ssp_mid_spread_lag1",
        *[F.col(f"dow_{i}").cast("int").alias(f"dow_{i}") for i in range(7)], F.col("is_holiday").cast("int").alias("is_holiday"))


def _design(t: Tables):
    mid = vwap(I.provider_trades(t), KEY).groupBy("settlement_date").agg(F.avg("mid_price").alias("mid_mean"))
    return L.profile_design(L.day_profiles(I.panel(t), value="ssp"), mid)


def _lasso(t: Tables):
    return materialise(L.slot_lasso(L.design_rows(_design(t)), "2024-01-24"), "lasso")


@query("J16 J17", rnd="mae coverage")
def slot_lasso_backtest(t: Tables):
    p = _lasso(t)
    return p.groupBy("settlement_date").agg(F.count("*").alias("n"), S.mae("actual", "q50").alias("mae"),
                                            S.coverage_pct("actual", "q10", "q90").alias("coverage"))


@query("J17 F3", rnd="beta alpha")
def slot_lasso_coefficients(t: Tables):
    return L.top_coefficients(_lasso(t), L.design_names())


@query("J18", rnd="mae coverage")
def direct_quantiles(t: Tables):
    """Direct slot model with short lags, median by absolute loss and residual bands."""
    d = materialise(FT.slot_history(C.winsorise(I.panel(t)), [FT.price_lags, FT.price_rolling]), "direct")
    train, val, test = _with_held_out(d, "2024-01-22", 5)
    feats = ["ssp_lag_1", "ssp_lag_2", "ssp_lag_48", "ssp_lag_336", "ssp_roll_mean_6", "ssp_roll_std_48", "net_imbalance_volume_lag_1"]
    p = L.quantile_forest(train, test, feats, "ssp_raw", rounds=8, depth=3, held_out=val)
    return p.groupBy("settlement_date").agg(F.count("*").alias("n"), S.mae("ssp_raw", "q50").alias("mae"),
                                            S.coverage_pct("ssp_raw", "q10", "q90").alias("coverage"))


_W = {"lag_1": 0.5, "lag_2": 0.1, "lag_48": 0.2, "roll_mean_6": 0.1}


@query("J19", rnd="pred", sql="""
WITH RECURSIVE h AS (SELECT CAST(settlement_date + 1 AS DATE) AS target_date, list(ssp ORDER BY settlement_period) AS buf FROM c_panel GROUP BY settlement_date HAVING count(*) = 48),
s AS (SELECT h.target_date, p.settlement_period, p.wind_pct * 0.1 AS base, row_number() OVER (PARTITION BY h.target_date ORDER BY p.settlement_period) AS k, h.buf
  FROM h JOIN c_panel p ON p.settlement_date = h.target_date),
r AS (
  SELECT target_date, CAST(0 AS BIGINT) AS k, CAST(0 AS INTEGER) AS settlement_period, CAST(0 AS DOUBLE) AS pred, any_value(buf) AS buf FROM s GROUP BY 1
  UNION ALL
  SELECT target_date, k, settlement_period, pred, list_append(buf[2:], least(greatest(pred, -500), 150)) FROM (
    SELECT r.target_date, s.k, s.settlement_period, r.buf,
      s.base + 0.5 * r.buf[48] + 0.1 * r.buf[47] + 0.2 * r.buf[1]
        + 0.1 * (r.buf[43] + r.buf[44] + r.buf[45] + r.buf[46] + r.buf[47] + r.buf[48]) / 6 AS pred
    FROM r JOIN s ON s.target_date = r.target_date AND s.k = r.k + 1))
SELECT target_date, settlement_period, pred FROM r WHERE k > 0""")
def recursive_rollout(t: Tables):
    p = I.panel(t)
    fut = p.select("series", F.col("settlement_date").alias("target_date"), "settlement_period", (F.col("wind_pct") * 0.1).alias("base"))
    return L.rollout(L.last_prices(p, "ssp"), fut, _W, cap=150.0).select("target_date", "settlement_period", "pred")


_ROLLED = ["ssp_lag_1", "ssp_lag_2", "ssp_lag_48", "ssp_roll_mean_6"]


@query("J19 J18", rnd="mae", sql=f"""
WITH RECURSIVE d AS (SELECT *, {", ".join(f"{at('ssp', n)} AS ssp_lag_{n}" for n in (1, 2, 48))}, {roll('ssp', 6, 'mean')} AS ssp_roll_mean_6 FROM c_clean),
tr AS (SELECT * FROM d WHERE settlement_date < DATE '2024-01-22'),
{least_squares("ls", "tr", _ROLLED, "ssp", ["series"])},
h AS (SELECT series, CAST(settlement_date + 1 AS DATE) AS target_date, list(ssp ORDER BY settlement_period) AS buf FROM d GROUP BY 1, 2 HAVING count(*) = 48),
s AS (SELECT h.*, d.settlement_period, d.ssp_raw, row_number() OVER (PARTITION BY h.series, h.target_date ORDER BY d.settlement_period) AS k, b0, b1, b2, b3, b4
  FROM h JOIN d ON d.series = h.series AND d.settlement_date = h.target_date JOIN ls ON ls.series = h.series WHERE h.target_date >= DATE '2024-01-22'),
r AS (
  SELECT series, target_date, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS pred, CAST(0 AS DOUBLE) AS y, any_value(buf) AS buf FROM s GROUP BY 1, 2
  UNION ALL
  SELECT series, target_date, k, pred, y, list_append(buf[2:], least(greatest(pred, -500), 500)) FROM (
    SELECT s.series, s.target_date, s.k, s.ssp_raw AS y, r.buf, b0 + b1 * r.buf[48] + b2 * r.buf[47] + b3 * r.buf[1]
        + b4 * (r.buf[43] + r.buf[44] + r.buf[45] + r.buf[46] + r.buf[47] + r.buf[48]) / 6 AS pred
    FROM r JOIN s ON s.series = r.series AND s.target_date = r.target_date AND s.k = r.k + 1))
SELECT target_date, count(*) AS n, avg(abs(y - pred)) AS mae FROM r WHERE k > 0 GROUP BY 1""")
def fitted_rollout(t: Tables):
    """Short-lag coefficients fitted on slots before the cut-off, then rolled out day by day."""
    d = FT.slot_history(C.winsorise(I.panel(t)), [FT.price_lags, FT.price_rolling])
    d = materialise(d, "roll")
    train, test = _split(d, "2024-01-22")
    # Each series has its own coefficients; a series without a fit has no roll-out.
    beta = L.grouped_least_squares(train, ["series"], _ROLLED, "ssp").select("series", "beta")
    w = {n: f"w_{n}" for n in ("lag_1", "lag_2", "lag_48", "roll_mean_6")}
    fut = test.join(beta, "series").select("series", F.col("settlement_date").alias("target_date"), "settlement_period", F.col("beta")[0].alias("base"),
                                           *[F.col("beta")[i].alias(c) for i, c in enumerate(w.values(), 1)])
    out = L.rollout(L.last_prices(d, "ssp"), fut, w, cap=500.0)
    j = out.join(test.select("series", F.col("settlement_date").alias("target_date"), "settlement_period", "ssp_raw"),
                 ["series", "target_date", "settlement_period"])
    return j.groupBy("target_date").agg(F.count("*").alias("n"), S.mae("ssp_raw", "pred").alias("mae"))


@query("J19 J18", rnd="mae mae_one_step")
def tree_rollout(t: Tables):
    """Boosted trees on short lags, fitted before the cut-off, rolled out day by day; beside it the same trees given true lags."""
    d = FT.slot_history(C.winsorise(I.panel(t)), [FT.price_lags, FT.price_rolling])
    d = materialise(d.withColumns({"target_date": F.col("settlement_date"), "slot": F.col("settlement_period").cast("double")}), "trees")
    train, test = _split(d, "2024-01-22")
    model, assembler = L.short_lag_trees(train, TREE_INPUTS, "ssp", rounds=8, depth=3)
    out = L.fitted_tree_rollout(L.last_prices(d, "ssp"), test, model, list(TREE_INPUTS), cap=500.0)
    one = model.transform(assembler.transform(test.dropna(subset=list(TREE_INPUTS.values())))).select("series", "target_date", "settlement_period", "ssp_raw", "prediction")
    j = out.join(one, ["series", "target_date", "settlement_period"])
    return j.groupBy("target_date").agg(F.count("*").alias("n"), S.mae("ssp_raw", "pred").alias("mae"), S.mae("ssp_raw", "prediction").alias("mae_one_step"))


#: Inputs of the roll-out, and the columns they are fitted on.
TREE_INPUTS = {"lag_1": "ssp_lag_1", "lag_2": "ssp_lag_2", "lag_48": "ssp_lag_48", "roll_mean_6": "ssp_roll_mean_6", "roll_min_6": "ssp_roll_min_6",
               "roll_max_6": "ssp_roll_max_6", "slot": "slot"}


_LS = f"""
WITH l AS (SELECT series, ssp AS y, {at('ssp', 1)} AS x FROM c_panel_type)
SELECT series, count(*) AS n_train, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM l WHERE x IS NOT NULL GROUP BY 1"""


@query("J22 J17", rnd="b0 b1", sql=_LS)
def least_squares_per_series(t: Tables):
    d = SR.with_frames(I.panel(t, by_type=True), ["series"], "slot_ix", lambda f: {"x": f.lag("ssp", 1)}, back=1)
    g = L.grouped_least_squares(d, ["series"], ["x"], "ssp")
    return g.select("series", "n_train", F.element_at("beta", 1).alias("b0"), F.element_at("beta", 2).alias("b1"))


_YEAR = 2 * math.pi / 365
_LAGGED = f"""SELECT series, settlement_date, price, {at('price', 1, 'd')} AS price_lag1, {at('price', 7, 'd')} AS price_lag7,
  {roll('price', 7, 'mean', 'd', 3)} AS roll_mean_7, {roll('price', 28, 'mean', 'd', 3)} AS roll_mean_28,
  sin(dayofyear(settlement_date) * {_YEAR!r}) AS sin_annual, cos(dayofyear(settlement_date) * {_YEAR!r}) AS cos_annual FROM c_daily_prio"""

_FITTED, _PROBS = ["price_lag1", "price_lag7", "roll_mean_28"], {"q10": 0.1, "q50": 0.5, "q90": 0.9}
_ROUNDS = 6


def _pinball_step(p: float) -> tuple[str, str]:
    above = "(1 / (1 + exp(-greatest(least((price - z) / h, 30), -30))))"
    w = f"(greatest({above} * (1 - {above}), {L.LEAST_DENSITY}) / h)"
    return w, f"z + ({p} - (1 - {above})) / {w}"


@query("J4 J18 D11", rnd="mae pinball_q10 pinball_q90 coverage mean_width", sql=f"""
WITH d AS ({_LAGGED}), tr AS (SELECT * FROM d WHERE settlement_date < DATE '2000-07-01'),
{", ".join(reweighted(n, "tr", _FITTED, "price", ["series"], ("1.0", "price"), _pinball_step(p), _ROUNDS) for n, p in _PROBS.items())},
p AS (SELECT d.series, price, {", ".join(f"{predicted(_FITTED, n)} AS p_{n}" for n in _PROBS)} FROM d {" ".join(f"JOIN {n} ON d.series = {n}.series" for n in _PROBS)}
  WHERE settlement_date >= DATE '2000-07-01' AND {" AND ".join(f"{c} IS NOT NULL" for c in _FITTED)}),
o AS (SELECT series, price, p_q50 AS q50, least(p_q10, p_q50) AS q10, greatest(p_q90, p_q50) AS q90 FROM p)
SELECT series, count(*) AS n, avg(abs(price - q50)) AS mae, avg(greatest((price - q10) * 0.1, (price - q10) * -0.9)) AS pinball_q10,
  avg(greatest((price - q90) * 0.9, (price - q90) * (0.9 - 1))) AS pinball_q90, avg(CASE WHEN price >= q10 AND price <= q90 THEN 1.0 ELSE 0.0 END) AS coverage,
  avg(q90 - q10) AS mean_width FROM o GROUP BY 1""")
def fitted_quantiles(t: Tables):
    """P10, P50 and P90 each fitted under its own pinball loss, all series and all three in the same rounds."""
    d = daily_model_table(t).select("series", "settlement_date", "price", *_FITTED)
    train, test = _split(materialise(d, "daily"))
    fit = L.reweighted_fits(train, ["series"], _FITTED, "price", {n: L.quantile_loss(p) for n, p in _PROBS.items()}, _ROUNDS)
    p = test.dropna(subset=_FITTED).join(fit.drop("n_train"), "series").withColumns({f"p_{n}": L.linear_predict(_FITTED, n) for n in _PROBS})
    o = p.select("series", "price", F.col("p_q50").alias("q50"), F.least("p_q10", "p_q50").alias("q10"), F.greatest("p_q90", "p_q50").alias("q90"))

    def pinball(c, q):
        e = F.col("price") - F.col(c)
        return F.avg(F.greatest(e * q, e * (q - 1)))

    return o.groupBy("series").agg(
        F.count("*").alias("n"), S.mae("price", "q50").alias("mae"), pinball("q10", 0.1).alias("pinball_q10"), pinball("q90", 0.9).alias("pinball_q90"),
        F.avg(F.when(F.col("price").between(F.col("q10"), F.col("q90")), 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.col("q90") - F.col("q10")).alias("mean_width"))


_CLASS_VARIANCE = f"greatest((1 / (1 + exp(-zc))) * (1 - 1 / (1 + exp(-zc))), {L.LEAST_VARIANCE})"
_CLASS_STEP = (f"{_CLASS_VARIANCE} * CASE WHEN high_day > 0 THEN 0.5 / share ELSE 0.5 / (1 - share) END".replace("zc", "greatest(least(z, 30), -30)"),
               f"zc + (high_day - 1 / (1 + exp(-zc))) / {_CLASS_VARIANCE}".replace("zc", "greatest(least(z, 30), -30)"))


@query("J7 J8 D28", rnd="brier base_brier mean_high mean_other", sql=f"""
WITH d AS (SELECT *, CAST(CASE WHEN price > roll_mean_28 THEN 1 ELSE 0 END AS DOUBLE) AS high_day FROM ({_LAGGED}) WHERE roll_mean_28 IS NOT NULL),
tr AS (SELECT *, avg(high_day) OVER (PARTITION BY series) AS share FROM d WHERE settlement_date < DATE '2000-07-01' AND {" AND ".join(f"{c} IS NOT NULL" for c in ["price", *_FITTED])}),
{reweighted("cl", "tr", _FITTED, "high_day", ["series"], _CLASS_STEP, _CLASS_STEP, _ROUNDS)},
p AS (SELECT d.series, high_day, 1 / (1 + exp(-{predicted(_FITTED, "cl")})) AS p FROM d JOIN cl ON d.series = cl.series
  WHERE settlement_date >= DATE '2000-07-01' AND {" AND ".join(f"{c} IS NOT NULL" for c in _FITTED)}),
r AS (SELECT series, avg(high_day) AS rate FROM p GROUP BY 1)
SELECT p.series, count(*) AS n, avg((p - high_day) * (p - high_day)) AS brier, avg((rate - high_day) * (rate - high_day)) AS base_brier,
  avg(CASE WHEN high_day = 1 THEN p END) AS mean_high, avg(CASE WHEN high_day = 0 THEN p END) AS mean_other FROM p JOIN r USING (series) GROUP BY 1""")
def fitted_day_class(t: Tables):
    """Days above their four-week mean: a balanced logistic fit per series by reweighted least squares, judged on later days."""
    d = daily_model_table(t).select("series", "settlement_date", "price", *_FITTED).where("roll_mean_28 IS NOT NULL")
    d = materialise(d.withColumn("high_day", (F.col("price") > F.col("roll_mean_28")).cast("double")), "daily")
    train, test = _split(d)
    train = train.dropna(subset=["price", *_FITTED])
    share = train.groupBy("series").agg(F.avg("high_day").alias("share"))
    fit = L.reweighted_fits(train.join(share, "series"), ["series"], _FITTED, "high_day", {"cl": L.class_loss("share")}, _ROUNDS)
    p = test.dropna(subset=_FITTED).join(fit.drop("n_train"), "series").withColumn("p", L.probability(L.linear_predict(_FITTED, "cl")))
    e = F.pow(F.col("p") - F.col("high_day"), 2)
    # The mean's own score needs the rate only.
    rate = F.avg("high_day")
    return p.groupBy("series").agg(F.count("*").alias("n"), F.avg(e).alias("brier"), (rate * (1 - rate)).alias("base_brier"),
                                   F.avg(F.when(F.col("high_day") == 1, F.col("p"))).alias("mean_high"), F.avg(F.when(F.col("high_day") == 0, F.col("p"))).alias("mean_other"))


# Training window in months, half-life in days, transform; first days of the folds.
CONFIGS = [(w, h, "linear") for w in (12, 18, 24, 36, None) for h in (None, 365, 182, 91)] + [
    (w, h, "asinh") for w in (36, 18, None) for h in (None, 182)]
STARTS = [f"2000-{m:02d}-01" for m in range(7, 13)] + [f"2001-{m:02d}-01" for m in range(1, 8)]
_SWEPT = ["price_lag1", "price_lag7", "roll_mean_7", "roll_mean_28", "sin_annual", "cos_annual"]

@query("J22 J23 E29", rnd="mae bias pinball coverage", sql=f"""
WITH d AS (SELECT * FROM ({_LAGGED}) WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ["price", *_SWEPT])}),
plan AS (SELECT config, coalesce(w, 99) AS window_months, coalesce(h, 0) AS half_life, transform, fs AS fold_start
  FROM (VALUES {", ".join(f"({i}, {w or 'NULL'}, {h or 'NULL'}, '{tr}')" for i, (w, h, tr) in enumerate(CONFIGS))}) AS c(config, w, h, transform),
       (VALUES {", ".join(f"(DATE '{x}')" for x in STARTS)}) AS f(fs)),
tr0 AS (SELECT d.*, plan.*, CASE WHEN half_life > 0 THEN power(0.5, (fold_start - settlement_date) / CAST(half_life AS DOUBLE)) ELSE 1.0 END AS w,
    CASE WHEN transform = 'asinh' THEN asinh(price / 50) ELSE price END AS y FROM d JOIN plan ON settlement_date < fold_start - 2
    AND (window_months = 99 OR settlement_date >= fold_start - to_months(CAST(window_months AS INTEGER)))),
enough AS (SELECT config, fold_start FROM tr0 GROUP BY 1, 2 HAVING count(DISTINCT settlement_date) >= 120),
tr AS (SELECT * FROM tr0 JOIN enough USING (config, fold_start)),
{least_squares("ls", "tr", _SWEPT, "y", ["config", "fold_start"], "w")},
trp AS (SELECT tr.*, {predicted(_SWEPT, "ls")} AS z FROM tr JOIN ls USING (config, fold_start)),
band AS (SELECT config, fold_start, quantile_cont(e, 0.1) AS r10, quantile_cont(e, 0.9) AS r90
  FROM (SELECT *, price - CASE WHEN transform = 'asinh' THEN sinh(z) * 50 ELSE z END AS e FROM trp) GROUP BY 1, 2),
te AS (SELECT d.*, plan.*, {predicted(_SWEPT, "ls")} AS z FROM d JOIN plan ON settlement_date >= fold_start AND settlement_date < fold_start + 14
  JOIN ls USING (config, fold_start)),
p AS (SELECT te.*, CASE WHEN transform = 'asinh' THEN sinh(z) * 50 ELSE z END AS pred, pred + r10 AS lo, pred + r90 AS hi FROM te JOIN band USING (config, fold_start))
SELECT config, window_months, half_life, transform, count(DISTINCT fold_start) AS n_folds, count(*) AS n_days, avg(abs(price - pred)) AS mae, avg(pred - price) AS bias,
  (avg(greatest((price - lo) * 0.1, (price - lo) * -0.9)) + avg(greatest((price - hi) * 0.9, (price - hi) * (0.9 - 1)))) / 2 AS pinball,
  avg(CASE WHEN price >= lo AND price <= hi THEN 1.0 ELSE 0.0 END) AS coverage FROM p GROUP BY 1, 2, 3, 4""")
def level_sweep(t: Tables):
    """26 training configurations x 13 folds, fitted in one grouped job."""
    d = daily_model_table(t)
    return L.level_sweep(d, _SWEPT, "price", CONFIGS, STARTS)


_PERMUTED = ["price_lag1", "price_lag7", "roll_mean_28"]


def _hash_sql(seed: int) -> str:
    return f"CAST('0x' || substr(md5(row_id || '|{seed}'), 1, 15) AS BIGINT)"


def _permuted_sql(feature: int, repeat: int) -> str:
    seed, c = 7919 * feature + repeat, _PERMUTED[feature]
    return f"""SELECT '{c}' AS feature, {repeat} AS rep, avg(abs(a.price - {predicted([f"b.{c}" if x == c else f"a.{x}" for x in _PERMUTED], "ls")})) AS m
  FROM (SELECT *, row_number() OVER (ORDER BY {_hash_sql(seed)}, row_id) AS rk FROM d) a
  JOIN (SELECT {c}, row_number() OVER (ORDER BY {_hash_sql(seed + 1_000_003)}, row_id) AS rk FROM d) b USING (rk), ls"""


@query("J20", rnd="importance_mean importance_std", sql=f"""
WITH d AS (SELECT *, 1 AS one, series || '|' || settlement_date AS row_id FROM ({_LAGGED}) WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ["price", *_PERMUTED])}),
{least_squares("ls", "d", _PERMUTED, "price", ["one"])},
base AS (SELECT avg(abs(price - {predicted(_PERMUTED, "ls")})) AS m0 FROM d, ls),
cells AS ({" UNION ALL ".join(_permuted_sql(i, r) for i in range(len(_PERMUTED)) for r in range(3))})
SELECT feature, avg(m - m0) AS importance_mean, stddev_pop(m - m0) AS importance_std FROM cells, base GROUP BY 1""")
def permutation_importance(t: Tables):
    d = daily_model_table(t).select("series", "settlement_date", "price", *_PERMUTED).dropna()
    d = materialise(d.withColumn("row_id", F.concat_ws("|", "series", "settlement_date")), "perm")
    beta = L.grouped_least_squares(d, [], _PERMUTED, "price").select("beta").scalar()
    return L.permutation_importance(d, lambda rows: rows.withColumn("beta", beta).withColumn("pred", L.linear_predict(_PERMUTED)), _PERMUTED, "price")


@query("J20", sql="""
SELECT count(*) AS n, round(sum(CAST(round(price, 6) AS DECIMAL(18,6))), 6)::DOUBLE AS total, count(DISTINCT price) AS n_values FROM c_daily_prio""")
def column_permuted(t: Tables):
    """A permuted column keeps every value exactly once."""
    d = I.daily_orders(t, by_priority=True).select("price", F.concat_ws("|", "series", "settlement_date").alias("row_id"))
    s = L.shuffled(d, "price", 42)
    return s.agg(F.count("*").alias("n"), F.round(F.sum(F.round("price", 6).cast("decimal(18,6)")), 6).cast("double").alias("total"),
                 F.count_distinct("price").alias("n_values"))


@query("J25 J26 J24", rnd="ssp_lag_48 ssp_lag_336 same_sp_mean_7d ssp_diff_48_336", sql="""
WITH x AS (SELECT series, max(day_ix) + 1 AS day_ix FROM c_panel_type GROUP BY 1),
g AS (SELECT x.series, x.day_ix, CAST(sp AS INTEGER) AS settlement_period FROM x CROSS JOIN (SELECT unnest(range(1, 49)) AS sp)),
w AS (SELECT g.series, g.settlement_period, g.day_ix, avg(p.ssp) AS m FROM g LEFT JOIN c_panel_type p ON p.series = g.series
  AND p.settlement_period = g.settlement_period AND p.day_ix BETWEEN g.day_ix - 7 AND g.day_ix - 1 GROUP BY 1, 2, 3)
SELECT w.series, CAST(DATE '1970-01-01' + CAST(w.day_ix AS INTEGER) AS DATE) AS settlement_date, w.settlement_period, a.ssp AS ssp_lag_48, b.ssp AS ssp_lag_336,
  m AS same_sp_mean_7d, a.ssp - b.ssp AS ssp_diff_48_336 FROM w
LEFT JOIN c_panel_type a ON a.series = w.series AND a.settlement_period = w.settlement_period AND a.day_ix = w.day_ix - 1
LEFT JOIN c_panel_type b ON b.series = w.series AND b.settlement_period = w.settlement_period AND b.day_ix = w.day_ix - 7""")
def target_day_features(t: Tables):
    """The training feature functions run over history plus the empty rows of the day to forecast."""
    p = I.panel(t, by_type=True).withColumns({"ssp_raw": F.col("ssp"), "is_spike": F.lit(False)})
    g = L.target_grid(p)
    f = FT.same_slot_week(FT.slot_history(g, [FT.price_lags])).where("is_target")
    return f.select("series", *KEY, "ssp_lag_48", "ssp_lag_336", "same_sp_mean_7d", "ssp_diff_48_336")
