import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from slotwise.functions.keys import ahead_date, ahead_period
from slotwise.operators import calibrate as CB
from slotwise.operators import correct as K
from slotwise.operators import features as FT
from slotwise.operators import joins as J
from slotwise.operators import learn as L
from slotwise.operators import monitor as MO
from slotwise.operators import nowcast as N
from slotwise.session import fresh_path
from slotwise.sources import increments as INC
from slotwise.streaming import corrector as SC
from slotwise.streaming import feeds as SF

DAY = dt.date(2026, 6, 24)


def flat(spark, err=None):
    err = err or {}
    rows = [("a", DAY, p, "f", 80.0 + err.get(p, 0.0), 70.0, 80.0, 90.0) for p in range(1, 49)]
    return spark.createDataFrame(rows, "series STRING, settlement_date DATE, settlement_period INT, fold STRING, actual DOUBLE, q10 DOUBLE, q50 DOUBLE, q90 DOUBLE")


def brute(errs, q=5.0, sigma=20.0):
    x, p, out = 0.0, sigma * sigma, []
    for h in range(10):
        s = errs[: min(17 + 2 * h, 48)]
        z, n = sum(s) / len(s), len(s)
        pm = p + q
        g = pm / (pm + sigma * sigma / n)
        x, p = x + g * (z - x), (1 - g) * pm
        out.append((x, p))
    return out


def test_batch_fold_matches_recursion(spark):
    errs = [((i * 37) % 23) - 9.0 for i in range(48)]
    s = K.filter_states(flat(spark, {i + 1: e for i, e in enumerate(errs)}), ["settlement_date"]).first().path
    for got, (x, p) in zip(s, brute(errs)):
        assert got.x == pytest.approx(x) and got.p == pytest.approx(p)


def test_guardrail_leaves_state(spark):
    s = K.filter_states(flat(spark, {p: 10_000.0 for p in range(1, 49)}), ["settlement_date"]).first().path
    assert all(r.x == 0.0 and r.p == 400.0 for r in s)


def test_corrected_bands_stay_ordered(spark):
    sim = K.replay(flat(spark, {p: 40.0 for p in range(1, 18)}))
    assert sim.where("pred_q10 > pred_q50 or pred_q50 > pred_q90").isEmpty()
    assert sim.where("corrector = 'static' and pred_q50 <> 80").isEmpty()


def _stream(spark, runs):
    """One micro-batch per landed run, restarted from the same checkpoint each time."""
    land, sink = fresh_path(spark, "land"), fresh_path(spark, "sink")
    schema = "series STRING, settlement_date DATE, settlement_period INT, run INT, actual DOUBLE, q50 DOUBLE"
    for i, slots in enumerate(runs):
        spark.createDataFrame([("a", DAY, p, i, 90.0, 80.0) for p in slots], schema).coalesce(1).write.mode("append").parquet(land)
        SF.run_updates(SC.track_bias(SF.landed_stream(spark, land, spark.read.parquet(land).schema)), sink, f"{sink}-ck", mode="append")
    return spark.read.parquet(sink).orderBy("run").collect()


def test_stream_out_of_order_and_idempotent(spark):
    a, b, c = _stream(spark, [[1, 2, 3], [1, 2, 3], [5]])
    assert (a.n, a.updated) == (3, True)
    assert (b.n, b.updated, b.x, b.p) == (3, False, a.x, a.p)
    assert (c.n, c.updated, c.last_sp, c.settled) == (4, True, 5, [1, 2, 3, 5])


def test_nowcast_rollover(spark):
    d = spark.createDataFrame([(DAY, sp, h) for sp in (46, 47, 48) for h in (1, 2, 3)], "d DATE, sp INT, h INT")
    r = {(x.sp, x.h): (x.dd, x.p) for x in d.select("sp", "h", ahead_date("d", "sp", "h").alias("dd"), ahead_period("sp", "h").alias("p")).collect()}
    nxt = DAY + dt.timedelta(1)
    assert r[(46, 1)] == (DAY, 47) and r[(46, 3)] == (nxt, 1) and r[(48, 1)] == (nxt, 1) and r[(48, 3)] == (nxt, 3)


def test_nowcast_band_by_horizon(spark):
    bands = spark.createDataFrame([(h, g, -10.0 * h, 10.0 * h, 5) for h in (1, 2, 3) for g in ("overall", "NP")],
                                  "h INT, regime STRING, p10 DOUBLE, p90 DOUBLE, n INT")
    last = spark.createDataFrame([("a", DAY, 48, 95.0, "P")], "series STRING, settlement_date DATE, settlement_period INT, ssp DOUBLE, price_derivation_code STRING")
    r = {x.h: x for x in N.nowcast(last, bands).collect()}
    assert [(r[h].q10, r[h].q90, r[h].target_period) for h in (1, 2, 3)] == [(85.0, 105.0, 1), (75.0, 115.0, 2), (65.0, 125.0, 3)]


@pytest.mark.parametrize("widened,n_open,want", [(True, 48, "pass"), (False, 48, "fail"), (False, 5, "skip"), (False, 6, "fail"), (True, 6, "pass")])
def test_band_guard(spark, widened, n_open, want):
    delta = spark.createDataFrame([(p, float(p % 13)) for p in range(1, 49)], "settlement_period INT, delta DOUBLE")
    rows = [(DAY, p, -20.0 - (p % 13 if widened else 0), 0.0, 20.0 + (p % 13 if widened else 0), p > n_open) for p in range(1, 49)]
    f = spark.createDataFrame(rows, "settlement_date DATE, settlement_period INT, q10 DOUBLE, q50 DOUBLE, q90 DOUBLE, is_actual BOOLEAN")
    g = CB.band_guard(f, delta, ["settlement_date"])
    assert g.first().verdict == want
    checked = CB.enforce_band_guard(f, g, ["settlement_date"])
    if want == "fail":
        with pytest.raises(Exception, match="lacks its calibration"):
            checked.collect()
    else:
        assert checked.count() == 48


def test_conformal_coverage_on_own_sample(spark):
    rows = [(DAY + dt.timedelta(d), p, float((d * 7 + p * 3) % 40), 10.0, 15.0, 20.0) for d in range(30) for p in range(1, 5)]
    f = spark.createDataFrame(rows, "settlement_date DATE, settlement_period INT, actual DOUBLE, q10 DOUBLE, q50 DOUBLE, q90 DOUBLE")
    c = CB.calibrated(f).groupBy("settlement_period").agg(F.avg(F.col("actual").between(F.col("lo"), F.col("hi")).cast("int")).alias("c"))
    assert all(r.c >= 0.8 - 1 / 30 for r in c.collect())


def _health(spark, now, n_actual=42, last=42, upd="2026-06-24 13:00:00", corrected=42, fc=DAY):
    d = spark.createDataFrame([(fc, n_actual, last, DAY, upd, corrected)], "fc_date DATE, n_actual INT, last_sp INT, state_date DATE, u STRING, n_corrected INT")
    d = d.withColumn("state_update", F.col("u").cast("timestamp_ntz")).drop("u")
    return MO.freshness(d, F.lit(now).cast("timestamp_ntz")).first()


def test_freshness_classes(spark):
    assert _health(spark, "2026-06-24 20:30:00").health == "stale"
    assert _health(spark, "2026-06-24 20:30:00", upd="2026-06-24 20:00:00").health == "ok"
    late = _health(spark, "2026-06-24 20:30:00", last=27, n_actual=27, corrected=27, upd="2026-06-24 20:00:00")
    assert late.health == "delayed" and late.inconsistency == "none"
    assert _health(spark, "2026-06-24 15:00:00", fc=DAY - dt.timedelta(1)).health == "daily_missed"
    assert _health(spark, "2026-06-24 20:30:00", upd="2026-06-24 20:00:00", corrected=38).inconsistency == "B"
    assert _health(spark, "2026-06-24 20:30:00", upd="2026-06-24 20:00:00", n_actual=0, last=0, corrected=5).inconsistency == "A"


def test_frontier_stops_at_first_hole(spark):
    d = spark.createDataFrame([(DAY, p) for p in [*range(1, 28), *range(29, 43)]], "settlement_date DATE, settlement_period INT")
    r = MO.contiguous_frontier(d, ["settlement_date"]).first()
    assert (r.frontier, r.latest, r.n_settled) == (27, 42, 41)


def test_as_of_window_closed_at_both_ends(spark):
    ts = "timestamp_ntz"
    t = spark.createDataFrame([(1, dt.date(2026, 1, 10))], "k INT, target_date DATE")

    def latest(*times):
        p = spark.createDataFrame([(1, x, i) for i, x in enumerate(times)], "k INT, s STRING, v INT").withColumn("published", F.col("s").cast(ts))
        return J.as_of(t, p.drop("s"), ["k"], "target_date", "published", ["v"]).first().v

    assert latest("2026-01-08 12:00:00", "2026-01-08 11:59:59") == 0
    assert latest("2026-01-09 12:00:00", "2026-01-09 12:00:01", "2026-01-09 11:00:00") == 0
    assert latest("2026-01-09 12:00:01") is None


def test_selectors_never_reach_into_the_open_day():
    cols = [*FT.REACH, "ssp", "ssp_raw", "net_imbalance_volume", "mid_price", "wind_pct", *FT.CALENDAR]
    h1, h2 = FT.features_known(cols, 48), FT.features_known(cols, 96)
    assert not {"ssp", "ssp_raw", "wind_pct", "mid_price", "ssp_lag_1", "ssp_roll_mean_48", "wind_ramp_6"} & set(h1)
    assert "ssp_lag_48" in h1 and "spike_count_roll_7d" in h1
    assert set(h2) < set(h1) and "ssp_lag_48" not in h2 and "ssp_lag_96" in h2 and "same_sp_mean_7d" not in h2


def test_partition_merge_touches_only_new_days(spark):
    path = fresh_path(spark, "t")
    schema = "settlement_date DATE, settlement_period INT, ssp DOUBLE"
    d1, d2 = dt.date(2026, 1, 1), dt.date(2026, 1, 2)
    spark.createDataFrame([(d1, 1, 1.0), (d2, 1, 2.0)], schema).write.partitionBy("settlement_date").parquet(path)
    INC.merge_into(spark, path, spark.createDataFrame([(d2, 1, 9.0), (d2, 2, 3.0)], schema), ["settlement_date", "settlement_period"], "settlement_date")
    got = sorted((r.settlement_date, r.settlement_period, r.ssp) for r in spark.read.parquet(path).collect())
    assert got == [(d1, 1, 1.0), (d2, 1, 9.0), (d2, 2, 3.0)]


def test_reweighted_fits_meet_their_loss(spark):
    """Shares below the fitted quantiles, and the balanced logistic fit's own equations, in two groups of unlike noise."""
    r = np.random.default_rng(12)
    n = 4000
    x = r.uniform(0, 10, n)
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 2 == 0, "a", None), "x": x, "y": 5 + 2 * x + r.exponential(3, n) * (1 + np.arange(n) % 2)})
    pdf["c"] = (pdf.y + r.normal(0, 8, n) > 18).astype(float)
    d = spark.createDataFrame(pdf)
    fit = {row.g: row for row in L.reweighted_fits(d, ["g"], ["x"], "y", {"lo": L.quantile_loss(0.1), "hi": L.quantile_loss(0.9)}).collect()}
    assert set(fit) == {"a", None}
    for g, row in fit.items():
        part = pdf[pdf.g.isna()] if g is None else pdf[pdf.g == g]
        for beta, p in ((row.lo, 0.1), (row.hi, 0.9)):
            assert abs((part.y < beta[0] + beta[1] * part.x).mean() - p) < 0.02 and row.n_train == 2000
    # Both slopes follow the spread: the upper quantile of the noisier group lies higher.
    assert fit[None].hi[0] > fit["a"].hi[0] + 4
    share = spark.createDataFrame(pdf.assign(g="all", share=pdf.c.mean()))
    beta = L.reweighted_fits(share, ["g"], ["x"], "c", {"cl": L.class_loss("share")}, rounds=12).first().cl
    p = 1 / (1 + np.exp(-(beta[0] + beta[1] * pdf.x)))
    w = np.where(pdf.c > 0, 0.5 / pdf.c.mean(), 0.5 / (1 - pdf.c.mean()))
    assert abs((w * (pdf.c - p)).mean()) < 1e-6 and abs((w * (pdf.c - p) * pdf.x).mean()) < 1e-6


def test_day_score_ships_no_model_and_equals_the_fitted_one(spark):
    """The scoring plan holds no function object to send; missing values, a column without spread and one class in training."""
    r = np.random.default_rng(4)
    x = r.normal(0, 3, 400)
    rows = [(i, None if i % 9 == 0 else float(v), 7, int(v + r.normal() > 1)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "i int, x double, flat int, y int")
    train, later = d.where("i < 300"), d.where("i >= 300")
    s = L.day_probability(train, later, ["x", "flat"], "y", "p")
    assert "UDF" not in s._jdf.queryExecution().executedPlan().toString()
    got = {row.i: row.p for row in s.collect()}
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True)
    model = Pipeline(stages=[scaled, LogisticRegression(featuresCol="z", labelCol="y", weightCol="_w", regParam=0.01, maxIter=100)]).fit(L.balanced(L.assemble(train, ["x", "flat"]), "y"))
    want = {row.i: float(row.probability[1]) for row in model.transform(L.assemble(later, ["x", "flat"], train)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    one = L.day_probability(train.where("y = 1"), later, ["x", "flat"], "y", "p")
    assert {row.p for row in one.collect()} == {1.0}
