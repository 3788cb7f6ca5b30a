"""Intraday bias correction: flat shift and scalar Kalman filter, replayed per day in one fold.

The filter is sequential inside a day and independent between days, so a day's
hourly observations (at most ten) become an array that ``aggregate`` folds
inside the JVM; days and series run in parallel. The streaming twin in
``slotwise.streaming`` uses the same transition on keyed state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import scoring as S
from slotwise.functions.keys import ratio

# Replay schedule, filter defaults, guardrail and tuning grids.
STEPS = 10
FIRST_SETTLED = 17
SETTLED_PER_STEP = 2
SLOTS = 48
Q_NOISE = 5.0
SIGMA_SP = 20.0
GAMMA = 0.98
Z_BAND = 1.28
GUARDRAIL = 500.0
ALPHA_SHIFT = 0.4
DEAD_BAND = 0.5
Q_GRID = (5.0, 10.0, 21.0, 35.0, 50.0, 100.0)
SIGMA_GRID = (20.0, 28.0, 35.0, 45.0, 55.0)
MIN_SETTLED_NIS = 3


def settled_until(h: int) -> int:
    return min(FIRST_SETTLED + SETTLED_PER_STEP * h, SLOTS)


def day_observations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per day the array of hourly observations (h, mean error z, settled count n, latest settled slot)."""
    err = F.col("actual") - F.col("q50")
    steps = []
    for h in range(STEPS):
        settled = F.col("settlement_period") <= settled_until(h)
        steps.append(F.struct(
            F.lit(h).alias("h"), F.avg(F.when(settled, err)).alias("z"),
            F.count(F.when(settled, err)).alias("n"),
            F.max(F.when(settled, F.col("settlement_period"))).alias("last_sp")))
    return df.groupBy(*keys).agg(F.array(*steps).alias("obs"))


def _step(acc: Column, o: Column, q: Column, sigma: Column) -> Column:
    """One predict/update; an empty or anomalous observation leaves the state as it was."""
    r = sigma * sigma / F.nullif(o["n"], F.lit(0))
    prior = acc["p"] + q
    s = prior + r
    gain = prior / s
    use = (o["n"] > 0) & (F.abs(o["z"]) <= GUARDRAIL)
    x = F.when(use, acc["x"] + gain * (o["z"] - acc["x"])).otherwise(acc["x"])
    p = F.when(use, (1 - gain) * prior).otherwise(acc["p"])
    nis = F.when(o["n"] >= MIN_SETTLED_NIS, F.pow(o["z"] - acc["x"], 2) / s)
    row = F.struct(o["h"].alias("h"), o["z"].alias("z"), o["n"].alias("n"), o["last_sp"].alias("last_sp"),
                   x.alias("x"), p.alias("p"), nis.alias("nis"))
    return F.struct(x.alias("x"), p.alias("p"), F.concat(acc["path"], F.array(row)).alias("path"))


_PATH = "array<struct<h:int,z:double,n:bigint,last_sp:int,x:double,p:double,nis:double>>"


def filter_path(obs: Column, q: Column, sigma: Column) -> Column:
    """State after every hourly step of a day, starting from x = 0, P = sigma^2."""
    start = F.struct(F.lit(0.0).alias("x"), (sigma * sigma).alias("p"), F.from_json(F.lit("[]"), _PATH).alias("path"))
    return F.aggregate(obs, start, lambda acc, o: _step(acc, o, q, sigma), lambda acc: acc["path"])


def filter_states(df: DataFrame, keys: Sequence[str], q: float = Q_NOISE, sigma: float = SIGMA_SP) -> DataFrame:
    obs = day_observations(df, keys)
    return obs.select(*keys, filter_path(F.col("obs"), F.lit(q), F.lit(sigma)).alias("path"))


def corrected(q10, q50, q90, x: Column, p: Column, pos: Column, gamma: float = GAMMA) -> dict[str, Column]:
    """Decayed shift and widening for the open slot ``pos`` steps after the latest settled one, kept in order."""
    decay = F.pow(F.lit(gamma), pos)
    mid = F.col(q50) + x * decay
    unsure = F.sqrt(p) * Z_BAND * decay
    return {"q10": F.least(F.col(q10) + x * decay - unsure, mid), "q50": mid,
            "q90": F.greatest(F.col(q90) + x * decay + unsure, mid)}


def replay(df: DataFrame, keys: Sequence[str] = ("series", "settlement_date", "fold"), q: float = Q_NOISE,
           sigma: float = SIGMA_SP, gamma: float = GAMMA) -> DataFrame:
    """Every open slot at every hourly step under three correctors: unchanged, flat shift, filter."""
    keys = list(keys)
    d = df.join(filter_states(df, keys, q, sigma), keys).withColumn("_s", F.explode("path")).drop("path")
    d = d.where(F.col("settlement_period") > F.least(F.col("_s.h") * SETTLED_PER_STEP + FIRST_SETTLED, F.lit(SLOTS)))
    seen = F.coalesce(F.col("_s.last_sp"), F.lit(0))
    kal = corrected("q10", "q50", "q90", F.col("_s.x"), F.col("_s.p"), F.col("settlement_period") - seen - 1, gamma)
    shift = F.coalesce(F.col("_s.z") * ALPHA_SHIFT, F.lit(0.0))
    shift = F.when(F.abs(shift) > DEAD_BAND, shift).otherwise(0.0)
    bands = {
        "static": {c: F.col(c) for c in ("q10", "q50", "q90")},
        "alpha": {c: F.col(c) + shift for c in ("q10", "q50", "q90")},
        "kalman": kal,
    }
    rows = F.array(*[F.struct(F.lit(n).alias("corrector"), *[v.alias(f"pred_{c}") for c, v in b.items()])
                     for n, b in bands.items()])
    extra = [c for c in ("price_derivation_code", "spike_risk_flag") if c in df.columns]
    return d.select(*keys, "settlement_period", F.col("_s.h").alias("h"), "actual", *extra, F.inline(rows))


def replay_scores(sim: DataFrame) -> DataFrame:
    from slotwise.operators.metrics import score_rollup
    return score_rollup(sim, "corrector", "fold", {
        "mae": S.mae("actual", "pred_q50"), "rmse": S.rmse("actual", "pred_q50"),
        "coverage": S.coverage_pct("actual", "pred_q10", "pred_q90"), "bias": F.avg(F.col("actual") - F.col("pred_q50"))})


def nis_grid(df: DataFrame, keys: Sequence[str] = ("series", "settlement_date", "fold"), qs: Sequence[float] = Q_GRID,
             sigmas: Sequence[float] = SIGMA_GRID) -> DataFrame:
    """Mean normalised innovation per (Q, sigma, fold).

    The grid runs over day arrays (one per day), not over slot rows, and leaves
    out the decay, which the innovation does not depend on.
    """
    obs = day_observations(df, keys)
    grid = F.array(*[F.struct(F.lit(float(q)).alias("q_noise"), F.lit(float(s)).alias("sigma_sp")) for q in qs for s in sigmas])
    d = obs.withColumn("_g", F.explode(grid))
    path = filter_path(F.col("obs"), F.col("_g.q_noise"), F.col("_g.sigma_sp"))
    nis = F.transform(path, lambda r: r["nis"])
    kept = F.filter(nis, lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    return d.select("_g.*", "fold", total.alias("s"), F.size(kept).alias("k")).groupBy("q_noise", "sigma_sp", "fold").agg(
        F.sum("k").alias("n"), ratio(F.sum("s"), F.sum("k")).alias("mean_nis"), F.sum("s").alias("sum_nis"))


def best_filter(grid: DataFrame) -> DataFrame:
    """Parameters whose pooled mean innovation is nearest 1 (the grid has 30 cells)."""
    g = grid.groupBy("q_noise", "sigma_sp").agg(ratio(F.sum("sum_nis"), F.sum("n")).alias("mean_nis"))
    return g.agg(F.min_by(F.struct("q_noise", "sigma_sp", "mean_nis"),
                          F.struct(F.abs(F.col("mean_nis") - 1), "q_noise", "sigma_sp")).alias("b")).select("b.*")


def nis_verdict(grid: DataFrame, best: DataFrame) -> DataFrame:
    """Structural reading of the innovations of the chosen parameters."""
    g = grid.join(F.broadcast(best.select("q_noise", "sigma_sp")), ["q_noise", "sigma_sp"], "left_semi")
    a = g.agg(ratio(F.sum("sum_nis"), F.sum("n")).alias("mean_nis"), F.min("mean_nis").alias("lowest"), F.max("mean_nis").alias("highest"))
    return a.withColumn("verdict", F.when(F.col("lowest") > 1.15, "over-confident").when(F.col("highest") < 0.85, "under-confident")
                        .when(F.col("mean_nis").between(0.85, 1.15), "well-calibrated").otherwise("mixed"))


def slot_bias_removed(df: DataFrame, bias: DataFrame, keys: Sequence[str] = ("settlement_period",)) -> DataFrame:
    """Per-slot bias taken off before filtering; the bias table grows with folds and series, so the join is left to adaptive execution."""
    b = bias.select(*keys, F.col("median_bias").alias("_b"))
    d = df.join(b, list(keys), "left")
    return d.withColumns({c: F.col(c) + F.coalesce("_b", F.lit(0.0)) for c in ("q10", "q50", "q90")}).drop("_b")
