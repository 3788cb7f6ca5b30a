"""Conformal bands: per-slot widening, upper widening on risk days, gates and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import scoring as S
from slotwise.functions.keys import ratio
from slotwise.operators.ordered import exact_quantiles, quantiles_of_others


def conformal_score(y="actual", lo="q10", hi="q90") -> Column:
    """How far the outcome fell outside the band (negative inside)."""
    return F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))


def conformal_delta(df: DataFrame, keys: Sequence[str], target: float = 0.8, out: str = "delta") -> DataFrame:
    """Half-widening per key: the target quantile of the scores, floored at 0.

    A slot pools every series and day, so its quantile goes through the
    distributed primitive rather than a per-group value table.
    """
    d = exact_quantiles(df.select(*keys, conformal_score().alias("_score")), keys, "_score", {"_d": target})
    return d.select(*keys, F.greatest("_d", F.lit(0.0)).alias(out))


def global_delta(df: DataFrame, target: float = 0.8, out: str = "delta_global") -> DataFrame:
    """One widening for all rows, through the distributed quantile."""
    q = exact_quantiles(df.select(conformal_score().alias("s")), [], "s", {"d": target})
    return q.select(F.greatest("d", F.lit(0.0)).alias(out))


def widen(df: DataFrame, delta: DataFrame, key: str = "settlement_period", default: Column | None = None) -> DataFrame:
    """Apply a per-slot widening; slots without a parameter get the default (0 unless given).

    The parameter table has at most 50 rows (one per slot), so it is broadcast.
    """
    d = df.join(F.broadcast(delta), key, "left").withColumn(
        "delta", F.coalesce("delta", default if default is not None else F.lit(0.0)))
    return d.withColumns({"lo": F.col("q10") - F.col("delta"), "hi": F.col("q90") + F.col("delta")})


def calibrated(df: DataFrame) -> DataFrame:
    return widen(df, conformal_delta(df, ["settlement_period"]))


def calibration_report(df: DataFrame) -> DataFrame:
    """Coverage and interval score of the raw, per-slot, global and fixed-width bands.

    The four bands sit side by side on each row; one aggregate row is unpivoted.
    """
    d = calibrated(df)
    half = d.agg(F.avg((F.col("hi") - F.col("lo")) / 2)).scalar()
    d = d.withColumns({"delta_global": global_delta(df).scalar(), "fixed_half": half})
    bands = {
        "raw": (F.col("q10"), F.col("q90")),
        "per_slot": (F.col("lo"), F.col("hi")),
        "global": (F.col("q10") - F.col("delta_global"), F.col("q90") + F.col("delta_global")),
        "fixed": (F.col("q50") - F.col("fixed_half"), F.col("q50") + F.col("fixed_half")),
    }
    rows = [F.struct(
        F.lit(b).alias("band"), S.coverage_pct("actual", lo, hi).alias("coverage"), F.avg(hi - lo).alias("width"),
        F.avg(S.interval_score("actual", lo, hi)).alias("interval_score"),
        ((F.avg(S.pinball("actual", lo, 0.1)) + F.avg(S.pinball("actual", hi, 0.9))) / 2).alias("pinball"),
    ) for b, (lo, hi) in bands.items()]
    return d.agg(F.array(*rows).alias("r"), F.count("*").alias("n")).select("n", F.inline("r"))


def conditioned_delta_check(df: DataFrame, keys: Sequence[str], fold: str = "fold", target: float = 0.8) -> DataFrame:
    """Leave-one-fold-out coverage of a widening conditioned on ``keys``."""
    scores = df.select(fold, *keys, conformal_score().alias("_score"))
    learnt = quantiles_of_others(scores, keys, fold, "_score", {"_d": target}).select(
        fold, *keys, F.greatest("_d", F.lit(0.0)).alias("delta"))
    d = df.join(learnt, [fold, *keys], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    lo, hi = F.col("q10") - F.col("delta"), F.col("q90") + F.col("delta")
    return d.groupBy(fold).agg(F.count("*").alias("n"), S.coverage_pct("actual", "q10", "q90").alias("before"),
                               S.coverage_pct("actual", lo, hi).alias("after"))


def risky_slots(df: DataFrame, limit: float = 150.0, share: float = 0.02, first: int = 33, last: int = 40) -> DataFrame:
    """Afternoon slots where the outcome exceeds the limit often enough (at most 8 rows)."""
    g = df.where(F.col("settlement_period").between(first, last)).groupBy("settlement_period").agg(
        F.avg((F.col("actual") > limit).cast("int")).alias("propensity"))
    return g.where(F.col("propensity") >= share)


def upper_widening(df: DataFrame, elevated: float = 120.0, q: float = 0.8, min_n: int = 10, **slots) -> DataFrame:
    """Extra upper widening per slot: a quantile of the exceedances over the calibrated band in risky slots.

    0 where the slot is not risky or there are fewer than ``min_n`` exceedances.
    """
    d = calibrated(df)
    risky = risky_slots(df, **slots)
    over = d.join(F.broadcast(risky), "settlement_period", "left_semi").where(F.col("actual") > elevated).select(
        (F.col("actual") - F.col("hi")).alias("s")).where("s > 0")
    n = over.agg(F.count("*")).scalar()
    block = F.coalesce(exact_quantiles(over, [], "s", {"d": q}).scalar(), F.lit(0.0))
    all_slots = df.sparkSession.range(1, 49).select(F.col("id").cast("int").alias("settlement_period"))
    flagged = all_slots.join(F.broadcast(risky), "settlement_period", "left")
    use = F.col("risky") & (F.col("n_exceed") >= min_n)
    return flagged.select("settlement_period", F.col("propensity").isNotNull().alias("risky"), n.alias("n_exceed")).select(
        "settlement_period", "risky", F.when(use, block).otherwise(0.0).alias("delta_hi"), "n_exceed")


def apply_upper_widening(df: DataFrame, delta_hi: DataFrame, p: str, tau: float, hi: str = "hi") -> DataFrame:
    """Raise the upper bound by the slot's extra widening on days whose risk score exceeds ``tau``."""
    d = df.join(F.broadcast(delta_hi.select("settlement_period", "delta_hi", "risky")), "settlement_period", "left")
    extra = F.when(F.col(p) > tau, F.coalesce("delta_hi", F.lit(0.0))).otherwise(0.0)
    return d.withColumn(f"{hi}_wide", F.col(hi) + extra)


def widening_sweep(df: DataFrame, delta_hi: DataFrame, p: str, taus: Sequence[float], elevated: float = 120.0) -> DataFrame:
    """Gate results per threshold.

    Rows first collapse to per-(score, flags) counts: everything a gate needs
    is a count, so the thresholds are evaluated on the collapsed table (one row
    per distinct day score) instead of on a copy of the data per threshold.
    """
    d = df.join(F.broadcast(delta_hi.select("settlement_period", "delta_hi", "risky")), "settlement_period", "left")
    in_band = (F.col("actual") >= F.col("lo")) & (F.col("actual") <= F.col("hi"))
    in_wide = (F.col("actual") >= F.col("lo")) & (F.col("actual") <= F.col("hi") + F.coalesce("delta_hi", F.lit(0.0)))
    cells = d.groupBy(F.col(p).alias("_p"), F.coalesce("risky", F.lit(False)).alias("_risky"),
                      (F.col("actual") > elevated).alias("_high")).agg(
        F.count("*").alias("n"), F.count_if(in_band).alias("k"), F.count_if(in_wide).alias("kw"))
    grid = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    c = cells.select("*", grid)
    up = F.coalesce(F.col("_p") > F.col("tau"), F.lit(False))
    g1, g1b = up & F.col("_risky") & F.col("_high"), up & F.col("_risky") & ~F.col("_high")

    def tot(c, cond):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    # What is covered after widening: only days above the threshold get the wider bound.
    after = F.when(up, F.col("kw")).otherwise(F.col("k"))
    r = c.withColumn("after", after).groupBy("tau").agg(
        tot("n", g1).alias("g1_n"), ratio(tot("kw", g1) * 100.0 - tot("k", g1) * 100.0, tot("n", g1)).alias("g1_lift"),
        tot("n", g1b).alias("g1b_n"), ratio(tot("kw", g1b) * 100.0, tot("n", g1b)).alias("g1b_cov"),
        tot("n", ~up).alias("g2_n"), ratio((tot("after", ~up) - tot("k", ~up)) * 100.0, tot("n", ~up)).alias("g2_change"))
    p1 = (F.col("g1_n") > 0) & (F.col("g1_lift") >= 5.0)
    p1b = (F.col("g1b_n") == 0) | (F.col("g1b_cov") <= 82.0)
    p2 = F.coalesce(F.abs("g2_change") <= 0.5, F.lit(False))
    return r.withColumn("all_pass", F.coalesce(p1 & p1b & p2, F.lit(False)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Passing threshold with the largest lift; without one, the largest lift (informational)."""
    order = F.struct(F.col("all_pass"), F.coalesce("g1_lift", F.lit(-999.0)), -F.col("tau"))
    return sweep.agg(F.max_by("tau", order).alias("best_tau"), F.max("all_pass").alias("any_pass"))


def band_guard(df: DataFrame, delta: DataFrame, keys: Sequence[str], max_rest: float = 1.5, min_spread: float = 3.0,
               min_open: int = 6, settled: str = "is_actual") -> DataFrame:
    """Whether a published band really carries the per-slot widening.

    A widened band's spread varies like 2 delta around a flat base, so removing
    2 delta must leave an almost constant spread. Fewer than ``min_open`` open
    rows decide nothing (skip).
    """
    d = df.where(~F.col(settled)).join(F.broadcast(delta), "settlement_period", "left")
    spread = F.col("q90") - F.col("q10")
    rest = spread - F.coalesce("delta", F.lit(0.0)) * 2
    g = d.groupBy(*keys).agg(F.count("*").alias("n_open"), F.stddev_pop(spread).alias("spread_std"),
                             F.stddev_pop(rest).alias("rest_std"))
    ok = (F.col("rest_std") < max_rest) & (F.col("spread_std") > min_spread)
    return g.withColumn("verdict", F.when(F.col("n_open") < min_open, "skip").when(ok, "pass").otherwise("fail"))


def enforce_band_guard(df: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stop the write when a group failed the guard."""
    j = df.join(verdicts.select(*keys, "verdict"), list(keys), "left")
    bad = F.col("verdict") == "fail"
    return j.withColumn("q50", F.when(bad, F.raise_error(F.lit("published band lacks its calibration")).cast("double"))
                        .otherwise(F.col("q50"))).drop("verdict")
