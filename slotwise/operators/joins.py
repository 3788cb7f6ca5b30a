"""Feed joins: weather, generation, price index, provider prices, as-of vintages, splices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.keys import ratio
from slotwise.operators.series import fill_forward

KEY = ["settlement_date", "settlement_period"]


def vwap(trades: DataFrame, keys: Sequence[str], price: str = "price", volume: str = "volume") -> DataFrame:
    """Volume-weighted price per key; the plain mean where no volume was reported."""
    v = F.coalesce(F.col(volume), F.lit(0))
    g = trades.where(F.col(price).isNotNull()).groupBy(*keys).agg(
        F.sum(F.col(price) * v).cast("double").alias("_pv"), F.sum(v).cast("double").alias("mid_volume"),
        (F.sum(price).cast("double") / F.count("*")).alias("_mean"))
    vw = F.when(F.col("mid_volume") > 0, ratio("_pv", "mid_volume")).otherwise(F.col("_mean"))
    return g.select(*keys, vw.alias("mid_price"), "mid_volume")


# Ex-ante spike risk rule.
ELEVATED = 120.0
ELEVATED_MIN = 5
LOW_WIND = 10.0
RISK_MONTHS = (3, 4, 5, 9, 10, 11)


def risk_days(df: DataFrame, keys: Sequence[str] = ("series",), wind: str = "wind_pct") -> DataFrame:
    """Day flag from the day before: many elevated slots, or little wind in a risk month.

    The previous day is found by shifting the date key, so a missing day gives
    no flag rather than the flag of an older day; missing wind counts as ample.
    """
    d = df.groupBy(*keys, "settlement_date").agg(
        F.count_if(F.col("ssp") > ELEVATED).alias("elevated"), F.avg(wind).alias("wind"))
    prev = d.select(*keys, F.date_add("settlement_date", 1).alias("settlement_date"),
                    F.col("elevated").alias("elevated_count_lag1d"), F.col("wind").alias("wind_pct_lag1d"))
    j = d.select(*keys, "settlement_date").join(prev, [*keys, "settlement_date"], "left").withColumns({
        "elevated_count_lag1d": F.coalesce("elevated_count_lag1d", F.lit(0)),
        "wind_pct_lag1d": F.coalesce("wind_pct_lag1d", F.lit(100.0)),
    })
    calm = (F.col("wind_pct_lag1d") < LOW_WIND) & F.month("settlement_date").isin(*RISK_MONTHS)
    return j.withColumn("spike_risk_flag", (F.col("elevated_count_lag1d") >= ELEVATED_MIN) | calm)


def previous_day(df: DataFrame, value: str, out: str, days: int = 1, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Same-slot value ``days`` earlier, by shifting the date key."""
    on = [*keys, *KEY]
    prev = df.select(*keys, F.date_add("settlement_date", days).alias("settlement_date"), "settlement_period",
                     F.col(value).alias(out))
    return df.join(prev, on, "left")


def as_of(targets: DataFrame, publications: DataFrame, key: Sequence[str], target_date: str, published: str,
          values: Sequence[str], cutoff_hour: int = 12, reach_hours: int = 24) -> DataFrame:
    """Latest publication per target inside ``[cutoff - reach, cutoff]``, cutoff = noon of the day before.

    A publication can only serve the one or two target days whose window holds
    it, so each publication is keyed by those days: an equi-join followed by a
    map-side ``max_by``, never a range join.
    """
    when = F.col(published)
    shifted = when - F.make_dt_interval(hours=F.lit(cutoff_hour))
    # A cutoff c = noon(D-1) admits c - reach <= t <= c: D - 1 runs from the next noon at or after t to the last one within reach.
    first = F.when(shifted == F.to_date(shifted).cast("timestamp_ntz"), F.to_date(shifted)).otherwise(
        F.date_add(F.to_date(shifted), 1))
    # Closed at both ends: a publication exactly at noon also closes the next day's window.
    last = F.to_date(shifted + F.make_dt_interval(hours=F.lit(reach_hours)))
    p = publications.where(when.isNotNull()).select(
        *key, published, *values, F.explode(F.when(last >= first, F.sequence(F.date_add(first, 1), F.date_add(last, 1)))).alias(target_date))
    best = p.groupBy(*key, target_date).agg(
        F.max_by(F.struct(published, *values), F.struct(published, *values)).alias("_b"))
    return targets.join(best, [*key, target_date], "left").select(
        *targets.columns, F.col(f"_b.{published}").alias(published), *[F.col(f"_b.{v}").alias(v) for v in values])


def latest_run(df: DataFrame, published: str) -> DataFrame:
    """Rows of the most recent publication."""
    return df.where(F.col(published) == df.agg(F.max(published)).scalar())


def with_code(df: DataFrame, prices: DataFrame, default: str = "N", keys: Sequence[str] = KEY) -> DataFrame:
    """Rows with the code of their slot; ``keys`` has the series too where there are several."""
    codes = prices.select(*keys, F.col("price_derivation_code").alias("_code"))
    return df.join(codes, list(keys), "left").withColumn("price_derivation_code", F.coalesce("_code", F.lit(default))).drop("_code")


def fill_from(df: DataFrame, fallback: DataFrame, value: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Missing values taken from a second source, with where each came from."""
    f = fallback.select(*keys, F.col(value).alias("_fb"))
    j = df.join(f, list(keys), "left")
    origin = F.when(F.col(value).isNotNull(), "first").when(F.col("_fb").isNotNull(), "second").otherwise("none")
    return j.withColumns({"origin": origin, value: F.coalesce(value, "_fb")}).drop("_fb")


def splice_actuals(forecast: DataFrame, settled: DataFrame, value: str = "ssp", keys: Sequence[str] = KEY) -> DataFrame:
    """Settled outcomes written over forecast rows: all quantiles collapse to the outcome and the row is marked."""
    s = settled.select(*keys, F.col(value).alias("_a"))
    d = forecast.join(s, list(keys), "left")
    known = F.col("_a").isNotNull()
    cols = {c: F.when(known, F.col("_a")).otherwise(F.col(c)) for c in ("q10", "q50", "q90")}
    before = F.col("is_actual") if "is_actual" in forecast.columns else F.lit(False)
    return d.withColumns({**cols, "is_actual": known | before}).drop("_a")


def restore_actuals(new: DataFrame, previous: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Outcomes already shown in the previous output stay when the new one lacks them."""
    old = previous.where("is_actual").select(*keys, F.col("q50").alias("ssp"))
    open_rows = new.where(~F.col("is_actual"))
    return splice_actuals(open_rows, old, keys=keys).unionByName(new.where("is_actual"))


def horizon_columns(df: DataFrame, horizons: Sequence[int], value: str = "ssp", keys: Sequence[str] = ("series",)) -> DataFrame:
    """The value ``h`` slots earlier as one column per horizon: the horizon self-join without copying rows."""
    from slotwise.operators.series import with_frames
    return with_frames(df, keys, "slot_ix", lambda f: {f"h{h}": f.lag(value, h) for h in horizons}, back=max(horizons))


def blend(readings: DataFrame, keys: Sequence[str], location: str, weights: dict[str, float], values: Sequence[str]) -> DataFrame:
    """Weighted sum over locations; the weights are a literal map, so no join is needed.

    A location without a weight adds nothing; a key that has only such gets NULL.
    """
    w = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(location))
    return readings.groupBy(*keys).agg(*[F.sum(F.col(v) * w).alias(v) for v in values])
