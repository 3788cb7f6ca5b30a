"""Daily roll-up of complete days, its lag features, and day-level flags."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.keys import day_index, periods_in_day
from slotwise.operators.series import Frames, frames_by

# Daily columns that describe the day itself and are unknown before it ends.
SAME_DAY = (
    "ssp_raw_daily_mean", "ssp_raw_daily_max", "ssp_raw_daily_min", "ssp_raw_daily_std", "ssp_daily_mean",
    "niv_daily_mean", "niv_daily_std", "is_spike_count", "wind_pct_daily_mean", "gas_pct_daily_mean",
    "cpi_deflator", "neg_sp_daily_count", "mid_daily_mean",
)
# Daily aggregates kept in the table but left out of the level model.
LEVEL_HELD_OUT = (
    "windfor_fc_daily_mean", "tsdf_fc_daily_mean", "tsdf_fc_daily_max", "margin_fc_daily_min", "margin_fc_daily_mean",
    "wind_pen_fc_daily_mean", "surplus_fc", "mid_daily_mean_lag1d", "mid_daily_mean_lag7d", "mid_daily_roll_mean_7d",
    "ssp_mid_spread_lag1d",
)


def daily_rollup(df: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """One row per series and day; optional inputs are aggregated when present."""
    have = set(df.columns)
    neg = (F.col("ssp_raw") < 0).cast("int")
    aggs: dict[str, Column] = {
        "n_slots": F.count("ssp_raw"),
        "ssp_raw_daily_mean": F.avg("ssp_raw"), "ssp_raw_daily_max": F.max("ssp_raw"),
        "ssp_raw_daily_min": F.min("ssp_raw"), "ssp_raw_daily_std": F.stddev_samp("ssp_raw"),
        "ssp_daily_mean": F.avg("ssp"),
        "niv_daily_mean": F.avg("net_imbalance_volume"), "niv_daily_std": F.stddev_samp("net_imbalance_volume"),
        "is_spike_count": F.sum(F.col("is_spike").cast("int")), "neg_sp_daily_count": F.sum(neg),
    }
    for c in ("wind_pct", "gas_pct"):
        if c in have:
            aggs[f"{c}_daily_mean"] = F.avg(c)
    for c in ("cpi_index", "cpi_yoy", "cpi_deflator"):
        if c in have:
            aggs[c] = F.min_by(c, "settlement_period")
    if "mid_price" in have:
        aggs["mid_daily_mean"] = F.avg("mid_price")
    if "tsdf_fc_mw" in have:
        aggs |= {
            "windfor_fc_daily_mean": F.avg("windfor_fc_mw"), "tsdf_fc_daily_mean": F.avg("tsdf_fc_mw"),
            "tsdf_fc_daily_max": F.max("tsdf_fc_mw"), "margin_fc_daily_min": F.min("margin_fc_mw"),
            "margin_fc_daily_mean": F.avg("margin_fc_mw"), "wind_pen_fc_daily_mean": F.avg("wind_pen_fc"),
            "surplus_fc": F.min_by("surplus_fc_mw", "settlement_period"),
        }
    for c in ("temp_c", "wind_ms", "solar_wm2", "precip_mm"):
        if c in have:
            aggs |= {f"{c}_daily_mean": F.avg(c), f"{c}_daily_max": F.max(c)}
    return df.groupBy(*keys, "settlement_date").agg(*[a.alias(n) for n, a in aggs.items()]).withColumn(
        "day_ix", day_index())


def complete_days(daily: DataFrame, zone: str | None = None) -> DataFrame:
    """Days with 48 slots; with a zone, days with as many slots as their clock has (46, 48 or 50)."""
    want = periods_in_day("settlement_date", zone) if zone else F.lit(48)
    return daily.where(F.col("n_slots") == want)


def day_calendar(date: str = "settlement_date") -> dict[str, Column]:
    d, doy = F.col(date), F.dayofyear(date)
    year = F.lit(2 * math.pi / 365)
    return {
        "day_of_week": F.weekday(d), "month": F.month(d), "day_of_year": doy, "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"), "is_business_day": (F.weekday(d) < 5).cast("int"),
        "sin_annual": F.sin(doy * year), "cos_annual": F.cos(doy * year),
        "sin_half_annual": F.sin(doy * 2 * year), "cos_half_annual": F.cos(doy * 2 * year),
    }


def level_lags(f: Frames) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in (1, 2, 7, 14, 28):
        for c in ("ssp_daily_mean", "ssp_raw_daily_max", "ssp_raw_daily_min"):
            out[f"{c}_lag{n}d"] = f.lag(c, n)
    return out


def level_rolling(f: Frames) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for w in (7, 14, 28):
        for s in ("mean", "std", "max", "min"):
            out[f"ssp_daily_roll_{s}_{w}d"] = f.rolling("ssp_daily_mean", w, s, min_periods=3)
        out[f"ssp_raw_max_roll_mean_{w}d"] = f.rolling("ssp_raw_daily_max", w, "mean", min_periods=3)
    return out


def driver_lags(f: Frames, have: Sequence[str]) -> dict[str, Column]:
    """Lags and weekly statistics of volume, spikes, negatives, generation, weather and the market index."""
    out: dict[str, Column] = {}
    for n in (1, 7):
        out[f"niv_daily_mean_lag{n}d"] = f.lag("niv_daily_mean", n)
        out[f"spike_count_lag{n}d"] = f.lag("is_spike_count", n)
        out[f"neg_sp_count_lag{n}d"] = f.lag("neg_sp_daily_count", n)
    for w in (7, 14):
        for s in ("mean", "std"):
            out[f"niv_daily_roll_{s}_{w}d"] = f.rolling("niv_daily_mean", w, s, min_periods=3)
    out["spike_count_roll_7d"] = f.rolling("is_spike_count", 7, "sum")
    out["neg_sp_count_roll_7d"] = f.rolling("neg_sp_daily_count", 7, "sum")
    for c in ("wind_pct", "gas_pct"):
        if f"{c}_daily_mean" in have:
            out |= {f"{c}_daily_mean_lag{n}d": f.lag(f"{c}_daily_mean", n) for n in (1, 7)}
            out[f"{c}_daily_roll_mean_7d"] = f.rolling(f"{c}_daily_mean", 7, "mean", min_periods=3)
    for c in ("temp_c", "wind_ms", "solar_wm2", "precip_mm"):
        if f"{c}_daily_mean" in have:
            out |= {f"{c}_daily_mean_lag{n}d": f.lag(f"{c}_daily_mean", n) for n in (1, 7)}
            out[f"{c}_daily_max_lag1d"] = f.lag(f"{c}_daily_max", 1)
    if "mid_daily_mean" in have:
        out |= {f"mid_daily_mean_lag{n}d": f.lag("mid_daily_mean", n) for n in (1, 7)}
        out["mid_daily_roll_mean_7d"] = f.rolling("mid_daily_mean", 7, "mean", min_periods=3)
        out["ssp_mid_spread_lag1d"] = f.lag("ssp_daily_mean", 1) - f.lag("mid_daily_mean", 1)
    return out


def daily_features(daily: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Calendar-safe daily lags; a series has one row per day, so its window is bounded by the calendar."""
    f = frames_by(keys, "day_ix")
    return daily.withColumns(day_calendar() | level_lags(f) | level_rolling(f) | driver_lags(f, daily.columns))


def level_feature_names(columns: Sequence[str]) -> list[str]:
    """Level-model inputs: nothing that describes the day itself, nothing held out."""
    drop = {*SAME_DAY, *LEVEL_HELD_OUT, "series", "settlement_date", "day_ix", "n_slots"}
    return [c for c in columns if c not in drop]


def spike_day_features(df: DataFrame, keys: Sequence[str] = ("series",), limit: float = 150.0) -> DataFrame:
    """Day rows for the spike classifier: outcome flag, lagged price aggregates, weekly spike days."""
    d = df.groupBy(*keys, "settlement_date", "day_ix").agg(
        F.max((F.col("ssp_raw") > limit).cast("int")).alias("spike_day"),
        F.max("ssp_raw_lag_48").alias("lag48_max"), F.sum("ssp_raw_lag_48").alias("lag48_sum"),
        F.avg("ssp_raw_lag_48").alias("lag48_mean"),
        F.min_by("ssp_raw_lag_48", "settlement_period").alias("lag48_first"),
        F.sum((F.col("ssp_raw_lag_48") > limit).cast("int")).alias("lag48_spikes"),
    )
    f = frames_by(keys, "day_ix")
    return d.withColumn("spike_days_7d", f.rolling("lag48_spikes", 7, "sum", include_current=True))
