"""Slot-level features: lags, rolling and same-slot statistics, weather, generation, calendar.

One function builds each family for training, back-tests and inference; a
target day is simply rows whose outcome is still NULL. ``REACH`` states how
many slots back a feature's newest input lies; the model selectors use it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.calendar import bank_holidays, calendar_cycles, calendar_flags, calendar_parts
from slotwise.functions.keys import ratio, slot_index
from slotwise.operators.series import CHUNK, Frames, fill_forward, frames_by, with_frames

# Lag and window lengths in slots, degree-day bases in Celsius.
SSP_LAGS = (1, 2, 48, 96, 336)
NIV_LAGS = (1, 48, 336)
SSP_WINDOWS = (6, 48, 336)
NIV_WINDOWS = (6, 48)
DAY_AND_WEEK = (48, 336)
STATS = ("mean", "std", "min", "max")
WEATHER = ("temp_c", "wind_ms", "solar_wm2", "precip_mm")
HEATING_BASE = 15.5
COOLING_BASE = 22.0
NIV = "net_imbalance_volume"


def price_lags(f: Frames) -> dict[str, Column]:
    out = {f"ssp_lag_{n}": f.lag("ssp", n) for n in SSP_LAGS}
    out |= {f"{NIV}_lag_{n}": f.lag(NIV, n) for n in NIV_LAGS}
    out |= {f"ssp_raw_lag_{n}": f.lag("ssp_raw", n) for n in (48, 96, 336)}
    out["ssp_diff_1_48"] = f.lag("ssp", 1) - f.lag("ssp", 48)
    out["ssp_diff_48_336"] = f.lag("ssp", 48) - f.lag("ssp", 336)
    return out


def ramps(f: Frames) -> dict[str, Column]:
    return {
        "ssp_ramp_48": f.lag("ssp", 48) - f.lag("ssp", 49),
        "ssp_ramp_336": f.lag("ssp", 336) - f.lag("ssp", 337),
        "ssp_raw_ramp_48": f.lag("ssp_raw", 48) - f.lag("ssp_raw", 49),
        "niv_ramp_48": f.lag(NIV, 48) - f.lag(NIV, 49),
    }


def price_rolling(f: Frames) -> dict[str, Column]:
    return {f"ssp_roll_{s}_{w}": f.rolling("ssp", w, s) for w in SSP_WINDOWS for s in STATS}


def volume_rolling(f: Frames) -> dict[str, Column]:
    out = {f"{NIV}_roll_{s}_{w}": f.rolling(NIV, w, s) for w in NIV_WINDOWS for s in STATS}
    return out | {f"abs_niv_roll_mean_{w}": f.rolling(F.abs(NIV), w, "mean") for w in NIV_WINDOWS}


def spike_memory(f: Frames) -> dict[str, Column]:
    spike = F.col("is_spike").cast("int")
    neg = (F.col("ssp_raw") < 0).cast("int")
    out = {f"is_spike_lag_{n}": f.lag(spike, n) for n in DAY_AND_WEEK}
    out |= {f"is_negative_lag_{n}": f.lag(neg, n) for n in DAY_AND_WEEK}
    out["spike_count_roll_48"] = f.rolling(spike, 48, "sum")
    out["neg_count_roll_48"] = f.rolling(neg, 48, "sum")
    return out


def generation_lags(f: Frames) -> dict[str, Column]:
    return {f"{c}_lag_{n}": f.lag(c, n) for c in ("wind_pct", "gas_pct") for n in DAY_AND_WEEK}


def market_lags(f: Frames) -> dict[str, Column]:
    out = {f"mid_price_lag_{n}": f.lag("mid_price", n) for n in (48, 96, 336)}
    out["ssp_mid_spread_lag_48"] = f.lag("ssp_raw", 48) - f.lag("mid_price", 48)
    return out


def weather_history(f: Frames) -> dict[str, Column]:
    out = {f"{c}_lag_{n}": f.lag(c, n) for c in WEATHER for n in (1, 48, 336)}
    out |= {f"{c}_roll_{s}_{w}": f.rolling(c, w, s) for c in WEATHER[:3] for w in (6, 48) for s in ("mean", "std")}
    out["wind_ramp_6"] = f.lag("wind_ms", 1) - f.lag("wind_ms", 7)
    out["heating_degree"] = F.greatest(HEATING_BASE - f.lag("temp_c", 48), F.lit(0.0))
    out["cooling_degree"] = F.greatest(f.lag("temp_c", 48) - COOLING_BASE, F.lit(0.0))
    # greatest() skips NULLs, so an unknown temperature must be kept unknown.
    for name in ("heating_degree", "cooling_degree"):
        out[name] = F.when(f.lag("temp_c", 48).isNotNull(), out[name])
    return out


def slot_history(df: DataFrame, families: Sequence, keys: Sequence[str] = ("series",), ix: str = "slot_ix",
                 chunk: int = CHUNK) -> DataFrame:
    """Any of the families above in one shuffle: all frames share the (series, chunk) partitioning."""

    def build(f: Frames) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for fam in families:
            out |= fam(f)
        return out

    return with_frames(df, keys, ix, build, back=337, chunk=chunk)


def same_slot_week(df: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The slot against itself on the 7 days before; parallel over (series, slot)."""
    f = frames_by([*keys, "settlement_period"], "day_ix")
    spread = f.rolling("ssp", 7, "max") - f.rolling("ssp", 7, "min")
    return df.withColumns({
        "same_sp_mean_7d": f.rolling("ssp", 7, "mean"),
        "same_sp_std_7d": f.rolling("ssp", 7, "std"),
        "same_sp_range_7d": spread,
        "ssp_sp_deviation": f.lag("ssp", 1) - f.rolling("ssp", 7, "mean"),
        "ssp_sp_trend_7d": f.lag("ssp", 1) - f.lag("ssp", 7),
        "niv_same_sp_mean_7d": f.rolling(NIV, 7, "mean"),
        "niv_same_sp_std_7d": f.rolling(NIV, 7, "std"),
    })


def join_weather(df: DataFrame, weather: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Hourly UTC readings on both half hours of each hour, last reading carried over holes."""
    minutes = F.timestamp_diff("MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("datetime_utc"))
    hourly = weather.withColumn("slot_ix", F.explode(F.array(F.floor(minutes / 30), F.floor(minutes / 30) + 1)))
    joined = df.join(hourly.drop("datetime_utc"), "slot_ix", "left")
    return fill_forward(joined, keys, "slot_ix", WEATHER)


def join_slot_table(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other, ["settlement_date", "settlement_period"], "left")


def vintage_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "margin_fc_mw": F.col("tsdf_fc_mw") - F.col("windfor_fc_mw"),
        "wind_pen_fc": ratio(F.col("windfor_fc_mw") * 100.0, "tsdf_fc_mw"),
    })


def price_index_months(cpi: DataFrame) -> DataFrame:
    """Month table with gaps carried forward, the yearly change and the deflator to the latest month.

    A few hundred rows at most (one per calendar month).
    """
    span = cpi.agg(F.min("year_month").alias("a"), F.max("year_month").alias("b"))
    months = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("year_month"))
    m = months.join(cpi, "year_month", "left").withColumns({
        "_k": F.lit(0), "_ix": (F.year("year_month") * 12 + F.month("year_month")).cast("long")})
    m = fill_forward(m, ["_k"], "_ix", ["cpi_index"], chunk=1200)
    f = frames_by(["_k"], "_ix")
    before = f.lag("cpi_index", 12)
    latest = F.max_by("cpi_index", "_ix").over(f.spec.rangeBetween(-100000, 100000))
    return m.select(
        "year_month", "cpi_index", (ratio(F.col("cpi_index") - before, before) * 100).alias("cpi_yoy"),
        ratio(latest, "cpi_index").alias("cpi_deflator"))


def join_price_index(df: DataFrame, cpi: DataFrame, date: str = "settlement_date") -> DataFrame:
    m = price_index_months(cpi).withColumnRenamed("year_month", "_month")
    return df.withColumn("_month", F.trunc(date, "month")).join(F.broadcast(m), "_month", "left").drop("_month")


def add_calendar(df: DataFrame) -> DataFrame:
    """Calendar parts, cycles, flags and England holidays (a generated table of about 8 rows per year of the data)."""
    hol = bank_holidays(df).select(F.col("holiday_date").alias("settlement_date"), F.lit(1).alias("_h"))
    out = df.withColumns(calendar_parts() | calendar_cycles() | calendar_flags())
    out = out.join(F.broadcast(hol), "settlement_date", "left")
    return out.withColumn("is_holiday", F.coalesce("_h", F.lit(0))).drop("_h").withColumn(
        "is_business_day", ((F.col("is_weekend") == 0) & (F.col("is_holiday") == 0)).cast("int"))


def shape_table(slots: DataFrame, daily: DataFrame, horizon: int = 1, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Slot rows with daily lags and the deviation target; ``horizon`` 2 uses only inputs two days old."""
    n = horizon
    lags = [f"ssp_daily_mean_lag{n}d", "ssp_daily_mean_lag7d", f"ssp_raw_daily_max_lag{n}d"]
    lags += ["niv_daily_mean_lag1d", "spike_count_lag1d", "spike_count_roll_7d",
             "ssp_daily_roll_mean_7d", "ssp_daily_roll_std_7d"] if n == 1 else [
             "spike_count_lag7d", "spike_count_roll_7d", "ssp_daily_roll_mean_7d"]
    d = daily.select(*keys, "settlement_date", "ssp_raw_daily_mean", *lags)
    out = slots.join(d, [*keys, "settlement_date"], "left")
    own = 48 * n
    return out.withColumns({
        "ssp_shape_target": F.col("ssp_raw") - F.col("ssp_raw_daily_mean"),
        f"ssp_lag{own}_deviation": F.col(f"ssp_lag_{own}") - F.col(f"ssp_daily_mean_lag{n}d"),
        "ssp_lag336_deviation": F.col("ssp_lag_336") - F.col("ssp_daily_mean_lag7d"),
    })


def _reach() -> dict[str, int]:
    r = {f"ssp_lag_{n}": n for n in SSP_LAGS} | {f"{NIV}_lag_{n}": n for n in NIV_LAGS}
    r |= {f"ssp_raw_lag_{n}": n for n in (48, 96, 336)} | {f"mid_price_lag_{n}": n for n in (48, 96, 336)}
    r |= {"ssp_diff_1_48": 1, "ssp_diff_48_336": 48, "ssp_mid_spread_lag_48": 48}
    r |= {"ssp_ramp_48": 48, "ssp_ramp_336": 336, "ssp_raw_ramp_48": 48, "niv_ramp_48": 48}
    r |= {f"ssp_roll_{s}_{w}": 1 for s in STATS for w in SSP_WINDOWS}
    r |= {f"{NIV}_roll_{s}_{w}": 1 for s in STATS for w in NIV_WINDOWS}
    r |= {f"abs_niv_roll_mean_{w}": 1 for w in NIV_WINDOWS}
    r |= {f"{k}_lag_{n}": n for k in ("is_spike", "is_negative", "wind_pct", "gas_pct") for n in DAY_AND_WEEK}
    r |= {"spike_count_roll_48": 1, "neg_count_roll_48": 1}
    r |= {f"{c}_lag_{n}": n for c in WEATHER for n in (1, 48, 336)}
    r |= {f"{c}_roll_{s}_{w}": 1 for c in WEATHER[:3] for w in (6, 48) for s in ("mean", "std")}
    r |= {"wind_ramp_6": 1, "heating_degree": 48, "cooling_degree": 48}
    r |= {c: 48 for c in ("same_sp_mean_7d", "same_sp_std_7d", "same_sp_range_7d", "ssp_sp_deviation",
                          "ssp_sp_trend_7d", "niv_same_sp_mean_7d", "niv_same_sp_std_7d")}
    r |= {"ssp_lag48_deviation": 48, "ssp_lag96_deviation": 96, "ssp_lag336_deviation": 336}
    # Daily inputs of the previous day are a day old for every slot of the target day.
    r |= {c: 48 for c in ("ssp_daily_mean_lag1d", "ssp_raw_daily_max_lag1d", "niv_daily_mean_lag1d", "spike_count_lag1d",
                          "spike_count_roll_7d", "ssp_daily_roll_mean_7d", "ssp_daily_roll_std_7d")}
    r |= {"ssp_daily_mean_lag2d": 96, "ssp_raw_daily_max_lag2d": 96, "ssp_daily_mean_lag7d": 336, "spike_count_lag7d": 336}
    # Day-ahead forecasts are published the day before.
    r |= {c: 48 for c in ("windfor_fc_mw", "tsdf_fc_mw", "surplus_fc_mw", "margin_fc_mw", "wind_pen_fc")}
    return r


REACH = _reach()
CALENDAR = (
    "hour", "day_of_week", "month", "week_of_year", "quarter", "day_of_year", "sin_sp", "cos_sp", "sin_hour",
    "cos_hour", "sin_dow", "cos_dow", "sin_month", "cos_month", "sin_half_year", "cos_half_year", "is_weekend",
    "is_peak", "is_evening_peak", "is_holiday", "is_business_day",
)
KNOWN_AHEAD = ("cpi_index", "cpi_yoy")


def features_known(columns: Sequence[str], slots_back: int) -> list[str]:
    """Feature columns whose newest input is at least ``slots_back`` slots old for every slot of the day.

    48 gives the next-day shape model, 96 the model for the day after, 1 the
    direct model. Outcomes, contemporaneous readings and keys have no reach
    entry and can never be selected.
    """
    ahead = set(CALENDAR) | set(KNOWN_AHEAD)
    return [c for c in columns if c in ahead or REACH.get(c, 0) >= slots_back]
