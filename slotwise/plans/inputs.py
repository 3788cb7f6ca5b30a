"""Adapters: the half-hour, daily and feed tables that the queries run on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.keys import day_index, slot_index, wall_period
from slotwise.operators.series import frames_by
from slotwise.session import Tables

MONEY = "decimal(18,2)"


def r6(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1.3e-8, 6)


def one_series(c: str) -> Column:
    """The single series of a table, as a value of its rows: a literal would be folded out of every key."""
    return F.when(F.col(c).isNotNull(), "all")


def slot_events(t: Tables, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events keyed by slot; the half-open date range is put on the stored column, so the scan skips row groups."""
    e = t.events
    if since:
        e = e.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        e = e.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return e.select(
        "event_id", "ts", "user_id", "event_type",
        F.to_date("ts").alias("settlement_date"),
        wall_period("ts").alias("settlement_period"),
        F.col("value").cast(MONEY).alias("dval"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def panel(t: Tables, by_type: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """Half-hour price panel; one series, or one per event type."""
    e = slot_events(t, since, until).withColumn("series", F.col("event_type") if by_type else one_series("event_id"))
    signed = F.when(F.col("event_type").isin("purchase", "signup"), F.col("dval")).otherwise(-F.col("dval"))
    g = e.groupBy("series", "settlement_date", "settlement_period").agg(
        (F.sum("dval").cast("double") / F.count("*") * 2 - 30).alias("ssp"),
        F.sum(signed).cast("double").alias("net_imbalance_volume"),
        F.max("dval").cast("double").alias("_top"),
        (F.count_if(F.col("event_type") == "view") * 100.0 / F.count("*")).alias("wind_pct"),
        (F.count_if(F.col("event_type") == "click") * 100.0 / F.count("*")).alias("gas_pct"),
    )
    niv = F.col("net_imbalance_volume")
    code = F.when(niv > 100, "P").when(niv < -100, "N").when(niv > 0, "K")
    return g.select(
        "series", "settlement_date", "settlement_period",
        slot_index().alias("slot_ix"), day_index().alias("day_ix"),
        "ssp", "net_imbalance_volume",
        code.alias("price_derivation_code"),
        F.when(code == "P", F.col("_top")).alias("replacement_price"),
        "wind_pct", "gas_pct",
    )


def weather(t: Tables) -> DataFrame:
    """Hourly readings with holes."""
    e = slot_events(t).where("event_type = 'purchase'")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime_utc")).agg(
        (F.sum("k") / F.count("*") / 4.0 - 2).alias("temp_c"),
        (F.sum("dval").cast("double") / F.count("*") / 5).alias("wind_ms"),
        (F.count("*") * 10.0).alias("solar_wm2"),
        (F.min("k") / 10.0).alias("precip_mm"),
    )


def provider_trades(t: Tables) -> DataFrame:
    return slot_events(t).select(
        "settlement_date", "settlement_period", F.col("event_type").alias("provider"),
        F.when(F.col("k") % 10 != 0, F.col("dval")).alias("price"),
        F.when(F.col("k") % 7 != 0, F.col("k")).alias("volume"),
    )


def vintages(t: Tables) -> DataFrame:
    """Day-ahead wind and demand forecasts per slot; wind is missing where no source reported."""
    e = slot_events(t)
    wind = F.sum(F.when(F.col("event_type") == "click", F.col("dval") * 10)).cast("double")
    demand = F.sum(F.col("dval") * 20).cast("double") + 100
    return e.groupBy("settlement_date", "settlement_period").agg(
        wind.alias("windfor_fc_mw"), demand.alias("tsdf_fc_mw")
    ).withColumn("surplus_fc_mw", F.col("tsdf_fc_mw") - F.col("windfor_fc_mw") - 50)


def cpi(t: Tables) -> DataFrame:
    """Monthly index covering 2018-01 to 2024-08, every fifth month unpublished."""
    month = F.add_months(F.trunc("o_orderdate", "month"), 276)
    return t.orders.groupBy(month.alias("year_month")).agg(
        (F.sum(F.col("o_totalprice").cast(MONEY)).cast("double") / F.count("*") / 2500).alias("cpi_index")
    ).where(F.month("year_month") % 5 != 0)


def forecasts(t: Tables) -> DataFrame:
    """Walk-forward forecasts: same-slot mean of the last 7 days with a band of 0.8 deviations."""
    p = panel(t)
    f = frames_by(["series", "settlement_period"], "day_ix")
    d = p.withColumns({
        "_m": f.rolling("ssp", 7, "mean"), "_s": f.rolling("ssp", 7, "std"), "_n": f.rolling("ssp", 7, "count"),
    }).where("_n >= 3")
    return d.select(
        "series", "settlement_date", "settlement_period", "slot_ix", "day_ix",
        F.concat(F.lit("fold_"), F.floor((F.col("day_ix") - 19723) / 7).cast("string")).alias("fold"),
        F.col("ssp").alias("actual"),
        r6("_m").alias("q50"),
        r6(F.col("_m") - F.col("_s") * 0.8).alias("q10"),
        r6(F.col("_m") + F.col("_s") * 0.8).alias("q90"),
        "price_derivation_code", "net_imbalance_volume", "wind_pct",
    )


def daily_orders(t: Tables, by_priority: bool = False) -> DataFrame:
    """Daily price over several years; one series, or one per order priority."""
    s = F.col("o_orderpriority") if by_priority else one_series("o_orderkey")
    return (
        t.orders.groupBy(s.alias("series"), F.to_date("o_orderdate").alias("settlement_date"))
        .agg(
            (F.sum(F.col("o_totalprice").cast(MONEY)).cast("double") / F.count("*") / 2500).alias("price"),
            F.count("*").alias("n_orders"),
        )
        .withColumn("day_ix", day_index())
    )


def long_panel(t: Tables) -> DataFrame:
    """Several years of half-hour prices from line items (slot by supplier)."""
    g = t.lineitem.groupBy(
        one_series("l_suppkey").alias("series"),
        F.to_date("l_shipdate").alias("settlement_date"),
        (F.col("l_suppkey") % 48 + 1).cast("int").alias("settlement_period"),
    ).agg(
        (F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double")
         / F.sum(F.col("l_quantity").cast(MONEY)).cast("double") / 12 - 40).alias("ssp"),
        F.sum("l_quantity").alias("volume"),
    )
    return g.select("*", day_index().alias("day_ix"),
                    (day_index() * 48 + F.col("settlement_period") - 1).alias("slot_ix"))


def short_forecasts(t: Tables, days: int = 3) -> DataFrame:
    """A rival forecast from a shorter memory (the second model, the shadow run)."""
    f = frames_by(["series", "settlement_period"], "day_ix")
    d = panel(t).withColumns({
        "_m": f.rolling("ssp", days, "mean"), "_s": f.rolling("ssp", days, "std"), "_n": f.rolling("ssp", days, "count"),
    }).where("_n >= 2")
    return d.select(
        "series", "settlement_date", "settlement_period", "slot_ix", "day_ix",
        r6("_m").alias("q50"), r6(F.col("_m") - F.col("_s") * 1.2).alias("q10"), r6(F.col("_m") + F.col("_s") * 1.2).alias("q90"))


def risk_flags(t: Tables) -> DataFrame:
    from slotwise.operators.joins import risk_days
    return risk_days(panel(t))


def flagged_forecasts(t: Tables) -> DataFrame:
    flags = risk_flags(t).select("series", "settlement_date", "spike_risk_flag", "elevated_count_lag1d")
    return forecasts(t).join(flags, ["series", "settlement_date"], "left").withColumn(
        "spike_risk_flag", F.coalesce("spike_risk_flag", F.lit(False)))
