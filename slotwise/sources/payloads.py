"""Landed nested JSON to flat rows: one built-in expression per feed, no Python per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise import schemas as X
from slotwise.functions.keys import local_date, ordinal_period


def price_records(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Price records from a bare list or a list under ``data``, ``items`` or ``results``."""
    bare = F.startswith(F.ltrim(payload), F.lit("["))
    text = F.when(bare, F.concat(F.lit('{"data":'), F.col(payload), F.lit("}"))).otherwise(F.col(payload))
    d = df.select(F.from_json(text, X.PRICE_ENVELOPE).alias("j"))
    rows = d.select(F.inline(F.coalesce("j.data", "j.items", "j.results")))
    return rows.withColumnsRenamed(X.PRICE_FIELDS)


def generation_mix(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Wind and gas shares per half hour; a fuel absent from the mix counts 0."""
    d = df.select(F.inline(F.from_json(payload, X.GENERATION)))
    share = F.map_from_entries(F.transform("generationmix", lambda g: F.struct(g["fuel"], g["perc"])))
    d = d.withColumn("m", share)
    return d.select(
        local_date("from").alias("settlement_date"), ordinal_period("from").alias("settlement_period"),
        F.coalesce(F.element_at("m", F.lit("wind")), F.lit(0.0)).alias("wind_pct"),
        F.coalesce(F.element_at("m", F.lit("gas")), F.lit(0.0)).alias("gas_pct"),
    )


def weather_hours(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Struct of parallel arrays to one row per hour."""
    names = {"temperature_2m": "temp_c", "windspeed_10m": "wind_ms",
             "shortwave_radiation": "solar_wm2", "precipitation": "precip_mm"}
    h = df.select(F.from_json(payload, X.WEATHER).alias("j")).select("j.hourly.*")
    rows = h.select(F.inline(F.arrays_zip("time", *names)))
    return rows.select(F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("datetime_utc"),
                       *[F.col(a).alias(b) for a, b in names.items()])


def cpi_months(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``2024 JAN`` months; rows that do not parse are left out, repeats keep the last listed."""
    m = df.select(F.posexplode(F.from_json(payload, X.CPI)["months"]).alias("pos", "m"))
    month = F.to_date(F.try_to_timestamp(F.initcap(F.col("m.date")), F.lit("yyyy MMM")))
    d = m.select(month.alias("year_month"), F.col("m.value").try_cast("double").alias("cpi_index"), "pos")
    d = d.where("year_month IS NOT NULL AND cpi_index IS NOT NULL")
    return d.groupBy("year_month").agg(F.max_by("cpi_index", "pos").alias("cpi_index"))


def half_hours(df: DataFrame, start: str, values: list[str]) -> DataFrame:
    """Each hourly row as the two half-hour slots it spans."""
    offs = F.explode(F.array(F.lit(0), F.lit(30))).alias("_m")
    d = df.select("*", offs).withColumn("_t", F.col(start) + F.make_dt_interval(mins=F.col("_m")))
    return d.select(local_date("_t").alias("settlement_date"), ordinal_period("_t").alias("settlement_period"), *values)
