"""Explicit schemas of landed feeds; missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the landed JSON and the column each becomes.
PRICE_FIELDS = {
    "settlementDate": "settlement_date",
    "settlementPeriod": "settlement_period",
    "systemSellPrice": "ssp",
    "netImbalanceVolume": "net_imbalance_volume",
    "sellPriceAdjustment": "sell_price_adjustment",
    "buyPriceAdjustment": "buy_price_adjustment",
    "priceDerivationCode": "price_derivation_code",
    "replacementPrice": "replacement_price",
}
PRICE_RECORD = (
    "settlementDate DATE, settlementPeriod INT, systemSellPrice DOUBLE, netImbalanceVolume DOUBLE, "
    "sellPriceAdjustment DOUBLE, buyPriceAdjustment DOUBLE, priceDerivationCode STRING, replacementPrice DOUBLE"
)
PRICE_ENVELOPE = ", ".join(
    f"{k} ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ') for f in PRICE_RECORD.split(','))}>>"
    for k in ("data", "items", "results")
)
GENERATION = "ARRAY<STRUCT<`from`: TIMESTAMP_NTZ, generationmix: ARRAY<STRUCT<fuel: STRING, perc: DOUBLE>>>>"
WEATHER = (
    "STRUCT<hourly: STRUCT<time: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>, windspeed_10m: ARRAY<DOUBLE>, "
    "shortwave_radiation: ARRAY<DOUBLE>, precipitation: ARRAY<DOUBLE>>>"
)
CPI = "STRUCT<months: ARRAY<STRUCT<date: STRING, value: STRING>>>"

PRICES = T.StructType([
    T.StructField("settlement_date", T.DateType()),
    T.StructField("settlement_period", T.IntegerType()),
    T.StructField("ssp", T.DoubleType()),
    T.StructField("net_imbalance_volume", T.DoubleType()),
    T.StructField("price_derivation_code", T.StringType()),
])
FORECAST_V1 = T.StructType([
    T.StructField("settlement_date", T.DateType()),
    T.StructField("settlement_period", T.IntegerType()),
    T.StructField("q10", T.DoubleType()),
    T.StructField("q50", T.DoubleType()),
    T.StructField("q90", T.DoubleType()),
])
FORECAST_V2 = T.StructType([*FORECAST_V1.fields, T.StructField("is_actual", T.StringType())])
