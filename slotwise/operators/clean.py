"""Validation, winsorising and base columns of the half-hour price table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.operators.ordered import exact_quantiles
from slotwise.operators.series import keep_one, slot_grid

KEY = ["settlement_date", "settlement_period"]


def drop_repeats(df: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """First arrival of each key; ``arrival`` must be a total order."""
    return keep_one(df, keys, arrival)


def missing_slots(df: DataFrame, keys: Sequence[str] = ("series",), slots: int = 48) -> DataFrame:
    """Slots absent between each series' first and last date."""
    on = [*keys, *KEY]
    return slot_grid(df, keys, slots).join(df.select(*on), on, "left_anti")


def coverage(df: DataFrame, keys: Sequence[str] = ("series",), slots: int = 48) -> DataFrame:
    """Expected against present slots per series."""
    days = F.datediff(F.max("settlement_date"), F.min("settlement_date")) + 1
    g = df.groupBy(*keys).agg((days * slots).cast("long").alias("expected"), F.count("*").alias("present"))
    return g.withColumn("missing", F.col("expected") - F.col("present"))


def fit_fence(df: DataFrame, keys: Sequence[str] = ("series",), value: str = "ssp", reach: float = 3.0) -> DataFrame:
    """Outer Tukey fence per series: quartiles widened by ``reach`` interquartile ranges."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, (F.col("q1") - iqr * reach).alias("lo"), (F.col("q3") + iqr * reach).alias("hi"))


def apply_fence(df: DataFrame, fence: DataFrame, keys: Sequence[str] = ("series",), value: str = "ssp",
                upper_only_flag: bool = False) -> DataFrame:
    """Clip to the fence, keep the raw value, flag values strictly outside."""
    d = df.join(fence, list(keys)).withColumn(f"{value}_raw", F.col(value))
    outside = F.col(value) > F.col("hi")
    if not upper_only_flag:
        outside = outside | (F.col(value) < F.col("lo"))
    return d.withColumns({
        "is_spike": outside, value: F.least(F.greatest(F.col(value), F.col("lo")), F.col("hi")),
    }).drop("lo", "hi")


def winsorise(df: DataFrame, keys: Sequence[str] = ("series",), value: str = "ssp") -> DataFrame:
    return apply_fence(df, fit_fence(df, keys, value), keys, value)


def extend_clean(history: DataFrame, new: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Winsorise only rows after the history with the history's fence (upper flag only)."""
    last = history.groupBy(*keys).agg(F.max("settlement_date").alias("_last"))
    fresh = new.join(last, list(keys), "left").where(
        F.col("_last").isNull() | (F.col("settlement_date") > F.col("_last"))
    ).drop("_last")
    return apply_fence(fresh, fit_fence(history, keys), keys, upper_only_flag=True)


def recover_fence(clean: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The fence a cleaned table was cut with, read off its clipped rows; NULL where none was clipped."""
    s = F.col("is_spike")
    return clean.groupBy(*keys).agg(
        F.min(F.when(s & (F.col("ssp_raw") < F.col("ssp")), F.col("ssp"))).alias("lo"),
        F.max(F.when(s & (F.col("ssp_raw") > F.col("ssp")), F.col("ssp"))).alias("hi"),
    )


def base_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "abs_imbalance_volume": F.abs("net_imbalance_volume"),
        "price_derivation_code_P": F.coalesce((F.col("price_derivation_code") == "P").cast("int"), F.lit(0)),
        "replacement_price": F.coalesce("replacement_price", "ssp"),
    })


def default_code(df: DataFrame, default: str = "N") -> DataFrame:
    return df.withColumn("price_derivation_code", F.coalesce("price_derivation_code", F.lit(default)))


def parse_flag(c: str) -> Column:
    """Text flags as written by CSV round trips; anything else, or missing, is false."""
    return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "1.0"), F.lit(False))


def complete_cases(df: DataFrame, core: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(core))


def all_null_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names of columns without any value: one aggregate row reaches the driver."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] == 0]


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*all_null_columns(df, columns))


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def null_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """What-if: the named features as if their source had not reported."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in names if c in types})


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: non-null count and share."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot("_n", list(columns), "column_name", "n_present")
    return long.select("column_name", "n_present", F.col("_n").alias("n_rows"),
                       (F.col("n_present") * 100.0 / F.col("_n")).alias("pct_present"))
