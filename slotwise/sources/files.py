"""Typed file scans and sinks: prices, forecast archives, parameter tables, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise import schemas as X
from slotwise.operators.clean import parse_flag


def read_prices(spark: SparkSession, path: str, schema: T.StructType = X.PRICES, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def numeric_scan(df: DataFrame, keep: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Projected scan with lenient numbers: unreadable values become NULL and their rows drop."""
    cols = [F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in keep]
    return df.select(*cols).dropna(subset=list(numeric))


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def scan_archive(spark: SparkSession, path: str, schema: T.StructType, stem: str = "forecast_") -> DataFrame:
    """Files of one schema under ``.../<stem>YYYY-MM-DD[_shadow].../``; date and source come from the path."""
    d = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    where = F.col("_metadata.file_path")
    return d.select(
        F.to_date(F.regexp_extract(where, stem + r"(?:\w+_)?(\d{4}-\d{2}-\d{2})", 1)).alias("target_date"),
        F.when(F.contains(where, F.lit("_shadow")), "shadow").otherwise("prod").alias("source"),
        F.when(F.contains(where, F.lit(f"{stem}phase3_")), "phase3").otherwise("legacy").alias("model"),
        *schema.names,
    )


def merge_archives(parts: Sequence[DataFrame]) -> DataFrame:
    """Archives of different schemas in one table; spliced actual rows are not forecasts and drop."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("is_actual", parse_flag("is_actual")).where(~F.col("is_actual")).drop("is_actual")


def best_archive(df: DataFrame) -> DataFrame:
    """Per target date only the best file's rows: phase3 before legacy, production before shadow.

    The winner is picked on the table of distinct files and joined back.
    """
    rank = (F.when(F.col("model") == "phase3", 2).otherwise(0) + F.when(F.col("source") == "prod", 1).otherwise(0))
    win = df.groupBy("target_date").agg(F.max(rank).alias("_best"))
    return df.join(win, "target_date").where(rank == F.col("_best")).drop("_best")


def write_if_clean(df: DataFrame, path: str, flag: str = "is_actual") -> bool:
    """Archive a forecast only when no settled row has been spliced in."""
    if df.where(F.col(flag)).isEmpty():
        df.drop(flag).write.mode("overwrite").parquet(path)
        return True
    return False


def params_to_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """A small parameter table as one JSON document (a fixed number of keys, such as 48 slots)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("int").alias("k"), F.col(value).alias("v"))))
    keyed = F.transform(entries, lambda e: F.struct(e["k"].cast("string").alias("k"), e["v"].alias("v")))
    return df.agg(F.to_json(F.map_from_entries(keyed)).alias("document"))


def params_from_json(df: DataFrame, key: str, value: str) -> DataFrame:
    d = df.select(F.explode(F.from_json("document", "MAP<STRING, DOUBLE>")).alias("k", "v"))
    return d.select(F.col("k").cast("int").alias(key), F.col("v").alias(value))


def heartbeat(df: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """What a fetch delivered: rows and latest slot per date, stamped with the fetch time."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_slots"), F.max("settlement_period").alias("max_sp")
    ).withColumn("fetched_at", at)


def land_observed(df: DataFrame, path: str, log: str, feed: str, at: Column, slots: int = 48) -> DataFrame:
    """Append a fetch to ``path`` and its heartbeat to ``log``; the heartbeat is counted by the write itself.

    One row: rows, days, slots missing of these days, the latest date and its last slot. The counting sits after the
    last shuffle of ``df``, in the stage that writes, whose tasks count once however often they are tried. The
    days of one fetch are kept as a set; an empty fetch leaves a heartbeat with zero rows.
    """
    spark, seen = df.sparkSession, Observation()
    day = F.col("settlement_date")
    counted = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.size(F.collect_set(day)).alias("n_days"),
                         F.max(F.struct(day.alias("d"), F.col("settlement_period").cast("int").alias("sp"))).alias("last"))
    counted.write.mode("append").parquet(path)
    got = seen.get
    last = got["last"] or (None, None)
    row = [(feed, got["n_rows"], got["n_days"], slots * got["n_days"] - got["n_rows"], last[0], last[1])]
    beat = spark.createDataFrame(row, "feed string, n_rows bigint, n_days int, n_missing bigint, last_date date, last_sp int")
    append_log(beat.withColumn("fetched_at", at).coalesce(1), log)
    return spark.read.schema(df.schema).parquet(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Chronological table: range-partitioned and sorted inside each file, so no task sorts everything."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
