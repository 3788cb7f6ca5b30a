"""Incremental loading: high-water marks, resumable backfill, keyed append and upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.series import keep_one
from slotwise.session import materialise


def high_water(df: DataFrame, date: str = "settlement_date", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(date).alias("last_date"))


def after_mark(history: DataFrame, feed: DataFrame, keys: Sequence[str], overlap_days: int = 0,
               date: str = "settlement_date") -> DataFrame:
    """Feed rows after each key's last stored date, re-reading ``overlap_days`` for late postings."""
    mark = high_water(history, date, keys)
    start = F.date_sub("last_date", overlap_days)
    return feed.join(mark, list(keys), "left").where(
        F.col("last_date").isNull() | (F.col(date) > start)
    ).drop("last_date")


def dates_to_do(wanted: DataFrame, done: DataFrame, value: str, date: str = "settlement_date") -> DataFrame:
    """Dates without any stored value yet."""
    have = done.groupBy(date).agg(F.count(value).alias("_n")).where("_n > 0")
    return wanted.join(have, date, "left_anti")


def first_source_wins(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Rows of the most preferred source per key, sources given in preference order."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return keep_one(out, keys, [F.col("source_rank"), *order])


def append_first_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Idempotent append: a key already stored keeps its stored row."""
    return first_source_wins([old, new], keys, order).drop("source_rank")


def upsert_last_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Revised rows replace stored ones."""
    return first_source_wins([new, old], keys, order).drop("source_rank")


def empty_table(spark: SparkSession, path: str, schema: str, partition: str) -> None:
    """A partitioned table without rows yet, to merge into."""
    spark.createDataFrame([], schema).write.partitionBy(partition).parquet(path)


def merge_into(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition: str,
               order: Sequence[Column] = (), keep: str = "last") -> None:
    """Merge rows into a partitioned parquet table, rewriting only the partitions they touch.

    The merged partitions are written to the shared folder before the dynamic
    overwrite, so a failed job never leaves a half-read partition. ``keep`` is
    first (stored row stays), last (new row wins) or newest (``order`` decides).
    The table has the columns of ``new``; it may hold no rows yet.
    """
    # Read once more per step below: a micro-batch would be computed anew each time.
    new = materialise(new, "batch")
    old = spark.read.schema(new.schema).parquet(path)
    touched = new.select(partition).distinct()
    affected = old.join(touched, partition, "left_semi")
    kept = affected.select(*new.columns)
    if keep == "newest":
        # Stored and new rows compete under ``order`` alone, so a late old version never wins.
        out = keep_one(kept.unionByName(new), keys, order)
    else:
        out = (upsert_last_wins if keep == "last" else append_first_wins)(kept, new, keys, order)
    merged = materialise(out, "merge")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
