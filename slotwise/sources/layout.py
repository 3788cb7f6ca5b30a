"""Tables laid out by their join keys, so that joins on these keys need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.session import fresh_path


def write_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, label: str = "bucketed") -> DataFrame:
    """``df`` as an external table in the shared folder, bucketed and sorted by ``keys``; returns its scan.

    The rows are dealt once by the hash that also names the buckets, so each bucket is one file. ``buckets`` is the
    caller's: one bucket is what one task of a later join reads, and tables to be joined share the number. The
    table's name lives in the session's catalog; dropping it keeps the files.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, *keys).write.format("parquet").option("path", fresh_path(spark, label))
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return spark.table(name)


def join_on_layout(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``base`` with each of ``others`` (one row per key at most) joined on; NULL where one has no row.

    Sorted merges: tables of one layout meet bucket by bucket, without an exchange however large they are.
    """
    out = base
    for other in others:
        out = out.join(other.hint("merge"), list(keys), "left")
    return out


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with several rows, which would multiply a join's rows; counted inside the buckets."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
