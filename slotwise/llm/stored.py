"""A run's own folder of written tables, which drops each table once its last reader is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwise.session import fresh_path


class Folder:
    """Tables written under one new folder of the shared one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, fresh_path(spark, label)
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        """Write once and read back: survives lost executors, and later readers do not compute it again."""
        path = f"{self.path}/{len(self.tables)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def discard(self, table: DataFrame) -> None:
        """Delete a table of this folder; nothing may read it, or what was derived from it without writing, afterwards."""
        path = next(p for t, p in self.tables if t is table)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
