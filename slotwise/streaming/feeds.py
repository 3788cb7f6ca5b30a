"""Structured Streaming over landed feeds: slots, freshness, revisions, nowcast, splices.

Every query keeps its state and offsets under the shared checkpoint folder, so
a lost executor or a restarted driver resumes where it stopped. Sinks that
receive updates write one folder per micro-batch and are read last-batch-wins,
which makes a replayed batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators.series import keep_one
from slotwise.session import fresh_path


def landed_stream(spark: SparkSession, path: str, schema=None, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream over parquet files landing in a folder, or over a table that may be one file or a folder of files."""
    schema = schema or spark.read.parquet(f"{path.rstrip('/')}/{glob}" if glob else path).schema
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, a path may name a file as well as a folder.
    path = path.rstrip("/")
    return r.parquet(f"{path[:-1]}[{path[-1]}]")


def run_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Drain what has landed; each micro-batch overwrites its own folder."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = each(batch) if each else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str], schema) -> DataFrame:
    """Current value per key: the row of the highest batch."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    d = spark.read.schema(full).option("basePath", path).parquet(path)
    return keep_one(d, keys, [-F.col("batch")]).drop("batch")


def drain(stream: DataFrame, keys: Sequence[str], label: str, mode: str = "update",
          each: Callable[[DataFrame], DataFrame] | None = None, schema=None) -> DataFrame:
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    run_updates(stream, path, f"{path}-checkpoint", mode, each)
    return latest_updates(spark, path, keys, schema or stream.schema)


def event_slots(events: DataFrame, series: Column, late: str | None = "2 days") -> DataFrame:
    """Raw events to half-hour sums, tumbling; state older than the watermark is dropped (``late`` is None for a table, which has none)."""
    e = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("event_time", late)
    g = e.groupBy(series.alias("series"), F.window("event_time", "30 minutes").alias("w")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("total"), F.count("*").alias("n"))
    start = F.col("w.start").cast("timestamp_ntz")
    return g.select("series", F.to_date(start).alias("settlement_date"),
                    (F.hour(start) * 2 + F.floor(F.minute(start) / 30) + 1).cast("int").alias("settlement_period"), "total", "n")


def sliding_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Mean value of the last 24 hours, every half hour, once the watermark has passed it.

    Two windows in a chain: events are summed into half hours first, and only a
    closed half hour enters the 48 days it lies in. Rows without a time of an
    event but with one in ``clock`` move the watermark.
    """
    e = events.withColumn("event_time", F.coalesce(F.col("ts").cast("timestamp"), "clock") if "clock" in events.columns else F.col("ts").cast("timestamp"))
    slots = e.withWatermark("event_time", late).groupBy(F.window("event_time", "30 minutes").alias("w")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("total"), F.count("ts").alias("n"))
    day = slots.withColumn("slot_time", F.window_time("w")).groupBy(F.window("slot_time", "24 hours", "30 minutes").alias("d")).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"))
    return day.where("n > 0").select(F.col("d.end").cast("timestamp_ntz").alias("window_end"), "n",
                                     (F.col("total").cast("double") / F.col("n")).alias("mean_value"))


def split_late(stream: DataFrame, path: str, checkpoint: str, window_end: Column, event_time: str, late: str) -> None:
    """Write every micro-batch to ``path`` with a flag ``late``: its window had ended when the batch arrived.

    The mark is the highest event time of earlier batches less ``late``, as a
    watermark is; here the rows behind it are kept and can be put right. The
    highest time of a batch is observed while it is written, and stored with it.
    """
    spark = stream.sparkSession
    marks = T.StructType.fromDDL("mark TIMESTAMP, n BIGINT, n_late BIGINT, batch BIGINT")

    def sink(batch: DataFrame, batch_id: int) -> None:
        earlier = None
        if batch_id:
            seen = spark.read.schema(marks).option("basePath", f"{path}/marks").parquet(f"{path}/marks")
            earlier = seen.where(F.col("batch") < batch_id).agg((F.max("mark") - F.expr(f"interval {late}")).cast("string")).first()[0]
        flagged = batch.withColumn("late", F.coalesce(window_end <= F.lit(earlier).cast("timestamp"), F.lit(False)))
        seen = Observation()
        counted = flagged.observe(seen, F.max(F.col(event_time).cast("timestamp").cast("string")).alias("mark"), F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"))
        counted.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
        found = seen.get
        row = spark.createDataFrame([(found["mark"], found["n"], found["n_late"])], "mark STRING, n BIGINT, n_late BIGINT")
        row.withColumn("mark", F.col("mark").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def split_rows(spark: SparkSession, path: str, schema: T.StructType, late: bool, stream: bool = True) -> DataFrame:
    """The on-time or the late rows that :func:`split_late` has written, as a stream or as the table so far."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())])
    reader = spark.readStream if stream else spark.read
    return reader.schema(full).option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(F.col("late") == F.lit(late)).drop("late", "batch")


SLOT_TABLE = "series STRING, settlement_period INT, total DECIMAL(38,2), n BIGINT, late_total DECIMAL(38,2), n_late BIGINT, settlement_date DATE"


def publish_slots(slots: DataFrame, table: str, checkpoint: str) -> None:
    """On-time half-hour sums into a table of ``SLOT_TABLE``; a slot sent again replaces its sums."""
    from slotwise.sources.increments import merge_into

    keys = ["series", "settlement_date", "settlement_period"]
    columns = T.StructType.fromDDL(SLOT_TABLE)

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"late_total": F.lit(0), "n_late": F.lit(0)})
        merge_into(batch.sparkSession, table, rows.select(*[F.col(f.name).cast(f.dataType) for f in columns]), keys, "settlement_date")

    q = slots.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def correct_slots(late: DataFrame, sums: Callable[[DataFrame], DataFrame], stored: Callable[[], DataFrame], table: str, checkpoint: str) -> None:
    """Late rows into the table: the late sums of every slot they touch are formed anew from all late rows, so a replayed batch changes nothing.

    ``sums`` turns raw rows into ``series, settlement_date, settlement_period, total, n``;
    ``stored`` reads all late rows so far. The on-time sums stay as they are.
    """
    from slotwise.sources.increments import merge_into

    keys = ["series", "settlement_date", "settlement_period"]
    columns = T.StructType.fromDDL(SLOT_TABLE)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = sums(batch).select(*keys)
        again = sums(stored()).join(touched, keys, "left_semi").select(*keys, F.col("total").alias("late_total"), F.col("n").alias("n_late"))
        on_time = spark.read.schema(columns).parquet(table).drop("late_total", "n_late")
        rows = again.join(on_time, keys, "left").withColumns({"total": F.coalesce("total", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
        merge_into(spark, table, rows.select(*[F.col(f.name).cast(f.dataType) for f in columns]), keys, "settlement_date")

    q = late.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def feed_status(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settled slots and latest slot per published day, kept current as rows arrive; a slot sent again counts once.

    The state holds the slots of a day: at most 50 per series.
    """
    slot = F.struct(*[c for c in ("series", "settlement_period") if c in slots.columns])
    return slots.groupBy(*keys).agg(F.size(F.collect_set(slot)).cast("bigint").alias("n_actual"), F.max("settlement_period").alias("last_sp"))


def latest_slot(slots: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Newest settled slot per series as streaming state of one row per series."""
    rest = ["settlement_date", "settlement_period", "ssp", "price_derivation_code"]
    return slots.groupBy(*keys).agg(F.max("slot_ix").alias("slot_ix"), F.max_by(F.struct(*rest), "slot_ix").alias("r")).select(
        *keys, "slot_ix", "r.*")


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], partition: str, version: str) -> None:
    """Apply revisions: the newest version of a key wins, whatever order the rows arrive in."""
    from slotwise.sources.increments import merge_into

    def sink(batch: DataFrame, batch_id: int) -> None:
        merge_into(batch.sparkSession, table, batch, keys, partition, [-F.col(version)], keep="newest")

    q = (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()


def watch_consistency(counts: DataFrame, path: str, checkpoint: str, keys: Sequence[str], state: Callable[[], DataFrame], corrections: Callable[[], DataFrame]) -> None:
    """After every micro-batch of published counts, the rules between them, the filter's state and its stored corrections.

    ``state`` and ``corrections`` read what is stored at that moment. Days that
    only the state knows take part, which is what the first rule is about.
    """
    from slotwise.operators.monitor import consistency

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        known = latest_updates(spark, f"{path}/counts", keys, batch.schema)
        consistency(known, state(), corrections(), keys).write.mode("overwrite").parquet(f"{path}/status/batch={batch_id}")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def splice_stream(settled: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stream-static join: forecast rows whose outcome has arrived."""
    s = settled.select(*keys, F.col("ssp").alias("actual_now"))
    return s.join(published, list(keys)).withColumn("is_actual", F.lit(True))
