import datetime as dt

from pyspark.sql import functions as F

from slotwise.functions.keys import clock_label, local_date, ordinal_period, periods_in_day, slot_index, slot_start
from slotwise.operators import clean as C


def prices(spark, days=2, periods=48, start=dt.date(2025, 5, 1)):
    rows = [("a", start + dt.timedelta(d), p, 80.0 + p, -100.0 + p, "N", None) for d in range(days) for p in range(1, periods + 1)]
    return spark.createDataFrame(rows, "series STRING, settlement_date DATE, settlement_period INT, ssp DOUBLE, "
                                       "net_imbalance_volume DOUBLE, price_derivation_code STRING, replacement_price DOUBLE")


def test_repeats_keep_first_and_are_idempotent(spark):
    p = prices(spark).withColumn("arrival", F.lit(0))
    twice = p.unionByName(p.withColumn("arrival", F.lit(1)).withColumn("ssp", F.lit(0.0)))
    once = C.drop_repeats(twice, ["series", *C.KEY], [F.col("arrival")])
    assert once.count() == 96 and once.where("ssp = 0").count() == 0
    assert C.drop_repeats(once, ["series", *C.KEY], [F.col("arrival")]).exceptAll(once).isEmpty()


def test_missing_slots_reported(spark):
    p = prices(spark).where("not (settlement_date = date'2025-05-02' and settlement_period = 7)")
    gap = C.missing_slots(p).collect()
    assert [(g.settlement_date.isoformat(), g.settlement_period) for g in gap] == [("2025-05-02", 7)]
    assert C.coverage(p).first().missing == 1


def test_slot_times(spark):
    r = prices(spark, 1).select("settlement_period", slot_start().alias("t"), clock_label().alias("l")).collect()
    at = {x.settlement_period: (x.t.strftime("%H:%M"), x.l) for x in r}
    assert at[1] == ("00:00", "00:00") and at[2] == ("00:30", "00:30") and at[48] == ("23:30", "23:30")


def test_base_columns(spark):
    p = prices(spark, 1, 3).withColumn("price_derivation_code", F.when(F.col("settlement_period") == 2, "P"))
    b = {r.settlement_period: r for r in C.base_columns(p).collect()}
    assert b[1].abs_imbalance_volume == 99.0 and b[2].price_derivation_code_P == 1 and b[1].price_derivation_code_P == 0
    assert b[3].replacement_price == 83.0


def test_local_clock_and_clock_change_days(spark):
    d = spark.createDataFrame([("2026-06-21 23:30:00",), ("2026-01-15 23:30:00",), ("2026-03-29 02:00:00",), ("2026-10-25 23:30:00",),
                               ("2026-10-25 01:30:00",)], "t STRING").withColumn("t", F.col("t").cast("timestamp_ntz"))
    r = d.select(local_date("t").alias("d"), ordinal_period("t").alias("p"), periods_in_day(local_date("t")).alias("n")).collect()
    assert [(x.d.isoformat(), x.p, x.n) for x in r] == [
        ("2026-06-22", 2, 48), ("2026-01-15", 48, 48), ("2026-03-29", 5, 46), ("2026-10-25", 50, 50), ("2026-10-25", 6, 50)]


def test_slot_index_never_collides_on_long_days(spark):
    days = spark.sql("SELECT explode(sequence(date'2026-10-23', date'2026-10-27')) AS settlement_date")
    d = days.withColumn("settlement_period", F.explode(F.sequence(F.lit(1), periods_in_day())))
    ix = [r.i for r in d.select(slot_index().alias("i")).orderBy("i").collect()]
    assert ix == list(range(ix[0], ix[0] + 242))
