"""Joins on a table's layout, metrics of the writing pass, fitted trees inside a roll-out."""

import datetime as dt
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from slotwise.operators import learn as L
from slotwise.plans.catalog import QUERIES
from slotwise.session import Tables, fresh_path
from slotwise.sources import files, layout

FOLDER = "/root/testdata/sf0.01"


def operators(df):
    """Names of the executed plan's operators, subqueries and written stages included."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_of_joins_has_no_exchange(spark):
    out = QUERIES["slot_tables_joined_on_layout"].build(Tables(spark, FOLDER))
    plan = operators(out)
    assert plan.count("SortMergeJoin") == 4 and "Exchange" not in plan


def test_bucketed_table_keeps_every_row(spark):
    rows = [(i % 7 if i % 5 else None, i % 3, float(i)) for i in range(200)] + [(1, 1, None)] * 300
    df = spark.createDataFrame(rows, "a int, b int, v double")
    got = layout.write_bucketed(df, ["a", "b"], 4)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert len(got.inputFiles()) <= 4
    keys = layout.duplicated_keys(got, ["a", "b"])
    assert "Exchange" not in operators(keys)
    assert {tuple(r) for r in keys.collect()} == {tuple(r) for r in df.groupBy("a", "b").count().where("count > 1").collect()}
    empty = layout.write_bucketed(df.limit(0), ["a", "b"], 4)
    assert empty.count() == 0
    joined = layout.join_on_layout(got, [empty.withColumnRenamed("v", "w")], ["a", "b"])
    assert joined.count() == len(rows) and joined.where("w IS NOT NULL").isEmpty()


def test_heartbeat_equals_a_recount(spark):
    day = dt.date(2024, 1, 1)
    schema = "settlement_date date, settlement_period int, ssp double"
    rows = [(day + dt.timedelta(d), p, float(p)) for d in range(3) for p in range(1, 49) if (d, p) not in {(1, 5), (2, 48)}]
    path, log = fresh_path(spark, "landed"), fresh_path(spark, "beats")
    landed = files.land_observed(spark.createDataFrame(rows, schema).repartition(5), path, log, "a", F.to_timestamp_ntz(F.lit("2024-01-31 09:00:00")))
    files.land_observed(spark.createDataFrame([], schema), path, log, "empty", F.to_timestamp_ntz(F.lit("2024-01-31 09:00:00")))
    assert landed.count() == len(rows)
    got = {r.feed: r for r in spark.read.parquet(log).collect()}
    assert tuple(got["a"])[1:6] == (142, 3, 2, day + dt.timedelta(2), 47)
    assert tuple(got["empty"])[1:6] == (0, 0, 0, None, None)
    assert got["a"].fetched_at == dt.datetime(2024, 1, 31, 9)


def fitted(spark, names, depth=3, rounds=5):
    rng = random.Random(3)
    rows = [tuple(rng.uniform(0, 100) for _ in names) for _ in range(400)]
    df = spark.createDataFrame([(*r, 0.7 * r[0] + (20 if r[1] > 50 else 0) + 0.1 * r[-1]) for r in rows], ", ".join(f"{n} double" for n in [*names, "y"]))
    va = VectorAssembler(inputCols=names, outputCol="features")
    return GBTRegressor(labelCol="y", featuresCol="features", maxIter=rounds, maxDepth=depth, seed=1).fit(va.transform(df)), va, df


@pytest.mark.parametrize("depth,rounds", [(1, 1), (3, 5), (5, 8)])
def test_flat_trees_predict_as_the_model(spark, depth, rounds):
    names = ["a", "b", "c"]
    model, va, df = fitted(spark, names, depth, rounds)
    x = F.array(*names)
    both = va.transform(df).withColumn("e", L.stored_ensemble(model).scalar()).withColumn("own", L.ensemble_value(F.col("e"), x, depth))
    assert model.transform(both).where(F.abs(F.col("own") - F.col("prediction")) > 1e-9).isEmpty()
    # Values on a threshold go left; a missing input has no prediction.
    cuts = [n.threshold for t in both.first().e for n in t.nodes if n.feature == 0]
    edge = spark.createDataFrame([(c, 50.0, 1.0) for c in cuts] or [(0.0, 50.0, 1.0)], "a double, b double, c double").withColumn("e", L.stored_ensemble(model).scalar())
    assert model.transform(va.transform(edge)).where(F.abs(L.ensemble_value(F.col("e"), x, depth) - F.col("prediction")) > 1e-9).isEmpty()
    assert edge.select(L.ensemble_value(F.col("e"), F.array("a", F.lit(None).cast("double"), "c"), depth).alias("v")).where("v IS NOT NULL").isEmpty()


def test_tree_rollout_feeds_its_own_predictions(spark):
    names = ["lag_1", "lag_48", "roll_mean_6", "wind"]
    model, _, _ = fitted(spark, names)
    rng = random.Random(4)
    day = dt.date(2024, 1, 2)
    history = {s: [rng.uniform(0, 100) for _ in range(48)] for s in "ab"}
    wind = {s: [rng.uniform(0, 100) for _ in range(48)] for s in "ab"}
    hist = spark.createDataFrame([(s, day, b) for s, b in history.items()], "series string, target_date date, buf array<double>")
    fut = spark.createDataFrame([(s, day, p + 1, w) for s, ws in wind.items() for p, w in enumerate(ws)], "series string, target_date date, settlement_period int, wind double")
    got = {(r.series, r.settlement_period): r.pred for r in L.fitted_tree_rollout(hist, fut, model, names, cap=60.0).collect()}
    assert len(got) == 96
    from pyspark.ml.linalg import Vectors
    for s, buf in history.items():
        buf = list(buf)
        for p, w in enumerate(wind[s], 1):
            y = model.predict(Vectors.dense([buf[-1], buf[-48], sum(buf[-6:]) / 6, w]))
            assert abs(got[s, p] - y) < 1e-9, (s, p)
            buf = [*buf[1:], min(max(y, -500.0), 60.0)]


def test_tree_rollout_stops_at_a_missing_input(spark):
    names = ["lag_1", "roll_mean_6", "wind"]
    model, _, _ = fitted(spark, names)
    day = dt.date(2024, 1, 2)
    hist = spark.createDataFrame([("a", day, [float(i) for i in range(48)])], "series string, target_date date, buf array<double>")
    fut = spark.createDataFrame([("a", day, p, None if p == 3 else 5.0) for p in range(1, 6)], "series string, target_date date, settlement_period int, wind double")
    got = [r.pred for r in L.fitted_tree_rollout(hist, fut, model, names, cap=60.0).orderBy("settlement_period").collect()]
    assert [v is None for v in got] == [False, False, True, True, True]
    assert L.fitted_tree_rollout(hist.limit(0), fut, model, names).count() == 0
