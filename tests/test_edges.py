"""Cases the synthetic tables do not reach: NULL groups, other years, unlisted values, several series and files."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from slotwise.functions.calendar import bank_holidays
from slotwise.operators import joins, learn
from slotwise.operators.ordered import average_ranks, exact_quantiles
from slotwise.session import shared_dir
from slotwise.streaming import feeds


def test_null_groups_keep_their_quantiles_and_ranks(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    assert {r.g: r.m for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()} == {None: 2.0, "a": 2.0}
    assert {(r.g, r.x): r.avg_rank for r in average_ranks(df, ["g"], "x").collect()} == {(None, 1.0): 1, (None, 3.0): 2, ("a", 2.0): 1}


def test_holidays_of_any_year(spark):
    days = spark.createDataFrame([(dt.date(1980, 5, 1),), (dt.date(2040, 1, 1),), (None,)], "settlement_date date")
    got = {r.holiday_date for r in bank_holidays(days).collect()}
    assert {d.year for d in got} == {1980, 2040}
    assert {dt.date(1980, 4, 4), dt.date(1980, 12, 25), dt.date(2040, 4, 2), dt.date(2040, 12, 26)} <= got


def test_blend_keeps_keys_of_unlisted_locations(spark):
    df = spark.createDataFrame([(1, "x", 10.0), (1, "odd", 99.0), (2, "odd", 5.0)], "k int, place string, v double")
    got = {r.k: r.v for r in joins.blend(df, ["k"], "place", {"x": 0.5}, ["v"]).collect()}
    assert got == {1: 5.0, 2: None}


@pytest.mark.parametrize("reach,hours,found", [(24, 20, True), (24, 34, False), (36, 34, True), (36, 37, False), (48, 48, True)])
def test_publications_within_any_reach(spark, reach, hours, found):
    target = dt.date(2024, 3, 10)
    at = dt.datetime(2024, 3, 9, 12) - dt.timedelta(hours=hours)
    pubs = spark.createDataFrame([(1, at, 5.0)], "settlement_period int, published timestamp_ntz, v double")
    targets = spark.createDataFrame([(target, 1)], "settlement_date date, settlement_period int")
    got = joins.as_of(targets, pubs, ["settlement_period"], "settlement_date", "published", ["v"], reach_hours=reach).first()
    assert got.v == (5.0 if found else None)


def test_permutation_keeps_every_value_under_tied_hashes(spark, monkeypatch):
    real = learn.seeded_hash
    monkeypatch.setattr(learn, "seeded_hash", lambda *c: F.pmod(real(*c), F.lit(3)))
    df = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    got = learn.shuffled(df, "x", 1).collect()
    assert sorted(r.row_id for r in got) == list(range(50)) and sorted(r.x for r in got) == list(range(0, 100, 2))
    assert any(r.x != 2 * r.row_id for r in got)


def test_rollout_takes_weights_of_each_series(spark):
    history = spark.createDataFrame([("a", 1, [1.0] * 48), ("b", 1, [1.0] * 48)], "series string, target_date int, buf array<double>")
    future = spark.createDataFrame([(s, 1, p, 0.0, w) for s, w in (("a", 2.0), ("b", 3.0)) for p in (1, 2)],
                                   "series string, target_date int, settlement_period int, base double, w double")
    got = {(r.series, r.settlement_period): r.pred for r in learn.rollout(history, future, {"lag_1": "w"}).collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 4.0, ("b", 1): 3.0, ("b", 2): 9.0}


def test_streams_over_a_folder_or_one_file(spark, tmp_path):
    rows = spark.range(30).repartition(3)
    rows.write.parquet(str(tmp_path / "many.parquet"))
    for name in ("many.parquet", next(p.name for p in (tmp_path / "many.parquet").glob("part-*"))):
        path = str(tmp_path / "many.parquet" / name) if name.startswith("part") else str(tmp_path / name)
        out = feeds.drain(feeds.landed_stream(spark, path).groupBy((F.col("id") % 2).alias("odd")).count(), ["odd"], "odd")
        assert sum(r["count"] for r in out.collect()) == spark.read.parquet(path).count()


def test_redelivered_slots_count_once(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, 1), p) for p in (1, 2, 2, 3, 3)], "series string, settlement_date date, settlement_period int")
    assert feeds.feed_status(df, ["series", "settlement_date"]).first()["n_actual"] == 3


@pytest.mark.parametrize("seed,block", [(0, 1024), (1, 3), (2, 7)])
def test_quantiles_of_the_other_folds(spark, seed, block):
    import numpy as np

    from slotwise.operators.ordered import quantiles_of_others

    rng = np.random.default_rng(seed)
    rows = [(rng.choice(["a", "b", None]), int(rng.integers(0, 5)), float(rng.integers(0, 12))) for _ in range(200)]
    rows += [("only", 1, 4.0), ("b", None, 100.0), ("a", 2, None), *[("b", 3, 5.0)] * 150]
    df = spark.createDataFrame(rows, "g string, fold int, x double")
    got = {(r.g, r.fold): (r.n, r.q1, r.q8) for r in quantiles_of_others(df, ["g"], "fold", "x", {"q1": 0.1, "q8": 0.8}, block=block).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for f in range(5):
            rest = [x for k, o, x in rows if k == g and o is not None and o != f and x is not None]
            if rest:
                want[g, f] = (len(rest), float(np.quantile(rest, 0.1)), float(np.quantile(rest, 0.8)))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def _session(master, folder=None):
    context = SimpleNamespace(master=master, folder=folder)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))


def test_shared_folder_is_asked_for_off_the_local_master():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session("spark://host:7077"))
    assert shared_dir(_session("spark://host:7077", "hdfs:/shared")) == "hdfs:/shared"
    local = _session("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_restored_outcomes_stay_with_their_series(spark):
    cols = "series string, settlement_date date, settlement_period int, q10 double, q50 double, q90 double, is_actual boolean"
    day = dt.date(2024, 1, 1)
    new = spark.createDataFrame([(s, day, 1, 1.0, 2.0, 3.0, False) for s in ("a", "b")], cols)
    old = spark.createDataFrame([("a", day, 1, 7.0, 7.0, 7.0, True), ("b", day, 1, 9.0, 9.0, 9.0, True)], cols)
    got = joins.restore_actuals(new, old, ["series", *joins.KEY]).collect()
    assert sorted((r.series, r.q50) for r in got) == [("a", 7.0), ("b", 9.0)]


def test_walk_forward_folds_learn_from_the_past_alone(spark):
    days = [(s, dt.date(2024, 1, 1) + dt.timedelta(d), 10.0 * k + d + (100 if d >= 20 else 0), int(d % 2), float(d % 3), float(d)) for k, s in enumerate("ab") for d in range(27)]
    daily = spark.createDataFrame(days, "series string, settlement_date date, level double, low_day int, x double, t double")
    slots = daily.select("series", "settlement_date", F.explode(F.array(F.lit(1), F.lit(2))).alias("settlement_period"), "level").selectExpr(
        "*", "double(settlement_period) AS p", "settlement_period - 1.5D AS deviation_true", "level + settlement_period - 1.5D AS ssp_raw")
    got = learn.walk_forward_two_stage(slots, daily, [("w", "2024-01-15", "2024-01-20"), ("v", "2024-01-21", "2024-01-27")], 3, ["x"], ["t"], ["p"]).collect()
    assert len(got) == 2 * 2 * (6 + 7) and {r.fold for r in got} == {"w", "v"}
    # The series rise by one a day until the level jumps: fold w is exact, fold v misses the jump alone.
    assert all(abs(r.actual - r.q50 - (100 if r.fold == "v" else 0)) < 1e-6 and abs(r.q90 - r.q10) < 1e-6 for r in got)
