import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotwise.operators import analysis as A
from slotwise.operators import learn as L
from slotwise.operators import metrics as M
from slotwise.operators import series as SR
from slotwise.operators.ordered import average_ranks, exact_quantiles, running_by_value

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def series(n=1500, gaps=0.1, seed=1):
    r = random.Random(seed)
    ix = [i for i in range(n) if r.random() > gaps]
    return pd.DataFrame({"series": "a", "slot_ix": ix, "ssp": [r.gauss(80, 30) for _ in ix]})


def test_chunked_frames_equal_whole_series_frames(spark):
    pdf = series()
    d = frame(spark, pdf)

    def build(f):
        return {"l48": f.lag("ssp", 48), "m": f.rolling("ssp", 48, "mean"), "s": f.rolling("ssp", 336, "std"), "nx": f.at("ssp", 2)}

    a = SR.with_frames(d, ["series"], "slot_ix", build, back=337, ahead=3, chunk=400).toPandas().sort_values("slot_ix")
    full = pdf.set_index("slot_ix")["ssp"].reindex(range(1500))
    want = pd.DataFrame({"l48": full.shift(48), "m": full.shift(1).rolling(48, min_periods=1).mean(),
                         "s": full.shift(1).rolling(336, min_periods=2).std(), "nx": full.shift(-2)}).loc[pdf.slot_ix]
    for c in want:
        np.testing.assert_allclose(a[c].to_numpy(float), want[c].to_numpy(), rtol=1e-9, equal_nan=True)


def test_frames_never_use_one_partition(spark):
    d = frame(spark, series(300))
    plan = SR.with_frames(d, ["series"], "slot_ix", lambda f: {"x": f.lag("ssp", 1)}, back=1)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@SLOW
@given(st.lists(st.integers(-50, 50).map(lambda x: x / 4), min_size=1, max_size=200), st.sampled_from([1000, 100_000]))
def test_exact_quantiles(spark, values, whole):
    d = spark.createDataFrame([("k", float(v)) for v in values], "k STRING, v DOUBLE")
    q = exact_quantiles(d, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.8}, whole=whole).first()
    np.testing.assert_allclose([q.a, q.b, q.c], np.quantile(values, [0.1, 0.5, 0.8]), atol=1e-9)


def test_large_groups_are_bracketed(spark):
    """Groups beyond the whole size: only what lies in the brackets is ordered, and the quantiles stay exact."""
    r = np.random.default_rng(8)
    groups = {"normal": r.normal(0, 50, 60_000), "ties": r.integers(0, 7, 45_000).astype(float), "hot": np.r_[np.zeros(30_000), r.normal(0, 1, 15_000)],
              "small": r.normal(5, 1, 11), None: np.arange(20_000, dtype=float)}
    pdf = pd.concat([pd.DataFrame({"g": g, "x": v}) for g, v in groups.items()])
    d = spark.createDataFrame(pdf, "g string, x double").repartition(16, F.rand(1))
    probs = {"a": 0.0, "b": 0.0001, "c": 0.25, "d": 0.2503, "e": 0.5, "f": 0.98, "h": 1.0}
    for q in exact_quantiles(d, ["g"], "x", probs).collect():
        np.testing.assert_allclose([q[n] for n in probs], np.quantile(groups[q.g], list(probs.values())), atol=1e-9)
    q = exact_quantiles(d, [], "x", probs).first()
    np.testing.assert_allclose([q[n] for n in probs], np.quantile(np.concatenate(list(groups.values())), list(probs.values())), atol=1e-9)
    assert exact_quantiles(d.limit(0), [], "x", {"a": 0.5}).first().a is None and exact_quantiles(d.limit(0), ["g"], "x", {"a": 0.5}).count() == 0


@pytest.mark.parametrize("gaps", [0.0, 0.4, 0.97])
def test_block_statistics_equal_plain_frames(spark, gaps, monkeypatch):
    monkeypatch.setattr(SR, "SHORT", 0)
    pdf = series(1300, gaps, seed=3)
    pdf["ssp"] = pdf["ssp"].where(pdf.index % 5 != 0).where(pdf.slot_ix < 700, 1e6)
    pdf["k"] = (pdf.slot_ix % 3).astype("int64")
    d = frame(spark, pdf)

    def build(f):
        out = {f"{s}_{w}_{int(now)}": f.rolling("ssp", w, s, include_current=now) for s in ("mean", "std", "min", "max", "sum", "count") for w in (1, 6, 48, 336) for now in (False, True)}
        return out | {"few": f.rolling("ssp", 48, "mean", min_periods=9), "k_sum": f.rolling("k", 6, "sum"), "k_abs": f.rolling(F.abs("k"), 6, "max")}

    got = SR.with_frames(d, ["series"], "slot_ix", build, back=337, chunk=400).toPandas().sort_values("slot_ix").reset_index(drop=True)
    want = d.withColumns(build(SR.frames_by(["series"], "slot_ix"))).toPandas().sort_values("slot_ix").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and str(got.k_sum.dtype) == str(want.k_sum.dtype)
    for c in got.columns[1:]:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
    # A window of equal values has no deviation at all, whatever stood before it.
    assert (got.loc[(got.slot_ix > 1060) & got.std_48_0.notna(), "std_48_0"] == 0).all()


def test_hot_value_third_of_rows(spark):
    v = [0.0] * 4000 + [float(i) for i in range(8000)]
    d = spark.createDataFrame([(x,) for x in v], "v DOUBLE")
    q = exact_quantiles(d, [], "v", {"a": 0.25, "b": 0.75}).first()
    np.testing.assert_allclose([q.a, q.b], np.quantile(v, [0.25, 0.75]))
    r = average_ranks(d, [], "v").where("v = 0").first()
    assert r.n == 4001 and r.avg_rank == 2001.0


def test_running_totals_descending(spark):
    d = spark.createDataFrame([(float(i % 7), 1) for i in range(70)], "p DOUBLE, y INT")
    r = {x.p: x.cum_n for x in running_by_value(d, [], "p", {"n": F.sum("y")}, descending=True, buckets=4).collect()}
    assert r == {6.0: 10, 5.0: 20, 4.0: 30, 3.0: 40, 2.0: 50, 1.0: 60, 0.0: 70}


def test_fill_crosses_chunks(spark):
    rows = [("a", i, {3: 5.0, 90: 9.0}.get(i)) for i in range(100)]
    d = spark.createDataFrame(rows, "series STRING, slot_ix BIGINT, v DOUBLE")
    f = SR.fill_forward(d, ["series"], "slot_ix", ["v"], chunk=10).toPandas().sort_values("slot_ix")["v"].tolist()
    assert all(x is None or np.isnan(x) for x in f[:3]) and f[3:90] == [5.0] * 87 and f[90:] == [9.0] * 10
    b = SR.fill_forward(d, ["series"], "slot_ix", ["v"], chunk=10, backward=True).toPandas().sort_values("slot_ix")["v"].tolist()
    assert b[:4] == [5.0] * 4 and b[4:91] == [9.0] * 87


def test_runs_merge_over_chunk_borders(spark):
    state = ["x"] * 25 + ["y"] * 3 + ["x"] * 12
    d = frame(spark, pd.DataFrame({"series": "a", "slot_ix": range(40), "s": state}))
    r = sorted((x.run_start, x.run_end, x.s) for x in SR.runs(d, ["series"], "slot_ix", "s", chunk=5).collect())
    assert r == [(0, 24, "x"), (25, 27, "y"), (28, 39, "x")]


def test_interpolation_edges(spark):
    d = spark.createDataFrame([("d", 1, None), ("d", 2, 10.0), ("d", 3, None), ("d", 4, 20.0), ("d", 5, None)], "d STRING, p INT, v DOUBLE")
    r = SR.interpolate_in_day(d, ["d"], "p", "v", "o").orderBy("p").collect()
    assert [x.o for x in r] == [10.0, 10.0, 15.0, 20.0, 20.0]


def test_average_precision_matches_definition(spark):
    r = random.Random(3)
    rows = [(round(r.random(), 1), int(r.random() < 0.3)) for _ in range(300)]
    d = spark.createDataFrame(rows, "p DOUBLE, y INT")
    got = M.average_precision(d, "p", "y").first().average_precision
    tp = fp = 0
    want, pos = 0.0, sum(y for _, y in rows)
    for s in sorted({p for p, _ in rows}, reverse=True):
        k = [y for p, y in rows if p == s]
        tp += sum(k)
        fp += len(k) - sum(k)
        want += sum(k) / pos * tp / (tp + fp)
    assert abs(got - want) < 1e-12


def test_fourier_fit_matches_direct_solve(spark):
    days = pd.date_range("2020-01-01", periods=1500)
    w = 2 * np.pi / 365.25 * days.dayofyear.to_numpy()
    y = 100 + 12 * np.cos(w - 1.0) + 5 * np.sin(2 * w) + np.random.default_rng(0).normal(0, 3, 1500)
    d = spark.createDataFrame(pd.DataFrame({"settlement_date": days.date, "y": y}))
    r = {x.harmonic: x for x in A.fourier_fit(d, "y", clip=(0.0, 1.0)).collect()}
    x = np.column_stack([np.ones(1500), np.sin(w), np.cos(w), np.sin(2 * w), np.cos(2 * w)])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    np.testing.assert_allclose([r[0].amplitude, r[1].amplitude, r[2].amplitude], [b[0], np.hypot(b[1], b[2]), np.hypot(b[3], b[4])], rtol=1e-6)


def test_permutation_keeps_rows_and_values(spark):
    d = spark.createDataFrame([(str(i), float(i), float(-i)) for i in range(500)], "row_id STRING, x DOUBLE, z DOUBLE")
    s = L.shuffled(d, "x", 7).toPandas()
    assert sorted(s.x) == [float(i) for i in range(500)] and sorted(s.row_id) == sorted(str(i) for i in range(500))
    assert (s.x != -s.z).sum() > 400


def test_lasso_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 20))
    y = 3 * x[:, 0] - 2 * x[:, 5] + rng.normal(scale=0.1, size=80)
    beta, c, alpha = L._lasso_path(x, y, steps=2000)
    grad = (x - x.mean(0)).T @ (y - c - x @ beta) / len(y)
    assert np.all(np.abs(grad) <= alpha * (1 + 1e-3) + 1e-6)
    on = np.abs(beta) > 1e-8
    np.testing.assert_allclose(grad[on], alpha * np.sign(beta[on]), atol=1e-5)


def test_grouped_least_squares_weighted(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 50), "x": rng.normal(size=100), "w": rng.uniform(0.1, 1, 100)})
    pdf["y"] = 2 + 3 * pdf.x + rng.normal(size=100)
    got = {r.g: r.beta for r in L.grouped_least_squares(spark.createDataFrame(pdf), ["g"], ["x"], "y", "w").collect()}
    for g, p in pdf.groupby("g"):
        s = np.sqrt(p.w)
        want = np.linalg.lstsq(np.column_stack([s, s * p.x]), s * p.y, rcond=None)[0]
        np.testing.assert_allclose(got[g], want, rtol=1e-8)
