"""Every registered query against its SQL twin at the smallest scale (``SF`` picks another)."""

import os

import pytest

from check import compare, connect
from slotwise.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf{}".format(os.environ.get("SF", "0.001"))
# Need complete days or unbroken daily lags, which the smallest scale has none of.
WHOLE_DAYS = {"complete_days", "recursive_rollout", "lagged_day_profiles", "slot_lasso_backtest", "slot_lasso_coefficients", "fitted_rollout",
              "level_sweep", "fitted_quantiles", "fitted_day_class", "tree_rollout"}


def folder_of(name):
    return "/root/testdata/sf0.01" if name in WHOLE_DAYS and "SF" not in os.environ else FOLDER


@pytest.fixture(scope="module")
def duck():
    return {f: connect(f) for f in (FOLDER, "/root/testdata/sf0.01")}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.body is not None])
def test_matches_sql(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, folder_of(name))
    rows = [tuple(r) for r in df.collect()]
    cur = duck[folder_of(name)].execute(q.sql())
    assert compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description]) == ""
    assert rows


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.body is None])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, folder_of(name)).collect()


@pytest.mark.parametrize("name", ["persistence_nowcast", "streamed_nowcast"])
def test_nowcast_of_a_regime_without_a_band(spark, tmp_path, name):
    """Until 21 January every slot is of one regime; two series end in the other one, which then has no band."""
    con = connect("/root/testdata/sf0.001")
    con.execute(f"""COPY (SELECT * REPLACE (value + 200 AS value) FROM events WHERE event_type NOT IN ('purchase', 'signup') OR ts >= DATE '2024-01-22')
                    TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES[name].run(spark, str(tmp_path))
    cur = con.execute(QUERIES[name].sql())
    want = cur.fetchall()
    assert compare([tuple(r) for r in df.collect()], df.columns, want, [c[0] for c in cur.description]) == ""
    assert len(want) == 9
