"""SQL twins of the adapters in ``inputs.py`` and of a few shared steps, as named CTEs."""

CTES: dict[str, str] = {}

CTES["c_ev"] = """
SELECT event_id, ts, user_id, event_type, CAST(ts AS DATE) AS settlement_date,
       CAST(hour(ts) * 2 + floor(minute(ts) / 30) + 1 AS INTEGER) AS settlement_period,
       CAST(value AS DECIMAL(18,2)) AS dval, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
FROM events"""

_PANEL = """
SELECT series, settlement_date, settlement_period,
       datediff('day', DATE '1970-01-01', settlement_date) * 48 + settlement_period - 1 AS slot_ix,
       datediff('day', DATE '1970-01-01', settlement_date) AS day_ix,
       ssp, net_imbalance_volume,
       CASE WHEN net_imbalance_volume > 100 THEN 'P' WHEN net_imbalance_volume < -100 THEN 'N'
            WHEN net_imbalance_volume > 0 THEN 'K' END AS price_derivation_code,
       CASE WHEN net_imbalance_volume > 100 THEN top END AS replacement_price, wind_pct, gas_pct
FROM (SELECT {series} AS series, settlement_date, settlement_period,
             CAST(sum(dval) AS DOUBLE) / count(*) * 2 - 30 AS ssp,
             CAST(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN dval ELSE -dval END) AS DOUBLE)
                 AS net_imbalance_volume,
             CAST(max(dval) AS DOUBLE) AS top,
             CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) * 100.0 / count(*) AS wind_pct,
             CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) * 100.0 / count(*) AS gas_pct
      FROM c_ev GROUP BY 1, 2, 3) g"""
CTES["c_panel"] = _PANEL.format(series="'all'")
CTES["c_panel_type"] = _PANEL.format(series="event_type")

CTES["c_weather"] = """
SELECT date_trunc('hour', ts) AS datetime_utc,
       CAST(sum(k) AS DOUBLE) / count(*) / 4.0 - 2 AS temp_c,
       CAST(sum(dval) AS DOUBLE) / count(*) / 5 AS wind_ms,
       CAST(count(*) AS DOUBLE) * 10.0 AS solar_wm2, CAST(min(k) AS DOUBLE) / 10.0 AS precip_mm
FROM c_ev WHERE event_type = 'purchase' GROUP BY 1"""

CTES["c_trades"] = """
SELECT settlement_date, settlement_period, event_type AS provider,
       CASE WHEN k % 10 <> 0 THEN dval END AS price, CASE WHEN k % 7 <> 0 THEN k END AS volume FROM c_ev"""

CTES["c_mid"] = """
SELECT settlement_date, settlement_period,
       CASE WHEN sum(coalesce(volume, 0)) > 0
            THEN CAST(sum(price * coalesce(volume, 0)) AS DOUBLE) / CAST(sum(coalesce(volume, 0)) AS DOUBLE)
            ELSE CAST(sum(price) AS DOUBLE) / count(*) END AS mid_price,
       CAST(sum(coalesce(volume, 0)) AS DOUBLE) AS mid_volume
FROM c_trades WHERE price IS NOT NULL GROUP BY 1, 2"""

CTES["c_vintage"] = """
SELECT *, tsdf_fc_mw - windfor_fc_mw - 50 AS surplus_fc_mw FROM (
  SELECT settlement_date, settlement_period,
         CAST(sum(CASE WHEN event_type = 'click' THEN dval * 10 END) AS DOUBLE) AS windfor_fc_mw,
         CAST(sum(dval * 20) AS DOUBLE) + 100 AS tsdf_fc_mw
  FROM c_ev GROUP BY 1, 2)"""

CTES["c_cpi"] = """
SELECT * FROM (
  SELECT CAST(date_trunc('month', o_orderdate) + INTERVAL 276 MONTH AS DATE) AS year_month,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 2500 AS cpi_index
  FROM orders GROUP BY 1) WHERE month(year_month) % 5 <> 0"""

CTES["c_fence"] = """
SELECT series, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi
FROM (SELECT series, quantile_cont(ssp, 0.25) AS q1, quantile_cont(ssp, 0.75) AS q3 FROM c_panel GROUP BY 1)"""

CTES["c_clean"] = """
SELECT p.* REPLACE (least(greatest(p.ssp, lo), hi) AS ssp), p.ssp AS ssp_raw, p.ssp < lo OR p.ssp > hi AS is_spike
FROM c_panel p JOIN c_fence USING (series)"""

CTES["c_wf"] = """
SELECT series, settlement_date, settlement_period, slot_ix, day_ix,
       'fold_' || CAST((day_ix - 19723) // 7 AS VARCHAR) AS fold, ssp AS actual,
       round(m + 1.3e-8, 6) AS q50, round(m - s * 0.8 + 1.3e-8, 6) AS q10, round(m + s * 0.8 + 1.3e-8, 6) AS q90,
       price_derivation_code, net_imbalance_volume, wind_pct
FROM (SELECT *, avg(ssp) OVER w AS m, stddev_samp(ssp) OVER w AS s, count(ssp) OVER w AS n FROM c_panel
      WINDOW w AS (PARTITION BY series, settlement_period ORDER BY day_ix RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING))
WHERE n >= 3"""

CTES["c_daily"] = """
SELECT 'all' AS series, CAST(o_orderdate AS DATE) AS settlement_date,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 2500 AS price, count(*) AS n_orders,
       datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day_ix
FROM orders GROUP BY 1, 2, 5"""
CTES["c_daily_prio"] = """
SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS settlement_date,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 2500 AS price, count(*) AS n_orders,
       datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day_ix
FROM orders GROUP BY 1, 2, 5"""

CTES["c_long"] = """
SELECT 'all' AS series, settlement_date, settlement_period, ssp, volume,
       datediff('day', DATE '1970-01-01', settlement_date) AS day_ix,
       datediff('day', DATE '1970-01-01', settlement_date) * 48 + settlement_period - 1 AS slot_ix
FROM (SELECT CAST(l_shipdate AS DATE) AS settlement_date, CAST(l_suppkey % 48 + 1 AS INTEGER) AS settlement_period,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
               / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 12 - 40 AS ssp, sum(l_quantity) AS volume
      FROM lineitem GROUP BY 1, 2)"""

CTES["c_level"] = """
SELECT series, settlement_date, day_ix, count(*) AS n_slots, avg(ssp) AS ssp_mean FROM c_panel GROUP BY 1, 2, 3"""

CTES["c_wf3"] = """
SELECT series, settlement_date, settlement_period, slot_ix, day_ix,
       round(m + 1.3e-8, 6) AS q50, round(m - s * 1.2 + 1.3e-8, 6) AS q10, round(m + s * 1.2 + 1.3e-8, 6) AS q90
FROM (SELECT *, avg(ssp) OVER w AS m, stddev_samp(ssp) OVER w AS s, count(ssp) OVER w AS n FROM c_panel
      WINDOW w AS (PARTITION BY series, settlement_period ORDER BY day_ix RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING))
WHERE n >= 2"""

CTES["c_delta"] = """
SELECT settlement_period, greatest(quantile_cont(greatest(q10 - actual, actual - q90), 0.8), 0) AS delta FROM c_wf GROUP BY 1"""

CTES["c_cal"] = """
SELECT w.*, delta, q10 - delta AS lo, q90 + delta AS hi FROM c_wf w JOIN c_delta USING (settlement_period)"""

CTES["c_risk"] = """
SELECT d.series, d.settlement_date, CAST(coalesce(p.elevated, 0) AS BIGINT) AS elevated_count_lag1d,
       coalesce(p.wind, 100) AS wind_pct_lag1d,
       coalesce(p.elevated, 0) >= 5 OR (coalesce(p.wind, 100) < 10 AND month(d.settlement_date) IN (3, 4, 5, 9, 10, 11)) AS spike_risk_flag
FROM (SELECT DISTINCT series, settlement_date, day_ix FROM c_panel) d
LEFT JOIN (SELECT series, day_ix + 1 AS day_ix, sum(CASE WHEN ssp > 120 THEN 1 ELSE 0 END) AS elevated, avg(wind_pct) AS wind
           FROM c_panel GROUP BY 1, 2) p ON p.series = d.series AND p.day_ix = d.day_ix"""

CTES["c_wfr"] = """
SELECT w.*, coalesce(r.spike_risk_flag, FALSE) AS spike_risk_flag, r.elevated_count_lag1d
FROM c_wf w LEFT JOIN c_risk r USING (series, settlement_date)"""


def least_squares(name: str, source: str, xs: list[str], y: str, keys: list[str], weight: str = "1.0") -> str:
    """CTEs ending in ``name`` (keys, n_train, b0, b1, ...): weighted least squares by elimination on centred products.

    A column that the earlier ones explain gets coefficient 0.
    """
    cols = [*xs, y]
    last, by = len(cols), ", ".join(keys)
    whole = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    means = ", ".join(f"sum({weight} * {c}) / sum({weight}) AS m_{i}" for i, c in enumerate(cols, 1))
    pairs = [(i, j) for i in range(1, last) for j in range(i, last + 1)]
    products = ", ".join(f"sum({weight} * ({cols[i - 1]} - m_{i}) * ({cols[j - 1]} - m_{j})) AS g0_{i}_{j}" for i, j in pairs)
    kept = ", ".join(f"any_value(m_{i}) AS m_{i}" for i in range(1, last + 1))
    steps = [f"{name}_m AS (SELECT {by}, count(*) AS n_train, {means} FROM {source} WHERE {whole} GROUP BY {by})",
             f"{name}_0 AS (SELECT {by}, any_value(n_train) AS n_train, {kept}, {products} FROM {source} JOIN {name}_m USING ({by}) WHERE {whole} GROUP BY {by})"]
    for p in range(1, last - 1):
        def less(i: int, j: int) -> str:
            return f"g{p-1}_{i}_{j} - CASE WHEN g{p-1}_{p}_{p} > 1e-9 THEN g{p-1}_{p}_{i} * g{p-1}_{p}_{j} / g{p-1}_{p}_{p} ELSE 0 END AS g{p}_{i}_{j}"

        steps.append(f"{name}_{p} AS (SELECT *, " + ", ".join(less(i, j) for i, j in pairs if i > p) + f" FROM {name}_{p-1})")
    back = []
    for i in range(last - 1, 0, -1):
        rest = "".join(f" - g{i-1}_{i}_{j} * b{j}" for j in range(i + 1, last))
        back.append(f"CASE WHEN g{i-1}_{i}_{i} > 1e-9 THEN (g{i-1}_{i}_{last}{rest}) / g{i-1}_{i}_{i} ELSE 0 END AS b{i}")
    origin = f"m_{last}" + "".join(f" - b{i} * m_{i}" for i in range(1, last))
    steps.append(f"{name} AS (SELECT {by}, n_train, {', '.join(back)}, {origin} AS b0 FROM {name}_{last-2})")
    return ",\n".join(steps)


def reweighted(name: str, source: str, xs: list[str], y: str, keys: list[str], first: tuple[str, str], later: tuple[str, str], rounds: int) -> str:
    """CTEs ending in ``name``: rounds of :func:`least_squares` whose weight and target follow from the last round's forecast z and a bandwidth h.

    ``first`` and ``later``: weight and target of the first and of the other rounds, over the columns of ``source``, z and h.
    """
    whole, by = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y]), ", ".join(keys)
    steps = []
    for r in range(rounds):
        fit, rows = name if r == rounds - 1 else f"{name}_fit{r}", f"{name}_rows{r}"
        (w, t), z = (first, "0.0") if r == 0 else (later, predicted(xs, f"{name}_fit{r - 1}"))
        joined = f" JOIN {name}_fit{r - 1} USING ({by}) JOIN {name}_scale USING ({by})" if r else ""
        h = f"greatest(scale_ * {0.5 ** (r - 1)}, 1e-6)" if r else "1.0"
        if r == 1:
            steps.append(f"{name}_scale AS MATERIALIZED (SELECT {by}, avg(abs({y} - {z})) AS scale_ FROM {source} JOIN {name}_fit0 USING ({by}) WHERE {whole} GROUP BY {by})")
        steps.append(f"{rows} AS MATERIALIZED (SELECT *, {w} AS w_, {t} AS t_ FROM (SELECT {source}.*, {z} AS z, {h} AS h FROM {source}{joined} WHERE {whole}))")
        steps.append(least_squares(fit, rows, xs, "t_", keys, "w_"))
    return ",\n".join(steps)


def predicted(xs: list[str], fit: str) -> str:
    return f"({fit}.b0" + "".join(f" + {fit}.b{i} * {c}" for i, c in enumerate(xs, 1)) + ")"
