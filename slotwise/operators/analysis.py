"""Descriptive analyses: seasonality, autocorrelation, persistence decay, blends, ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.keys import ratio
from slotwise.operators.joins import horizon_columns
from slotwise.operators.learn import grouped_least_squares, linear_predict
from slotwise.operators.ordered import average_ranks, exact_quantiles
from slotwise.operators.series import frames_by, with_frames


def year_month_table(df: DataFrame, value: str, date: str = "settlement_date") -> DataFrame:
    """Mean per year (rows) and month (columns m1..m12); fixed pivot values need no extra pass."""
    d = df.select(F.year(date).alias("year"), F.month(date).alias("month"), value)
    t = d.groupBy("year").pivot("month", list(range(1, 13))).agg(F.avg(value))
    return t.select("year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def month_means(df: DataFrame, value: str, date: str = "settlement_date") -> DataFrame:
    return df.groupBy(F.month(date).alias("month")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H statistic with tie correction from rank sums per group.

    Ranks live on the table of distinct values; rows reach it already counted
    per (value, group), so a frequent value is one row per group.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    ranks = average_ranks(df.where(F.col(group).isNotNull()), [], value)
    per = counts.join(ranks.select(value, "avg_rank"), value).groupBy(group).agg(
        F.sum(F.col("avg_rank") * F.col("k")).alias("r"), F.sum("k").alias("k"))
    ties = ranks.agg(F.sum(F.pow(F.col("n"), 3) - F.col("n"))).scalar()
    n = F.sum("k").cast("double")
    raw = F.sum(F.col("r") * F.col("r") / F.col("k")) * 12 / (n * (n + 1)) - (n + 1) * 3
    g = per.agg(n.alias("n"), F.count("*").alias("n_groups"), raw.alias("_h")).withColumn("_t", ties)
    return g.select(F.col("n").cast("long").alias("n"), "n_groups",
                    (F.col("_h") / (1 - F.col("_t") / (F.pow("n", 3) - F.col("n")))).alias("h_statistic"))


def harmonics(date: str = "settlement_date", count: int = 2) -> dict[str, Column]:
    base = F.dayofyear(date) * (2 * math.pi / 365.25)
    out = {}
    for k in range(1, count + 1):
        out |= {f"sin_{k}": F.sin(base * k), f"cos_{k}": F.cos(base * k)}
    return out


def fourier_fit(df: DataFrame, value: str, date: str = "settlement_date", clip: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Two-harmonic least-squares fit of the clipped series: amplitudes, peaks, R2.

    The fit needs only sums of products, combined map-side; R2 takes a second
    pass with the coefficients as a scalar. Harmonic 0 is the intercept.
    """
    q = exact_quantiles(df, [], value, {"lo": clip[0], "hi": clip[1]}).select(F.struct("*")).scalar()
    h = harmonics(date)
    d = df.withColumn("_q", q).select(F.least(F.greatest(F.col(value), F.col("_q.lo")), F.col("_q.hi")).alias("y"),
                                      *[c.alias(n) for n, c in h.items()])
    beta = grouped_least_squares(d, [], list(h), "y").select("beta").scalar()
    err = F.col("y") - linear_predict(list(h))
    g = d.withColumn("beta", beta).agg(F.any_value("beta").alias("beta"), (1 - F.sum(err * err) / (F.var_pop("y") * F.count("y"))).alias("r2"))
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(0).alias("harmonic"), F.element_at("beta", 1).alias("amplitude"), none.alias("peak_day"), F.col("r2"))]
    for k in (1, 2):
        s, c = F.element_at("beta", 2 * k), F.element_at("beta", 2 * k + 1)
        turn = F.pmod(F.atan2(s, c), F.lit(2 * math.pi))
        rows.append(F.struct(F.lit(k).alias("harmonic"), F.hypot(s, c).alias("amplitude"), (turn * 365.25 / (2 * math.pi) / k).alias("peak_day"), none.alias("r2")))
    return g.select(F.inline(F.array(*rows)))


def autocorrelation(df: DataFrame, value: str, lags: Sequence[int], keys: Sequence[str] = ("series",),
                    by: Sequence[str] = ()) -> DataFrame:
    """Correlation of the series with itself ``lag`` slots earlier: one pass, one aggregate per lag."""
    d = horizon_columns(df, lags, value, keys)
    g = d.groupBy(*by).agg(*[F.corr(value, f"h{n}").alias(f"l{n}") for n in lags])
    return g.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"l{n}").alias("acf")) for n in lags])))


def partial_autocorrelation(acf: DataFrame, max_lag: int) -> DataFrame:
    """Durbin-Levinson recursion over one row of autocorrelations, as column arithmetic."""
    row = acf.agg(*[F.max(F.when(F.col("lag") == n, F.col("acf"))).alias(f"r{n}") for n in range(1, max_lag + 1)])
    row = row.withColumn("f1_1", F.col("r1"))
    for k in range(2, max_lag + 1):
        num, den = F.col(f"r{k}"), F.lit(1.0)
        for j in range(1, k):
            num = num - F.col(f"f{k - 1}_{j}") * F.col(f"r{k - j}")
            den = den - F.col(f"f{k - 1}_{j}") * F.col(f"r{j}")
        row = row.withColumn(f"f{k}_{k}", num / den)
        row = row.withColumns({f"f{k}_{j}": F.col(f"f{k - 1}_{j}") - F.col(f"f{k}_{k}") * F.col(f"f{k - 1}_{k - j}")
                               for j in range(1, k)})
    out = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"f{k}_{k}").alias("pacf")) for k in range(1, max_lag + 1)])
    return row.select(F.inline(out))


def cross_correlation(df: DataFrame, x: str, y: str, horizons: Sequence[int], by: Sequence[str] = (),
                      keys: Sequence[str] = ("series",)) -> DataFrame:
    """corr(x h slots earlier, y now) per horizon and group."""
    d = with_frames(df, keys, "slot_ix", lambda f: {f"x{h}": f.lag(x, h) for h in horizons}, back=max(horizons))
    g = d.groupBy(*by).agg(*[F.corr(f"x{h}", y).alias(f"c{h}") for h in horizons])
    return g.select(*by, F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"c{h}").alias("corr")) for h in horizons])))


def partial_r2(df: DataFrame, target: str, control: str, signals: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Squared partial correlation of each signal with the target given the control.

    Closed form of residualising both on the control, from pairwise
    correlations over the rows where all three are known.
    """
    d = df.select(*by, target, control, F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("s")) for s in signals])))
    d = d.dropna(subset=[target, control, "s"])
    g = d.groupBy(*by, "signal").agg(F.count("*").alias("n"), F.corr(target, "s").alias("a"), F.corr(target, control).alias("b"),
                                     F.corr("s", control).alias("c"))
    num = F.col("a") - F.col("b") * F.col("c")
    den = (1 - F.col("b") * F.col("b")) * (1 - F.col("c") * F.col("c"))
    return g.select(*by, "signal", "n", ratio(num * num, den).alias("partial_r2"))


def spearman(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """|rho| of each feature with the target over rows where both are known.

    Ranks are assigned to distinct values per feature and joined back to the
    rows counted per (feature, x, y); the mean rank is (n + 1) / 2, so the
    correlation needs one aggregate.
    """
    long = df.select(F.col(target).cast("double").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    pairs = long.where("x IS NOT NULL AND y IS NOT NULL").groupBy("feature", "x", "y").agg(F.count("*").alias("k"))
    rows = long.where("x IS NOT NULL AND y IS NOT NULL")
    rx = average_ranks(rows, ["feature"], "x", "rx").select("feature", "x", "rx", "n_total")
    ry = average_ranks(rows, ["feature"], "y", "ry").select("feature", "y", "ry")
    j = pairs.join(rx, ["feature", "x"]).join(ry, ["feature", "y"])
    mid = (F.col("n_total") + 1) / 2
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    g = j.groupBy("feature").agg(F.sum("k").alias("n"), F.sum(dx * dy * F.col("k")).alias("xy"),
                                 F.sum(dx * dx * F.col("k")).alias("xx"), F.sum(dy * dy * F.col("k")).alias("yy"))
    return g.select("feature", "n", F.abs(ratio("xy", F.sqrt(F.col("xx") * F.col("yy")))).alias("abs_rho"))


def persistence_decay(df: DataFrame, horizons: Sequence[int], value: str = "ssp", by: Sequence[str] = ()) -> DataFrame:
    """Error of carrying the last value forward, per horizon: the horizons are columns, never copied rows."""
    d = horizon_columns(df, horizons, value)
    aggs = []
    for h in horizons:
        e = F.col(value) - F.col(f"h{h}")
        aggs.append(F.struct(F.lit(h).alias("h"), F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"),
                             F.sqrt(F.avg(e * e)).alias("rmse")))
    return d.groupBy(*by).agg(F.array(*aggs).alias("r")).select(*by, F.inline("r"))


def blend_weights(df: DataFrame, horizons: Sequence[int], grid: int = 20, gain_pct: float = 5.0) -> DataFrame:
    """Best weight of the forecast against persistence per horizon, and whether it clears the gate.

    ``df`` has columns actual, q50 and h1..hN. Each weight is one more
    aggregate of the same pass; only one row per horizon is expanded.
    """
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"h{h}").alias("pers")) for h in horizons])
    long = df.select("actual", "q50", F.inline(steps)).where("pers IS NOT NULL AND q50 IS NOT NULL")
    e, d = F.col("actual") - F.col("pers"), F.col("q50") - F.col("pers")
    maes = F.array(*[F.struct(F.avg(F.abs(e - d * (i / grid))).alias("mae"), F.lit(i / grid).alias("alpha")) for i in range(grid + 1)])
    g = long.groupBy("h").agg(F.count("*").alias("n"), maes.alias("m"))
    pick = F.array_min(F.transform("m", lambda r: F.struct(F.round(r["mae"], 9).alias("mae"), r["alpha"].alias("alpha"))))
    pers, fc = F.element_at("m", 1)["mae"], F.element_at("m", -1)["mae"]
    r = g.select("h", "n", pick["alpha"].alias("alpha"), pick["mae"].alias("mae"), pers.alias("mae_persistence"), fc.alias("mae_forecast"))
    better = F.least("mae_persistence", "mae_forecast")
    return r.withColumn("gain_pct", (1 - F.col("mae") / better) * 100).withColumn("ship", F.col("gain_pct") >= gain_pct)


def crossover(df: DataFrame, horizons: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Shortest horizon at which the forecast beats persistence, per group."""
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"h{h}").alias("pers")) for h in horizons])
    long = df.select(*by, "actual", "q50", F.inline(steps)).where("pers IS NOT NULL AND q50 IS NOT NULL")
    g = long.groupBy(*by, "h").agg(F.avg(F.abs(F.col("actual") - F.col("q50"))).alias("f"),
                                   F.avg(F.abs(F.col("actual") - F.col("pers"))).alias("p"))
    return g.groupBy(*by).agg(F.min(F.when(F.col("f") < F.col("p"), F.col("h"))).alias("crossover_h"),
                              F.min(F.col("f") / F.col("p")).alias("best_ratio"))


def volatility_signal(df: DataFrame, widths: Sequence[int] = (6, 12), keys: Sequence[str] = ("series",)) -> DataFrame:
    """Correlation of recent rolling deviation with the size of the next step."""
    d = with_frames(df, keys, "slot_ix", lambda f: {
        **{f"v{w}": f.rolling("ssp", w, "std") for w in widths}, "step": F.abs(F.col("ssp") - f.lag("ssp", 1))}, back=max(widths))
    g = d.agg(*[F.corr(f"v{w}", "step").alias(f"c{w}") for w in widths])
    return g.select(F.inline(F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"c{w}").alias("corr")) for w in widths])))


def smoothed(df: DataFrame, alpha: float, keys: Sequence[str] = ("series",), value: str = "ssp", chunk: int = 512,
             out: str = "es") -> DataFrame:
    """Exponential smoothing of the rows before each slot; exact, though no task sees a whole series.

    The recursion is linear, so a chunk of slots acts on its starting value s as
    ``end0 + (1 - alpha)^m s``: chunks are folded from 0 in parallel, their
    starting values are chained on one row per chunk, and the decayed starting
    value is added back. The first value of a series seeds it.
    """
    keys, keep = list(keys), 1 - alpha
    d = df.where(F.col(value).isNotNull()).withColumn("_chunk", F.floor(F.col("slot_ix") / chunk))
    rows = F.array_sort(F.collect_list(F.struct("slot_ix", F.col(value).alias("v"))))
    path = "array<struct<slot_ix:bigint,before:double,k:int>>"
    start = F.struct(F.lit(0.0).alias("s"), F.from_json(F.lit("[]"), path).alias("out"))

    def push(acc, r):
        row = F.struct(r["slot_ix"].cast("long").alias("slot_ix"), acc["s"].alias("before"), F.size(acc["out"]).alias("k"))
        return F.struct((acc["s"] * keep + r["v"] * alpha).alias("s"), F.concat(acc["out"], F.array(row)).alias("out"))

    parts = d.groupBy(*keys, "_chunk").agg(rows.alias("_p")).select(
        *keys, "_chunk", F.size("_p").alias("m"), F.element_at("_p", 1)["v"].alias("v1"), F.aggregate("_p", start, push).alias("f"))

    def chain(acc, c):
        return F.struct((c["end0"] + acc["s"] * F.pow(F.lit(keep), c["m"])).alias("s"),
                        F.concat(acc["out"], F.array(F.struct(c["c"].alias("_chunk"), acc["s"].alias("s_in")))).alias("out"))

    ends = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_chunk").alias("c"), "m", F.col("f.s").alias("end0"), "v1"))).alias("_q"))
    seed = F.struct(F.element_at("_q", 1)["v1"].alias("s"), F.from_json(F.lit("[]"), "array<struct<_chunk:bigint,s_in:double>>").alias("out"))
    carry = ends.select(*keys, F.element_at("_q", 1)["c"].alias("_first"), F.inline(F.aggregate("_q", seed, chain, lambda a: a["out"])))
    j = parts.select(*keys, "_chunk", F.inline("f.out")).join(carry, [*keys, "_chunk"])
    es = F.when((F.col("_chunk") == F.col("_first")) & (F.col("k") == 0), F.lit(None)).otherwise(
        F.col("before") + F.col("s_in") * F.pow(F.lit(keep), F.col("k")))
    return df.join(j.select(*keys, "slot_ix", es.alias(out)), [*keys, "slot_ix"], "left")


def rolling_ar2(df: DataFrame, days: int = 28, keys: Sequence[str] = ("series",), value: str = "ssp") -> DataFrame:
    """AR(2) forecast refitted for every day on the previous ``days`` days, by windowed normal equations.

    Daily sums of the cross products are added over a day frame; the 2 x 2
    system is solved in columns.
    """
    d = with_frames(df, keys, "slot_ix", lambda f: {"a": f.lag(value, 1), "b": f.lag(value, 2)}, back=2)
    known = d.where("a IS NOT NULL AND b IS NOT NULL")
    y, a, b = F.col(value), F.col("a"), F.col("b")
    sums = {"n": F.lit(1.0), "sa": a, "sb": b, "sy": y, "saa": a * a, "sbb": b * b, "sab": a * b, "say": a * y, "sby": b * y}
    daily = known.groupBy(*keys, "day_ix").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    f = frames_by(keys, "day_ix")
    w = daily.select(*keys, "day_ix", *[f.over(F.sum(n), -days, -1).alias(n) for n in sums])
    c = F.col
    saa, sbb = c("saa") - c("sa") * c("sa") / c("n"), c("sbb") - c("sb") * c("sb") / c("n")
    sab = c("sab") - c("sa") * c("sb") / c("n")
    say, sby = c("say") - c("sa") * c("sy") / c("n"), c("sby") - c("sb") * c("sy") / c("n")
    det = saa * sbb - sab * sab
    fit = w.withColumns({"p1": ratio(say * sbb - sby * sab, det), "p2": ratio(sby * saa - say * sab, det)}).withColumn(
        "c0", (c("sy") - c("p1") * c("sa") - c("p2") * c("sb")) / c("n"))
    fit = fit.select(*keys, "day_ix", "c0", "p1", "p2")
    return known.join(fit, [*keys, "day_ix"], "left").withColumn("ar2", c("c0") + c("p1") * a + c("p2") * b)


def recency_weight(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)
