"""Forecast scoring tables: one grouped pass with map-side partial aggregates each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import scoring as S
from slotwise.functions.keys import col, ratio
from slotwise.operators.ordered import exact_quantiles, quantiles_of_others
from slotwise.operators.series import frames_by


def point_scores(y="actual", p="q50") -> dict[str, Column]:
    return {"mae": S.mae(y, p), "rmse": S.rmse(y, p), "mape": S.mape(y, p), "smape": S.smape(y, p)}


def band_scores(y="actual", lo="q10", hi="q90") -> dict[str, Column]:
    return {
        "coverage": S.coverage_pct(y, lo, hi),
        "width": F.avg(col(hi) - col(lo)),
        "interval_score": F.avg(S.interval_score(y, lo, hi)),
    }


def pinball_score(y="actual", lo="q10", hi="q90") -> Column:
    return (F.avg(S.pinball(y, lo, 0.1)) + F.avg(S.pinball(y, hi, 0.9))) / 2


def score(df: DataFrame, keys: Sequence[str], scores: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in scores.items()])


def score_rollup(df: DataFrame, outer: str, inner: str, scores: dict[str, Column]) -> DataFrame:
    """Scores per (outer, inner), per outer, and overall, in one pass; 'all' marks a total."""
    g = df.rollup(outer, inner).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in scores.items()],
                                    F.grouping(outer).alias("_go"), F.grouping(inner).alias("_gi"))
    return g.withColumns({
        outer: F.when(F.col("_go") == 1, "all").otherwise(F.col(outer)),
        inner: F.when(F.col("_gi") == 1, "all").otherwise(F.col(inner)),
    }).drop("_go", "_gi")


def day_decomposition(df: DataFrame, keys: Sequence[str], y="actual", p="q50", period="settlement_period") -> DataFrame:
    """Per day: level error, profile correlation and distance between the peak slots."""

    def first_max(v):
        return F.max_by(period, F.struct(F.col(v), -F.col(period)))

    varied = (F.stddev_pop(y) > 0) & (F.stddev_pop(p) > 0)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.abs(F.avg(p) - F.avg(y)).alias("level_error"),
        F.when(varied, F.corr(y, p)).alias("shape_corr"),
        F.abs(first_max(p) - first_max(y)).alias("peak_offset"),
    )


def decomposition(df: DataFrame, group: Sequence[str], day: Sequence[str]) -> DataFrame:
    d = day_decomposition(df, [*group, *day]).where("n >= 2")
    return d.groupBy(*group).agg(
        F.count("*").alias("n_days"), F.avg("level_error").alias("level_mae"),
        F.avg("shape_corr").alias("shape_corr"), F.avg("peak_offset").alias("peak_offset"))


def coverage_wilson(df: DataFrame, keys: Sequence[str], y="actual", lo="q10", hi="q90") -> DataFrame:
    """Coverage with its 90 % Wilson interval, in percent; rows lacking a bound or outcome are left out."""
    d = df.dropna(subset=[y, lo, hi]).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(S.covered(y, lo, hi)).alias("_p"))
    a, b = S.wilson(F.col("_p"), F.col("n"))
    return d.select(*keys, "n", (F.col("_p") * 100).alias("coverage"), (a * 100).alias("ci_lo"), (b * 100).alias("ci_hi"))


def winsorised_residual(df: DataFrame, keys: Sequence[str], tail: float = 0.05) -> DataFrame:
    r = df.select(*keys, (F.col("actual") - F.col("q50")).alias("e")).where("e IS NOT NULL")
    q = exact_quantiles(r, keys, "e", {"lo": tail, "hi": 1 - tail, "median": 0.5})
    joined = r.join(q, list(keys)) if keys else r.withColumn("_q", q.select(F.struct("*")).scalar()).select("e", "_q.*")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.least(F.greatest("e", "lo"), "hi")).alias("win_mean"),
        F.any_value("median").alias("median"))


def daily_bias(df: DataFrame, keys: Sequence[str] = ("series",), days: int = 7) -> DataFrame:
    """Daily mean residual and its mean over the last ``days`` days."""
    d = df.groupBy(*keys, "settlement_date", "day_ix").agg(F.avg(F.col("actual") - F.col("q50")).alias("bias"))
    f = frames_by(keys, "day_ix")
    return d.withColumn("bias_7d", f.rolling("bias", days, "mean", include_current=True))


def rolling_coverage(df: DataFrame, keys: Sequence[str] = ("series",), days: int = 7) -> DataFrame:
    """Daily coverage with both 7-day forms: mean of the daily shares and pooled share."""
    d = df.groupBy(*keys, "settlement_date", "day_ix").agg(
        F.sum(S.covered("actual", "q10", "q90")).alias("k"), F.count("*").alias("n"))
    f = frames_by(keys, "day_ix")
    share = ratio(F.col("k") * 100.0, "n")
    return d.withColumns({
        "coverage": share,
        "mean_of_ratios": f.rolling(share, days, "mean", include_current=True),
        "ratio_of_sums": ratio(f.rolling("k", days, "sum", include_current=True) * 100.0,
                               f.rolling("n", days, "sum", include_current=True)),
    })


def risk_split(df: DataFrame, flag: str = "spike_risk_flag", limit: float = 150.0) -> DataFrame:
    return df.groupBy(flag).agg(
        F.count("*").alias("n"), S.coverage_pct("actual", "q10", "q90").alias("coverage"),
        S.mae("actual", "q50").alias("mae"), (F.avg((F.col("actual") > limit).cast("int")) * 100).alias("spike_rate"))


def spike_harness(df: DataFrame, flag: str = "spike_risk_flag") -> DataFrame:
    """Coverage, error, median error, code-P rate by bucket, by flag, by both and by fold x flag.

    The rows are summed once, by fold, flag and bucket; the groups are sums of
    these cells. Medians go through the distributed quantile so that no group,
    however large, sits in one task.
    """
    d = df.withColumns({"bucket": S.price_bucket("actual"), "_f": F.when(F.col(flag), "risk").otherwise("no-risk")})
    tags = F.array(
        F.struct(F.lit("bucket").alias("cut"), F.col("bucket").alias("grp")),
        F.struct(F.lit("flag").alias("cut"), F.col("_f").alias("grp")),
        F.struct(F.lit("flag_bucket").alias("cut"), F.concat_ws("|", "_f", "bucket").alias("grp")),
        F.struct(F.lit("fold_flag").alias("cut"), F.concat_ws("|", "fold", "_f").alias("grp")),
    )
    measures = {"coverage": S.covered("actual", "q10", "q90"), "mae": F.abs(F.col("actual") - F.col("q50")),
                "code_p_rate": F.coalesce((F.col("price_derivation_code") == "P").cast("int"), F.lit(0))}
    cells = cell_sums(d, ["fold", "_f", "bucket"], measures)
    keys = ["cut", "grp"]
    main = cells.withColumn("_t", F.explode(tags)).select("*", "_t.*").groupBy(*keys).agg(F.sum("n").alias("n"), *cell_averages(measures))
    errors = d.select(F.explode(tags).alias("_t"), (F.col("actual") - F.col("q50")).alias("e")).select("_t.*", "e")
    return main.join(exact_quantiles(errors, keys, "e", {"median_error": 0.5}), keys)


def cell_sums(df: DataFrame, cell: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Rows, and the sum and number of each measure, per finest cell; coarser groups are sums of cells, so no row is copied to the groups it is in."""
    sums = [f(c.cast("double") if f is F.sum else c).alias(f"_{k}_{n}") for n, c in measures.items() for k, f in (("s", F.sum), ("n", F.count))]
    return df.groupBy(*cell).agg(F.count("*").alias("n"), *sums)


def cell_averages(measures: Sequence[str]) -> list[Column]:
    return [ratio(F.sum(f"_s_{n}"), F.sum(f"_n_{n}")).alias(n) for n in measures]


def flag_lift(df: DataFrame, flag: str = "spike_risk_flag", limit: float = 150.0) -> DataFrame:
    """How often the flag is up and how much more often a spike follows when it is."""
    spike = (F.col("actual") > limit).cast("int")
    day = df.groupBy("settlement_date", flag).agg(F.sum(spike).alias("k"), F.count("*").alias("n"))
    g = day.agg(
        F.count_if(F.col(flag)).alias("n_risk_days"), F.count("*").alias("n_days"),
        ratio(F.sum(F.when(F.col(flag), F.col("k"))), F.sum(F.when(F.col(flag), F.col("n")))).alias("spike_rate_risk"),
        ratio(F.sum(F.when(~F.col(flag), F.col("k"))), F.sum(F.when(~F.col(flag), F.col("n")))).alias("spike_rate_other"))
    return g.withColumn("lift", F.col("spike_rate_risk") / F.greatest("spike_rate_other", F.lit(1e-6)))


def slot_bias(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "settlement_period").agg(
        F.avg(F.col("actual") - F.col("q50")).alias("bias"), F.count("*").alias("n"))


def diurnal_swing(df: DataFrame, keys: Sequence[str] = (), strong: float = 15.0) -> DataFrame:
    g = slot_bias(df, keys).groupBy(*keys).agg(
        (F.max("bias") - F.min("bias")).alias("swing"), F.stddev_pop("bias").alias("spread"))
    return g.withColumn("verdict", F.when(F.col("swing") > strong, "strong").otherwise("weak"))


def leave_one_out_bias(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Median bias per slot learnt from every other fold."""
    r = df.select(fold, "settlement_period", (F.col("actual") - F.col("q50")).alias("e"))
    return quantiles_of_others(r, ["settlement_period"], fold, "e", {"median_bias": 0.5})


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    d = df.select(F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).where("bin IS NOT NULL")
    step = (hi - lo) / bins
    return d.groupBy("bin").agg(F.count("*").alias("n")).withColumn("left_edge", (F.col("bin") - 1) * step + lo)


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    """Brier score, the score of always forecasting the base rate, and the skill against it."""
    g = df.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(y).alias("base_rate"))
    base = F.col("base_rate") * (1 - F.col("base_rate"))
    return g.withColumn("base_brier", base).withColumn("skill", 1 - ratio("brier", "base_brier"))


def average_precision(df: DataFrame, p: str, y: str) -> DataFrame:
    """Step-wise average precision over descending scores, exact under ties, no global sort in one task."""
    from slotwise.operators.ordered import running_by_value
    r = running_by_value(df, [], p, {"pos": F.sum(F.col(y).cast("long")), "n": F.count(F.lit(1))}, descending=True)
    term = ratio("pos", "all_pos") * F.col("cum_pos") / F.col("cum_n")
    return r.agg(F.sum(term).alias("average_precision"), F.max("all_pos").alias("n_pos"), F.max("all_n").alias("n"))


def threshold_sweep(df: DataFrame, p: str, y: str, taus: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold: conditional counts in one pass, one row per threshold out."""
    up = [F.count_if(F.col(p) > t) for t in taus]
    hit = [F.count_if((F.col(p) > t) & (F.col(y) == 1)) for t in taus]
    g = df.agg(F.count_if(F.col(y) == 1).alias("pos"), F.array(*up).alias("up"), F.array(*hit).alias("hit"))
    rows = g.select("pos", F.posexplode(F.arrays_zip(F.array(*map(F.lit, taus)).alias("tau"), "up", "hit")).alias("i", "z"))
    d = rows.select(F.col("z.tau").alias("tau"), F.col("z.up").alias("n_flagged"), F.col("z.hit").alias("_h"), "pos")
    precision, recall = ratio("_h", "n_flagged"), ratio("_h", "pos")
    return d.select("tau", "n_flagged", precision.alias("precision"), recall.alias("recall"),
                    ratio(precision * recall * 2, precision + recall).alias("f1"))
