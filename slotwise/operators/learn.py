"""Data side of model fitting: splits, folds, scaling, MLlib fits per fold, roll-outs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.operators.ordered import _with, exact_quantiles
from slotwise.operators.series import interpolate_in_day
from slotwise.session import fresh_path, materialise

# Fixed value: installed wind capacity used when no demand forecast exists, in MW.
WIND_CAPACITY_MW = 32000.0


def time_split(df: DataFrame, val_days: int, test_days: int, day: str = "day_ix") -> DataFrame:
    """train / val / test by cut-offs counted back from the last day."""
    last = df.agg(F.max(day)).scalar()
    part = F.when(F.col(day) <= last - (val_days + test_days), "train").when(F.col(day) <= last - test_days, "val").otherwise("test")
    return df.withColumn("part", part)


def fold_parts(df: DataFrame, folds: Sequence[tuple[str, str, str]], val_days: int, train_days: int | None = None,
               date: str = "settlement_date", parts: Sequence[str] = ("train", "val", "predict")) -> DataFrame:
    """Rows tagged per walk-forward fold: train before the validation days, predict inside the fold.

    The fold list is a handful of literals, so each row is tagged by an
    expression instead of a range join; folds starting after the data are skipped.
    Only rows of the wanted ``parts`` come out, so a row that no fold trains on
    is not copied for it.
    """
    d = F.col(date)
    last = df.agg(F.max(date)).scalar()
    tags = []
    for name, start, end in folds:
        a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
        part = F.when(d < F.date_sub(a, val_days), "train").when(d < a, "val").otherwise("predict")
        inside = (d <= b) & (a <= last) & part.isin(*parts)
        if train_days:
            inside = inside & (d >= F.date_sub(a, val_days + train_days))
        tags.append(F.when(inside, F.struct(F.lit(name).alias("fold"), part.alias("part"))))
    return df.withColumn("_t", F.explode(F.array_compact(F.array(*tags)))).select("*", "_t.*").drop("_t")


def robust_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and 1.4826 x median absolute deviation per key; a zero scale becomes 1."""
    m = exact_quantiles(df, keys, value, {"median": 0.5})
    dev = df.join(m, list(keys)).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_d"))
    s = exact_quantiles(dev, keys, "_d", {"mad": 0.5})
    return m.join(s, list(keys)).select(*keys, "median", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad") * 1.4826).alias("scale"))


def wind_share(grid: DataFrame, keys: Sequence[str] = ("series", "settlement_date")) -> DataFrame:
    """Forecast wind share of demand per slot, both interpolated over the day's 48 slots."""
    d = interpolate_in_day(grid, keys, "settlement_period", "windfor_fc_mw", "_w")
    d = interpolate_in_day(d, keys, "settlement_period", "tsdf_fc_mw", "_t")
    share = F.when(F.col("_t").isNull(), F.col("_w") / WIND_CAPACITY_MW * 100).when(F.col("_t") > 0, F.col("_w") / F.col("_t") * 100)
    return d.withColumn("wind_pct", share).drop("_w", "_t")


# -- linear fits from sufficient statistics ---------------------------------------
def _cross_products(features: Sequence[str], labels: Sequence[str], weight=None) -> dict:
    """Named sums a weighted least-squares fit needs: upper triangle of X'WX and X'Wy per label."""
    w = weight if weight is not None else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    k = len(cols)
    out = {f"g_{i}_{j}": F.sum(w * cols[i] * cols[j]) for i in range(k) for j in range(i, k)}
    for lab in labels:
        out |= {f"r_{lab}_{i}": F.sum(w * cols[i] * F.col(lab)) for i in range(k)}
    return out


def _solver(k: int, rcond: float):
    @F.pandas_udf("array<double>")
    def solve(gs: pd.Series, rs: pd.Series) -> pd.Series:
        at = np.triu_indices(k)
        out = []
        for a, r in zip(gs, rs):
            m = np.zeros((k, k))
            m[at] = a
            m = m + np.triu(m, 1).T
            size = np.sqrt(np.maximum(np.diag(m), 1e-300))
            out.append(np.linalg.lstsq(m / np.outer(size, size), np.asarray(r) / size, rcond=rcond)[0] / size)
        return pd.Series(out)

    return solve


def grouped_least_squares(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, weight: str | None = None,
                          rcond: float = 1e-12) -> DataFrame:
    """Weighted least squares of many groups in one job.

    The cross products are plain sums, combined map-side, so a group of any
    size costs one row per task; only the (features + 1)^2 matrix of a group
    is solved in Python. Result: (keys, beta) with the intercept first.
    """
    sums = _cross_products(features, [label], F.col(weight) if weight else None)
    g = df.dropna(subset=[label, *features]).groupBy(*keys).agg(F.count("*").alias("n_train"), *[c.alias(n) for n, c in sums.items()])
    return _solved(g, keys, sums, label, len(features) + 1, rcond)


def _solved(g: DataFrame, keys: Sequence[str], sums: dict, label: str, k: int, rcond: float = 1e-12) -> DataFrame:
    gram = F.array(*[n for n in sums if n.startswith("g_")])
    rhs = F.array(*[f"r_{label}_{i}" for i in range(k)])
    return g.select(*keys, "n_train", _solver(k, rcond)(gram, rhs).alias("beta"))


#: Class variances, densities (times the bandwidth) and bandwidths below these count as these, which bounds the weights of a reweighted fit.
LEAST_VARIANCE, LEAST_DENSITY, LEAST_WIDTH = 1e-4, 1e-3, 1e-6


def quantile_loss(p: float):
    """Weight and target of a row under the pinball loss at ``p``, smoothed over a bandwidth, given its label and the last round's forecast."""
    def step(y: Column, z: Column | None, width: Column | None) -> tuple[Column, Column]:
        if z is None:
            return F.lit(1.0), y
        above = probability(F.greatest(F.least((y - z) / width, F.lit(30.0)), F.lit(-30.0)))
        w = F.greatest(above * (1 - above), F.lit(LEAST_DENSITY)) / width
        return w, z + (p - (1 - above)) / w

    return step


def class_loss(share: str):
    """Weight and target of a row under the logistic loss, both classes weighing alike; ``share``: the label's mean in the row's group."""
    def step(y: Column, z: Column | None, width: Column | None) -> tuple[Column, Column]:
        z = F.lit(0.0) if z is None else F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
        p = probability(z)
        v = F.greatest(p * (1 - p), F.lit(LEAST_VARIANCE))
        balance = F.when(y > 0, 0.5 / F.col(share)).otherwise(0.5 / (1 - F.col(share)))
        return v * balance, z + (y - p) / v

    return step


def probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def reweighted_fits(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, losses: dict, rounds: int = 6, rcond: float = 1e-12) -> DataFrame:
    """Linear fits of many groups under several losses by iteratively reweighted least squares: (keys, n_train, one coefficient array per loss).

    Every round is one grouped sum of cross products over the rows, all losses
    side by side as columns of it, and one small solve per group. The first
    round's mean error is a group's bandwidth, halved from round to round. The
    coefficients, a row per group, are written between rounds.
    """
    keys = list(keys)
    rows = df.dropna(subset=[label, *features])
    y, k = F.col(label).cast("double"), len(features) + 1
    solve = _solver(k, rcond)
    fit = scale = None
    for r in range(rounds):
        d = rows if fit is None else _with(rows, fit.drop("n_train"), keys)
        if r == 1:
            scale = materialise(d.groupBy(*keys).agg(*[F.avg(F.abs(y - linear_predict(features, n))).alias(f"_s_{n}") for n in losses]), "scale")
        d = d if scale is None else _with(d, scale, keys)
        cols, aggs = {}, {}
        for name, loss in losses.items():
            z = None if fit is None else linear_predict(features, name)
            width = None if scale is None else F.greatest(F.col(f"_s_{name}") * 0.5 ** (r - 1), F.lit(LEAST_WIDTH))
            cols[f"_w_{name}"], cols[f"_t_{name}"] = loss(y, z, width)
            aggs |= {f"{name}_{c}": a for c, a in _cross_products(features, [f"_t_{name}"], F.col(f"_w_{name}")).items()}
        g = d.withColumns(cols).groupBy(*keys).agg(F.count("*").alias("n_train"), *[a.alias(c) for c, a in aggs.items()])
        betas = [solve(F.array(*[c for c in aggs if c.startswith(f"{n}_g_")]), F.array(*[f"{n}_r__t_{n}_{i}" for i in range(k)])).alias(n) for n in losses]
        fit = materialise(g.select(*keys, "n_train", *betas), "coefficients")
    return fit


def fold_least_squares(df: DataFrame, folds: Sequence[tuple[str, str, str]], val_days: int, keys: Sequence[str], features: Sequence[str],
                       label: str) -> DataFrame:
    """One least-squares fit per (keys, walk-forward fold), all folds in one job: (keys, fold, n_train, beta).

    Rows collapse to cross products per date first; only those are given to the
    folds that train on them.
    """
    sums = _cross_products(features, [label])
    by_date = df.dropna(subset=[label, *features]).groupBy(*keys, "settlement_date").agg(
        F.count("*").alias("n_train"), *[c.alias(n) for n, c in sums.items()])
    spread = fold_parts(by_date, folds, val_days, parts=["train"])
    g = spread.groupBy(*keys, "fold").agg(*[F.sum(n).alias(n) for n in ("n_train", *sums)])
    return _solved(g, [*keys, "fold"], sums, label, len(features) + 1)


def walk_forward_two_stage(slots: DataFrame, daily: DataFrame, folds: Sequence[tuple[str, str, str]], val_days: int, score_features: Sequence[str],
                           level_features: Sequence[str], shape_features: Sequence[str], keys: Sequence[str] = ("series",)) -> DataFrame:
    """Level and shape fitted anew for every walk-forward fold; one table of all folds' forecasts.

    ``daily`` has level and low_day (0 / 1): a linear score of the day class is
    fitted first and is a feature of the level. ``slots`` has ssp_raw and
    deviation_true. The band comes from the fold's validation days, which neither
    stage has seen. Result: (fold, keys, date, slot, actual, q10, q50, q90).
    """
    on = [*keys, "fold"]
    score = fold_least_squares(daily, folds, val_days, keys, score_features, "low_day")
    # The score differs by fold, so the days (one row per series and date) are tagged before the level is fitted.
    days = fold_parts(daily, folds, val_days).join(score.select(*on, F.col("beta").alias("_s")), on)
    days = days.withColumn("low_score", linear_predict(score_features, "_s"))
    inputs = [*level_features, "low_score"]
    level = grouped_least_squares(days.where("part = 'train'"), on, inputs, "level")
    ahead = days.where("part <> 'train'").join(level.select(*on, "beta"), on).select(
        *on, "part", "settlement_date", linear_predict(inputs).alias("_level"))
    shape = fold_least_squares(slots, folds, val_days, keys, shape_features, "deviation_true")
    d = fold_parts(slots, folds, val_days, parts=["val", "predict"]).join(shape.select(*on, "beta"), on)
    d = d.join(ahead, [*on, "part", "settlement_date"]).select(
        "fold", *keys, "part", "settlement_date", "settlement_period", F.col("ssp_raw").alias("actual"),
        (F.col("_level") + linear_predict(shape_features)).alias("q50")).where("q50 IS NOT NULL")
    band = exact_quantiles(d.where("part = 'val'").withColumn("_e", F.col("actual") - F.col("q50")), on, "_e", {"_r10": 0.1, "_r90": 0.9})
    out = d.where("part = 'predict'").join(band, on)
    return out.select("fold", *keys, "settlement_date", "settlement_period", "actual",
                      F.least(F.col("q50") + F.col("_r10"), "q50").alias("q10"), "q50", F.greatest(F.col("q50") + F.col("_r90"), "q50").alias("q90"))


def linear_predict(features: Sequence[str], beta: str = "beta"):
    out = F.element_at(beta, 1)
    for i, c in enumerate(features):
        out = out + F.element_at(beta, i + 2) * F.col(c)
    return out


def level_sweep(daily: DataFrame, features: Sequence[str], label: str, configs: Sequence[tuple[int | None, int | None, str]],
                fold_starts: Sequence[str], fold_days: int = 14, gap_days: int = 2, scale: float = 50.0,
                min_train: int = 120) -> DataFrame:
    """Training-window x half-life x transform sweep over walk-forward folds, scored per configuration.

    Weights depend on the date alone, so all series first collapse to one row
    of cross products per date; the (configuration, fold) grid is spread over
    that calendar-sized table, not over the data. P10 / P90 are exact quantiles
    of the training residuals.
    """
    spark = daily.sparkSession
    grid = [(i, w or 99, h or 0, tr, f) for i, (w, h, tr) in enumerate(configs) for f in fold_starts]
    plan = spark.createDataFrame(grid, "config INT, window_months INT, half_life INT, transform STRING, fold_start STRING").withColumn(
        "fold_start", F.to_date("fold_start"))
    cells = plan.agg(F.collect_list(F.struct("*"))).scalar()
    date, fs = F.col("settlement_date"), F.col("fold_start")
    in_train = (date < F.date_sub(fs, gap_days)) & ((F.col("window_months") == 99) | (date >= F.add_months(fs, -F.col("window_months"))))
    in_test = (date >= fs) & (date < F.date_add(fs, fold_days))
    weight = F.when(F.col("half_life") > 0, F.pow(F.lit(0.5), F.datediff(fs, date) / F.nullif(F.col("half_life"), F.lit(0)))).otherwise(1.0)
    keys, k = ["config", "fold_start"], len(features) + 1

    d = daily.select("settlement_date", label, *features).dropna(subset=[label, *features]).withColumn(
        "_asinh", F.asinh(F.col(label) / scale))
    sums = _cross_products(features, [label, "_asinh"])
    by_date = d.groupBy("settlement_date").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in sums.items()])
    spread = by_date.withColumn("_c", F.explode(cells)).select("*", "_c.*").drop("_c").where(in_train).withColumn("_w", weight)
    # One row per date: the days of a window, however many series they hold.
    g = spread.groupBy(*keys, "transform").agg(F.count("*").alias("n_train"), *[F.sum(F.col(n) * F.col("_w")).alias(n) for n in sums])
    gram = F.array(*[n for n in sums if n.startswith("g_")])
    rhs = F.when(F.col("transform") == "asinh", F.array(*[f"r__asinh_{i}" for i in range(k)])).otherwise(
        F.array(*[f"r_{label}_{i}" for i in range(k)]))
    # At most one row per grid cell: a few hundred.
    fit = g.where(F.col("n_train") >= min_train).select(*keys, _solver(k, 1e-12)(gram, rhs).alias("beta"))
    models = fit.join(F.broadcast(plan), keys).agg(F.collect_list(F.struct(*plan.columns, "beta"))).scalar()
    z = linear_predict(features)

    def used(m):
        ahead = date >= m["fold_start"]
        back = (m["window_months"] == 99) | (date >= F.add_months(m["fold_start"], -m["window_months"]))
        return (ahead & (date < F.date_add(m["fold_start"], fold_days))) | (~ahead & back & (date < F.date_sub(m["fold_start"], gap_days)))

    # A row meets only the models that train or are scored on it.
    rows = d.withColumn("_m", models).withColumn("_c", F.explode(F.filter("_m", used))).select("settlement_date", label, *features, "_c.*")
    rows = rows.withColumn("pred", F.when(F.col("transform") == "asinh", F.sinh(z) * scale).otherwise(z))
    err = F.col(label) - F.col("pred")
    band = exact_quantiles(rows.where(in_train).withColumn("_e", err), keys, "_e", {"_r10": 0.1, "_r90": 0.9})
    t = rows.where(in_test).join(band, keys).withColumns({"lo": F.col("pred") + F.col("_r10"), "hi": F.col("pred") + F.col("_r90")})

    def pin(c, q):
        e = F.col(label) - F.col(c)
        return F.avg(F.greatest(e * q, e * (q - 1)))

    return t.groupBy("config", "window_months", "half_life", "transform").agg(
        F.count_distinct("fold_start").alias("n_folds"), F.count("*").alias("n_days"), F.avg(F.abs(err)).alias("mae"),
        F.avg(-err).alias("bias"), ((pin("lo", 0.1) + pin("hi", 0.9)) / 2).alias("pinball"),
        F.avg(F.when((F.col(label) >= F.col("lo")) & (F.col(label) <= F.col("hi")), 1.0).otherwise(0.0)).alias("coverage"))


# -- MLlib models -----------------------------------------------------------------
def imputed(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The rows with median-imputed features and missing flags, and the names of these columns."""
    from pyspark.ml.feature import Imputer
    flags = {f"{c}__na": F.col(c).isNull().cast("double") for c in features}
    src = df.withColumns({c: F.col(c).cast("double") for c in features})
    base = (fit_on if fit_on is not None else df).withColumns({c: F.col(c).cast("double") for c in features})
    filled = [f"{c}__i" for c in features]
    imp = Imputer(inputCols=list(features), outputCols=filled, strategy="median").fit(base)
    return imp.transform(src.withColumns(flags)), [*filled, *flags]


def assemble(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None):
    """Median-imputed features plus missing flags as one vector (trees in MLlib do not route missing values)."""
    from pyspark.ml.feature import VectorAssembler
    d, names = imputed(df, features, fit_on)
    return VectorAssembler(inputCols=names, outputCol="features").transform(d)


def quantile_forest(train: DataFrame, score: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = (),
                    rounds: int = 20, depth: int = 4, seed: int = 42, held_out: DataFrame | None = None) -> DataFrame:
    """Boosted median with P10 / P90 from residual quantiles per key, as MLlib has no quantile loss.

    The residuals are those of ``held_out``, rows after the training rows;
    without it those of the training rows, which understate the band.
    """
    from pyspark.ml.regression import GBTRegressor
    labelled = train.dropna(subset=[label])
    tr = assemble(labelled, features)
    m = GBTRegressor(labelCol=label, featuresCol="features", lossType="absolute", maxIter=rounds, maxDepth=depth, seed=seed).fit(tr)
    judged = tr if held_out is None else assemble(held_out.dropna(subset=[label]), features, labelled)
    resid = m.transform(judged).select(*keys, (F.col(label) - F.col("prediction")).alias("_e"))
    q = exact_quantiles(resid, keys, "_e", {"_r10": 0.1, "_r90": 0.9})
    out = m.transform(assemble(score, features, labelled)).drop("features", *[f"{c}__i" for c in features], *[f"{c}__na" for c in features])
    out = out.join(q, list(keys), "left") if keys else out.withColumn("_q", q.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")
    return out.withColumns({"q50": F.col("prediction"), "q10": F.least(F.col("prediction") + F.col("_r10"), "prediction"),
                            "q90": F.greatest(F.col("prediction") + F.col("_r90"), "prediction")}).drop("prediction", "_r10", "_r90")


def two_stage(level: DataFrame, shape: DataFrame, keys: Sequence[str] = ("series", "settlement_date")) -> DataFrame:
    """Slot quantiles = ordered daily level quantiles + the slot's predicted deviation."""
    lv = level.select(*keys, F.least("q10", "q50").alias("l10"), F.col("q50").alias("l50"), F.greatest("q90", "q50").alias("l90"))
    j = shape.join(lv, list(keys))
    return j.withColumns({f"q{q}": F.col(f"l{q}") + F.col("deviation") for q in (10, 50, 90)}).drop("l10", "l50", "l90")


def day_probability(train: DataFrame, score: DataFrame, features: Sequence[str], label: str, out: str) -> DataFrame:
    """Balanced logistic score of a day class as a feature column.

    The fit is MLlib's; the score is an expression over its coefficients, so
    the plan that scores ships no model to the tasks.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    labelled = train.dropna(subset=[label])
    tr = balanced(assemble(labelled, features), label)
    pipe = Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True),
        LogisticRegression(featuresCol="z", labelCol=label, weightCol="_w", regParam=0.01, maxIter=100)]).fit(tr)
    scaler, model = pipe.stages
    rows, names = imputed(score, features, labelled)
    z = F.lit(float(model.intercept))
    for c, beta, mean, std in zip(names, model.coefficients.toArray().tolist(), scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()):
        # A column without spread is scaled to zero.
        z = z + (F.col(c) - mean) * (beta / std if std else 0.0)
    return rows.withColumn(out, probability(z)).select(*score.columns, out)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Class weights n / (2 n_class)."""
    n = df.agg(F.struct(F.count("*").alias("n"), F.sum(label).alias("k"))).scalar()
    d = df.withColumn("_n", n)
    mine = F.when(F.col(label) == 1, F.col("_n.k")).otherwise(F.col("_n.n") - F.col("_n.k"))
    return d.withColumn("_w", F.col("_n.n") / (2.0 * F.greatest(mine, F.lit(1)))).drop("_n")


def calibrated_spike_scores(train: DataFrame, score: DataFrame, key: Sequence[str], features: Sequence[str], label: str, folds: int = 5) -> DataFrame:
    """Logistic scores of a later window, mapped to probabilities by an isotonic fit on out-of-fold scores of the training rows.

    Neither fit has seen a row of ``score``. The fold of a training row is a
    hash of its key, so it is stable under re-runs and lost executors.
    """
    from pyspark.ml.regression import IsotonicRegression
    d = train.dropna(subset=[label]).withColumn("_fold", F.pmod(F.xxhash64(*key), F.lit(folds)))
    out = None
    for f in range(folds):
        part = day_probability(d.where(F.col("_fold") != f), d.where(F.col("_fold") == f), features, label, "raw")
        out = part if out is None else out.unionByName(part)
    iso = IsotonicRegression(featuresCol="raw", labelCol=label, predictionCol="p")
    fitted = iso.fit(out.select("raw", F.col(label).cast("double").alias(label)))
    return fitted.transform(day_probability(d, score, features, label, "raw"))


def seeded_hash(c: str, seed: int):
    """The first 60 bits of the digest of value and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(c).cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("bigint")


def shuffled(df: DataFrame, feature: str, seed: int) -> DataFrame:
    """The table with one column permuted over all rows.

    Both sides get a distributed rank by a seeded hash of the row key and are
    joined rank to rank: a true permutation without a global sort in one task.
    The hash is one that every engine has, so the permutation can be repeated
    elsewhere. ``df`` needs a unique ``row_id``.
    """
    from slotwise.operators.ordered import running_by_value
    a = df.withColumn("_h", seeded_hash("row_id", seed))
    b = df.select("row_id", feature).withColumn("_h", seeded_hash("row_id", seed + 1_000_003))

    def ranked(rows: DataFrame) -> DataFrame:
        # Rows of one hash follow each other by their id, so every row has a rank of its own.
        before = running_by_value(rows, [], "_h", {"n": F.count(F.lit(1))}).select("_h", (F.col("cum_n") - F.col("n")).alias("_before"))
        tie = F.row_number().over(W.partitionBy("_h").orderBy("row_id"))
        return rows.join(before, "_h").withColumn("_rank", F.col("_before") + tie).drop("_before", "_h")

    left = ranked(a).drop(feature)
    right = ranked(b).select("_rank", feature)
    return left.join(right, "_rank").drop("_rank")


def permutation_importance(df: DataFrame, predict, features: Sequence[str], label: str, repeats: int = 3) -> DataFrame:
    """Rise of the mean absolute error when one column is permuted, per feature, mean and deviation over repeats."""
    err = F.abs(F.col(label) - F.col("pred"))
    base = predict(df).agg(F.avg(err)).scalar()
    cells = None
    for i, f in enumerate(features):
        for r in range(repeats):
            one = predict(shuffled(df, f, 7919 * i + r)).agg(F.avg(err).alias("m")).select(
                F.lit(f).alias("feature"), F.lit(r).alias("rep"), "m")
            cells = one if cells is None else cells.unionByName(one)
    d = cells.withColumn("gain", F.col("m") - base)
    return d.groupBy("feature").agg(F.avg("gain").alias("importance_mean"), F.stddev_pop("gain").alias("importance_std"))


# -- lagged day profiles and per-slot lasso ---------------------------------------
PROFILE_LAGS = (1, 2, 7)


def day_profiles(df: DataFrame, keys: Sequence[str] = ("series",), value: str = "ssp_raw", slots: int = 48) -> DataFrame:
    """Complete days as one 48-vector each (bounded by the slots of a day)."""
    pairs = F.array_sort(F.collect_list(F.struct("settlement_period", F.col(value).alias("v"))))
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, "settlement_date", "day_ix").agg(pairs.alias("p"))
    d = d.where(F.size("p") == slots)
    v = F.transform("p", lambda r: r["v"])
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return d.select(*keys, "settlement_date", "day_ix", v.alias("profile"), (total / slots).alias("day_mean"),
                    F.array_min(v).alias("day_min"), F.array_max(v).alias("day_max"))


def profile_design(days: DataFrame, market: DataFrame | None = None, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Per day: profiles 1, 2 and 7 days back, daily aggregates, weekday one-hot and holiday flag.

    Days whose lagged profile is missing are left out. Calendar-safe: the lag
    is a join on the day index.
    """
    from slotwise.functions.calendar import bank_holidays
    out = days
    for n in PROFILE_LAGS:
        cols = [F.col("profile").alias(f"profile_lag{n}d"), F.col("day_mean").alias(f"dmean_lag{n}")]
        if n == 1:
            cols += [F.col("day_min").alias("dmin_lag1"), F.col("day_max").alias("dmax_lag1")]
        out = out.join(days.select(*keys, (F.col("day_ix") + n).alias("day_ix"), *cols), [*keys, "day_ix"])
    out = out.drop("dmean_lag2")
    if market is not None:
        m = market.select(F.date_add("settlement_date", 1).alias("settlement_date"), F.col("mid_mean").alias("mid_lag1"))
        out = out.join(m, "settlement_date", "left").withColumn("ssp_mid_spread_lag1", F.col("dmean_lag1") - F.col("mid_lag1"))
    hol = bank_holidays(days).select(F.col("holiday_date").alias("settlement_date"), F.lit(1.0).alias("_h"))
    out = out.join(F.broadcast(hol), "settlement_date", "left").withColumn("is_holiday", F.coalesce("_h", F.lit(0.0))).drop("_h")
    return out.withColumns({f"dow_{i}": (F.weekday("settlement_date") == i).cast("double") for i in range(7)})


def design_names(market: bool = True) -> list[str]:
    # The column names of the design.
    names = [f"p_lag{n}d_sp{s}" for n in PROFILE_LAGS for s in range(1, 49)]
    names += ["dmean_lag1", "dmean_lag7", "dmin_lag1", "dmax_lag1"]
    names += ["mid_lag1", "ssp_mid_spread_lag1"] if market else []
    return names + [f"dow_{i}" for i in range(7)] + ["is_holiday"]


def design_rows(design: DataFrame, keys: Sequence[str] = ("series",), market: bool = True) -> DataFrame:
    """One row per (day, slot): the shared day vector x and the slot's outcome y."""
    tail = ["dmean_lag1", "dmean_lag7", "dmin_lag1", "dmax_lag1"]
    tail += ["mid_lag1", "ssp_mid_spread_lag1"] if market else []
    tail += [f"dow_{i}" for i in range(7)] + ["is_holiday"]
    x = F.concat(*[F.col(f"profile_lag{n}d") for n in PROFILE_LAGS], F.array(*[F.col(c).cast("double") for c in tail]))
    d = design.select(*keys, "settlement_date", "day_ix", x.alias("x"), F.posexplode("profile").alias("_i", "y"))
    return d.withColumn("settlement_period", F.col("_i") + 1).drop("_i")


def _lasso_path(x, y, n_alphas: int = 40, ratio_min: float = 1e-3, folds: int = 5, steps: int = 400):
    """Lasso with the penalty chosen by contiguous cross-validation; all penalties advance together."""
    def solve(a, b, alphas):
        n, rhs = len(b), (a.T @ b / len(b))[:, None]
        wide = a.shape[1] > n
        gram = a @ a.T / n if wide else a.T @ a / n
        lip = max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
        beta = np.zeros((a.shape[1], len(alphas)))
        move, t = beta.copy(), 1.0
        for _ in range(steps):
            pull = a.T @ (a @ move) / n if wide else gram @ move
            step = move - (pull - rhs) / lip
            new = np.sign(step) * np.maximum(np.abs(step) - alphas[None, :] / lip, 0.0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            move = new + (t - 1) / t_new * (new - beta)
            beta, t = new, t_new
        return beta

    top = np.abs(x.T @ (y - y.mean())).max() / len(y)
    alphas = np.geomspace(max(top, 1e-9), max(top, 1e-9) * ratio_min, n_alphas)
    losses = np.zeros(n_alphas)
    for part in np.array_split(np.arange(len(y)), min(folds, len(y))):
        keep = np.setdiff1d(np.arange(len(y)), part)
        if len(keep) < 2:
            continue
        mu, my = x[keep].mean(0), y[keep].mean()
        beta = solve(x[keep] - mu, y[keep] - my, alphas)
        losses += (((x[part] - mu) @ beta + my - y[part][:, None]) ** 2).sum(0)
    best = int(np.argmin(losses))
    beta = solve(x - x.mean(0), y - y.mean(), alphas[: best + 1])[:, -1]
    return beta, float(y.mean() - x.mean(0) @ beta), float(alphas[best])


def slot_lasso(rows: DataFrame, train_until: str, keys: Sequence[str] = ("series",)) -> DataFrame:
    """One lasso per (series, slot) on the asinh robust-scaled outcome, forecasting the days after the cut-off.

    A group holds one row per calendar day of one slot, so its size is bounded
    by the length of the history, and Spark spreads series x 48 groups.
    Returns predictions with P10 / P90 from training residuals, the penalty and
    the coefficients.
    """
    on = [*keys, "settlement_period"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [*on, "settlement_date", "actual", "q10", "q50", "q90", "alpha", "coef"]
        pdf = pdf.sort_values("day_ix")
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        y = pdf["y"].to_numpy(dtype=float)
        tr = pdf["train"].to_numpy(dtype=bool)
        if (~tr).sum() == 0:
            return pd.DataFrame(columns=cols)
        if tr.sum() < 5:
            # Too little to learn from: the slot stays, without a forecast.
            out = pdf.loc[~tr, [*on, "settlement_date"]].copy()
            out["actual"] = y[~tr]
            for c in ("q10", "q50", "q90", "alpha", "coef"):
                out[c] = None
            return out[cols]
        med_x = np.nanmedian(x[tr], axis=0)
        x = np.where(np.isnan(x), np.where(np.isnan(med_x), 0.0, med_x), x)
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z = (x - mu) / np.where(sd == 0, 1.0, sd)
        a = float(np.median(y[tr]))
        b = float(1.4826 * np.median(np.abs(y[tr] - a))) or 1.0
        beta, c0, alpha = _lasso_path(z[tr], np.arcsinh((y[tr] - a) / b))
        pred = a + b * np.sinh(z @ beta + c0)
        lo, hi = np.quantile(y[tr] - pred[tr], [0.1, 0.9])
        out = pdf.loc[~tr, [*on, "settlement_date"]].copy()
        out["actual"], out["q50"] = y[~tr], pred[~tr]
        out["q10"], out["q90"], out["alpha"] = out["q50"] + lo, out["q50"] + hi, alpha
        out["coef"] = [beta.tolist()] * len(out)
        return out[cols]

    schema = ", ".join([*[f"{k} STRING" for k in keys], "settlement_period INT", "settlement_date DATE", "actual DOUBLE",
                        "q10 DOUBLE", "q50 DOUBLE", "q90 DOUBLE", "alpha DOUBLE", "coef ARRAY<DOUBLE>"])
    d = rows.withColumn("train", F.col("settlement_date") <= F.lit(train_until).cast("date"))
    return d.groupBy(*on).applyInPandas(fit, schema)


def top_coefficients(pred: DataFrame, names: Sequence[str], n: int = 15, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The n largest non-zero coefficients per slot, by size."""
    one = pred.groupBy(*keys, "settlement_period").agg(F.any_value("coef").alias("coef"), F.any_value("alpha").alias("alpha"))
    pairs = F.zip_with(F.array(*map(F.lit, names)), "coef", lambda a, b: F.struct((-F.abs(b)).alias("o"), a.alias("feature"), b.alias("beta")))
    kept = F.slice(F.array_sort(F.filter(pairs, lambda r: r["beta"] != 0)), 1, n)
    d = one.select(*keys, "settlement_period", "alpha", F.posexplode(kept).alias("_p", "r"))
    return d.select(*keys, "settlement_period", "alpha", (F.col("_p") + 1).alias("rank"), "r.feature", "r.beta")


# -- recursive roll-out -----------------------------------------------------------
def short_lag_trees(train: DataFrame, inputs: dict[str, str], label: str, rounds: int = 20, depth: int = 4, seed: int = 42):
    """Boosted trees of absolute loss on ``inputs``' columns, rows with a missing one left out; the model and its assembler."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    va = VectorAssembler(inputCols=list(inputs.values()), outputCol="features")
    rows = va.transform(train.dropna(subset=[label, *inputs.values()]))
    return GBTRegressor(labelCol=label, featuresCol="features", lossType="absolute", maxIter=rounds, maxDepth=depth, seed=seed).fit(rows), va


def stored_ensemble(model) -> DataFrame:
    """A fitted tree ensemble as one row: per tree its weight and its nodes as a flat array.

    The saved model's node table, children by their position. Its size is set by the fit's rounds and depth.
    """
    spark = SparkSession.active()
    path = fresh_path(spark, "trees")
    model.save(path)
    n = F.col("nodeData")
    node = F.struct(n.id.alias("id"), n.split.featureIndex.alias("feature"), F.try_element_at(n.split.leftCategoriesOrThreshold, F.lit(1)).alias("threshold"),
                    n.leftChild.alias("left"), n.rightChild.alias("right"), n.prediction.alias("value"))
    nodes = spark.read.parquet(f"{path}/data").groupBy("treeID").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    weight = F.array(*[F.lit(w) for w in model.treeWeights])[F.col("treeID")]
    return nodes.agg(F.array_sort(F.collect_list(F.struct("treeID", weight.alias("weight"), "nodes"))).alias("ensemble"))


def ensemble_value(ensemble: Column, x: Column, depth: int) -> Column:
    """The ensemble's prediction for the input array ``x``, by built-in functions alone; NULL where an input is NULL.

    Each tree is descended ``depth`` steps; a leaf stays where it is. Continuous splits only.
    """
    def leaf(nodes):
        def step(at, _):
            node = nodes[at]
            return F.when(node.feature < 0, at).when(x[node.feature] <= node.threshold, node.left).otherwise(node.right)
        return nodes[F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)].value

    total = F.aggregate(ensemble, F.lit(0.0), lambda a, t: a + t.weight * leaf(t.nodes))
    return F.when(~F.exists(x, lambda v: v.isNull()), total)


def _recent(buf: Column, memory: int) -> dict[str, Column]:
    """Short-memory inputs of the next slot, from the last prices (newest last)."""
    last6 = F.slice(buf, -6, 6)
    return {
        "lag_1": F.element_at(buf, -1), "lag_2": F.element_at(buf, -2), "lag_48": F.element_at(buf, -memory),
        "roll_mean_6": F.aggregate(last6, F.lit(0.0), lambda a, v: a + v) / 6,
        "roll_min_6": F.array_min(last6), "roll_max_6": F.array_max(last6),
    }


def fitted_tree_rollout(history: DataFrame, future: DataFrame, model, inputs: Sequence[str], keys: Sequence[str] = ("series",),
                        cap: float | None = None, memory: int = 48) -> DataFrame:
    """``rollout`` with a fitted tree ensemble: each slot's prediction is an input of the next ones.

    ``inputs`` names the model's features in order: terms of the last prices (``lag_1``, ``roll_mean_6``, ...), or
    columns of ``future`` (keys, target_date, settlement_period and these). The trees travel as flat arrays and are
    descended inside the day's ``aggregate``; days and series run in parallel. A slot with a NULL input has a NULL
    forecast, and so have the later ones that look back at it.
    """
    on = [*keys, "target_date"]
    given = [c for c in inputs if c in future.columns]
    steps = future.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("settlement_period", *[F.col(c).cast("double").alias(c) for c in given]))).alias("steps"))
    d = history.join(steps, on).withColumn("ensemble", stored_ensemble(model).scalar())
    depth = max(model.getMaxDepth(), 1)

    def push(acc, s):
        terms = _recent(acc["buf"], memory)
        x = F.array(*[s[c] if c in given else terms[c] for c in inputs])
        # The input array and the prediction are used many times and computed once.
        y = F.transform(F.array(x), lambda v: ensemble_value(F.col("ensemble"), v, depth))
        return F.transform(y, lambda v: F.struct(
            F.concat(F.slice(acc["buf"], -(memory - 1), memory - 1), F.array(v if cap is None else F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(-500.0)), F.lit(float(cap)))))).alias("buf"),
            F.concat(acc["out"], F.array(F.struct(s["settlement_period"].alias("settlement_period"), v.alias("pred")))).alias("out")))[0]

    start = F.struct(F.col("buf"), F.from_json(F.lit("[]"), "array<struct<settlement_period:int,pred:double>>").alias("out"))
    return d.select(*on, F.inline(F.aggregate("steps", start, push, lambda a: a["out"])))


def rollout(history: DataFrame, future: DataFrame, weights: dict[str, float | str], keys: Sequence[str] = ("series",),
            cap: float | None = None, memory: int = 48) -> DataFrame:
    """Slot-by-slot forecast of a day, each step feeding the next; days run in parallel.

    ``history``: (keys, target_date, buf) with the last ``memory`` prices before
    the day, newest last. ``future``: (keys, target_date, settlement_period,
    base), base being the part of the forecast that does not depend on the
    day's own slots. ``weights`` are the coefficients of lag_1, lag_2, lag_48
    and the rolling mean, minimum and maximum of 6 slots: numbers, or names of
    columns of ``future``. The fold is a built-in
    ``aggregate`` over at most 50 steps.
    """
    on = [*keys, "target_date"]
    steps = future.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("settlement_period", "base", *dict.fromkeys(w for w in weights.values() if isinstance(w, str))))).alias("steps"))
    d = history.join(steps, on)

    def push(acc, s):
        buf = acc["buf"]
        terms = _recent(buf, memory)
        y = s["base"]
        for n, w in weights.items():
            y = y + terms[n] * (s[w] if isinstance(w, str) else float(w))
        fed = F.least(F.greatest(y, F.lit(-500.0)), F.lit(float(cap))) if cap is not None else y
        nxt = F.concat(F.slice(buf, -(memory - 1), memory - 1), F.array(fed))
        return F.struct(nxt.alias("buf"), F.concat(acc["out"], F.array(F.struct(
            s["settlement_period"].alias("settlement_period"), y.alias("pred")))).alias("out"))

    start = F.struct(F.col("buf"), F.from_json(F.lit("[]"), "array<struct<settlement_period:int,pred:double>>").alias("out"))
    return d.select(*on, F.inline(F.aggregate("steps", start, push, lambda a: a["out"])))


def last_prices(df: DataFrame, value: str, keys: Sequence[str] = ("series",), memory: int = 48) -> DataFrame:
    """Per target day the complete previous day's prices in slot order."""
    d = df.groupBy(*keys, F.date_add("settlement_date", 1).alias("target_date")).agg(
        F.array_sort(F.collect_list(F.struct("settlement_period", F.col(value).alias("v")))).alias("p"))
    return d.where(F.size("p") == memory).select(*keys, "target_date", F.transform("p", lambda r: r["v"]).alias("buf"))


def target_grid(df: DataFrame, days: int = 1, keys: Sequence[str] = ("series",), slots: int = 48) -> DataFrame:
    """History plus empty rows for the days to forecast, so that one feature function serves both."""
    last = df.groupBy(*keys).agg(F.max("settlement_date").alias("_d"))
    g = last.select(*keys, F.explode(F.sequence(F.date_add("_d", 1), F.date_add("_d", days))).alias("settlement_date"))
    g = g.select(*keys, "settlement_date", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("settlement_period"))
    from slotwise.functions.keys import day_index, slot_index
    g = g.withColumns({"slot_ix": slot_index(), "day_ix": day_index()})
    return df.withColumn("is_target", F.lit(False)).unionByName(g.withColumn("is_target", F.lit(True)), allowMissingColumns=True)
