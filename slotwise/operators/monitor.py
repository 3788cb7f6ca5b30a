"""Monitoring tables: frontiers, gates, readiness, freshness, shadow and scenario comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import scoring as S
from slotwise.functions.keys import DEFAULT_ZONE, local_clock, ratio
from slotwise.operators.metrics import cell_averages, cell_sums

# Freshness limits in minutes and hours, tolerance, gate thresholds.
STALE_MIN = 360
DELAY_MIN = 150
MISSED_HOUR = 14
WINDOW = (7, 22)
RULE_B_TOLERANCE = 3
REPORT_OK_HOURS = 4
QUIET_RATE = 0.10
MIN_AUTUMNS = 2
SHADOW_MAE = 0.50
SHADOW_COVERAGE = 0.03
BANDS_MAX_AGE_DAYS = 31


def contiguous_frontier(df: DataFrame, keys: Sequence[str], period: str = "settlement_period") -> DataFrame:
    """Largest F with slots 1..F all present, the latest slot, and how many are present (one day per group)."""
    w = W.partitionBy(*keys).orderBy(period)
    d = df.withColumn("_rn", F.row_number().over(w))
    return d.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col(period) == F.col("_rn"), F.col("_rn"))), F.lit(0)).alias("frontier"),
        F.max(period).alias("latest"), F.count("*").alias("n_settled"))


def spike_autumns(days: DataFrame, crisis: Sequence[int], transition: Sequence[int], value: str = "price",
                  limit: float = 150.0, date: str = "settlement_date") -> DataFrame:
    """Yearly and autumn spike-day rates with the usability class of each year (annual full-outer autumn)."""
    d = days.groupBy(date).agg(F.max((F.col(value) > limit).cast("int")).alias("spike"))
    d = d.withColumns({"year": F.year(date), "autumn": F.month(date).isin(9, 10, 11)})
    annual = d.groupBy("year").agg(F.count("*").alias("n_days"), F.avg("spike").alias("annual_rate"))
    autumn = d.where("autumn").groupBy("year").agg(F.count("*").alias("n_autumn"), F.avg("spike").alias("autumn_rate"))
    j = annual.join(autumn, "year", "full").withColumns({
        "annual_rate": F.coalesce("annual_rate", F.lit(0.0)), "autumn_rate": F.coalesce("autumn_rate", F.lit(0.0)),
        "n_autumn": F.coalesce("n_autumn", F.lit(0))})
    status = (F.when(F.col("n_autumn") == 0, "pending").when(F.col("year").isin(*crisis), "crisis")
              .when(F.col("year").isin(*transition), "transition").when(F.col("annual_rate") < QUIET_RATE, "quiet")
              .otherwise("usable"))
    return j.withColumn("status", status)


def autumn_gate(years: DataFrame) -> DataFrame:
    return years.agg(F.count_if(F.col("status") == "usable").alias("n_usable")).withColumn(
        "green", F.col("n_usable") >= MIN_AUTUMNS)


def archive_readiness(df: DataFrame, date: str, min_months: int) -> DataFrame:
    g = df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"),
               F.count_distinct(F.trunc(date, "month")).alias("n_months"))
    return g.withColumn("green", F.col("n_months") >= min_months)


def shadow_log(pair: DataFrame, keys: Sequence[str] = ("settlement_date",)) -> DataFrame:
    """Shadow against production on the slots both have; days without production stay as shadow-only rows.

    ``pair`` has actual, s10/s50/s90 and p10/p50/p90 (NULL where production has no row).
    """
    both = F.col("p50").isNotNull()
    day = pair.groupBy(*keys).agg(F.max(both.cast("int")).alias("_has"))
    d = pair.join(day, list(keys)).where(both | (F.col("_has") == 0))
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n_sps"), S.mae("actual", "s50").alias("shadow_mae"), S.mae("actual", "p50").alias("prod_mae"),
        F.avg(S.covered("actual", "s10", "s90")).alias("shadow_cov"), F.avg(S.covered("actual", "p10", "p90")).alias("prod_cov"),
        F.avg(F.col("s90") - F.col("s10")).alias("shadow_width"), F.avg(F.col("p90") - F.col("p10")).alias("prod_width"),
        (F.max("_has") == 0).alias("shadow_only"))
    g = g.withColumns({"mae_delta": F.col("shadow_mae") - F.col("prod_mae"),
                       "cov_delta_pp": (F.col("shadow_cov") - F.col("prod_cov")) * 100})
    return g.withColumns({"pass_mae": F.coalesce(F.abs("mae_delta") <= SHADOW_MAE, F.lit(False)),
                          "pass_cov": F.coalesce(F.abs("cov_delta_pp") <= SHADOW_COVERAGE * 100, F.lit(False))})


def scenario_table(df: DataFrame, variants: dict[str, tuple[str, str, str]], base: str, groups: dict[str, Column]) -> DataFrame:
    """Group x variant scores with the change against the base variant.

    The rows are summed once, by the set of groups they are in; a group is the
    sum of the sets that have it, all variants side by side.
    """
    named = [F.when(c, F.lit(n)) for n, c in groups.items()]
    measures, names = {}, ("mae", "coverage", "mean_width", "is_score")
    for v, (lo, mid, hi) in variants.items():
        found = (F.abs(F.col("actual") - F.col(mid)), S.covered("actual", lo, hi), F.col(hi) - F.col(lo), S.interval_score("actual", lo, hi))
        measures |= {f"{v}_{n}": c for n, c in zip(names, found)}
    cells = cell_sums(df.withColumn("_in", F.array_compact(F.array(*named))), ["_in"], measures)
    g = cells.withColumn("group", F.explode("_in")).groupBy("group").agg(F.sum("n").alias("n"), *cell_averages(measures))
    rows = [F.struct(F.lit(v).alias("variant"), *[F.col(f"{v}_{n}").alias(n) for n in names]) for v in variants]
    g = g.select("group", "n", F.array(*rows).alias("r"))
    ref = F.element_at("r", list(variants).index(base) + 1)
    g = g.withColumns({"base_mae": ref["mae"], "base_cov": ref["coverage"], "base_is": ref["is_score"]})
    out = g.select("group", "n", "base_mae", "base_cov", "base_is", F.inline("r"))
    return out.select("group", "n", "variant", "mae", "coverage", "mean_width", "is_score",
                      (F.col("mae") - F.col("base_mae")).alias("mae_penalty"),
                      (F.col("coverage") - F.col("base_cov")).alias("coverage_delta"),
                      (F.col("is_score") - F.col("base_is")).alias("is_delta"))


def ship_gate(table: DataFrame, group: str, variant: str, max_mae: float = 1.5, max_cov: float = 0.05) -> DataFrame:
    ok = (F.col("mae_penalty") <= max_mae) & (F.abs("coverage_delta") <= max_cov)
    return table.where((F.col("group") == group) & (F.col("variant") == variant)).select(
        "variant", "mae_penalty", "coverage_delta", F.when(ok, "ship").otherwise("hold").alias("decision"))


def divergence(published: DataFrame, live: DataFrame, keys: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Days whose live forecast moved away from the published one (population deviation of the difference)."""
    on = [*keys, "settlement_period"]
    d = published.select(*on, F.col("q50").alias("a")).join(live.select(*on, F.col("q50").alias("b")), on)
    g = d.groupBy(*keys).agg(F.stddev_pop(F.col("b") - F.col("a")).alias("spread"), F.count("*").alias("n"))
    return g.withColumn("diverged", F.col("spread") > limit)


def freshness(status: DataFrame, now: Column, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Health class of each feed from its forecast date, settled rows and filter state.

    ``status`` has fc_date, n_actual, last_sp (latest settled slot), state_date,
    state_update (UTC, no zone) and n_corrected; ``now`` is a UTC time without zone.
    """
    d = status.withColumn("_now", now)
    today, hour = F.to_date("_now"), F.hour("_now")
    active = (hour >= WINDOW[0]) & (hour < WINDOW[1])
    age = F.timestamp_diff("MINUTE", F.col("state_update"), F.col("_now"))
    latest_end = F.col("fc_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("last_sp") * 30)
    lag = F.timestamp_diff("MINUTE", latest_end, local_clock("_now", zone))
    base = (
        F.when(F.col("fc_date").isNull() & F.col("state_update").isNull(), "unknown")
        .when((F.col("fc_date") < today) & (hour >= MISSED_HOUR), "daily_missed")
        .when((F.col("state_date") == today) & active & (age > STALE_MIN), "stale")
        .otherwise("ok"))
    d = d.withColumns({"_base": base, "age_min": age, "lag_min": F.when(F.col("last_sp") > 0, lag)})
    late = (F.col("_base") == "ok") & (F.col("fc_date") == today) & active & (F.col("last_sp") > 0) & (F.col("lag_min") > DELAY_MIN)
    d = d.withColumn("health", F.when(late, "delayed").otherwise(F.col("_base")))
    checked = ~F.col("health").isin("daily_missed", "unknown") & (F.col("state_date") == today)
    rule = F.when(F.coalesce(checked, F.lit(False)), consistency_rule("n_actual", "n_corrected")).otherwise("none")
    return d.withColumn("inconsistency", rule).drop("_base", "_now")


def consistency_rule(n_actual: str, n_corrected: str) -> Column:
    """A: outcomes were corrected for that no published row shows; B: published outcomes the correction has not taken in."""
    return (F.when((F.col(n_corrected) > 0) & (F.col(n_actual) == 0), "A")
            .when(F.col(n_actual) > F.col(n_corrected) + RULE_B_TOLERANCE, "B").otherwise("none"))


def consistency(counts: DataFrame, state: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Published outcomes, outcomes in the filter's state, and open slots of the last stored correction of each day, with the rule they break.

    ``counts``: keys, n_actual. ``state``: one row per settled slot in the filter's state. ``corrections``: stored rows with run and settlement_period.
    """
    held = state.groupBy(*keys).agg(F.count("*").alias("n_corrected"))
    per_run = corrections.groupBy(*keys, "run").agg(F.count("*").alias("n"))
    stored = per_run.groupBy(*keys).agg(F.max_by("n", "run").alias("n_open"))
    j = counts.join(held, list(keys), "full").join(stored, list(keys), "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_actual", "n_corrected", "n_open")})
    return j.withColumn("inconsistency", consistency_rule("n_actual", "n_corrected"))


def report_status(heartbeat: DataFrame, now: Column) -> DataFrame:
    """Status line of the weekly report from the last state update."""
    d = heartbeat.withColumn("_now", now)
    age = F.timestamp_diff("MINUTE", F.col("state_update"), F.col("_now")) / 60
    today = F.to_date("_now")
    status = (
        F.when(F.col("state_update").isNull(), "unknown").when(age <= REPORT_OK_HOURS, "ok")
        .when(F.col("state_date") == today, "stale")
        .when((F.col("state_date") < today) & (F.hour("_now") >= MISSED_HOUR), "daily_missed").otherwise("morning_gap"))
    return d.withColumns({"age_hours": age, "status": status}).drop("_now")


def parameter_age(params: DataFrame, fitted: str, now: Column, limit_days: int = BANDS_MAX_AGE_DAYS) -> DataFrame:
    g = params.agg(F.max(fitted).alias("fitted_on"))
    return g.withColumn("age_days", F.datediff(now, "fitted_on")).withColumn("expired", F.col("age_days") > limit_days)


def revision_size(first: DataFrame, final: DataFrame, keys: Sequence[str], value: str, code: str, big: float = 2.0) -> DataFrame:
    """How much values moved between their first and final version, per code of the first."""
    from slotwise.operators.ordered import exact_quantiles
    d = first.select(*keys, code, F.col(value).alias("a")).join(final.select(*keys, F.col(value).alias("b")), list(keys))
    d = d.withColumn("move", F.abs(F.col("b") - F.col("a"))).withColumn(code, F.coalesce(code, F.lit("none")))
    g = d.groupBy(code).agg(F.count("*").alias("n"), ratio(F.count_if(F.col("move") > big) * 100.0, F.count("*")).alias("pct_big"))
    return g.join(exact_quantiles(d, [code], "move", {"median_move": 0.5, "p95_move": 0.95}), code)
