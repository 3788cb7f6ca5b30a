"""Distributed primitives over a total order: prefix sums, ranks, exact quantiles.

A plain window over a whole table runs in one task. Here the order is cut into
value ranges (quantiles: into a few brackets): (1) rows collapse to one row per distinct value with map-side
partial aggregation, so a hot value is a single row; (2) a bounded sketch
proposes split points; (3) range totals (``buckets`` rows per key) are summed
in order; (4) the exact running sum is taken inside each range in parallel.
The sketch only decides where to cut; every result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fewest ranges of an order; a session with more shuffle partitions gets as many ranges.
BUCKETS = 64
#: Values of a group that are ordered whole; error bound of the sketch of larger groups, as its inverse.
WHOLE = 10_000
ACCURACY = 10_000


def _ranges(df: DataFrame) -> int:
    return max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a NULL key meets a NULL key."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, on).drop(*[f"_r_{k}" for k in keys])


def running_by_value(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """One row per (keys, distinct value) with each sum, its running total ``cum_*`` and grand total ``all_*``."""
    keys = list(keys)
    names = list(sums)
    per_value = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])
    buckets = buckets or _ranges(df)
    cuts = [i / buckets for i in range(1, buckets)]
    splits = per_value.groupBy(*keys).agg(F.percentile_approx(value, cuts, 16 * buckets).alias("_splits"))
    cut = _with(per_value, splits, keys) if keys else per_value.withColumn("_splits", splits.scalar())
    ranged = cut.withColumn("_range", F.size(F.filter("_splits", lambda s: s < F.col(value)))).drop("_splits")
    order = F.col("_range").desc() if descending else F.col("_range").asc()
    # These two windows run over at most ``buckets`` rows per key.
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    offsets = totals.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_t_{n}").over(whole).alias(f"all_{n}") for n in names],
    )
    vorder = F.col(value).desc() if descending else F.col(value).asc()
    inside = W.partitionBy(*keys, "_range").orderBy(vorder).rowsBetween(W.unboundedPreceding, 0)
    out = _with(ranged, offsets, [*keys, "_range"])
    return out.select(
        *keys, value, *names,
        *[(F.col(f"_o_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in names],
        *[f"all_{n}" for n in names],
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "avg_rank") -> DataFrame:
    """(keys, value, n, rank): the mean rank of tied rows, one row per distinct value."""
    r = running_by_value(df, keys, value, {"n": F.count(F.lit(1))})
    return r.select(*keys, value, "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias(rank), F.col("all_n").alias("n_total"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], whole: int = WHOLE
) -> DataFrame:
    """Linear-interpolated exact quantiles, one row per key: ``{column: probability}``, for groups of any size.

    A sketch brackets each quantile. One pass then counts what lies between the
    brackets and, per value, what lies inside them; only these few values (about
    ``4 / whole + 4 / ACCURACY`` of a group per probability) are put in order.
    Groups of up to ``whole`` values are ordered as they are. A rank outside its
    bracket, which the sketch's error bound rules out, raises.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    room = 2 / ACCURACY + 2 / whole
    low, high = ([min(max(p + d, 0.0), 1.0) for p in probs.values()] for d in (-room, room))
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.percentile_approx("_x", [*low, *high], ACCURACY).alias("_s"))

    def bound(i: int, p: float, end: float) -> Column:
        open_end = F.col("_all") <= whole
        return F.when(open_end | F.lit(p == end), F.lit(float("-inf" if end == 0.0 else "inf"))).otherwise(F.get("_s", F.lit(i)).cast("double"))

    k = len(probs)
    sketch = sketch.select(*keys, "_all", F.array(*[F.struct(bound(i, low[i], 0.0).alias("lo"), bound(k + i, high[i], 1.0).alias("hi")) for i in range(k)]).alias("_b"))
    if keys:
        placed = _with(rows, sketch, keys)
    else:
        placed = rows.withColumn("_one", sketch.select(F.struct("_all", "_b")).scalar()).select("_x", "_one.*")
    inside = F.exists("_b", lambda b: (b["lo"] <= F.col("_x")) & (F.col("_x") <= b["hi"]))
    # Values between brackets stand right above the last bracket below them.
    below = F.array_max(F.transform(F.filter("_b", lambda b: b["hi"] < F.col("_x")), lambda b: b["hi"]))
    counted = placed.select(*keys, "_all", inside.alias("_in"), F.when(inside, F.col("_x").cast("double")).otherwise(below).alias("_v")).groupBy(
        *keys, "_v", "_in").agg(F.count(F.lit(1)).alias("_n"), F.any_value("_all").alias("_all"))
    order = W.partitionBy(*keys or [F.lit(0)]).orderBy(F.col("_v").asc_nulls_first(), F.col("_in").desc()).rowsBetween(W.unboundedPreceding, 0)
    r = counted.withColumn("_cum", F.sum("_n").over(order))
    first = F.col("_cum") - F.col("_n")
    found = F.when(F.col("_in"), F.col("_v")).otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_all") - 1)
        for part, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (first <= at) & (at < F.col("_cum"))
            picks.append(F.max(F.when(hit, found)).alias(f"_{part}_{name}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_w_{name}"))
    got = r.groupBy(*keys).agg(*picks)
    return got.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def quantiles_of_others(df: DataFrame, keys: Sequence[str], fold: str, value: str, probs: dict[str, float], block: int = 1024) -> DataFrame:
    """Exact quantiles per (fold, keys) over the rows of all *other* folds, with their number ``n``.

    No row is copied to the folds it serves. Take the order of all folds: if o
    rows of the own fold lie below the answer, the answer stands o places
    further up than its place among the others. o follows from the own fold's
    values; places are then looked up by blocks of ranks. Rows without a fold
    take no part.
    """
    keys = list(keys)
    rows = df.where(F.col(fold).isNotNull() & F.col(value).isNotNull())
    count = {"m": F.count(F.lit(1))}
    total = running_by_value(rows, keys, value, count)
    own = running_by_value(rows, [*keys, fold], value, count).select(
        *keys, fold, value, F.col("cum_m").alias("_own"), F.col("all_m").alias("_size"))
    parts = [(f"{name}_{part}", p, at) for name, p in probs.items() for part, at in (("lo", F.floor), ("hi", F.ceil))]

    def place(p: float, at, n: Column) -> Column:
        return at(F.lit(float(p)) * (n - 1)).cast("bigint")

    others = F.col("all_m") - F.col("_size")
    below = {part: F.max(F.when(F.col("cum_m") - F.col("_own") < place(p, at, others) + 1, F.col("_own"))).alias(f"_b_{part}") for part, p, at in parts}
    mine = _with(own, total, [*keys, value]).groupBy(*keys, fold).agg(F.max("_size").alias("_size"), *below.values())
    # Every fold with every key, also where the fold has no row of its own.
    folds = rows.select(fold).distinct().agg(F.collect_list(fold)).scalar()
    pairs = total.groupBy(*keys).agg(F.max("all_m").alias("all_m")).withColumn(fold, F.explode(folds))
    r = mine.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, fold) else F.col(c) for c in mine.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in (*keys, fold)]
    n = F.col("all_m") - F.coalesce("_size", F.lit(0))
    wanted = pairs.join(r, on, "left").withColumn("n", n).where("n > 0")
    ranks = F.array(*[F.struct(F.lit(part).alias("part"), (place(p, at, F.col("n")) + 1 + F.coalesce(f"_b_{part}", F.lit(0))).alias("at")) for part, p, at in parts])
    wanted = wanted.select(*keys, fold, "n", F.explode(ranks).alias("w")).select(*keys, fold, "n", "w.*").withColumn("_block", F.floor(F.col("at") / block))
    first = F.col("cum_m") - F.col("m") + 1
    held = total.select(*keys, value, first.alias("_first"), "cum_m", F.explode(F.sequence(F.floor(first / block), F.floor(F.col("cum_m") / block))).alias("_block"))
    found = _with(wanted, held, [*keys, "_block"]).where((F.col("at") >= F.col("_first")) & (F.col("at") <= F.col("cum_m")))
    got = found.groupBy(*keys, fold).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("part") == part, F.col(value))).alias(f"_v_{part}") for part, *_ in parts])

    def between(name: str, p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_v_{name}_lo"), F.col(f"_v_{name}_hi")
        return (lo + (hi - lo) * (pos - F.floor(pos))).alias(name)

    return got.select(*keys, fold, "n", *[between(name, p) for name, p in probs.items()])
