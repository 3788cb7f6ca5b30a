"""Ordered-series primitives: halo-chunk windows, calendar-safe lags, fills, islands.

All frames are RANGE frames over a slot or day index, so a missing slot gives a
NULL lag instead of shifting every later one, and no densified grid is needed.
A long series is cut into chunks of ``chunk`` slots; each chunk is handed the
last ``halo`` slots of its predecessor, so one series runs in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 8192
#: Windows up to this width (a day) are summed anew for every row; measured, blocks pay beyond it.
SHORT = 48


class Frames:
    """Frames relative to the current index over one window specification."""

    def __init__(self, spec: WindowSpec):
        self.spec = spec

    def at(self, c: str | Column, offset: int) -> Column:
        """Value exactly ``offset`` steps away (negative: past); NULL when that slot is absent."""
        return F.max(c).over(self.spec.rangeBetween(offset, offset))

    def lag(self, c, n: int) -> Column:
        return self.at(c, -n)

    def over(self, agg: Column, lo: int, hi: int) -> Column:
        return agg.over(self.spec.rangeBetween(lo, hi))

    def rolling(self, c, width: int, stat: str, min_periods: int = 1, include_current: bool = False) -> Column:
        """Statistic of the ``width`` previous steps; NULL below ``min_periods`` values."""
        lo, hi = (-(width - 1), 0) if include_current else (-width, -1)
        fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[stat]
        out = self.over(fn(c), lo, hi)
        if min_periods > 1:
            out = F.when(self.over(F.count(c), lo, hi) >= min_periods, out)
        return out


class BlockFrames(Frames):
    """Frames whose rolling statistics cost the same at any width beyond ``SHORT``.

    The index is cut into blocks as long as the window, so a window is the end
    of one block and the beginning of the next. Every row carries the statistics
    of its block up to itself and from itself on, both running frames; a window
    joins two of these, found by frames without a lower bound, which Spark also
    advances row by row. Nothing is subtracted, so no digits are lost.
    """

    def __init__(self, keys: Sequence[str], ix: str):
        super().__init__(W.partitionBy(*keys).orderBy(ix))
        self.keys, self.ix = list(keys), ix
        self.asked: dict[str, tuple[Column, int, int, set[str]]] = {}

    def rolling(self, c, width: int, stat: str, min_periods: int = 1, include_current: bool = False) -> Column:
        if width <= SHORT:
            return super().rolling(c, width, stat, min_periods, include_current)
        column, now = F.col(c) if isinstance(c, str) else c, int(include_current)
        name = f"{len(self.asked)}_{width}"
        for known, (other, w, at, _) in self.asked.items():
            if (w, at, str(other)) == (width, now, str(column)):
                name = known
        self.asked.setdefault(name, (column, width, now, set()))[3].add(stat)
        first, last = F.col(self.ix) - width + now, F.col(self.ix) - 1 + now
        head, tail = F.col(f"_before_{name}"), F.col(f"_since_{name}")
        one_block = F.pmod(first, F.lit(width)) == 0
        use_head = F.coalesce(F.floor(head["ix"] / width) == F.floor(last / width), F.lit(False))
        use_tail = F.coalesce((F.floor(tail["ix"] / width) == F.floor(first / width)) & ~one_block, F.lit(False))

        def both(field: str) -> tuple[Column, Column]:
            return F.when(use_head, head[field]), F.when(use_tail, tail[field])

        def added(field: str) -> Column:
            a, b = both(field)
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

        n = added("n")
        if stat == "count":
            out = n
        elif stat in ("min", "max"):
            out = (F.least if stat == "min" else F.greatest)(*both(stat))
        elif stat == "std":
            (na, nb), (sa, sb) = both("n"), both("sum")
            apart = F.when((na > 0) & (nb > 0), F.pow(sb / nb - sa / na, 2) * na * nb / n).otherwise(0.0)
            out = F.when(n > 1, F.sqrt((added("m2") + apart) / (n - 1)))
        else:
            out = F.when(n > 0, added("sum") / n if stat == "mean" else added("sum"))
        return F.when(n >= min_periods, out) if min_periods > 1 else out

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with the block statistics that :meth:`rolling` has asked for, and those of the two ends of each row's window."""
        if not self.asked:
            return df
        df = df.withColumn("_neg", -F.col(self.ix)).withColumns({f"_x_{n}": c for n, (c, *_) in self.asked.items()})
        for width in sorted({w for _, w, *_ in self.asked.values()}):
            df = df.withColumn(f"_block_{width}", F.floor(F.col(self.ix) / width))
            for side, order in (("head", self.ix), ("tail", "_neg")):
                run = W.partitionBy(*self.keys, f"_block_{width}").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
                df = df.withColumns({f"_{side}_{n}": self._state(f"_x_{n}", stats, run) for n, (_, w, _, stats) in self.asked.items() if w == width})
        back = W.partitionBy(*self.keys).orderBy("_neg")
        df = df.withColumns({f"_since_{n}": F.last(f"_tail_{n}").over(back.rangeBetween(W.unboundedPreceding, w - now)) for n, (_, w, now, _) in self.asked.items()})
        return df.withColumns({f"_before_{n}": F.last(f"_head_{n}").over(self.spec.rangeBetween(W.unboundedPreceding, now - 1)) for n, (_, _, now, _) in self.asked.items()})

    def _state(self, x: str, stats: set[str], run: WindowSpec) -> Column:
        fields = [F.col(self.ix).alias("ix"), F.count(x).over(run).alias("n")]
        if stats & {"mean", "std", "sum"}:
            fields.append(F.sum(x).over(run).alias("sum"))
        if "std" in stats:
            fields.append((F.var_pop(x).over(run) * F.count(x).over(run)).alias("m2"))
        fields += [f(x).over(run).alias(s) for s, f in (("min", F.min), ("max", F.max)) if s in stats]
        return F.struct(*fields)


def with_frames(
    df: DataFrame,
    keys: Sequence[str],
    ix: str,
    build: Callable[[Frames], dict[str, Column]],
    back: int,
    ahead: int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``build(frames)`` columns; frames may reach ``back`` steps back and ``ahead`` forward."""
    if max(back, ahead) >= chunk:
        raise ValueError("chunk must exceed the reach of the frames")
    pos = F.pmod(F.col(ix), F.lit(chunk))
    home = F.floor(F.col(ix) / chunk)
    copies = [F.struct(home.alias("c"), F.lit(True).alias("own"))]
    if back:
        copies.append(F.when(pos >= chunk - back, F.struct((home + 1).alias("c"), F.lit(False).alias("own"))))
    if ahead:
        copies.append(F.when(pos < ahead, F.struct((home - 1).alias("c"), F.lit(False).alias("own"))))
    spread = df.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
    spread = spread.withColumns({"_chunk": F.col("_copy.c"), "_own": F.col("_copy.own")}).drop("_copy")
    frames = BlockFrames([*keys, "_chunk"], ix)
    added = build(frames)
    done = frames.prepared(spread).withColumns(added).where("_own")
    return done.select(*df.columns, *[c for c in added if c not in df.columns])


def frames_by(keys: Sequence[str], ix: str) -> Frames:
    """Frames over groups whose length the calendar bounds (days of one slot, days of one series)."""
    return Frames(W.partitionBy(*keys).orderBy(ix))


def fill_forward(
    df: DataFrame, keys: Sequence[str], ix: str, cols: Sequence[str], chunk: int = CHUNK, backward: bool = False
) -> DataFrame:
    """Last (or, backward, next) non-null value of each column, without a per-series task.

    Each chunk's closing value is carried to later chunks through a table of one
    row per chunk; the fill inside a chunk is an ordinary frame.
    """
    keys = list(keys)
    d = df.withColumn("_chunk", F.floor(F.col(ix) / chunk))
    pick = F.min_by if backward else F.max_by
    # max_by skips rows whose ordering is NULL, so null values never win.
    ends = d.groupBy(*keys, "_chunk").agg(
        *[pick(c, F.when(F.col(c).isNotNull(), F.col(ix))).alias(f"_e_{c}") for c in cols]
    )
    w_chunks = W.partitionBy(*keys).orderBy("_chunk")
    if backward:
        carried = [
            F.first(f"_e_{c}", ignorenulls=True).over(w_chunks.rowsBetween(1, W.unboundedFollowing)).alias(f"_c_{c}")
            for c in cols
        ]
    else:
        carried = [
            F.last(f"_e_{c}", ignorenulls=True).over(w_chunks.rowsBetween(W.unboundedPreceding, -1)).alias(f"_c_{c}")
            for c in cols
        ]
    carry = ends.select(*keys, "_chunk", *carried)
    w_in = W.partitionBy(*keys, "_chunk").orderBy(ix)
    if backward:
        inside = {c: F.first(c, ignorenulls=True).over(w_in.rowsBetween(0, W.unboundedFollowing)) for c in cols}
    else:
        inside = {c: F.last(c, ignorenulls=True).over(w_in.rowsBetween(W.unboundedPreceding, 0)) for c in cols}
    joined = d.join(carry, [*keys, "_chunk"], "left")
    return joined.withColumns({c: F.coalesce(e, F.col(f"_c_{c}")) for c, e in inside.items()}).drop(
        "_chunk", *[f"_c_{c}" for c in cols]
    )


def interpolate_in_day(df: DataFrame, keys: Sequence[str], ix: str, c: str, out: str) -> DataFrame:
    """Linear interpolation between known slots of one day, edges held flat (at most 50 rows per group)."""
    w = W.partitionBy(*keys).orderBy(ix)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    future = w.rowsBetween(0, W.unboundedFollowing)
    known_ix = F.when(F.col(c).isNotNull(), F.col(ix))
    d = df.withColumns({
        "_v0": F.last(c, ignorenulls=True).over(past),
        "_i0": F.last(known_ix, ignorenulls=True).over(past),
        "_v1": F.first(c, ignorenulls=True).over(future),
        "_i1": F.first(known_ix, ignorenulls=True).over(future),
    })
    slope = (F.col("_v1") - F.col("_v0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    value = F.coalesce(
        F.col(c), F.col("_v0") + slope * (F.col(ix) - F.col("_i0")), F.col("_v0"), F.col("_v1")
    )
    return d.withColumn(out, value).drop("_v0", "_i0", "_v1", "_i1")


def runs(df: DataFrame, keys: Sequence[str], ix: str, state: str, chunk: int = CHUNK) -> DataFrame:
    """Gaps-and-islands: one row per run of equal ``state`` over consecutive slots.

    Runs are found per chunk and runs that touch across a chunk border are
    merged on the far smaller table of partial runs.
    """
    keys = list(keys)
    d = df.withColumn("_chunk", F.floor(F.col(ix) / chunk))
    w = W.partitionBy(*keys, "_chunk", state).orderBy(ix)
    part = (
        d.withColumn("_g", F.col(ix) - F.row_number().over(w))
        .groupBy(*keys, "_chunk", state, "_g")
        .agg(F.min(ix).alias("run_start"), F.max(ix).alias("run_end"))
    )
    # Only partial runs touching a border can merge; the rest is final.
    border = (F.pmod("run_start", F.lit(chunk)) == 0) | (F.pmod("run_end", F.lit(chunk)) == chunk - 1)
    final = part.where(~border)
    touch = part.where(border)
    wt = W.partitionBy(*keys, state).orderBy("run_start")
    grouped = touch.withColumn(
        "_new", F.when(F.col("run_start") == F.lag("run_end").over(wt) + 1, 0).otherwise(1)
    ).withColumn("_run", F.sum("_new").over(wt.rowsBetween(W.unboundedPreceding, 0)))
    merged = grouped.groupBy(*keys, state, "_run").agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end")
    )
    cols = [*keys, state, "run_start", "run_end"]
    return final.select(*cols).unionByName(merged.select(*cols)).withColumn(
        "run_length", F.col("run_end") - F.col("run_start") + 1
    )


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by a total order.

    ``min_by`` over a struct combines map-side, so a key with very many copies
    never lands in one task's sort.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def slot_grid(df: DataFrame, keys: Sequence[str], slots: int = 48) -> DataFrame:
    """(keys, date, period) for every slot between each key's first and last date."""
    span = df.groupBy(*keys).agg(F.min("settlement_date").alias("_a"), F.max("settlement_date").alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("settlement_date"))
    return days.select(*keys, "settlement_date", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("settlement_period"))
