"""Short-horizon nowcast: persistence from the last settled slot with regime-wise residual bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import scoring as S
from slotwise.functions.keys import ahead_date, ahead_period
from slotwise.operators.ordered import exact_quantiles
from slotwise.operators.series import CHUNK, with_frames

HORIZONS = (1, 2, 3)
GATE = (0.77, 0.86)


def forward_residuals(df: DataFrame, keys: Sequence[str] = ("series",), value: str = "ssp",
                      horizons: Sequence[int] = HORIZONS, chunk: int = CHUNK) -> DataFrame:
    """Long table (origin slot, regime of the origin, h, change to the slot h ahead)."""

    def build(f):
        return {f"_a{h}": f.at(value, h) for h in horizons}

    d = with_frames(df, keys, "slot_ix", build, back=0, ahead=max(horizons), chunk=chunk)
    regime = F.when(F.col("price_derivation_code") == "N", "NP").otherwise("EN")
    steps = F.array(*[F.struct(F.lit(h).alias("h"), (F.col(f"_a{h}") - F.col(value)).alias("r")) for h in horizons])
    return d.select(*keys, "settlement_date", "settlement_period", "slot_ix", regime.alias("regime"),
                    F.col(value).alias("y0"), F.inline(steps)).where("r IS NOT NULL")


def fit_bands(resid: DataFrame, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """(h, regime, p10, p90, n) for each regime and overall: 9 rows."""
    both = resid.select("h", "r", F.explode(F.array(F.col("regime"), F.lit("overall"))).alias("regime"))
    q = exact_quantiles(both, ["h", "regime"], "r", {"p10": lo, "p90": hi})
    return q.join(both.groupBy("h", "regime").agg(F.count("*").alias("n")), ["h", "regime"])


def score_bands(resid: DataFrame, bands: DataFrame, gate: tuple[float, float] = GATE) -> DataFrame:
    """Out-of-sample coverage of the fitted bands per horizon and regime, with the gate."""
    both = resid.select("h", "r", F.explode(F.array(F.col("regime"), F.lit("overall"))).alias("regime"))
    j = both.join(F.broadcast(bands.select("h", "regime", "p10", "p90")), ["h", "regime"])
    g = j.groupBy("h", "regime").agg(F.count("*").alias("n"), F.avg(S.covered("r", "p10", "p90")).alias("coverage"))
    a, b = S.wilson(F.col("coverage"), F.col("n"))
    return g.withColumns({"ci_lo": a, "ci_hi": b, "pass": F.col("coverage").between(*gate)})


def keep_or_replace(old: DataFrame, new: DataFrame, check: DataFrame) -> DataFrame:
    """New bands only if every horizon's overall band passed its gate, else the old ones stay."""
    ok = check.where("regime = 'overall'").agg(F.min(F.col("pass").cast("int"))).scalar()
    a = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return a.where(F.col("_new") == F.coalesce(ok, F.lit(0))).drop("_new")


def nowcast(latest: DataFrame, bands: DataFrame, horizons: Sequence[int] = HORIZONS, fallback: bool = True) -> DataFrame:
    """Persistence forecast for the next slots; a regime without its own band uses the overall one, or has no row without ``fallback``."""
    regime = F.when(F.col("price_derivation_code") == "N", "NP").otherwise("EN")
    d = latest.select("*", regime.alias("regime"), F.explode(F.array(*map(F.lit, horizons))).alias("h"))
    own = bands.select("h", "regime", F.col("p10").alias("a10"), F.col("p90").alias("a90"))
    overall = bands.where("regime = 'overall'").select("h", F.col("p10").alias("b10"), F.col("p90").alias("b90"))
    j = d.join(F.broadcast(own), ["h", "regime"], "left" if fallback else "inner").join(F.broadcast(overall), "h", "left")
    return j.select(
        *[c for c in ("series",) if c in latest.columns], "settlement_date", "settlement_period", "h",
        ahead_date("settlement_date", "settlement_period", "h").alias("target_date"),
        ahead_period("settlement_period", "h").alias("target_period"), F.col("ssp").alias("q50"),
        (F.col("ssp") + F.coalesce("a10", "b10")).alias("q10"), (F.col("ssp") + F.coalesce("a90", "b90")).alias("q90"))


def latest_slot(df: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "slot_ix").alias("_r")).select(*keys, "_r.*")
