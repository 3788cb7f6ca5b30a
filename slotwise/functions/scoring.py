"""Column expressions for errors, intervals, quantile losses and status classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.keys import col

ALPHA = 0.2
# Price bucket edges, right-closed.
BUCKET_EDGES = (85.0, 120.0, 150.0, 250.0)


def mae(y, p) -> Column:
    return F.avg(F.abs(col(y) - col(p)))


def rmse(y, p) -> Column:
    return F.sqrt(F.avg(F.pow(col(y) - col(p), 2)))


def mape(y, p, floor: float = 1.0) -> Column:
    """Mean absolute percentage error over rows with ``|y| >= floor``."""
    return F.avg(F.when(F.abs(col(y)) >= floor, F.abs(col(y) - col(p)) / F.nullif(F.abs(col(y)), F.lit(0.0)))) * 100


def smape(y, p, zero: float | None = 0.0) -> Column:
    """Symmetric percentage error; a zero denominator counts as ``zero`` (None: left out)."""
    denom = (F.abs(col(y)) + F.abs(col(p))) / 2
    term = F.abs(col(y) - col(p)) / F.nullif(denom, F.lit(0.0))
    if zero is not None:
        term = F.when(col(y).isNotNull() & col(p).isNotNull(), F.coalesce(term, F.lit(zero)))
    return F.avg(term) * 100


def covered(y, lo, hi) -> Column:
    return ((col(y) >= col(lo)) & (col(y) <= col(hi))).cast("int")


def coverage_pct(y, lo, hi) -> Column:
    return F.avg(covered(y, lo, hi)) * 100


def interval_score(y, lo, hi, alpha: float = ALPHA) -> Column:
    below = F.greatest(col(lo) - col(y), F.lit(0.0))
    above = F.greatest(col(y) - col(hi), F.lit(0.0))
    return (col(hi) - col(lo)) + (below + above) * (2.0 / alpha)


def pinball(y, pred, q: float) -> Column:
    d = col(y) - col(pred)
    return F.greatest(d * q, d * (q - 1.0))


def wilson(p: Column, n: Column, z: float = 1.6449) -> tuple[Column, Column]:
    """Wilson score interval of a share, clamped to [0, 1]; NULL for n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    denom = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / denom
    half = F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) * z / denom
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def price_bucket(y, edges=BUCKET_EDGES) -> Column:
    """Label of the right-closed bucket holding y."""
    y = col(y)
    out = F.when(y <= edges[0], f"<={edges[0]:g}")
    for a, b in zip(edges, edges[1:]):
        out = out.when(y <= b, f"{a:g}-{b:g}")
    return out.when(y > edges[-1], f">{edges[-1]:g}")


def ordered_band(q10, q50, q90) -> dict[str, Column]:
    """Quantile-crossing repair around the median."""
    return {"q10": F.least(col(q10), col(q50)), "q50": col(q50), "q90": F.greatest(col(q90), col(q50))}


def range_status(value, low: float, high: float, n, min_n: int) -> Column:
    """Traffic light of a value that should lie inside [low, high]."""
    return (
        F.when((col(n) < min_n) | col(value).isNull(), "low-n")
        .when(col(value) < low, "red")
        .when(col(value) > high, "amber")
        .otherwise("green")
    )


def residual_status(value, warn: float, alert: float, n, min_n: int) -> Column:
    """Traffic light of the size of a bias."""
    return (
        F.when((col(n) < min_n) | col(value).isNull(), "low-n")
        .when(F.abs(col(value)) >= alert, "red")
        .when(F.abs(col(value)) >= warn, "amber")
        .otherwise("green")
    )
