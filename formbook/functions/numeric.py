"""Numeric column helpers: bins, shrinkage, odds arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(value: str | Column, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Right-closed bins ``(e0, e1] .. (en-1, en]``; outside the edges the result is null."""
    value = col(value)
    out = None
    for i, label in enumerate(labels):
        above = value >= float(edges[i]) if include_lowest and i == 0 else value > float(edges[i])
        test = above & (value <= float(edges[i + 1]))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def bin_index(value: str | Column, edges: Column) -> Column:
    """0-based right-closed bin of ``value`` in an ascending edge array.

    Values at or below the first inner edge fall in bin 0; the lowest edge is
    included, values beyond the last edge stay in the last bin.
    """
    value = col(value)
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(value.isNotNull(), F.size(F.filter(inner, lambda e: e < value)))


def rate(numerator: str | Column, denominator: str | Column, minimum: int = 0) -> Column:
    """``numerator / denominator`` when the denominator exceeds ``minimum``, else 0."""
    n, d = col(numerator), col(denominator)
    return F.when(d > minimum, n / d).otherwise(F.lit(0.0))


def shrink(observed: str | Column, n: str | Column, prior: float, strength: float) -> Column:
    """Pull an observed rate towards ``prior`` as if ``strength`` earlier cases had shown it."""
    n = F.greatest(col(n), F.lit(0))
    return (n * col(observed) + F.lit(strength * prior)) / (n + F.lit(float(strength)))


def kelly(prob: str | Column, odds: str | Column, fraction: float | Column = 1.0) -> Column:
    """Stake share with the best long-run growth, times ``fraction``; never negative."""
    p, b = col(prob), col(odds) - 1.0
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.when(b > 0, F.greatest((b * p - (1.0 - p)) / b * f, F.lit(0.0))).otherwise(F.lit(0.0))


def value_threshold(base: float | Column, odds: str | Column) -> Column:
    """Edge demanded at these odds: ``base * sqrt(odds / 3)`` with odds below 1 read as 1."""
    b = base if isinstance(base, Column) else F.lit(float(base))
    return b * F.sqrt(F.greatest(col(odds), F.lit(1.0)) / 3.0)


def finite(value: str | Column) -> Column:
    """Null instead of NaN and infinities."""
    v = col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(math.inf)), v)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def clip(value: str | Column, low: float | None, high: float | None) -> Column:
    """Bound a value; null stays null."""
    v = col(value)
    out = v
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(v.isNotNull(), out)


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -60.0, 60.0)))


def log_loss_term(y: Column, p: Column) -> Column:
    q = clip(p, 1e-15, 1.0 - 1e-15)
    return -(y * F.log(q) + (1 - y) * F.log(1.0 - q))


# Net odds and the label shown for them.
DISPLAY_ODDS = {
    0.5: "1/2", 0.67: "4/6", 0.8: "4/5", 1.0: "EVS", 1.5: "6/4", 2.0: "2/1", 2.5: "5/2", 3.0: "3/1", 4.0: "4/1",
    5.0: "5/1", 6.0: "6/1", 8.0: "8/1", 10.0: "10/1", 12.0: "12/1", 14.0: "14/1", 16.0: "16/1", 20.0: "20/1",
    25.0: "25/1", 33.0: "33/1", 50.0: "50/1", 100.0: "100/1",
}


def display_odds(odds: str | Column) -> Column:
    """Nearest display label of decimal odds; the shorter price wins a tie."""
    o = col(odds)
    options = [
        F.struct(F.abs(F.lit(net) - (o - 1.0)).alias("gap"), F.lit(i).alias("i"), F.lit(label).alias("label"))
        for i, (net, label) in enumerate(DISPLAY_ODDS.items())
    ]
    return F.when(o <= 1.0, F.lit("EVS")).otherwise(F.array_min(F.array(*options)).getField("label"))
