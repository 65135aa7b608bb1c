"""Exponentially weighted mean of earlier values.

The recurrence ``s = a*x + (1-a)*s`` (seeded by the first value, nulls
carried over) is linear, so it is a weighted prefix sum.  Observations are cut
into blocks short enough that the growing weights stay inside a double; a block
is long enough that only the block before it still has weight.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.plans.ordered import Running, null_safe_join, ordered
from formbook.plans.skew import SkewProfile, profile_for

UNBOUNDED = Window.unboundedPreceding


def half_life_alpha(half_life: float) -> float:
    return 1.0 - math.exp(-math.log(2.0) / half_life)


def with_ewma(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, float]],
    skew: SkewProfile | None = None,
) -> DataFrame:
    """Add ``name -> (value column, half-life)`` means over earlier rows only."""
    skew = profile_for(df, keys, skew)
    columns = sorted({c for c, _ in outputs.values()})
    out = ordered(df, keys, order, {f"_m_{c}": Running("count", F.col(c)) for c in columns}, skew)
    hot = skew.hot(df, keys) is not None
    for name, (col, half_life) in outputs.items():
        lam = math.log(2.0) / half_life
        size = int(300.0 / lam)
        seen = F.col(f"_m_{col}")
        slot = (seen % size).cast("double")
        weight = F.when(seen == 0, F.lit(1.0)).otherwise(F.lit(half_life_alpha(half_life)))
        term = F.col(col) * weight * F.exp((slot + 1) * lam)
        blk = f"_b_{name}"
        out = out.withColumn(blk, F.floor(seen / size).cast("long"))
        inside = Window.partitionBy(*keys, blk).orderBy(*order).rowsBetween(UNBOUNDED, -1)
        if hot:
            ends = out.groupBy(*keys, blk).agg((F.sum(term) * math.exp(-lam * size)).alias("_end"))
            ends = ends.withColumn(blk, F.col(blk) + 1)
            out = null_safe_join(out, ends, [*keys, blk])
            before = F.col("_end")
        else:
            previous = Window.partitionBy(*keys).orderBy(blk).rangeBetween(-1, -1)
            before = F.sum(term).over(previous) * math.exp(-lam * size)
        value = (F.coalesce(F.sum(term).over(inside), F.lit(0.0)) + F.coalesce(before, F.lit(0.0))) * F.exp(-slot * lam)
        out = out.withColumn(name, F.when(seen > 0, value)).drop("_end", blk)
    return out.drop(*[f"_m_{c}" for c in columns])
