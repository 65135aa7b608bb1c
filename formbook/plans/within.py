"""Comparisons inside one group (usually one race).

Groups are normally tiny, so totals and ranks are window expressions that share
one exchange on the group key.  Groups above the skew limit use partial
aggregation plus a join for totals and sliced ordinals for ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.plans.ordered import UNBOUNDED, null_safe_join, order_columns, with_ordinal
from formbook.plans.skew import SkewProfile, profile_for


def with_totals(
    df: DataFrame, keys: Sequence[str], totals: dict[str, Column], skew: SkewProfile | None = None
) -> DataFrame:
    """Add group aggregates (``F.sum``, ``F.avg``, ``F.median`` ...) to every row."""
    cold, hot = profile_for(df, keys, skew).split(df, keys)
    w = Window.partitionBy(*keys)
    out = cold.select("*", *[agg.over(w).alias(n) for n, agg in totals.items()])
    if hot is None:
        return out
    agg = hot.groupBy(*keys).agg(*[a.alias(n) for n, a in totals.items()])
    return out.unionByName(null_safe_join(hot, agg, keys))


def with_ranks(
    df: DataFrame,
    keys: Sequence[str],
    ranks: dict[str, tuple[str, str, bool]],
    tie: str | None = None,
    skew: SkewProfile | None = None,
) -> DataFrame:
    """Add rank columns: name -> (kind, column, descending).

    Kinds: ``min`` (ties share the best rank), ``first`` (ties ordered by
    ``tie``), ``pct`` (average rank of ties / non-null count).  Nulls get no rank.
    """
    cold, hot = profile_for(df, keys, skew).split(df, keys)
    cols = []
    for name, (kind, col, desc) in ranks.items():
        value = F.col(col)
        key = value.desc_nulls_last() if desc else value.asc_nulls_last()
        w = Window.partitionBy(*keys)
        if kind == "min":
            r = F.rank().over(w.orderBy(key)).cast("long")
        elif kind == "first":
            r = F.row_number().over(w.orderBy(key, *order_columns([tie] if tie else []))).cast("long")
        else:
            ties = F.count(value).over(Window.partitionBy(*keys, col))
            r = (F.rank().over(w.orderBy(key)) + (ties - 1) / 2.0) / F.count(value).over(w)
        cols.append(F.when(value.isNotNull(), r).alias(name))
    out = cold.select("*", *cols)
    if hot is None:
        return out
    limit = profile_for(df, keys, skew).limit
    for name, (kind, col, desc) in ranks.items():
        hot = _hot_rank(hot, keys, name, kind, col, desc, tie, limit)
    return out.unionByName(hot)


def with_percent_ranks(
    df: DataFrame, keys: Sequence[str], ranks: dict[str, tuple[str, bool]], skew: SkewProfile | None = None
) -> DataFrame:
    """Average-tie percent ranks of many columns: name -> (column, descending).

    One sort per column would dominate wide tables, so an ordinary group's
    values are gathered per column (a race is a short array) and compared in
    place; hot groups are ranked by slices as in :func:`with_ranks`.
    """
    cold, hot = profile_for(df, keys, skew).split(df, keys)
    w = Window.partitionBy(*keys)
    wanted = sorted({c for c, _ in ranks.values()})
    rows = cold.select("*", *[F.collect_list(c).over(w).alias(f"_all_{c}") for c in wanted])

    def rank(c: str, desc: bool) -> Column:
        field, mine = F.col(f"_all_{c}"), F.col(c)
        better = F.size(F.filter(field, lambda x: x > mine if desc else x < mine))
        ties = F.size(F.filter(field, lambda x: x == mine))
        return F.when(mine.isNotNull(), (better + (ties + 1) / 2.0) / F.size(field))

    out = rows.select(*cold.columns, *[rank(c, d).alias(n) for n, (c, d) in ranks.items()])
    if hot is None:
        return out
    limit = profile_for(df, keys, skew).limit
    for name, (c, desc) in ranks.items():
        hot = _hot_rank(hot, keys, name, "pct", c, desc, None, limit)
    return out.unionByName(hot)


def value_ranges(df: DataFrame, keys: Sequence[str], value: str, limit: int) -> DataFrame:
    """(keys, value, _t, _below, _n): rows of each distinct non-null value, rows below it, rows of the key.

    Counts are combined before the shuffle; distinct values are placed by slices and summed up
    block by block, so no task sorts a key that holds more than ``limit`` values."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    placed = with_ordinal(distinct, keys, [value], "_o", limit)
    placed = placed.withColumn("_blk", F.floor((F.col("_o") - 1) / F.lit(limit)).cast("long"))
    blocks = placed.groupBy(*keys, "_blk").agg(F.sum("_t").alias("_bt"))
    wk = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(UNBOUNDED, -1)
    total = F.sum("_bt").over(Window.partitionBy(*keys))
    blocks = blocks.select(*keys, "_blk", F.coalesce(F.sum("_bt").over(wk), F.lit(0)).alias("_off"), total.alias("_n"))
    wi = Window.partitionBy(*keys, "_blk").orderBy("_o").rowsBetween(UNBOUNDED, -1)
    placed = placed.withColumn("_loc", F.coalesce(F.sum("_t").over(wi), F.lit(0)))
    placed = null_safe_join(placed, blocks, [*keys, "_blk"])
    return placed.select(*keys, value, "_t", (F.col("_off") + F.col("_loc")).alias("_below"), "_n")


def _hot_rank(df, keys, name, kind, col, desc, tie, limit) -> DataFrame:
    """Ranks in hot groups, over the values as they are (any ordered type; NaN is the largest)."""
    df = df.withColumn("_v", F.col(col))
    some = df.where(F.col("_v").isNotNull())
    better = F.col("_n") - F.col("_below") - F.col("_t") if desc else F.col("_below")
    placed = value_ranges(some, keys, "_v", limit).select(*keys, "_v", "_t", "_n", better.alias("_b"))
    if kind == "first":
        some = with_ordinal(some, [*keys, "_v"], [tie or "_v"], "_i", limit)
        out = null_safe_join(some, placed.select(*keys, "_v", "_b"), [*keys, "_v"])
        out = out.withColumn(name, (F.col("_b") + F.col("_i")).cast("long")).drop("_b", "_i")
        rest = df.where(F.col("_v").isNull()).withColumn(name, F.lit(None).cast("long"))
        return out.unionByName(rest).drop("_v")
    out = null_safe_join(df, placed, [*keys, "_v"])
    rank = (F.col("_b") + 1).cast("long") if kind == "min" else (F.col("_b") + (F.col("_t") + 1) / 2.0) / F.col("_n")
    return out.withColumn(name, rank).drop("_v", "_t", "_n", "_b")
