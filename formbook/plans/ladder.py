"""Date-strict and race-strict history of busy entities.

A jockey, trainer, sire, venue or going value can carry a large share of all
rows.  Its history is therefore first reduced to one row per (entity, day) with
map-side partial sums, windowed at that level (one entity has at most as many
rows as the calendar has days), and joined back to the runners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.plans.ordered import Running, ordered
from formbook.plans.skew import SkewProfile, profile_for
from formbook.plans.within import with_totals

UNBOUNDED = Window.unboundedPreceding


def day_number(col: str | Column = "race_date") -> Column:
    return F.unix_date(F.col(col) if isinstance(col, str) else col)


def day_ladder(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    days: Sequence[int] = (),
    lifetime: bool = True,
    date: str = "race_date",
) -> DataFrame:
    """One row per (keys, date): sums over strictly earlier days.

    Gives ``<name>`` for the whole past and ``<name>_<n>d`` for the last ``n``
    calendar days, for each entry of ``sums``.  Rows with a null key are left out.
    """
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    daily = present.groupBy(*keys, date).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy(day_number(date))
    cols = []
    if lifetime:
        cols += [F.coalesce(F.sum(n).over(w.rangeBetween(UNBOUNDED, -1)), F.lit(0)).alias(n) for n in sums]
    for d in days:
        cols += [F.coalesce(F.sum(n).over(w.rangeBetween(-d, -1)), F.lit(0)).alias(f"{n}_{d}d") for n in sums]
    return daily.select(*keys, date, *cols)


def attach_day_ladder(
    df: DataFrame, keys, sums, days=(), lifetime=True, date="race_date", source: DataFrame | None = None
) -> DataFrame:
    """``df`` with the day ladder's columns (null where the key is null).

    ``source`` is the table the ladder is built from.  Stages that attach several
    ladders pass their input, so that a ladder never re-evaluates the joins of
    the ladders before it.
    """
    ladder = day_ladder(df if source is None else source, keys, sums, days, lifetime, date)
    return df.join(ladder, [*keys, date], "left")


def race_ladder(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    order: Sequence[str] = ("race_date", "race_id"),
    skew: SkewProfile | None = None,
) -> DataFrame:
    """One row per (keys, race): sums over strictly earlier races.

    Runners of one entity in the same race are combined first, so they never see
    each other's result.
    """
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    races = present.groupBy(*keys, *order).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    out = ordered(races, keys, order, {f"_p_{n}": Running("sum", F.col(f"_s_{n}")) for n in sums}, skew)
    return out.select(*keys, "race_id", *[F.coalesce(f"_p_{n}", F.lit(0)).alias(n) for n in sums])


def attach_race_ladder(
    df, keys, sums, order=("race_date", "race_id"), skew=None, source: DataFrame | None = None
) -> DataFrame:
    ladder = race_ladder(df if source is None else source, keys, sums, order, skew)
    return df.join(ladder, [*keys, "race_id"], "left")


def calendar_sums(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    days: Sequence[int],
    skew: SkewProfile | None = None,
    date: str = "race_date",
) -> DataFrame:
    """Add ``<name>_<n>d``: sums over the last ``n`` days, today excluded.

    For sparse entities (entrants) a range frame over the rows is cheapest; hot
    entities go through the day ladder.
    """
    cold, hot = profile_for(df, keys, skew).split(df, keys)
    w = Window.partitionBy(*keys).orderBy(day_number(date))
    out = cold.select("*", *[
        F.coalesce(F.sum(c).over(w.rangeBetween(-d, -1)), F.lit(0)).alias(f"{n}_{d}d")
        for d in days for n, c in sums.items()])
    if hot is None:
        return out
    return out.unionByName(attach_day_ladder(hot, keys, sums, days, lifetime=False, date=date))


def day_start_view(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], skew: SkewProfile | None = None, date: str = "race_date",
    order: Sequence[str] = ("race_id", "entrant_id"),
) -> DataFrame:
    """All of an entity's rows on one day take the values of its first row that day."""
    first = F.min_by(F.struct(*cols), F.struct(*order))
    out = with_totals(df, [*keys, date], {"_day": first}, skew)
    return out.drop(*cols).select("*", *[F.col(f"_day.{c}").alias(c) for c in cols]).drop("_day")
