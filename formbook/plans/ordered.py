"""Row-ordered features of one key's history.

``ordered`` evaluates a set of frame specs (running totals, short rolling
frames, shifts) over ``partition by keys order by order``.  All specs of a call
share one exchange and one sort.  Keys above the skew limit are cut into chunks
of consecutive rows that are spread over tasks:

* a rolling frame or shift sees copies of the few neighbouring rows ("halo");
* a running total adds the combined total of the earlier chunks ("carry").

Both routes give the same values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from formbook.plans.skew import SkewProfile, profile_for
from formbook.session import stored

UNBOUNDED = Window.unboundedPreceding

_AGG = {
    "sum": F.sum,
    "count": F.count,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "last": lambda c: F.last(c, ignorenulls=True),
}


@dataclass(frozen=True)
class Running:
    """Aggregate of all earlier rows (``current=True`` adds the row itself)."""

    op: str  # sum, count, min, max, last
    expr: Column
    current: bool = False


@dataclass(frozen=True)
class Rolling:
    """Aggregate of the ``n`` rows just before the current one; nulls keep their slot."""

    op: str  # mean, sum, min, max, std, count
    expr: Column
    n: int


@dataclass(frozen=True)
class Shift:
    """Value ``k`` rows earlier (negative: later)."""

    expr: Column
    k: int = 1


@dataclass(frozen=True)
class Ordinal:
    """1-based position of the row in its key's order."""


Spec = Running | Rolling | Shift | Ordinal


def order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _plain(spec: Spec, w: WindowSpec) -> Column:
    match spec:
        case Running(op, expr, current):
            return _AGG[op](expr).over(w.rowsBetween(UNBOUNDED, 0 if current else -1))
        case Rolling(op, expr, n):
            return _AGG[op](expr).over(w.rowsBetween(-n, -1))
        case Shift(expr, k):
            return (F.lag(expr, k) if k >= 0 else F.lead(expr, -k)).over(w)
        case Ordinal():
            return F.row_number().over(w).cast("long")
    raise TypeError(spec)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, Spec],
    skew: SkewProfile | None = None,
) -> DataFrame:
    """``df`` plus one column per spec."""
    cold, hot = profile_for(df, keys, skew).split(df, keys)
    w = Window.partitionBy(*keys).orderBy(*order_columns(order))
    out = cold.select("*", *[_plain(s, w).alias(n) for n, s in specs.items()])
    if hot is None:
        return out
    limit = profile_for(df, keys, skew).limit
    return out.unionByName(_chunked(hot, keys, order, specs, limit))


def _chunked(df, keys, order, specs: dict[str, Spec], limit: int) -> DataFrame:
    back = max([s.n for s in specs.values() if isinstance(s, Rolling)]
               + [s.k for s in specs.values() if isinstance(s, Shift)] + [0])
    ahead = max([-s.k for s in specs.values() if isinstance(s, Shift)] + [0])
    size = max(limit, back + ahead + 1)

    placed = with_ordinal(df, keys, order, "_ord", limit)
    home = F.floor((F.col("_ord") - 1) / F.lit(size)).cast("long")
    slot = (F.col("_ord") - 1) % F.lit(size)
    # A row is evaluated in its home chunk and copied to a neighbour whose
    # frames reach into it.
    copies = F.array_compact(F.array(
        F.struct(home.alias("chunk"), F.lit(False).alias("halo")),
        F.when(slot >= size - back, F.struct((home + 1).alias("chunk"), F.lit(True).alias("halo"))),
        F.when((slot < ahead) & (home > 0), F.struct((home - 1).alias("chunk"), F.lit(True).alias("halo"))),
    ))
    rows = placed.select("*", F.explode(copies).alias("_c")).select(
        *placed.columns, F.col("_c.chunk").alias("_chunk"), F.col("_c.halo").alias("_halo"))

    own = ~F.col("_halo")
    w = Window.partitionBy(*keys, "_chunk").orderBy("_ord")
    local, carries, final = [], {}, []
    for name, spec in specs.items():
        match spec:
            case Running(op, expr, current):
                mine = F.when(own, expr)
                local.append(_plain(Running(op, mine, current), w).alias(f"_l_{name}"))
                if op == "last":
                    carries[name] = (F.max_by(expr, F.when(expr.isNotNull(), F.col("_ord"))), "last")
                else:
                    carries[name] = (_AGG[op](expr), "sum" if op == "count" else op)
                mine, before = F.col(f"_l_{name}"), F.col(f"_k_{name}")
                if op in ("sum", "count"):
                    both = F.coalesce(mine, F.lit(0)) + F.coalesce(before, F.lit(0))
                    value = both if op == "count" else F.when(mine.isNotNull() | before.isNotNull(), both)
                elif op == "max":
                    value = F.greatest(mine, before)
                elif op == "min":
                    value = F.least(mine, before)
                else:
                    value = F.coalesce(mine, before)
                final.append(value.alias(name))
            case Ordinal():
                final.append(F.col("_ord").alias(name))
            case _:
                local.append(_plain(spec, w).alias(name))
                final.append(F.col(name))

    out = rows.select("*", *local).where(own)
    if carries:
        totals = placed.withColumn("_chunk", home).groupBy(*keys, "_chunk").agg(
            *[agg.alias(f"_t_{n}") for n, (agg, _) in carries.items()])
        wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(UNBOUNDED, -1)
        before = totals.select(
            *keys, "_chunk", *[_AGG[op](F.col(f"_t_{n}")).over(wc).alias(f"_k_{n}") for n, (_, op) in carries.items()])
        out = null_safe_join(out, before, [*keys, "_chunk"])
    return out.select(*df.columns, *final)


def with_ordinal(df: DataFrame, keys, order, name: str, limit: int) -> DataFrame:
    """Position of every row inside its (hot) key without sorting a key in one task.

    Rows are dealt by ranges of (keys, order) into partitions of about a quarter of the limit and
    stored, so that every reader sees the same ranges; a range is sorted by one task and shifted by
    the size of its key's earlier ranges.
    """
    w = Window.partitionBy(*keys).orderBy(*order_columns(order))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = groups.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= limit:
        return df.select("*", F.row_number().over(w).cast("long").alias(name))
    ranges = int(-(-total // limit) * 4)
    # Names carry the depth: a caller's own keys may be ranges already.
    d = len(keys)
    range_, before, inside = (f"_{n}{d}" for n in ("range", "before", "in"))
    dealt = stored(df.repartitionByRange(ranges, *[F.col(k) for k in keys], *order_columns(order))
                   .withColumn(range_, F.spark_partition_id()))
    counts = dealt.groupBy(*keys, range_).agg(F.count(F.lit(1)).alias("_n"))
    earlier = counts.select(
        *keys, range_,
        F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(range_).rowsBetween(UNBOUNDED, -1)),
                   F.lit(0)).alias(before))
    inner = [*keys, range_]
    placed = dealt.select("*", F.row_number().over(
        Window.partitionBy(*inner).orderBy(*order_columns(order))).cast("long").alias(inside))
    return null_safe_join(placed, earlier, inner).select(
        *df.columns, (F.col(before) + F.col(inside)).cast("long").alias(name))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on ``on`` where null keys match null keys; keeps left's key columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, cond, "left").drop(*[f"_r_{c}" for c in on])
