"""Training filters, chronological splits, folds, weights and targets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.operators.betting import places_paid
from formbook.plans.ordered import Running, ordered
from formbook.plans.within import with_totals


def drop_degenerate_races(df: DataFrame, pending: str | None = None) -> DataFrame:
    """Leave out races with one runner, one distinct position or odds below 1.01.

    They are judged by their rows with a valid position and left out whole, non-finishers
    included.  Rows marked in the column ``pending`` have no result yet and always stay.
    """
    open_ = F.coalesce(F.col(pending).cast("boolean"), F.lit(False)) if pending else F.lit(False)
    races = df.where(~open_ & (F.col("finish_position") > 0)).groupBy("race_id").agg(
        F.max("num_runners").alias("n"), F.min("finish_position").alias("lo"), F.max("finish_position").alias("hi"),
        F.min("odds").alias("o"))
    bad = races.where((F.col("n") <= 1) | (F.col("lo") == F.col("hi")) | (F.col("o") < 1.01)).select("race_id")
    good = df.where(~open_).join(bad, "race_id", "left_anti")
    return good.unionByName(df.where(open_)) if pending else good


def burn_in(df: DataFrame, months: int = 4) -> DataFrame:
    """Drop the first months, but only when the data is longer than that."""
    span = df.agg(F.min("race_date").alias("_a"), F.max("race_date").alias("_b"))  # one row
    cut = F.add_months("_a", months)
    return df.join(F.broadcast(span)).where((cut >= F.col("_b")) | (F.col("race_date") >= cut)).drop("_a", "_b")


def with_test_flag(df: DataFrame, test_share: float = 0.2) -> DataFrame:
    """``is_test`` by position in time, cut at a race boundary.

    Rows before a race are counted per day, then per race inside the day, so the
    order of all rows is never established in one place.
    """
    df = df.drop("is_test")
    races = df.groupBy("race_date", "race_id").agg(F.count(F.lit(1)).alias("_c"))
    inside = ordered(races, ["race_date"], ["race_id"], {"_in": Running("sum", F.col("_c"))})
    # One row per calendar day.
    days = df.groupBy("race_date").agg(F.count(F.lit(1)).alias("_d"))
    w = Window.orderBy("race_date")
    days = days.select(
        "race_date", F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_pre"),
        F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    flags = inside.join(days, "race_date").select(
        "race_id", (F.col("_pre") + F.coalesce("_in", F.lit(0)) > F.floor(F.col("_all") * (1 - test_share)))
        .alias("is_test"))
    return df.join(flags, "race_id")


def purge(df: DataFrame, days: int = 7) -> DataFrame:
    """Drop training rows closer than ``days`` to the first test day."""
    first = df.where("is_test").agg(F.min("race_date").alias("_t"))  # one row
    return df.join(F.broadcast(first)).where(
        F.col("is_test") | (F.col("race_date") <= F.date_sub("_t", days))).drop("_t")


def monthly_folds(df: DataFrame, purge_days: int = 7, min_train: int = 50, min_test: int = 10) -> DataFrame:
    """Walk-forward folds: test one month, train on everything before it, less the purge gap.

    One row per fold with its boundaries and sizes; all counting happens on the
    day level.
    """
    days = df.groupBy("race_date").agg(F.count(F.lit(1)).alias("n"))
    months = days.groupBy(F.trunc("race_date", "month").cast("date").alias("test_month")).agg(
        F.min("race_date").alias("test_start"), F.max("race_date").alias("test_end"), F.sum("n").alias("test_rows"))
    months = months.withColumn("train_end", F.date_sub("test_month", purge_days + 1))
    w = Window.orderBy("race_date").rowsBetween(Window.unboundedPreceding, 0)
    running = days.select("race_date", F.sum("n").over(w).alias("run"))
    # The running total as of train_end: last day at or before it.
    marks = months.select(F.col("train_end").alias("race_date"), F.lit(None).cast("long").alias("run"),
                          F.col("test_month").alias("mark")).unionByName(
        running.withColumn("mark", F.lit(None).cast("date")))
    wm = Window.orderBy("race_date", F.col("mark").isNotNull())
    train = marks.select("mark", F.last("run", True).over(wm).alias("train_rows")).where(F.col("mark").isNotNull())
    return months.join(train, F.col("test_month") == F.col("mark"), "left").where(
        (F.coalesce("train_rows", F.lit(0)) >= min_train) & (F.col("test_rows") >= min_test)).select(
        "test_month", "test_start", "test_end", "train_end", "train_rows", "test_rows")


def with_folds(df: DataFrame, n: int = 3, purge_days: int = 7) -> DataFrame:
    """Expanding-window folds: rows of each fold tagged ``train`` or ``valid``.

    The span is cut into ``n + 1`` equal periods; fold ``k`` validates on period
    ``k`` and trains on everything earlier, less the purge gap.
    """
    span = df.agg(F.min("race_date").alias("_a"), F.max("race_date").alias("_b"))  # one row
    df = df.join(F.broadcast(span))
    days = F.datediff("race_date", "_a")
    size = F.ceil((F.datediff("_b", "_a") + 1) / F.lit(float(n + 1)))
    period = F.floor(days / size)
    folds = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(
            k.alias("fold"),
            F.when(period == k, "valid").when(days < k * size - purge_days, "train").alias("part"))),
        lambda f: f["part"].isNotNull())
    return df.select("*", F.explode(folds).alias("_f")).select("*", "_f.fold", "_f.part").drop("_f", "_a", "_b")


def with_slab(df: DataFrame, share: float = 0.8) -> DataFrame:
    """``part``: ``fit`` for the earliest share of rows (race-aligned), ``calibrate`` for the rest."""
    flagged = with_test_flag(df, 1.0 - share)
    return flagged.withColumn("part", F.when(F.col("is_test"), "calibrate").otherwise("fit")).drop("is_test")


def with_early_stop(df: DataFrame, share: float = 0.9, purge_days: int = 7) -> DataFrame:
    """``is_validation`` on the last races; rows inside the purge gap are dropped."""
    return purge(with_test_flag(df, 1.0 - share), purge_days).withColumnRenamed("is_test", "is_validation")


def recency_weights(df: DataFrame, half_life: float = 180.0, seasonal: float = 0.15, shape: str = "exp",
                    name: str = "weight") -> DataFrame:
    """Sample weights that fade with age, lifted in the current month, with mean one."""
    last = df.agg(F.max("race_date").alias("_last"))  # one row
    df = df.join(F.broadcast(last))
    age = F.datediff("_last", "race_date").cast("double")
    half_life = max(half_life, 1.0)
    w = {
        "exp": F.exp(age * (-math.log(2.0) / half_life)),
        "poly": 1.0 / (1.0 + age / half_life),
        "linear": F.greatest(F.lit(0.0), 1.0 - age / (2.0 * half_life)),
    }[shape]
    w = w * (1.0 + seasonal * (F.month("race_date") == F.month("_last")).cast("double"))
    df = df.withColumn("_w", w)
    mean = df.agg(F.greatest(F.avg("_w"), F.lit(1e-12)).alias("_mean"))  # one row
    return df.join(F.broadcast(mean)).withColumn(name, F.col("_w") / F.col("_mean")).drop("_w", "_mean", "_last")


def relevance(position: str = "finish_position") -> Column:
    p = F.col(position)
    return F.when(p == 1, 5).when(p == 2, 2).when(p == 3, 1).otherwise(0)


def with_targets(df: DataFrame, teacher: str | None = None, blend: float = 1.0, skew=None) -> DataFrame:
    """Win, place, relevance, residual, position and margin targets, and the soft win label."""
    df = with_totals(df, ["race_id"], {"_book": F.sum(1.0 / F.col("odds")), "_far": F.max("lengths_behind")}, skew)
    n = F.when(F.col("num_runners") == 0, 1).otherwise(F.col("num_runners"))
    implied = F.least(F.greatest(1.0 / F.col("odds"), F.lit(0.0)), F.lit(1.0)) / F.greatest("_book", F.lit(1e-9))
    pos = F.col("finish_position")
    placed = ((pos > 0) & (pos <= places_paid("num_runners", "handicap", "three"))).cast("int")
    lengths = F.when(pos >= 1, F.col("lengths_behind")).otherwise(F.col("_far") + 10.0)
    soft = implied if teacher is None else F.coalesce(F.col(teacher), implied)
    return df.select(
        "*", F.coalesce("won", F.lit(0)).alias("y_won"), placed.alias("y_placed"), relevance().alias("y_rel"),
        (F.coalesce("won", F.lit(0)) - implied).alias("y_resid"),
        F.when(pos > 0, (pos - 1) / F.greatest(n - 1, F.lit(1))).alias("y_norm_pos"),
        F.coalesce(lengths, F.lit(30.0)).alias("y_lengths"),
        (blend * soft + (1.0 - blend) * F.coalesce("won", F.lit(0))).alias("y_soft")).drop("_book", "_far")
