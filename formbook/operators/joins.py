"""Lookups, reconciliations and key alignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.functions.text import (
    exchange_entrant_key, exchange_track_key, entrant_key, off_time_key, track_key,
)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order``.

    An aggregate instead of a window, so duplicates are combined map-side and a
    key with many copies never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    # max_by picks the greatest; order columns arrive most wanted first.
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def fill_pedigree(df: DataFrame, pedigree: DataFrame, key: str = "entrant_id",
                  cols: Sequence[str] = ("sire", "dam", "damsire")) -> DataFrame:
    """Fill blank pedigree names from the lookup; an existing name wins."""
    dim = pedigree.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols])
    joined = df.join(dim, key, "left")
    return joined.select(*[c for c in df.columns if c not in cols], *[
        F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"_p_{c}")).alias(c) for c in cols])


KEYS = ["_k_date", "_k_track", "_k_off", "_k_entrant"]


def with_runner_keys(df: DataFrame, exchange: bool = False, date: str = "race_date", track: str = "track",
                     off: str = "off_time", entrant: str = "entrant_name") -> DataFrame:
    """The four normalised keys that identify a runner across sources."""
    t, h = (exchange_track_key(track), exchange_entrant_key(entrant)) if exchange else (track_key(track), entrant_key(entrant))
    return df.select("*", F.col(date).cast("date").alias("_k_date"), t.alias("_k_track"),
                     off_time_key(off).alias("_k_off"), h.alias("_k_entrant"))


def attach_by_runner_keys(df: DataFrame, other: DataFrame, cols: Sequence[str], order: Sequence[Column],
                          exchange: bool = False, marker: str | None = None) -> DataFrame:
    """Left join of another source on the runner keys; of duplicates the first under ``order`` is used."""
    right = with_runner_keys(other, exchange).select(*KEYS, *cols, *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    right = latest_per_key(right, KEYS, [F.col(f"_o{i}") for i in range(len(order))]).select(
        *KEYS, *[F.col(c).alias(f"_j_{c}") for c in cols], F.lit(1).alias("_hit"))
    out = with_runner_keys(df, exchange).join(right, KEYS, "left")
    extra = [F.coalesce("_hit", F.lit(0)).alias(marker)] if marker else []
    return out.select(*[c for c in df.columns if c not in cols], *[F.col(f"_j_{c}").alias(c) for c in cols], *extra)


def fill_missing(df: DataFrame, updates: DataFrame, keys: Sequence[str], cols: Sequence[str],
                 flag: str = "was_filled") -> DataFrame:
    """Refresh only null values; ``flag`` marks rows where a value was filled."""
    dim = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in cols])
    out = df.join(dim, list(keys), "left")
    filled = F.lit(False)
    for c in cols:
        filled = filled | (F.col(c).isNull() & F.col(f"_u_{c}").isNotNull())
    return out.select(*[c for c in df.columns if c not in cols],
                      *[F.coalesce(c, f"_u_{c}").alias(c) for c in cols], filled.cast("int").alias(flag))


def coverage_reasons(df: DataFrame, cache: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``reason`` per row: matched, matched without any metric, or not matched."""
    right = cache.select(*keys, F.lit(1).alias("_hit"), F.coalesce(*[F.col(m).cast("double") for m in metrics])
                         .isNotNull().alias("_any"))
    out = df.join(right, list(keys), "left")
    return out.select(*df.columns, F.when(F.col("_hit").isNull(), "no_key_match").when(
        ~F.col("_any"), "key_match_but_no_metrics").otherwise("key_match").alias("reason"))


def reconcile_races(left: DataFrame, right: DataFrame, race: Sequence[str], meeting: Sequence[str]) -> DataFrame:
    """Races missing on either side, and whether the whole meeting or part of the card is missing."""
    a, b = (d.select(*race).distinct() for d in (left, right))
    am, bm = (d.select(*meeting).distinct().withColumn("_m", F.lit(1)) for d in (a, b))

    def gap(present, absent, absent_meetings, side):
        missing = present.join(absent, list(race), "left_anti")
        return missing.join(absent_meetings, list(meeting), "left").select(
            *race, F.lit(side).alias("missing_in"),
            F.when(F.col("_m").isNull(), "whole_meeting").otherwise("partial_card").alias("kind"))

    return gap(a, b, bm, "right").unionByName(gap(b, a, am, "left"))


def pending_entities(df: DataFrame, cache: DataFrame, key: str, recency: str, limit: int | None = None) -> DataFrame:
    """Entities without a cache row, most recently seen first; ``limit`` sizes one work batch."""
    todo = df.where(F.col(key).isNotNull()).join(cache.select(key), key, "left_anti").groupBy(key).agg(
        F.max(recency).alias("last_seen"))
    if limit is None:
        return todo
    return todo.orderBy(F.desc("last_seen"), key).limit(limit)


def align_occurrences(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str],
                      right_order: Sequence[str], cols: Sequence[str], skew=None) -> DataFrame:
    """Match the n-th occurrence of a key on the left with the n-th on the right."""
    from formbook.plans.ordered import Ordinal, ordered

    a = ordered(left, keys, left_order, {"occurrence": Ordinal()}, skew)
    b = ordered(right, keys, right_order, {"occurrence": Ordinal()}, skew).select(*keys, "occurrence", *cols)
    return a.join(b, [*keys, "occurrence"], "left")


def refresh_card(predictions: DataFrame, card: DataFrame, keys: Sequence[str] = ("race_id", "entrant_id"),
                 price: str = "odds") -> DataFrame:
    """Keep runners still on the card and take the card's price where it has one."""
    kept = predictions.join(card.select(*keys, F.col(price).alias("_new")), list(keys))
    return kept.select(*[c for c in predictions.columns if c != price], F.coalesce("_new", price).alias(price))


def settle_predictions(predictions: DataFrame, results: DataFrame, keys: Sequence[str] = ("race_id", "entrant_id"),
                       non_runner: Sequence[str] = ("NR", "WD")) -> DataFrame:
    """``settled`` when the race has results and the runner is in them; non-runners flagged by label."""
    res = results.select(*keys, F.col("finish_position").alias("_fp"), F.col("won").alias("_won"),
                         F.col("finish_pos_label").alias("_label"))
    races = results.where(F.col("finish_position") > 0).select("race_id").distinct().withColumn("_race", F.lit(1))
    out = predictions.join(res, list(keys), "left").join(races, "race_id", "left")
    gone = F.coalesce(F.upper("_label").isin(*non_runner), F.lit(False)) | (
        F.col("_race").isNotNull() & F.col("_fp").isNull())
    settled = F.col("_race").isNotNull() & F.col("_fp").isNotNull() & ~gone
    return out.select(*predictions.columns, settled.cast("int").alias("settled"), gone.cast("int").alias("non_runner"),
                      F.when(settled, F.col("_won")).alias("result_won"),
                      F.when(settled, F.col("_fp")).alias("result_position"))
