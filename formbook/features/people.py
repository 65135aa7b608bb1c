"""Features of jockeys, trainers, their pairings and pedigrees.

These entities run several times a day, so their past is date-strict: it is
reduced to (entity, day) sums before any window sees it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.features.flags import ORDER
from formbook.features.entrant import drop_helpers, flag, half_furlong, record
from formbook.functions.numeric import rate, shrink
from formbook.plans.ewma import with_ewma
from formbook.plans.ladder import attach_day_ladder, attach_race_ladder, calendar_sums, day_start_view
from formbook.plans.ordered import Rolling, Running, ordered
from formbook.plans.skew import SkewProfile

ROW_ORDER = (*ORDER, "entrant_id")


def results() -> dict[str, Column]:
    return {"_n": F.col("rs"), "_w": F.col("won_hist"), "_p": F.col("placed_hist")}


def date_strict_record(df, keys: Sequence[str], prefix: str, runs: str, strength: float,
                       days: Sequence[int] = (), source: DataFrame | None = None) -> DataFrame:
    """Lifetime win/place rates (raw and shrunk) and calendar-window rates of an entity."""
    df = attach_day_ladder(df, keys, results(), days, source=source)
    n = f"{prefix}_{runs}"
    cols = [F.col("_n").alias(n), rate("_w", "_n").alias(f"{prefix}_win_rate"),
            shrink(rate("_w", "_n"), "_n", 0.10, strength).alias(f"{prefix}_win_rate_shrunk"),
            rate("_p", "_n").alias(f"{prefix}_place_rate"),
            shrink(rate("_p", "_n"), "_n", 0.30, strength).alias(f"{prefix}_place_rate_shrunk")]
    kind = "rides" if prefix == "jockey" else "runs"
    for d in days:
        cols += [F.col(f"_w_{d}d").alias(f"{prefix}_wins_{d}d"), F.col(f"_n_{d}d").alias(f"{prefix}_{kind}_{d}d"),
                 F.col(f"_p_{d}d").alias(f"{prefix}_places_{d}d"),
                 rate(f"_w_{d}d", f"_n_{d}d", 2).alias(f"{prefix}_wr_{d}d"),
                 rate(f"_p_{d}d", f"_n_{d}d", 2).alias(f"{prefix}_pr_{d}d")]
    df = df.select("*", *cols)
    if days:
        df = df.select("*", *[
            (F.col(f"{prefix}_{r}_{d}d") - F.col(f"{prefix}_{base}_rate_shrunk")).alias(f"{prefix}_{r}_{d}d_delta")
            for d in days for r, base in (("wr", "win"), ("pr", "place"))],
            (F.col(f"{prefix}_wr_14d") - F.col(f"{prefix}_wr_30d")).alias(f"{prefix}_hot_vs_30d"))
    return df.drop(*[c for c in df.columns if c.startswith(("_n", "_w", "_p"))])


def add_jockey_features(df: DataFrame, skew: SkewProfile | None = None) -> DataFrame:
    """Lifetime, last 10/20 rides and 14/30-day record, all as of the start of the day."""
    src, rolls = df, {}
    for n in (10, 20):
        rolls |= {f"jockey_wins_{n}": Rolling("sum", F.col("won_hist"), n),
                  f"jockey_avg_pos_{n}": Rolling("mean", F.col("fp"), n)}
    df = ordered(df, ["jockey"], ROW_ORDER, rolls, skew)
    df = day_start_view(df, ["jockey"], list(rolls), skew)
    return date_strict_record(df, ["jockey"], "jockey", "prev_rides", 10.0, (14, 30), src)


def add_trainer_features(df: DataFrame, skew=None) -> DataFrame:
    """As for jockeys, plus the trainer's record at this venue."""
    src = df
    rolls = {f"trainer_wins_{n}": Rolling("sum", F.col("won"), n) for n in (10, 20)}
    df = ordered(df, ["trainer"], ROW_ORDER, rolls, skew)
    df = day_start_view(df, ["trainer"], list(rolls), skew)
    df = date_strict_record(df, ["trainer"], "trainer", "prev_runs", 10.0, (14, 30), src)
    return plain_record(df, src, ["trainer", "track"], "trainer_track", "win_rate", 0)


def plain_record(df, source, keys, prefix: str, rate_name: str, minimum: int) -> DataFrame:
    """``<prefix>_runs`` and a raw win rate that needs more than ``minimum`` runs."""
    df = attach_day_ladder(df, keys, {"_pn": F.lit(1), "_pw": F.col("won")}, source=source)
    return df.select("*", F.col("_pn").alias(f"{prefix}_runs"),
                     rate("_pw", "_pn", minimum).alias(f"{prefix}_{rate_name}")).drop("_pn", "_pw")


def add_jockey_track_features(df: DataFrame, skew=None) -> DataFrame:
    return plain_record(df, df, ["jockey", "track"], "jockey_track", "win_rate", 0)


def add_jockey_trainer_features(df: DataFrame, skew=None) -> DataFrame:
    """The pairing's record, and whether the jockey is the stable's most used one."""
    src = df
    df = attach_race_ladder(df, ["jockey", "trainer"], {"_own": F.lit(1)}, skew=skew)
    # The trainer's most-used pairing so far, runners of one race taken together.
    races = df.groupBy("trainer", *ORDER).agg(F.max("_own").alias("_m"))
    best = ordered(races, ["trainer"], ORDER, {"_best": Running("max", F.col("_m"), current=True)}, skew)
    df = df.join(best.select("trainer", "race_id", "_best"), ["trainer", "race_id"], "left")
    df = date_strict_record(df, ["jockey", "trainer"], "jt", "prev_runs", 5.0, source=src)
    return drop_helpers(df.withColumn(
        "is_stable_jockey", flag((F.col("_own") == F.col("_best")) & (F.col("_own") > 0))))


def add_trainer_specialisation_features(df: DataFrame, skew=None) -> DataFrame:
    src = df
    df = plain_record(df, src, ["trainer", "dist_category"], "trainer_dist_cat", "wr", 2)
    return plain_record(df, src, ["trainer", "going"], "trainer_going", "wr", 2)


def add_cross_entity_features(df: DataFrame, skew=None) -> DataFrame:
    """Jockey by going and distance, entrant by going and trip, trainer by class."""
    src = df
    df = df.withColumn("_half", half_furlong())
    if "entrant_going_runs" not in df.columns:
        df = record(df, ["entrant_id", "going"], "entrant_going", skew)
        df = df.withColumn("entrant_going_wr", rate("_entrant_going_wins", "entrant_going_runs"))
    df = record(df, ["entrant_id", "going", "_half"], "entrant_going_dist", skew)
    df = plain_record(df, src, ["jockey", "going"], "jockey_going", "wr", 2)
    df = plain_record(df, src, ["jockey", "dist_category"], "jockey_dist_cat", "wr", 2)
    df = plain_record(df, src, ["trainer", "race_class"], "trainer_class", "wr", 2)
    return drop_helpers(df.withColumn("entrant_going_dist_wr", rate("_entrant_going_dist_wins", "entrant_going_dist_runs")))


def soft_ground() -> Column:
    return F.coalesce("going", F.lit("Good")).isin("Soft", "Heavy", "Yielding")


def add_pedigree_features(df: DataFrame, skew=None) -> DataFrame:
    """Progeny records of sire, dam and damsire, the males' also under special conditions."""
    dist = F.coalesce("distance_furlongs", F.lit(8.0))
    conditions = {
        "soft": soft_ground(),
        "aw": F.lower("surface").rlike("aw|all weather|all-weather"),
        "sprint": dist <= 7.0,
        "stay": dist >= 11.5,
    }
    src = df
    for parent in ("sire", "dam", "damsire"):
        sums = {"_n": F.col("rs"), "_w": F.col("won"), "_p": F.col("placed_hist")}
        special = conditions if parent != "dam" else {}
        for name, cond in special.items():
            for s in ("_n", "_w", "_p"):
                sums[f"{s}_{name}"] = F.when(cond, {"_n": F.col("rs"), "_w": F.col("won"),
                                                    "_p": F.col("placed_hist")}[s]).otherwise(0)
        df = attach_race_ladder(df, [parent], sums, skew=skew, source=src)
        win = f"{parent}_win_rate_shrunk"
        df = df.select("*", shrink(rate("_w", "_n"), "_n", 0.10, 20.0).alias(win),
                       shrink(rate("_p", "_n"), "_n", 0.30, 20.0).alias(f"{parent}_place_rate_shrunk"))
        for name in special:
            n = f"_n_{name}"
            w = shrink(rate(f"_w_{name}", n), n, 0.10, 10.0)
            df = df.select(
                "*", w.alias(f"{parent}_{name}_win_rate_shrunk"),
                shrink(rate(f"_p_{name}", n), n, 0.30, 10.0).alias(f"{parent}_{name}_place_rate_shrunk"),
                (w - F.col(win)).alias(f"{parent}_{name}_edge"))
        df = df.drop(*sums)
    return df


def add_candidate_features(df: DataFrame, skew=None) -> DataFrame:
    """Sires by distance category and going, and how often a trainer's newcomers win."""
    n, w, p = F.lit(1), F.col("won"), F.col("placed_hist")
    df = ordered(df, ["entrant_id"], ORDER, {"_runs": Running("sum", F.col("rs"))}, skew)
    df = df.withColumn("is_debut", flag(F.coalesce("_runs", F.lit(0)) == 0)).drop("_runs")
    src = df
    for parent in ("sire", "damsire"):
        df = attach_race_ladder(df, [parent, "dist_category"], {"_n": n, "_w": w, "_p": p}, skew=skew, source=src)
        df = df.select("*", shrink(rate("_w", "_n"), "_n", 0.10, 20.0).alias(f"{parent}_dc_wr_shrunk"),
                       shrink(rate("_p", "_n"), "_n", 0.30, 20.0).alias(f"{parent}_dc_pr_shrunk"),
                       F.col("_n").alias(f"{parent}_dc_runs")).drop("_n", "_w", "_p")
    df = attach_race_ladder(df, ["sire", "going"], {"_n": n, "_w": w}, skew=skew, source=src)
    df = df.withColumn("sire_going_wr_shrunk", shrink(rate("_w", "_n"), "_n", 0.10, 20.0)).drop("_n", "_w")
    df = attach_race_ladder(df, ["trainer"], {"_n": F.col("is_debut"), "_w": F.col("is_debut") * w}, skew=skew,
                            source=src)
    df = df.withColumn("trainer_fto_sr_shrunk", shrink(rate("_w", "_n"), "_n", 0.08, 15.0))
    return df.drop("_n", "_w")


TE_PRIOR, TE_STRENGTH, TE_DAYS, TE_HALF_LIFE = 0.45, 15.0, 365, 20


def encoded(total: str, n: str) -> Column:
    """Mean normalised position pulled towards the neutral prior."""
    mean = F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(F.lit(TE_PRIOR))
    return shrink(mean, n, TE_PRIOR, TE_STRENGTH)


def add_target_encoded_features(df: DataFrame, skew=None) -> DataFrame:
    """Normalised finishing position (0 winner .. 1 last) per entity: lifetime, last year, EWMA."""
    field = F.when(F.col("num_runners") == 0, 1).otherwise(F.col("num_runners"))
    df = df.withColumn("_np", ((F.col("fp") - 1) / F.greatest(field - 1, F.lit(1))).cast("double"))
    df = df.withColumn("_nw", F.col("finished"))
    src = df
    # Entrants: one run a day as a rule, so plain row order.
    df = ordered(df, ["entrant_id"], ORDER, {"_s": Running("sum", F.col("_np")), "_c": Running("sum", F.col("_nw"))}, skew)
    df = df.fillna(0, ["_s", "_c"])
    df = calendar_sums(df, ["entrant_id"], {"_ws": F.coalesce("_np", F.lit(0.0)), "_wc": F.col("_nw")}, [TE_DAYS], skew)
    df = with_ewma(df, ["entrant_id"], ORDER, {"_e": ("_np", TE_HALF_LIFE)}, skew)
    df = df.select("*", encoded("_s", "_c").alias("entrant_te_norm_pos"),
                   encoded(f"_ws_{TE_DAYS}d", f"_wc_{TE_DAYS}d").alias(f"entrant_te_norm_pos_{TE_DAYS}d"),
                   shrink(F.when(F.col("_c") > 0, F.col("_e")).otherwise(TE_PRIOR), "_c", TE_PRIOR, TE_STRENGTH)
                   .alias("entrant_te_ewma")).drop("_s", "_c", "_e", f"_ws_{TE_DAYS}d", f"_wc_{TE_DAYS}d")
    for prefix, keys, windowed in (
        ("jockey", ["jockey"], True), ("trainer", ["trainer"], True), ("track", ["track"], False),
        ("going", ["going"], True), ("jt", ["jockey", "trainer"], False),
    ):
        df = attach_day_ladder(df, keys, {"_s": F.coalesce("_np", F.lit(0.0)), "_c": F.col("_nw")},
                               [TE_DAYS] if windowed else [], source=src)
        cols = [encoded("_s", "_c").alias(f"{prefix}_te_norm_pos")]
        if windowed:
            cols.append(encoded(f"_s_{TE_DAYS}d", f"_c_{TE_DAYS}d").alias(f"{prefix}_te_norm_pos_{TE_DAYS}d"))
        df = df.select("*", *cols)
        if windowed:
            df = _encoded_ewma(df, src, keys, prefix, skew)
        df = df.drop("_s", "_c", f"_s_{TE_DAYS}d", f"_c_{TE_DAYS}d")
    return df.drop("_np", "_nw")


def _encoded_ewma(df, source, keys, prefix, skew) -> DataFrame:
    """EWMA over the entity's races (one mean per race), read at the start of the day."""
    races = source.groupBy(*keys, *ORDER).agg(F.avg("_np").alias("_m"))
    races = with_ewma(races, keys, ORDER, {"_e": ("_m", TE_HALF_LIFE)}, skew)
    opening = races.groupBy(*keys, "race_date").agg(F.min_by("_e", "race_id").alias("_e"))
    df = df.join(opening, [*keys, "race_date"], "left")
    value = shrink(F.when(F.col("_c") > 0, F.col("_e")).otherwise(TE_PRIOR), "_c", TE_PRIOR, TE_STRENGTH)
    return df.withColumn(f"{prefix}_te_ewma", value).drop("_e")
