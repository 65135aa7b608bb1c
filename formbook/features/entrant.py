"""Features of an entrant's own past.

Every stage takes and returns a runner table that carries the result flags.
Windows partition by the entrant (or entrant and a condition), so consecutive stages
reuse the entrant's partitioning instead of shuffling again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.features.flags import ORDER
from formbook.functions.numeric import clip, cut, rate, shrink
from formbook.functions.text import any_first_time, class_number, equipment_count, first_time, headgear_items
from formbook.plans.ewma import with_ewma
from formbook.plans.ladder import calendar_sums
from formbook.plans.medians import expanding_median
from formbook.plans.ordered import Ordinal, Rolling, Running, Shift, ordered
from formbook.plans.skew import SkewProfile
from formbook.plans.within import with_totals

ENTRANT = ["entrant_id"]


def flag(cond: Column) -> Column:
    """0/1 where an unknown condition counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def entrant_history(df, specs, skew=None, keys: Sequence[str] = ("entrant_id",)) -> DataFrame:
    return ordered(df, list(keys), ORDER, specs, skew)


def record(df: DataFrame, keys: Sequence[str], prefix: str, skew=None) -> DataFrame:
    """``<prefix>_runs`` and ``_<prefix>_wins`` of this entrant under the key's condition."""
    df = entrant_history(df, {
        f"{prefix}_runs": Running("sum", F.col("rs")), f"_{prefix}_wins": Running("sum", F.col("won_hist"))}, skew, keys)
    return df.fillna(0, [f"{prefix}_runs", f"_{prefix}_wins"])


def add_entrant_features(df: DataFrame, skew: SkewProfile | None = None) -> DataFrame:
    """Career counts and rates, recent form, layoffs, winning marks."""
    fp, won, nonfin = F.col("fp"), F.col("won_hist"), F.col("nonfin")
    started = F.when(F.col("rs") == 1, nonfin)
    lengths = F.when(F.col("fp") >= 1, F.col("lengths_behind"))
    rated = F.when(F.col("official_rating") > 0, F.col("official_rating"))
    df = df.withColumn("_lb", lengths)
    specs = {
        "entrant_prev_races": Running("sum", F.col("rs")),
        "entrant_prev_finishes": Running("sum", F.col("finished")),
        "_wins": Running("sum", F.col("won")),
        "_places": Running("sum", F.col("placed_hist")),
        "_nonfin": Running("sum", nonfin),
        "_pos_sum": Running("sum", fp),
        "_last_nonfin": Shift(nonfin),
        "_last_date": Shift(F.col("race_date")),
        "_last_weight": Shift(F.col("weight_lbs")),
        "_win_date": Running("last", F.when(F.col("won") == 1, F.col("race_date"))),
        "_win_or": Running("last", F.when(F.col("won") == 1, rated)),
        "_place_or": Running("last", F.when(fp.between(1, 3), rated)),
        "_high_or": Running("max", rated),
        "_ord": Ordinal(),
    }
    for n in (3, 5, 10, 20):
        specs[f"entrant_avg_pos_{n}"] = Rolling("mean", fp, n)
        specs[f"entrant_wins_{n}"] = Rolling("sum", won, n)
    specs |= {
        "entrant_best_pos_5": Rolling("min", fp, 5),
        "entrant_worst_pos_5": Rolling("max", fp, 5),
        "_std5": Rolling("std", fp, 5),
        "_won3": Rolling("mean", won, 3),
        "_nf5": Rolling("mean", started, 5),
        "_nf10": Rolling("mean", started, 10),
        "_lb5": Rolling("mean", lengths, 5),
        "_close5": Rolling("mean", F.when(lengths.isNotNull(), (lengths <= 2.0).cast("double")), 5),
    }
    df = entrant_history(df, specs, skew)
    df = entrant_history(df, {"_win_ord": Running("last", F.when(F.col("won") == 1, F.col("_ord")))}, skew)
    df = with_ewma(df, ENTRANT, ORDER, {
        "entrant_ewma_pos_3": ("fp", 3), "entrant_ewma_pos_7": ("fp", 7),
        "entrant_ewma_won_3": ("won_hist", 3), "entrant_ewma_won_7": ("won_hist", 7),
        "entrant_ewma_lb_3": ("_lb", 3), "entrant_ewma_lb_7": ("_lb", 7)}, skew)
    df = df.fillna(0, ["entrant_prev_races", "entrant_prev_finishes", "_wins", "_places", "_nonfin", "_pos_sum"])
    runs = F.col("entrant_prev_races")
    df = df.select(
        "*",
        rate("_wins", runs).alias("entrant_win_rate"),
        rate("_places", runs).alias("entrant_place_rate"),
        rate("_nonfin", runs).alias("entrant_non_finish_rate"),
    )
    idle = F.coalesce(F.datediff("race_date", "_last_date"), F.lit(60))
    slope = F.coalesce(F.col("entrant_avg_pos_10"), F.lit(0)) - F.coalesce(F.col("entrant_avg_pos_3"), F.lit(0))
    age = F.coalesce(F.col("age"), F.lit(4))

    def against(mark: str) -> Column:
        return F.coalesce(rated - F.col(mark), F.lit(0.0))

    df = df.select(
        "*",
        shrink("entrant_win_rate", runs, 0.10, 8.0).alias("entrant_win_rate_shrunk"),
        shrink("entrant_place_rate", runs, 0.30, 8.0).alias("entrant_place_rate_shrunk"),
        shrink("entrant_non_finish_rate", runs, 0.05, 10.0).alias("entrant_non_finish_rate_shrunk"),
        F.coalesce("_last_nonfin", F.lit(0)).alias("entrant_last_run_non_finish"),
        runs.alias("entrant_runs"), F.col("_wins").alias("entrant_wins"), F.col("_places").alias("entrant_places"),
        F.when(F.col("entrant_prev_finishes") > 0, F.col("_pos_sum") / F.col("entrant_prev_finishes"))
        .otherwise(F.col("num_runners") / 2.0).alias("entrant_avg_position"),
        F.coalesce("_std5", F.lit(3.0)).alias("entrant_pos_consistency"),
        F.coalesce("_won3", F.lit(0.0)).alias("entrant_win_pct_last3"),
        F.coalesce("_nf5", F.lit(0.0)).alias("entrant_non_finish_rate_5"),
        F.coalesce("_nf10", F.lit(0.0)).alias("entrant_non_finish_rate_10"),
        F.coalesce("_lb5", F.lit(3.0)).alias("entrant_avg_lb_behind"),
        F.coalesce("_close5", F.lit(0.0)).alias("close_finish_rate"),
        idle.alias("days_since_last_race"),
        F.log1p(idle).alias("days_log"),
        flag(idle <= 14).alias("days_bucket_fresh"),
        flag(idle.between(15, 28)).alias("days_bucket_normal"),
        flag(idle > 60).alias("days_bucket_break"),
        F.coalesce(F.col("weight_lbs") - F.col("_last_weight"), F.lit(0.0)).alias("weight_change"),
        slope.alias("form_slope"),
        (flag(age <= 3) * slope).alias("age_x_form_slope"),
        (age * F.log1p(runs)).alias("age_x_prev_races"),
        flag(F.col("_wins") == 0).alias("is_maiden"),
        (F.col("_ord") - 1 - F.coalesce("_win_ord", F.lit(0))).alias("runs_since_last_win"),
        F.coalesce(F.datediff("race_date", "_win_date"), F.lit(365)).alias("days_since_last_win"),
        against("_win_or").alias("or_vs_last_win_mark"),
        against("_place_or").alias("or_vs_last_place_mark"),
        against("_high_or").alias("or_vs_career_high_prev"),
    )
    df = df.select(
        "*",
        flag(F.col("or_vs_last_win_mark") < 0).alias("below_last_win_mark"),
        flag(F.col("or_vs_career_high_prev") > 0).alias("above_career_high_or"),
        flag(F.col("weight_change") < -3).alias("is_big_weight_drop"),
    )
    # The record under today's race type.
    df = record(df, ["entrant_id", "race_type"], "entrant_rt", skew)
    df = df.withColumn("entrant_rt_win_rate", rate("_entrant_rt_wins", "entrant_rt_runs"))
    df = df.withColumn("entrant_rt_wr_shrunk", shrink("entrant_rt_win_rate", "entrant_rt_runs", 0.10, 6.0))
    df = df.withColumn("entrant_rt_specialist_edge", F.col("entrant_rt_wr_shrunk") - F.col("entrant_win_rate_shrunk"))
    return drop_helpers(df)


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def add_track_features(df: DataFrame, skew=None) -> DataFrame:
    """The entrant's record at this venue, distance and going."""
    for prefix, condition in (("entrant_track", "track"), ("entrant_dist", "distance_furlongs"), ("entrant_going", "going")):
        df = record(df, ["entrant_id", condition], prefix, skew)
        df = df.withColumn(f"{prefix}_win_rate", rate(f"_{prefix}_wins", f"{prefix}_runs"))
        df = df.withColumn(f"{prefix}_wr_shrunk", shrink(f"{prefix}_win_rate", f"{prefix}_runs", 0.10, 5.0))
    return drop_helpers(df)


def half_furlong(c: str = "distance_furlongs") -> Column:
    return F.bround(F.col(c) * 2, 0) / 2


def add_course_distance_features(df: DataFrame, skew=None) -> DataFrame:
    """The record over this course and distance; earlier course wins."""
    df = df.withColumn("_half", half_furlong())
    df = record(df, ["entrant_id", "track", "_half"], "entrant_cd", skew)
    df = record(df, ["entrant_id", "track"], "_course", skew)
    return drop_helpers(df.select(
        "*",
        flag(F.col("_entrant_cd_wins") > 0).alias("entrant_cd_winner"),
        rate("_entrant_cd_wins", "entrant_cd_runs").alias("entrant_cd_win_rate"),
        flag(F.col("__course_wins") > 0).alias("entrant_course_winner"),
    ))


def add_class_change_features(df: DataFrame, skew=None) -> DataFrame:
    """Step in class and in official rating since the last run."""
    number = class_number("race_class", 0)
    df = entrant_history(df, {"_pc": Shift(number), "_por": Shift(F.col("official_rating"))}, skew)
    change = F.coalesce(number - F.col("_pc"), F.lit(0))
    return drop_helpers(df.select(
        "*", change.alias("class_change"), flag(change > 0).alias("class_dropped"),
        flag(change < 0).alias("class_raised"),
        F.coalesce(F.col("official_rating") - F.col("_por"), F.lit(0.0)).alias("or_change")))


def distance_category(c: str = "distance_furlongs") -> Column:
    return F.coalesce(cut(c, [0, 6.5, 8.5, 11.5, 50], [0, 1, 2, 3], include_lowest=True), F.lit(1))


def add_distance_change_features(df: DataFrame, skew=None) -> DataFrame:
    """Change of trip; record in the distance category, also by surface."""
    df = df.withColumn("dist_category", distance_category())
    df = entrant_history(df, {"_pd": Shift(F.col("distance_furlongs"))}, skew)
    df = record(df, ["entrant_id", "dist_category"], "entrant_dist_cat", skew)
    df = record(df, ["entrant_id", "surface", "dist_category"], "entrant_surface_dist_cat", skew)
    # Most wins so far in any one category, this row's own category included.
    df = entrant_history(df, {"_best": Running("max", F.col("_entrant_dist_cat_wins"), current=True)}, skew)
    step = F.coalesce(F.col("distance_furlongs") - F.col("_pd"), F.lit(0.0))
    df = df.select(
        "*",
        step.alias("distance_change"), flag(step > 0.5).alias("stepping_up"), flag(step < -0.5).alias("stepping_down"),
        rate("_entrant_dist_cat_wins", "entrant_dist_cat_runs").alias("entrant_dist_cat_wr"),
        rate("_entrant_surface_dist_cat_wins", "entrant_surface_dist_cat_runs").alias("entrant_surface_dist_cat_wr"),
        flag((F.col("_entrant_dist_cat_wins") == F.col("_best")) & (F.col("_best") > 0)).alias("at_preferred_dist"),
    )
    df = df.select(
        "*",
        shrink("entrant_dist_cat_wr", "entrant_dist_cat_runs", 0.10, 5.0).alias("entrant_dist_cat_wr_shrunk"),
        shrink("entrant_surface_dist_cat_wr", "entrant_surface_dist_cat_runs", 0.10, 8.0)
        .alias("entrant_surface_dist_cat_wr_shrunk"))
    if "entrant_win_rate_shrunk" in df.columns:
        overall = F.col("entrant_win_rate_shrunk")
        df = df.select(
            "*", (F.col("entrant_dist_cat_wr_shrunk") - overall).alias("entrant_dist_cat_specialist_edge"),
            (F.col("entrant_surface_dist_cat_wr_shrunk") - overall).alias("entrant_surface_dist_cat_edge"))
    return drop_helpers(df)


def add_headgear_features(df: DataFrame, skew=None) -> DataFrame:
    """Headgear worn, worn for the first time, left off."""
    text = F.lower(F.trim(F.coalesce("headgear", F.lit(""))))
    df = df.withColumn("has_headgear", (~text.isin("", "none", "0", "nan")).cast("int"))
    df = entrant_history(df, {"_prev": Shift(F.col("has_headgear")),
                            "_ever": Running("sum", F.col("has_headgear"))}, skew)
    worn = F.col("has_headgear")
    return drop_helpers(df.select(
        "*", flag((worn == 1) & (F.coalesce("_ever", F.lit(0)) == 0)).alias("first_time_headgear"),
        flag((worn == 0) & (F.col("_prev") == 1)).alias("headgear_off")))


def add_surface_features(df: DataFrame, skew=None) -> DataFrame:
    """Record on this surface, alone and with the race type; switches."""
    df = record(df, ["entrant_id", "surface"], "entrant_surface", skew)
    df = record(df, ["entrant_id", "surface", "race_type"], "entrant_surface_rt", skew)
    df = entrant_history(df, {"_ps": Shift(F.col("surface"))}, skew)
    df = df.select(
        "*",
        rate("_entrant_surface_wins", "entrant_surface_runs").alias("entrant_surface_win_rate"),
        rate("_entrant_surface_rt_wins", "entrant_surface_rt_runs").alias("entrant_surface_rt_wr"),
        flag(F.col("entrant_surface_runs") == 0).alias("first_time_surface"),
        flag(F.col("surface") != F.col("_ps")).alias("surface_switch"))
    df = df.select(
        "*", shrink("entrant_surface_win_rate", "entrant_surface_runs", 0.10, 6.0).alias("entrant_surface_wr_shrunk"),
        shrink("entrant_surface_rt_wr", "entrant_surface_rt_runs", 0.10, 8.0).alias("entrant_surface_rt_wr_shrunk"))
    if "entrant_win_rate_shrunk" in df.columns:
        overall = F.col("entrant_win_rate_shrunk")
        df = df.select(
            "*", (F.col("entrant_surface_wr_shrunk") - overall).alias("entrant_surface_specialist_edge"),
            (F.col("entrant_surface_rt_wr_shrunk") - overall).alias("entrant_surface_rt_edge"))
    return drop_helpers(df)


def add_jockey_intent_features(df: DataFrame, skew=None) -> DataFrame:
    """Jockey changes, beaten favourites, equipment worn for the first time."""
    has_elo, has_fav = "jockey_elo" in df.columns, "is_favourite" in df.columns
    specs = {"_pj": Shift(F.col("jockey"))}
    if has_elo:
        specs["_pe"] = Shift(F.col("jockey_elo"))
    if has_fav:
        specs |= {"_pf": Shift(F.col("is_favourite")), "_pw": Shift(F.col("won"))}
    df = entrant_history(df, specs, skew)
    df = df.withColumn("jockey_switch", flag(F.col("jockey") != F.col("_pj")))
    if has_elo:
        df = df.withColumn("jockey_elo_change", F.coalesce(F.col("jockey_elo") - F.col("_pe"), F.lit(0.0)))
        df = df.withColumn("jockey_upgrade", flag((F.col("jockey_switch") == 1) & (F.col("jockey_elo_change") > 50)))
    if has_fav:
        df = df.withColumn("beaten_fav_last",
                           flag((F.col("_pf") == 1) & (F.coalesce(F.col("_pw"), F.lit(0)) == 0)))
    if "headgear" in df.columns:
        df = df.withColumn("_items", headgear_items("headgear"))
        items = F.col("_items")
        df = df.select(
            "*", flag(first_time(items, "b")).alias("blinkers_first_time"),
            flag(first_time(items, "t")).alias("tongue_strap_first_time"),
            flag(first_time(items, "p")).alias("cheekpieces_first_time"),
            flag(first_time(items, "v")).alias("visor_first_time"),
            any_first_time(items).alias("any_first_time_equip"), equipment_count(items).alias("equip_count"))
    if "weight_change" in df.columns:
        df = df.select("*", flag(F.col("weight_change") < 0).alias("weight_dropped"),
                       flag(F.col("weight_change") > 0).alias("weight_raised"))
    return drop_helpers(df)


def add_medical_features(df: DataFrame, skew=None) -> DataFrame:
    """First run since gelding."""
    gelding = flag(F.lower("sex") == "gelding")
    df = entrant_history(df, {"_pg": Shift(gelding), "_runs": Running("sum", F.col("rs"))}, skew)
    return drop_helpers(df.withColumn("first_time_gelded", flag(
        (gelding == 1) & (F.coalesce("_pg", F.lit(0)) == 0) & (F.coalesce("_runs", F.lit(0)) > 0))))


def add_prize_money_features(df: DataFrame, skew=None) -> DataFrame:
    """Purses contested so far and the step to today's."""
    prize = F.coalesce("prize_money", F.lit(0.0))
    df = entrant_history(df, {"_max": Running("max", prize), "_sum": Running("sum", prize),
                            "_runs": Running("sum", F.col("rs"))}, skew)
    runs = F.coalesce("_runs", F.lit(0))
    top = F.coalesce("_max", F.lit(0.0))
    mean = rate("_sum", runs)
    return drop_helpers(df.select(
        "*", top.alias("entrant_max_prize_contested"), mean.alias("entrant_avg_prize_contested"),
        (prize - mean).alias("prize_money_change_vs_avg"),
        flag((runs > 0) & (prize > top * 1.5)).alias("stepping_up_in_purse")))


def add_collateral_form_features(df: DataFrame, skew=None) -> DataFrame:
    """How the rivals of the last race fared next time out.

    A rival counts when its own next run is strictly before today.  Today is the
    runner's next run after that race, so inside the earlier race this is a
    running total over rivals ordered by the date of their next run: no pairs of
    runners are formed.  The totals then move one run forward with the entrant.
    """
    df = entrant_history(df, {"_next": Shift(F.unix_date("race_date"), -1),
                            "_nfp": Shift(F.col("finish_position"), -1)}, skew)
    per_day = df.where(F.col("_next").isNotNull()).groupBy("race_id", "_next").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("_nfp") == 1).cast("int")).alias("_w"),
        F.sum(F.col("_nfp").between(1, 3).cast("int")).alias("_p"))
    before = ordered(per_day, ["race_id"], ["_next"], {
        "_rn": Running("sum", F.col("_n")), "_rw": Running("sum", F.col("_w")),
        "_rp": Running("sum", F.col("_p"))}, skew).select("race_id", "_next", "_rn", "_rw", "_rp")
    df = df.join(before, ["race_id", "_next"], "left")
    df = entrant_history(df, {"_an": Shift(F.col("_rn")), "_aw": Shift(F.col("_rw")), "_ap": Shift(F.col("_rp"))}, skew)
    n = F.coalesce("_an", F.lit(0))
    df = df.select("*", n.alias("collateral_n_rivals"),
                   F.when(n > 0, F.col("_aw") / n).alias("collateral_next_win_rate"),
                   F.when(n > 0, F.col("_ap") / n).alias("collateral_next_place_rate"))
    df = with_totals(df, ["race_id"], {"_mean": F.avg("collateral_next_win_rate")}, skew)
    return drop_helpers(df.withColumn("collateral_next_win_rate_vs_field",
                                      F.col("collateral_next_win_rate") - F.col("_mean")))


def add_speed_figure_features(df: DataFrame, skew=None) -> DataFrame:
    """Beaten lengths per distance as a speed figure (lower is faster), with class context."""
    dist = F.coalesce(F.when(F.col("distance_furlongs") != 0, F.col("distance_furlongs")), F.lit(8.0))
    df = df.withColumn("_lpf", F.when(F.col("fp") >= 1, F.col("lengths_behind") / F.pow(dist, F.lit(0.6))))
    df = df.withColumn("_cls", class_number("race_class", 5))
    quality = clip(1.0 - (F.col("_cls") - 1) * 0.1, 0.4, 1.0)
    df = df.withColumn("_adj", F.col("_lpf") + (1.0 - quality) * 0.5)
    src = df
    df = with_totals(df, ["race_id"], {"_med": F.median("_lpf")}, skew)
    df = df.withColumn("_rel", F.col("_lpf") - F.col("_med"))
    df = with_class_history(df, src, skew)
    spread = F.coalesce(F.when(F.col("_class_std") != 0, F.col("_class_std")), F.lit(1.0))
    df = df.withColumn("_z", (F.col("_lpf") - F.col("_class_median")) / spread)
    df = entrant_history(df, {
        "speed_fig_avg_5": Rolling("mean", F.col("_lpf"), 5), "speed_fig_avg_10": Rolling("mean", F.col("_lpf"), 10),
        "speed_fig_best_5": Rolling("min", F.col("_lpf"), 5), "speed_fig_rel_avg_5": Rolling("mean", F.col("_rel"), 5),
        "speed_fig_adj_avg_5": Rolling("mean", F.col("_adj"), 5),
        "speed_fig_adj_best_5": Rolling("min", F.col("_adj"), 5),
        "speed_z_class_avg_5": Rolling("mean", F.col("_z"), 5),
        "speed_z_class_avg_10": Rolling("mean", F.col("_z"), 10),
        "speed_z_class_best_5": Rolling("min", F.col("_z"), 5)}, skew)
    return drop_helpers(df.select(
        "*", (F.col("speed_fig_avg_5") - F.col("speed_fig_avg_10")).alias("speed_fig_trend"),
        (F.col("speed_z_class_avg_5") - F.col("speed_z_class_avg_10")).alias("speed_z_class_trend")))


def with_class_history(df: DataFrame, source: DataFrame, skew=None) -> DataFrame:
    """Median and standard deviation of the class's figures on earlier days.

    A class holds a large share of all rows, so nothing is collected per class:
    the deviation comes from day-level sums, the median from rank leaves.
    """
    keys = ["_cls"]
    daily = source.groupBy(*keys, "race_date").agg(
        F.count("_lpf").alias("_n"), F.sum("_lpf").alias("_s"), F.sum(F.col("_lpf") * F.col("_lpf")).alias("_q"))
    past = ordered(daily, keys, ["race_date"], {
        "_pn": Running("sum", F.col("_n")), "_ps": Running("sum", F.col("_s")), "_pq": Running("sum", F.col("_q"))},
        skew).select(*keys, "race_date", "_pn", "_ps", "_pq")
    var = (F.col("_pq") - F.col("_ps") * F.col("_ps") / F.col("_pn")) / (F.col("_pn") - 1)
    past = past.select(*keys, "race_date", F.when(F.col("_pn") > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
                       .alias("_class_std"))
    medians = expanding_median(source, keys, "race_date", "_lpf").withColumnRenamed("median", "_class_median")
    return df.join(past, [*keys, "race_date"], "left").join(medians, [*keys, "race_date"], "left")


def add_supplementary_features(df: DataFrame, skew=None) -> DataFrame:
    """Consistency, class trajectory, campaign intensity, stable switch, season, field make-up."""
    fp = F.col("fp")
    number = class_number("race_class", 0)
    specs = {}
    for n in (5, 10):
        specs |= {f"_mx{n}": Rolling("max", fp, n), f"_mn{n}": Rolling("min", fp, n), f"_sd{n}": Rolling("std", fp, n)}
    specs |= {
        "_c3": Rolling("mean", number, 3), "_c10": Rolling("mean", number, 10),
        "_bc": Running("min", F.when((F.col("won") == 1) & (number > 0), number)),
        "_pt": Shift(F.col("trainer")), "_lbsd": Rolling("std", F.col("lengths_behind"), 5),
    }
    df = entrant_history(df, specs, skew)
    df = calendar_sums(df, ENTRANT, {"_starts": F.col("rs")}, [14, 30], skew)
    # Distance categories met so far: first sightings counted over the past.
    if "dist_category" in df.columns:
        df = entrant_history(df, {"_seen": Ordinal()}, skew, ["entrant_id", "dist_category"])
        df = entrant_history(df, {"entrant_n_dist_cats": Running("sum", flag(F.col("_seen") == 1), current=True)}, skew)
    best = F.coalesce("_bc", F.lit(7))
    month = F.month("race_date")
    cols = [
        F.coalesce(F.col("_mx10") - F.col("_mn10"), F.lit(0)).alias("entrant_pos_range_10"),
        F.coalesce("_sd10", F.lit(3.0)).alias("entrant_pos_stddev_10"),
        F.coalesce(F.col("_mx5") - F.col("_mn5"), F.lit(0)).alias("entrant_pos_range_5"),
        F.coalesce("_sd5", F.lit(3.0)).alias("entrant_pos_stddev_5"),
        F.coalesce(F.col("_c3") - F.col("_c10"), F.lit(0.0)).alias("entrant_class_trend"),
        best.alias("entrant_best_class_won"), (number - best).alias("class_vs_best_won"),
        F.col("_starts_14d").alias("races_in_last_14d"), F.col("_starts_30d").alias("races_in_last_30d"),
        flag(F.col("trainer") != F.col("_pt")).alias("trainer_switch"),
        F.coalesce("_lbsd", F.lit(3.0)).alias("entrant_lb_stddev_5"),
        F.sin(month * (2 * 3.141592653589793 / 12)).alias("month_sin"),
        F.cos(month * (2 * 3.141592653589793 / 12)).alias("month_cos"),
    ]
    if "entrant_place_rate_shrunk" in df.columns:
        cols.append((F.col("entrant_place_rate_shrunk") - F.col("entrant_win_rate_shrunk")).alias("entrant_unlucky_rate"))
    if "entrant_ewma_lb_3" in df.columns:
        cols.append(F.coalesce(F.col("entrant_ewma_lb_3") - F.col("entrant_ewma_lb_7"), F.lit(0.0)).alias("lb_trend"))
    if "odds_rank" in df.columns and "entrant_elo_rank" in df.columns:
        cols.append((F.col("entrant_elo_rank") - F.col("odds_rank")).alias("odds_vs_elo_rank"))
    df = df.select("*", *cols)
    if "entrant_wins" in df.columns:
        df = with_totals(df, ["race_id"], {
            "n_prev_winners_in_field": F.sum(flag(F.col("entrant_wins") > 0)),
            "_mr": F.median("entrant_prev_races")}, skew)
        df = df.withColumn("field_experience_gap", F.col("entrant_prev_races") - F.col("_mr"))
    return drop_helpers(df)


def add_opposition_strength_features(df: DataFrame, skew=None) -> DataFrame:
    """Mean rating of the other runners, today and over the entrant's past."""
    df = with_totals(df, ["race_id"], {"_s": F.sum("entrant_elo"), "_n": F.count("entrant_elo")}, skew)
    elo = F.col("entrant_elo")
    df = df.withColumn("opposition_elo", F.when(F.col("_n") > 1, (F.col("_s") - elo) / (F.col("_n") - 1)).otherwise(elo))
    df = df.withColumn("_gap", elo - F.col("opposition_elo"))
    df = entrant_history(df, {"field_avg_elo_5": Rolling("mean", F.col("opposition_elo"), 5),
                            "field_avg_elo_10": Rolling("mean", F.col("opposition_elo"), 10)}, skew)
    df = with_ewma(df, ENTRANT, ORDER, {"field_avg_elo_ewma": ("opposition_elo", 7),
                                      "elo_vs_field_ewma": ("_gap", 7)}, skew)
    return drop_helpers(df)
