"""Features that compare a runner with the rest of its race."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.features.entrant import drop_helpers, flag
from formbook.features.people import soft_ground
from formbook.functions.numeric import clip, cut, finite, rate
from formbook.plans.ladder import attach_race_ladder
from formbook.plans.skew import SkewProfile
from formbook.plans.within import with_ranks, with_totals

RACE = ["race_id"]


def add_market_features(df: DataFrame, skew: SkewProfile | None = None) -> DataFrame:
    """Implied probabilities, market rank, price against the field."""
    df = df.withColumn("implied_prob", 1.0 / F.col("odds"))
    df = with_totals(df, RACE, {"overround": F.sum("implied_prob"), "_mean": F.avg("odds")}, skew)
    df = with_ranks(df, RACE, {"odds_rank": ("min", "odds", False)}, skew=skew)
    return drop_helpers(df.select(
        "*", (F.col("implied_prob") / F.col("overround")).alias("norm_implied_prob"),
        flag(F.col("odds_rank") == 1).alias("is_favourite"), F.log1p("odds").alias("log_odds"),
        (F.col("odds") / F.col("_mean")).alias("odds_vs_field")))


def add_trainer_runner_intent_features(df: DataFrame, skew=None) -> DataFrame:
    """A stable's several runners in one race: pecking order and market share."""
    stable = ["race_id", "trainer"]
    elo = "entrant_elo" in df.columns
    df = df.withColumn("_imp", F.coalesce(1.0 / F.when(F.col("odds") != 0, F.col("odds")), F.lit(0.0)))
    totals = {"same_trainer_runners": F.count("trainer"), "_bo": F.max("official_rating"), "_mo": F.min("odds"),
              "_ti": F.sum("_imp")}
    ranks = {"trainer_runner_rank_by_or": ("min", "official_rating", True),
             "trainer_runner_rank_by_odds": ("min", "odds", False)}
    if elo:
        totals["_be"] = F.max("entrant_elo")
        ranks["trainer_runner_rank_by_elo"] = ("min", "entrant_elo", True)
    df = with_ranks(with_totals(df, stable, totals, skew), stable, ranks, skew=skew)
    several = F.col("same_trainer_runners") > 1

    def first(by: str) -> Column:
        return flag(several & (F.col(f"trainer_runner_rank_by_{by}") == 1))

    def gap(a: str, b: str) -> Column:
        return F.abs(F.col(f"trainer_runner_rank_by_{a}") - F.col(f"trainer_runner_rank_by_{b}"))

    cols = [
        flag(several).alias("trainer_has_multiple_runners"),
        first("or").alias("trainer_first_string_by_or"),
        (F.col("official_rating") - F.col("_bo")).alias("trainer_or_vs_best_stablemate"),
        first("odds").alias("trainer_first_string_by_odds"),
        (F.col("odds") - F.col("_mo")).alias("trainer_odds_vs_stablemate_best"),
        rate("_imp", "_ti").alias("trainer_stable_market_share"),
        (first("odds") * first("or")).alias("trainer_first_string_odds_or_agree"),
        gap("odds", "or").alias("trainer_string_disagreement_or_odds"),
    ]
    if elo:
        cols += [first("elo").alias("trainer_first_string_by_elo"),
                 (F.col("entrant_elo") - F.col("_be")).alias("trainer_elo_vs_best_stablemate"),
                 (first("odds") * first("elo")).alias("trainer_first_string_odds_elo_agree"),
                 gap("odds", "elo").alias("trainer_string_disagreement_elo_odds")]
    if "is_stable_jockey" in df.columns:
        cols.append((first("odds") * F.col("is_stable_jockey")).alias("trainer_first_string_stable_jockey"))
    return drop_helpers(df.select("*", *cols))


def jumps(race_type: str = "race_type") -> Column:
    return F.coalesce(F.col(race_type).isin("Hurdle", "Chase"), F.lit(False))


def add_race_context_features(df: DataFrame, skew=None) -> DataFrame:
    """Draw, age curve, base rates, weight, price spread."""
    dp, dist, n = F.col("draw_pct"), F.coalesce("distance_furlongs", F.lit(8.0)), F.coalesce("num_runners", F.lit(10))
    df = df.withColumn("draw_pct", F.col("draw") / F.col("num_runners"))
    df = df.withColumn("_third", cut(clip("draw_pct", 0.01, 0.99), [0, 0.33, 0.66, 1.0], ["low", "mid", "high"], True))
    df = attach_race_ladder(df, ["track", "_third"], {"_tn": F.lit(1), "_tw": F.col("won")}, skew=skew)
    df = with_totals(df, RACE, {
        "_mw": F.avg("weight_lbs"), "_ma": F.avg("age"), "_so": F.stddev_samp("odds"), "_mo": F.avg("odds"),
        "_top": F.max("official_rating")}, skew)
    df = with_ranks(df, RACE, {"weight_rank": ("min", "weight_lbs", True)}, skew=skew)
    sprint, big = (dist <= 7.0).cast("double"), (n >= 14).cast("double")
    draw = F.coalesce(dp, F.lit(0.5))
    age = F.coalesce(F.col("age").cast("double"), F.lit(4.0))
    nh = jumps().cast("double")
    from_peak = age - F.when(nh > 0.5, 8.0).otherwise(3.5)
    safe_n = F.greatest(n, F.lit(1))
    hcap = F.coalesce(F.col("handicap"), F.lit(0)) != 0
    places = F.when(n <= 4, n).when(n <= 7, 2).when(n <= 15, 3).when(hcap, 4).otherwise(3)
    cols = [
        rate("_tw", "_tn", 5).alias("track_draw_win_rate"),
        (draw * sprint * big).alias("draw_x_sprint_x_large"),
        (draw * (1.0 / F.greatest(dist, F.lit(4.0)))).alias("draw_x_inv_dist"),
        (draw * clip(n / 20.0, 0, 2)).alias("draw_x_field_size"),
        from_peak.alias("years_from_peak"), F.abs(from_peak).alias("years_from_peak_abs"),
        (from_peak * from_peak / 25.0).alias("age_decline_curve"), flag(from_peak > 0).alias("past_peak"),
        (age * nh).alias("age_x_nh"), flag((age <= 3) & (nh < 0.5)).alias("young_flat"),
        (F.col("weight_lbs") - F.col("_mw")).alias("weight_vs_field"),
        (F.col("age") - F.col("_ma")).alias("age_vs_field"),
        flag(n <= 8).alias("small_field"), flag(n >= 14).alias("large_field"),
        (1.0 / safe_n).alias("base_win_rate"), (places / safe_n).alias("base_place_rate"),
        F.log1p("prize_money").alias("prize_log"),
        (F.col("weight_lbs") / F.coalesce(F.when(F.col("distance_furlongs") != 0, F.col("distance_furlongs")),
                                          F.lit(8.0))).alias("weight_per_furlong"),
        (F.col("official_rating") * F.coalesce(F.col("handicap"), F.lit(0))).alias("or_x_handicap"),
        F.when(F.col("_mo") > 0, F.coalesce("_so", F.lit(0.0)) / F.col("_mo")).otherwise(0.0).alias("odds_cv"),
        (F.col("official_rating") - F.col("_top")).alias("or_vs_top"),
        flag(F.col("age") == 2).alias("age_2yo"), flag(F.col("age") == 3).alias("age_3yo"),
        flag(F.col("age").between(4, 5)).alias("age_4_5yo"), flag(F.col("age") >= 6).alias("age_6plus"),
    ]
    if "implied_prob" in df.columns:
        cols.append(F.log(F.greatest("implied_prob", F.lit(1e-4)) * safe_n).alias("implied_prob_vs_base"))
    if "track_draw_bias" in df.columns:
        cols.append((F.col("track_draw_bias") * sprint).alias("draw_bias_x_sprint"))
    return drop_helpers(df.select("*", *cols))


def add_field_quality_features(df: DataFrame, skew=None) -> DataFrame:
    """Strength and spread of the field by official rating and by Elo."""
    for col, name in (("official_rating", "or"), ("entrant_elo", "elo")):
        if col not in df.columns:
            continue
        df = with_ranks(df, RACE, {"_first": ("first", col, True), "_rank": ("min", col, True),
                                   "_pct": ("pct", col, False)}, tie="entrant_id", skew=skew)
        df = with_totals(df, RACE, {
            "_mean": F.avg(col), "_sd": F.stddev_samp(col), "_max": F.max(col), "_min": F.min(col),
            "_two": F.max(F.when(F.col("_first") == 2, F.col(col)))}, skew)
        second = F.coalesce("_two", "_max")
        cols = [F.col("_mean").alias(f"field_avg_{name}"), F.coalesce("_sd", F.lit(0.0)).alias(f"field_std_{name}"),
                (F.col("_max") - F.col("_min")).alias(f"field_{name}_range"),
                (F.col("_max") - second).alias(f"field_top2_{name}_gap"),
                (F.col(col) - second).alias(f"{name}_vs_second_top"),
                F.col("_rank").alias("or_rank_in_race") if name == "or" else F.col("_pct").alias("elo_pctile_in_race")]
        df = drop_helpers(df.select("*", *cols))
    return df


def weighted_score(parts: dict[str, float]) -> Column:
    """Weighted mean of the available components; null when none is available."""
    total = sum((F.coalesce(finite(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), abs(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)


# Weights of the speed-metric components of pace.
PACE_BASE = {"sm_entry_speed_avg_3_vs_field": 1.0, "sm_top_speed_avg_3_vs_field": 0.75,
             "sm_acceleration_avg_3_vs_field": -1.0}
PACE_FINISH = {"sm_fsp_avg_3_vs_field": 1.0}
PACE_TREND = {"sm_entry_speed_trend": 1.0, "sm_top_speed_trend": 0.5, "sm_acceleration_trend": -1.0}


def add_pace_style_features(df: DataFrame, skew=None) -> DataFrame:
    """Front-runners and closers from historical speed metrics, and the pace they imply."""
    have = set(df.columns)

    def score(parts):
        parts = {c: w for c, w in parts.items() if c in have}
        return weighted_score(parts) if parts else F.lit(None).cast("double")

    df = df.select("*", score(PACE_BASE).alias("pace_style_index"), score(PACE_FINISH).alias("pace_finish_bias"),
                   score(PACE_TREND).alias("pace_style_trend"))
    idx, bias = F.col("pace_style_index"), F.col("pace_finish_bias")
    df = with_totals(df, RACE, {"_m": F.avg(idx), "_s": F.stddev_samp(idx), "_hi": F.max(idx), "_lo": F.min(idx),
                                "_mb": F.avg(bias)}, skew)
    margin = 0.35 * F.coalesce("_s", F.lit(0.0))

    def at(x: Column) -> Column:
        # Summation order must not decide a tie with the threshold.
        return F.round(x, 9)

    df = df.select(
        "*", flag(idx.isNotNull()).alias("has_pace_style_history"), (idx - bias).alias("pace_style_balance"),
        (idx - F.col("_m")).alias("pace_style_vs_field"), (bias - F.col("_mb")).alias("pace_finish_bias_vs_field"),
        flag((at(idx) >= at(F.col("_m") + margin)) & (idx > 1e-9)).alias("pace_front_runner_flag"),
        flag((at(idx) <= at(F.col("_m") - margin)) & (bias > 1e-9)).alias("pace_closer_flag"))
    df = with_totals(df, RACE, {"_front": F.sum("pace_front_runner_flag"), "_close": F.sum("pace_closer_flag")}, skew)
    df = with_ranks(df, RACE, {"pace_rank": ("min", "pace_style_index", True)}, skew=skew)
    size = F.when(F.coalesce("num_runners", F.lit(1)) == 0, 1).otherwise(F.coalesce("num_runners", F.lit(1)))
    front, closer = F.col("pace_front_runner_flag"), F.col("pace_closer_flag")
    pressure, share = F.col("_front").cast("double"), F.col("_front") / size
    hot = flag(pressure >= 3)
    dist = F.coalesce("distance_furlongs", F.lit(8.0))
    return drop_helpers(df.select(
        "*", pressure.alias("field_pace_pressure"), share.alias("field_pace_pressure_share"),
        (F.col("_close") / size).alias("field_closer_share"), hot.alias("hot_pace_flag"),
        flag((front == 1) & (pressure == 1)).alias("lone_speed_flag"), hot.alias("is_pace_duel"),
        (front * pressure).alias("front_runner_vulnerability"), (closer * pressure).alias("closer_setup_intensity"),
        F.when(size > 1, (size - F.col("pace_rank")) / (size - 1)).otherwise(0.5).alias("pace_rank_pct"),
        (idx - F.col("_hi")).alias("pace_gap_to_leader"), (idx - F.col("_lo")).alias("pace_gap_to_slowest"),
        (clip(idx, 0, None) * share).alias("front_runner_pressure"),
        (clip(bias, 0, None) * share).alias("closer_pace_setup"),
        (idx * (dist <= 7.0).cast("double")).alias("pace_style_x_sprint"),
        (hot.cast("double") * dist).alias("is_pace_duel_x_distance")))


# Columns that mean nothing without starting stalls.
DRAW_COLUMNS = [
    "draw_pct", "draw_x_bias", "draw_x_sprint_x_large", "draw_x_inv_dist", "draw_x_field_size",
    "draw_bias_x_sprint", "track_draw_win_rate", "tight_track_x_draw", "track_draw_bias", "draw_pct_x_soft_turf",
    "draw_bias_x_soft_turf",
]


def apply_conditional_feature_masks(df: DataFrame, skew=None) -> DataFrame:
    """Null the draw-derived columns of jump races."""
    return df.select(*[F.when(~jumps(), F.col(c)).alias(c) if c in DRAW_COLUMNS else F.col(c) for c in df.columns])


def add_interaction_features(df: DataFrame, skew=None) -> DataFrame:
    """Products and differences of strong signals, for the columns that are present."""
    c = F.col
    elo = (c("entrant_elo") - 1500) / 400
    pace = 1.0 - clip("speed_fig_avg_5", 0, 2)
    intent = [x for x in ("class_dropped", "jockey_upgrade", "first_time_headgear") if x in df.columns]
    terms: dict[str, tuple[str, Column]] = {
        "fresh_x_dropped": ("days_log class_dropped", c("days_log") * c("class_dropped")),
        "going_wr_x_runs": ("entrant_going_win_rate entrant_going_runs",
                            c("entrant_going_win_rate") * F.log1p("entrant_going_runs")),
        "jockey_elo_x_fav": ("jockey_elo is_favourite", (c("jockey_elo") - 1500) * c("is_favourite")),
        "elo_x_class_drop": ("entrant_elo class_dropped", (c("entrant_elo") - 1500) * c("class_dropped")),
        "speed_x_dist_wr": ("speed_fig_avg_5 entrant_dist_win_rate", pace * c("entrant_dist_win_rate")),
        "or_vs_field_x_hcap": ("field_avg_or handicap", (c("official_rating") - c("field_avg_or")) * c("handicap")),
        "age_x_distance": ("age distance_furlongs", c("age") * c("distance_furlongs")),
        "age_x_soft_going": ("age going", c("age") * c("going").isin("Soft", "Heavy").cast("int")),
        "days_since_race_sq": ("days_since_last_race", c("days_since_last_race") * c("days_since_last_race") / 1000.0),
        "improving_flag": ("speed_fig_trend form_slope", flag((c("speed_fig_trend") < 0) & (c("form_slope") > 0))),
        "trainer_intent_score": (" ".join(intent), sum((c(x) for x in intent), F.lit(0))),
        "dist_x_class_change": ("distance_change class_change", c("distance_change") * c("class_change")),
        "jockey_up_x_dropped": ("jockey_upgrade class_dropped", c("jockey_upgrade") * c("class_dropped")),
        "close_x_speed": ("close_finish_rate speed_fig_avg_5", c("close_finish_rate") * pace),
        "mkt_x_win_rate": ("norm_implied_prob entrant_win_rate_shrunk",
                           c("norm_implied_prob") - c("entrant_win_rate_shrunk")),
        "logodds_x_elo": ("log_odds entrant_elo", c("log_odds") * elo),
        "odds_field_x_dropped": ("odds_vs_field class_dropped", c("odds_vs_field") * c("class_dropped")),
        "mkt_x_speed": ("norm_implied_prob speed_fig_avg_5", c("norm_implied_prob") - pace),
        "odds_field_x_jock_elo": ("odds_vs_field jockey_elo", c("odds_vs_field") * (c("jockey_elo") - 1500) / 400),
        "elo_x_recent_form": ("entrant_elo entrant_avg_pos_3", elo * (1.0 - clip("entrant_avg_pos_3", 1, 8) / 8.0)),
        "jockey_trainer_synergy": ("jockey_wr_14d trainer_wr_14d", c("jockey_wr_14d") * c("trainer_wr_14d")),
        "going_specialist_edge": ("entrant_going_win_rate entrant_win_rate_shrunk",
                                  c("entrant_going_win_rate") - c("entrant_win_rate_shrunk")),
        "form_slope_x_fresh": ("form_slope days_since_last_race",
                               c("form_slope") * flag(c("days_since_last_race") > 30)),
        "jockey_hot_x_experience": ("jockey_hot_vs_30d entrant_prev_races",
                                    c("jockey_hot_vs_30d") * F.log1p("entrant_prev_races")),
        "dist_x_going_specialist": ("entrant_dist_win_rate entrant_going_win_rate",
                                    c("entrant_dist_win_rate") * c("entrant_going_win_rate")),
    }
    for name, edge in (("elo_x_surface_edge", "entrant_surface_specialist_edge"),
                       ("elo_x_rt_edge", "entrant_rt_specialist_edge"),
                       ("elo_x_dist_cat_edge", "entrant_dist_cat_specialist_edge"),
                       ("elo_x_surface_rt_edge", "entrant_surface_rt_edge"),
                       ("elo_x_surface_dist_edge", "entrant_surface_dist_cat_edge")):
        terms[name] = (f"entrant_elo {edge}", elo * c(edge))
    have = set(df.columns)
    keep = [x for x in df.columns if x not in terms]
    return df.select(*keep, *[e.alias(n) for n, (need, e) in terms.items() if set(need.split()) <= have])
