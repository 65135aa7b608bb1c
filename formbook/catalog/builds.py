"""The whole feature build, historical and live, with all side tables, ratings and speed medians.

The build has about a thousand columns.  The queries show single ones and, for each family of
features, one weighted sum of the columns below; the check SQL takes both from the check SQL of
the families' own queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog import features_entrant, features_people, features_race, ratings  # noqa: F401  (their check SQL)
from formbook.catalog.ratings import DIGITS
from formbook.catalog.registry import ORACLES, query, r6, r6_sql, runner_skew, runner_table
from formbook.features.build import engineer_features, live_features, strip_outcomes
from formbook.sources.dimensions import load_speed_metrics, load_venues, load_weather

FAMILIES = {
    "entrant_career": "entrant_prev_races entrant_wins days_since_last_race runs_since_last_win entrant_win_rate_shrunk form_slope weight_change",
    "entrant_venue_distance_going_record": "entrant_track_runs entrant_dist_runs entrant_going_runs entrant_track_wr_shrunk entrant_dist_wr_shrunk",
    "course_and_distance": "entrant_cd_runs entrant_cd_winner entrant_course_winner entrant_cd_win_rate",
    "class_change": "class_change class_dropped class_raised or_change",
    "distance_change": "stepping_up stepping_down entrant_dist_cat_runs at_preferred_dist distance_change entrant_dist_cat_wr_shrunk",
    "headgear": "has_headgear first_time_headgear headgear_off any_first_time_equip equip_count jockey_switch",
    "surface_record": "entrant_surface_runs first_time_surface surface_switch entrant_surface_wr_shrunk",
    "gelding_and_prize": "first_time_gelded stepping_up_in_purse entrant_max_prize_contested",
    "campaign_and_consistency": "races_in_last_30d trainer_switch class_vs_best_won entrant_pos_stddev_10 entrant_lb_stddev_5 month_sin",
    "jockey_record": "jockey_prev_rides jockey_wins_30d jockey_wins_20 jockey_avg_pos_10 jockey_win_rate_shrunk jockey_hot_vs_30d",
    "trainer_record": "trainer_prev_runs trainer_wins_20 trainer_win_rate_shrunk trainer_track_win_rate trainer_pr_30d_delta",
    "jockey_trainer_pairing": "jt_prev_runs jockey_track_runs is_stable_jockey jt_win_rate_shrunk jockey_track_win_rate",
    "entity_by_condition": "trainer_dist_cat_runs jockey_going_runs trainer_class_wr entrant_going_dist_wr",
    "pedigree": "sire_win_rate_shrunk dam_win_rate_shrunk sire_soft_edge damsire_stay_edge",
    "target_encoding": "entrant_te_norm_pos jockey_te_norm_pos_365d trainer_te_norm_pos going_te_norm_pos jockey_te_ewma",
    "market": "odds_rank is_favourite norm_implied_prob overround odds_vs_field",
    "stable_intent": "same_trainer_runners trainer_runner_rank_by_odds trainer_or_vs_best_stablemate trainer_stable_market_share",
    "race_context": "past_peak weight_rank age_decline_curve weight_vs_field draw_pct track_draw_win_rate or_vs_top odds_cv",
    "field_quality": "or_rank_in_race field_avg_or field_std_or or_vs_second_top",
    "venue_attributes": "track_is_aw track_uphill_finish track_shape_tight track_circumference uphill_x_weight",
    "weather": "weather_is_wet weather_precip_prev3 weather_temp_range weather_wind_x_dist",
    "speed_metrics": "sm_top_speed_avg_3 sm_top_speed_trend sm_acceleration_best_3 sm_speed_score",
    "pace_style": "field_pace_pressure lone_speed_flag pace_style_index pace_finish_bias pace_gap_to_leader",
    "race_relative": "entrant_prev_races_vs_field entrant_avg_pos_3_z_in_race entrant_avg_pos_3_vs_best_in_race or_change_z_in_race",
    "interactions": "odds_field_x_dropped age_x_distance going_wr_x_runs or_vs_field_x_hcap dist_x_going_specialist",
}
# Missing values are filled with the column's median.
SPEED = "speed_fig_avg_5 speed_fig_best_5 speed_fig_adj_avg_5 speed_fig_trend"
RATED = "entrant_glicko entrant_glicko_rd"
ELO = {"elo_entrant": "entrant_elo", "elo_margin": "entrant_margin_elo"}


def _shown(df):
    sums = []
    for part, columns in FAMILIES.items():
        terms = [(k + 1) * F.coalesce(r6(c), F.lit(-0.5)) for k, c in enumerate(columns.split())]
        sums.append(r6(sum(terms[1:], terms[0]), f"{part}_sum", DIGITS))
    return df.select("race_id", "entrant_id", *sums, *[r6(r6(c), c, DIGITS) for c in SPEED.split()],
                     r6(F.round("entrant_glicko", 6), "entrant_glicko", DIGITS), *[r6(c, digits=DIGITS) for c in ["entrant_glicko_rd", *ELO.values()]])


def _sql(where: str = "true") -> str:
    """The families' check SQL joined by runner."""
    cols, parts = [], []
    for part, columns in FAMILIES.items():
        terms = " + ".join(f"{k + 1} * coalesce({c}::double, -0.5)" for k, c in enumerate(columns.split()))
        cols.append(r6_sql(f"{part}_v", f"{part}_sum", DIGITS))
        parts.append(f"(select race_id, entrant_id, {terms} as {part}_v from ({ORACLES[part]}))")
    filled = ", ".join(f"coalesce({c}, median({c}) over ()) as {c}" for c in SPEED.split())
    parts.append(f"(select race_id, entrant_id, {filled} from ({ORACLES['speed_figures']}))")
    parts.append(f"(select race_id, entrant_id, {RATED.replace(' ', ', ')} from ({ORACLES['glicko_features']}))")
    parts += [f"(select race_id, entrant_id, rating as {c} from ({ORACLES[part]}))" for part, c in ELO.items()]
    cols += [r6_sql(c, c, DIGITS) for c in SPEED.split()] + [*RATED.split(), *ELO.values()]
    joined = f"{parts[0]} p0" + "".join(f" join {p} p{k + 1} using (race_id, entrant_id)" for k, p in enumerate(parts[1:]))
    return f"select race_id, entrant_id, {', '.join(cols)} from {joined} where {where}"


def _options(spark, sf):
    base = runner_table(spark, sf)
    m = load_speed_metrics(base)
    m = m.select("race_id", "entrant_id", *[F.col(c).alias(f"sm_{c}") for c in m.columns if c not in ("race_id", "entrant_id")])
    return {"skew": runner_skew(spark, sf), "venues": load_venues(spark, sf), "weather": load_weather(spark, sf), "speed_metrics": m}


@query("all_features", "E35 P36 H6", _sql())
def _(spark, sf):
    return _shown(engineer_features(runner_table(spark, sf), **_options(spark, sf)))


@query("live_card_features", "X1 F8 E35", _sql("""race_id in (select o_orderkey from orders where o_orderdate =
  (select max(o_orderdate) from orders where o_orderkey in (select l_orderkey from lineitem)))"""))
def _(spark, sf):
    """The last day's cards without their results, with the same side tables as the history."""
    df = runner_table(spark, sf)
    day = df.agg(F.max("race_date").alias("d"))  # one row
    marked = df.join(F.broadcast(day))
    history = marked.where("race_date < d").drop("d")
    cards = strip_outcomes(marked.where("race_date = d").drop("d"))
    return _shown(live_features(history, cards, **_options(spark, sf)))
