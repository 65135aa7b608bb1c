"""Race-level, venue and race-relative stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.features_entrant import _CLS, _DC, KEY, dbls, ints, pick, prior_sum, rate_sql, roll, shrink_sql
from formbook.catalog.features_people import SEQ, races_sum
from formbook.catalog.history import history_base
from formbook.catalog.registry import WITH_FLAGS, WITH_RUNNERS, query, runner_skew, runner_table
from formbook.features import entrant as H
from formbook.features import race as R
from formbook.features import venue as V
from formbook.features.relative import add_race_relative_signal_features
from formbook.sources.dimensions import (
    VENUES_SQL, WEATHER_SQL, load_speed_metrics, load_venues, load_weather, speed_metrics_sql,
)

BY_RACE = "over (partition by race_id)"


@query("market", "E20 W14 W17 A1", f"""{WITH_RUNNERS}, w as (select *, 1.0 / odds as ip, sum(1.0 / odds) {BY_RACE} as ov,
  rank() over (partition by race_id order by odds) as rk, avg(odds) {BY_RACE} as mo from runners)
select race_id, entrant_id, {ints(odds_rank='rk', is_favourite='rk = 1')}, {dbls(implied_prob='ip',
  norm_implied_prob='ip / ov', overround='ov', log_odds='ln(1 + odds)', odds_vs_field='odds / mo')} from w""")
def _(spark, sf):
    df = R.add_market_features(runner_table(spark, sf), runner_skew(spark, sf))
    return pick(df, "odds_rank is_favourite", "implied_prob norm_implied_prob overround log_odds odds_vs_field")


_ST = "partition by race_id, trainer"


@query("stable_intent", "E25 W14", f"""{WITH_RUNNERS}, w as (select *, count(*) over ({_ST}) as k,
  rank() over ({_ST} order by official_rating desc) as ro, rank() over ({_ST} order by odds) as rd,
  max(official_rating) over ({_ST}) as bo, min(odds) over ({_ST}) as mo, sum(1 / odds) over ({_ST}) as ti from runners)
select race_id, entrant_id, {ints(same_trainer_runners='k', trainer_has_multiple_runners='k > 1',
  trainer_runner_rank_by_or='ro', trainer_runner_rank_by_odds='rd', trainer_first_string_by_or='k > 1 and ro = 1',
  trainer_first_string_by_odds='k > 1 and rd = 1', trainer_first_string_odds_or_agree='k > 1 and ro = 1 and rd = 1',
  trainer_string_disagreement_or_odds='abs(rd - ro)')},
  {dbls(trainer_or_vs_best_stablemate='official_rating - bo', trainer_odds_vs_stablemate_best='odds - mo',
        trainer_stable_market_share='1 / odds / ti')} from w""")
def _(spark, sf):
    df = R.add_trainer_runner_intent_features(runner_table(spark, sf), runner_skew(spark, sf))
    return pick(df, "same_trainer_runners trainer_has_multiple_runners trainer_runner_rank_by_or "
                    "trainer_runner_rank_by_odds trainer_first_string_by_or trainer_first_string_by_odds "
                    "trainer_first_string_odds_or_agree trainer_string_disagreement_or_odds",
                "trainer_or_vs_best_stablemate trainer_odds_vs_stablemate_best trainer_stable_market_share")


_THIRD = "case when dp <= 0.33 then 'low' when dp <= 0.66 then 'mid' else 'high' end"


@query("race_context", "E26 E31 F7 P32 A1 W2", f"""{WITH_FLAGS}, {SEQ},
d as (select *, least(greatest(cast(draw as double) / num_runners, 0.01), 0.99) as dp,
  cast(draw as double) / num_runners as pct, race_type in ('Hurdle', 'Chase') as nh from q),
e as (select *, {_THIRD} as third, age - case when nh then 8.0 else 3.5 end as fpk from d),
w as (select *, {races_sum('1', 'track, third')} as tn, {races_sum('won', 'track, third')} as tw,
  avg(weight_lbs) {BY_RACE} as mw, avg(age) {BY_RACE} as ma, stddev_samp(odds) {BY_RACE} as so, avg(odds) {BY_RACE} as mo,
  max(official_rating) {BY_RACE} as top, rank() over (partition by race_id order by weight_lbs desc) as wr from e)
select race_id, entrant_id, {ints(past_peak='fpk > 0', young_flat='age <= 3 and not nh', small_field='num_runners <= 8',
  weight_rank='wr', age_4_5yo='age between 4 and 5')},
  {dbls(draw_pct='case when not nh then pct end',
        track_draw_win_rate=f"case when not nh then {rate_sql('tw', 'tn', 5)} end",
        draw_x_inv_dist='case when not nh then pct / greatest(distance_furlongs, 4.0) end',
        draw_x_field_size='case when not nh then pct * least(num_runners / 20.0, 2.0) end',
        years_from_peak='fpk', age_decline_curve='fpk * fpk / 25.0', weight_vs_field='weight_lbs - mw',
        age_vs_field='age - ma', base_win_rate='1.0 / num_runners',
        base_place_rate='(case when num_runners <= 4 then num_runners when num_runners <= 7 then 2 else 3 end) '
                        '/ cast(num_runners as double)',
        prize_log='ln(1 + prize_money)', weight_per_furlong='weight_lbs / distance_furlongs',
        or_x_handicap='official_rating * handicap', odds_cv='coalesce(so, 0) / mo',
        or_vs_top='official_rating - top')} from w""")
def _(spark, sf):
    df = R.add_race_context_features(history_base(spark, sf), runner_skew(spark, sf))
    df = R.apply_conditional_feature_masks(df)
    return pick(df, "past_peak young_flat small_field weight_rank age_4_5yo",
                "draw_pct track_draw_win_rate draw_x_inv_dist draw_x_field_size years_from_peak age_decline_curve "
                "weight_vs_field age_vs_field base_win_rate base_place_rate prize_log weight_per_furlong "
                "or_x_handicap odds_cv or_vs_top")


@query("field_quality", "E27 W14 W15", f"""{WITH_RUNNERS}, w as (select *, avg(official_rating) {BY_RACE} as m,
  stddev_samp(official_rating) {BY_RACE} as s, max(official_rating) {BY_RACE} as hi, min(official_rating) {BY_RACE} as lo,
  rank() over (partition by race_id order by official_rating desc) as rk,
  nth_value(official_rating, 2) over (partition by race_id order by official_rating desc, entrant_id
    rows between unbounded preceding and unbounded following) as two from runners)
select race_id, entrant_id, {ints(or_rank_in_race='rk')}, {dbls(field_avg_or='m', field_std_or='coalesce(s, 0)',
  field_or_range='hi - lo', field_top2_or_gap='hi - coalesce(two, hi)',
  or_vs_second_top='official_rating - coalesce(two, hi)')} from w""")
def _(spark, sf):
    df = R.add_field_quality_features(runner_table(spark, sf), runner_skew(spark, sf))
    return pick(df, "or_rank_in_race", "field_avg_or field_std_or field_or_range field_top2_or_gap or_vs_second_top")


@query("venue_attributes", "E17 J4", f"""{WITH_RUNNERS}, {VENUES_SQL}, j as (select r.*, coalesce(direction, 'Right') as di,
  coalesce(shape, 'Galloping') as sh, coalesce(is_aw, 0) as aw, coalesce(circumference_f, 10.0) as ci,
  coalesce(uphill_finish, 0) as up, coalesce(downhill_section, 0) as dn, coalesce(draw_bias, 0) as db,
  cast(draw as double) / num_runners as dp, going in ('Soft', 'Heavy', 'Yielding') as soft
  from runners r left join venues on lower(track) = venue)
select race_id, entrant_id, {ints(track_direction="di = 'Right'",
  track_shape="case sh when 'Tight' then 1 when 'Sharp' then 2 when 'Undulating' then 3 else 0 end", track_is_aw='aw',
  track_uphill_finish='up', track_downhill='dn', track_draw_bias='db', track_shape_tight="sh = 'Tight'")},
  {dbls(track_circumference='ci', draw_x_bias='dp * db', uphill_x_weight='up * weight_lbs',
        draw_pct_x_soft_turf='case when soft and aw = 0 then dp else 0 end',
        tight_track_x_draw="case when sh in ('Tight', 'Sharp') then dp else 0 end")} from j""")
def _(spark, sf):
    df = V.add_track_config_features(runner_table(spark, sf), load_venues(spark, sf))
    return pick(df, "track_direction track_shape track_is_aw track_uphill_finish track_downhill track_draw_bias "
                    "track_shape_tight", "track_circumference draw_x_bias uphill_x_weight draw_pct_x_soft_turf "
                                         "tight_track_x_draw")


@query("weather", "E18 J5", f"""{WITH_RUNNERS}, {VENUES_SQL}, {WEATHER_SQL}, y as (select *, sum(precip_mm) over (
  partition by lat, lon order by date range between interval 3 day preceding and interval 1 day preceding) as p3
  from weather),
p as (select r.*, coalesce(lat, 52.0) as la, coalesce(lon, -1.5) as lo
  from runners r left join venues on lower(track) = venue),
j as (select p.*, coalesce(temp_max, 14.0) as tx, coalesce(temp_min, 7.0) as tn, coalesce(precip_mm, 1.5) as pr,
  coalesce(wind_kmh, 18.0) as wi, coalesce(p3, 4.5) as p3 from p left join y on la = lat and lo = lon and race_date = date)
select race_id, entrant_id, {ints(weather_is_wet='pr > 2', weather_heavy_rain_prev='p3 > 10', weather_cold='tx < 5')},
  {dbls(weather_precip_prev3='p3', weather_temp_range='tx - tn', weather_wind_x_dist='wi * distance_furlongs / 100')}
from j""")
def _(spark, sf):
    df = V.attach_weather(runner_table(spark, sf), load_venues(spark, sf), load_weather(spark, sf))
    return pick(V.add_weather_features(df), "weather_is_wet weather_heavy_rain_prev weather_cold",
                "weather_precip_prev3 weather_temp_range weather_wind_x_dist")


def _with_metrics(spark, sf):
    m = load_speed_metrics(runner_table(spark, sf))
    m = m.select("race_id", "entrant_id", *[F.col(c).alias(f"sm_{c}") for c in m.columns if c not in KEY])
    return history_base(spark, sf).join(m, KEY, "left")


_SM3 = {m: roll("avg", m, 3) for m in V.SPEED_METRICS}


@query("speed_metrics", "E15 J2", f"""{WITH_FLAGS}, {speed_metrics_sql()}, j as (
  select r.*, m.* exclude (race_id, entrant_id) from r left join metrics m using (race_id, entrant_id)),
w as (select *, {_SM3['top_speed']} as t3, {_SM3['fsp']} as f3, {_SM3['acceleration']} as a3,
  {roll('avg', 'top_speed', 5)} as t5, {roll('max', 'top_speed', 3)} as tb, {roll('min', 'acceleration', 3)} as ab from j)
select race_id, entrant_id, {dbls(sm_top_speed_avg_3='t3', sm_top_speed_best_3='tb', sm_top_speed_trend='t3 - t5',
  sm_acceleration_best_3='ab', sm_fsp_avg_3_vs_field=f'f3 - avg(f3) {BY_RACE}',
  sm_speed_score='((t3 - avg(t3) over ()) / stddev_samp(t3) over () + (f3 - avg(f3) over ()) '
                 '/ stddev_samp(f3) over ()) / 2')} from w""")
def _(spark, sf):
    df = V.add_speed_metric_features(_with_metrics(spark, sf), runner_skew(spark, sf))
    return pick(df, "", "sm_top_speed_avg_3 sm_top_speed_best_3 sm_top_speed_trend sm_acceleration_best_3 "
                        "sm_fsp_avg_3_vs_field sm_speed_score")


PACE_SQL = f"""{WITH_FLAGS}, {speed_metrics_sql()}, j as (
  select r.*, m.* exclude (race_id, entrant_id) from r left join metrics m using (race_id, entrant_id)),
a as (select *, {_SM3['entry_speed']} as e3, {_SM3['top_speed']} as t3, {_SM3['acceleration']} as a3,
  {_SM3['fsp']} as f3 from j),
b as (select *, e3 - avg(e3) {BY_RACE} as ev, t3 - avg(t3) {BY_RACE} as tv, a3 - avg(a3) {BY_RACE} as av,
  f3 - avg(f3) {BY_RACE} as bias from a),
c as (select *, case when ev is not null or tv is not null or av is not null then
   (coalesce(ev, 0) + 0.75 * coalesce(tv, 0) - coalesce(av, 0)) / (case when ev is not null then 1 else 0 end
   + case when tv is not null then 0.75 else 0 end + case when av is not null then 1 else 0 end) end as ix from b),
d as (select *, round(ix, 9) >= round(avg(ix) {BY_RACE} + 0.35 * coalesce(stddev_samp(ix) {BY_RACE}, 0), 9)
    and ix > 1e-9 as fr, round(ix, 9) <= round(avg(ix) {BY_RACE} - 0.35 * coalesce(stddev_samp(ix) {BY_RACE}, 0), 9)
    and bias > 1e-9 as cl from c),
f as (select *, sum(coalesce(cast(fr as integer), 0)) {BY_RACE} as nf_ from d)"""


@query("pace_style", "E16 E15 W14", f"""{PACE_SQL}
select race_id, entrant_id, {ints(field_pace_pressure='nf_', pace_front_runner_flag='coalesce(fr, false)',
  pace_closer_flag='coalesce(cl, false)', lone_speed_flag='coalesce(fr, false) and nf_ = 1', hot_pace_flag='nf_ >= 3')},
  {dbls(pace_style_index='ix', pace_finish_bias='bias', pace_gap_to_leader=f'ix - max(ix) {BY_RACE}',
        front_runner_pressure='case when ix > 0 then ix when ix <= 0 then 0 end * nf_ / num_runners')} from f""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = V.add_speed_metric_features(_with_metrics(spark, sf), skew)
    df = R.add_pace_style_features(df, skew)
    return pick(df, "field_pace_pressure pace_front_runner_flag pace_closer_flag lone_speed_flag hot_pace_flag",
                "pace_style_index pace_finish_bias pace_gap_to_leader front_runner_pressure")


def rel_sql(c: str, desc: bool) -> dict[str, str]:
    sign = "" if desc else "-1 * "
    gap = f"{sign}({c} - avg({c}) {BY_RACE})"
    rank = (f"(rank() over (partition by race_id order by {c} {'desc' if desc else 'asc'} nulls last) + "
            f"(count({c}) over (partition by race_id, {c}) - 1) / 2.0) / count({c}) {BY_RACE}")
    sd = f"coalesce(stddev_samp({c}) {BY_RACE}, 0)"
    return {"_vs_field": f"coalesce({gap}, 0)", "_z_in_race": f"case when {sd} > 1e-12 then {gap} / {sd} else 0 end",
            "_rank_pct_in_race": f"coalesce(case when {c} is not null then {rank} end, 0.5)",
            "_vs_best_in_race": f"coalesce({sign}({c} - {'max' if desc else 'min'}({c}) {BY_RACE}), 0)"}


_REL = {f"entrant_prev_races{k}": v for k, v in rel_sql("entrant_prev_races", True).items()}
_REL |= {f"entrant_avg_pos_3{k}": v for k, v in rel_sql("entrant_avg_pos_3", False).items()}
_OC = f"coalesce(stddev_samp(oc) {BY_RACE}, 0)"
_REL |= {
    "or_change_vs_field": f"oc - avg(oc) {BY_RACE}",
    "or_change_z_in_race": f"case when {_OC} > 1e-12 then (oc - avg(oc) {BY_RACE}) / {_OC} else 0 end",
    "or_change_abs_rank_pct_in_race":
        "(rank() over (partition by race_id order by abs(oc) desc) + (count(*) over (partition by race_id, abs(oc)) - 1)"
        f" / 2.0) / count(*) {BY_RACE}"}


@query("race_relative", "E33 W14 P35 A1", f"""{WITH_FLAGS}, w as (select *, {prior_sum('rs')} as entrant_prev_races,
  {roll('avg', 'fp', 3)} as entrant_avg_pos_3,
  coalesce(official_rating - lag(official_rating) over (partition by entrant_id order by race_date, race_id), 0) as oc from r)
select race_id, entrant_id, {dbls(**_REL)} from w""")
def _(spark, sf):
    from formbook.plans.ordered import Rolling, Running, ordered
    skew = runner_skew(spark, sf)
    df = ordered(history_base(spark, sf), ["entrant_id"], H.ORDER, {
        "entrant_prev_races": Running("sum", F.col("rs")), "entrant_avg_pos_3": Rolling("mean", F.col("fp"), 3)}, skew)
    df = df.fillna(0, ["entrant_prev_races"])
    df = H.add_class_change_features(df, skew)
    df = add_race_relative_signal_features(df, skew)
    return pick(df, "", " ".join(_REL))


@query("interactions", "E19", f"""{WITH_FLAGS}, c as (select *, {_CLS} as cls from r), w as (select *,
  cast(coalesce(cls - lag(cls) over (partition by entrant_id order by race_date, race_id), 0) > 0 as integer) as drp,
  {prior_sum('rs', 'entrant_id, going')} as gn, {prior_sum('won', 'entrant_id, going')} as gw,
  {prior_sum('won', 'entrant_id, distance_furlongs')} as dw, {prior_sum('rs', 'entrant_id, distance_furlongs')} as dn,
  avg(odds) {BY_RACE} as mo, avg(official_rating) {BY_RACE} as mr from c)
select race_id, entrant_id, {dbls(odds_field_x_dropped='odds / mo * drp', age_x_distance='age * distance_furlongs',
  going_wr_x_runs=f"{rate_sql('gw', 'gn')} * ln(1 + gn)", or_vs_field_x_hcap='(official_rating - mr) * handicap',
  dist_x_going_specialist=f"{rate_sql('dw', 'dn')} * {rate_sql('gw', 'gn')}", trainer_intent_score='drp')} from w""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = H.add_class_change_features(H.add_track_features(history_base(spark, sf), skew), skew)
    df = R.add_field_quality_features(R.add_market_features(df, skew), skew)
    return pick(R.add_interaction_features(df), "", "odds_field_x_dropped age_x_distance going_wr_x_runs "
                "or_vs_field_x_hcap dist_x_going_specialist trainer_intent_score")
