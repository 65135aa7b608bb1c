"""Entrant feature stages, one query per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.catalog.history import HW, PRIOR, history_base
from formbook.catalog.registry import WITH_FLAGS, query, r6, r6_sql, runner_skew
from formbook.features import entrant as H

KEY = ["race_id", "entrant_id"]


def pick(df: DataFrame, ints: str = "", doubles: str = "", keys=KEY, digits: int = 6) -> DataFrame:
    """Project to comparable types: whole numbers as bigint, the rest rounded."""
    return df.select(*keys, *[F.col(c).cast("long").alias(c) for c in ints.split()],
                     *[r6(c, digits=digits) for c in doubles.split()])


def ints(**cols: str) -> str:
    return ", ".join(f"cast({e} as bigint) as {n}" for n, e in cols.items())


def dbls(digits: int = 6, **cols: str) -> str:
    return ", ".join(r6_sql(e, n, digits) for n, e in cols.items())


def rate_sql(w: str, n: str, minimum: int = 0) -> str:
    return f"(case when {n} > {minimum} then cast({w} as double) / {n} else 0 end)"


def shrink_sql(w: str, n: str, prior: float, m: float) -> str:
    return f"(({n} * {rate_sql(w, n)} + cast({prior} as double) * {m}) / ({n} + cast({m} as double)))"


def prior_sum(expr: str, part: str = "entrant_id") -> str:
    return (f"coalesce(sum({expr}) over (partition by {part} order by race_date, race_id "
            "rows between unbounded preceding and 1 preceding), 0)")


def roll(agg: str, expr: str, n: int) -> str:
    return f"{agg}({expr}) over ({HW} rows between {n} preceding and 1 preceding)"


def last_of(expr: str) -> str:
    return (f"last_value({expr} ignore nulls) over ({HW} rows between unbounded preceding and 1 preceding)")


LAG = f"over ({HW})"

_RUNS = prior_sum("rs")
_CAREER_SQL = f"""{WITH_FLAGS}, w as (
  select *, {_RUNS} as n, {prior_sum('finished')} as nf_, {prior_sum('won')} as w, {prior_sum('placed')} as p,
    {prior_sum('nonfin')} as x, {prior_sum('fp')} as ps, lag(nonfin) {LAG} as lnf, lag(race_date) {LAG} as ld,
    row_number() over ({HW}) as rn, case when fp >= 1 then lengths_behind end as lb,
    case when official_rating > 0 then official_rating end as ro
  from r),
v as (
  select *, {last_of('case when won = 1 then rn end')} as wrn, {last_of('case when won = 1 then race_date end')} as wd,
    {last_of('case when won = 1 then ro end')} as wor, {last_of('case when fp between 1 and 3 then ro end')} as por,
    max(ro) over {PRIOR} as hor, lag(weight_lbs) {LAG} as lw,
    {prior_sum('rs', 'entrant_id, race_type')} as rtn, {prior_sum('won', 'entrant_id, race_type')} as rtw,
    coalesce(race_date - ld, 60) as idle,
    coalesce({roll('avg', 'fp', 10)}, 0) - coalesce({roll('avg', 'fp', 3)}, 0) as slope
  from w)
select race_id, entrant_id,
  {ints(entrant_prev_races='n', entrant_prev_finishes='nf_', entrant_wins='w', entrant_places='p',
        entrant_last_run_non_finish='coalesce(lnf, 0)', days_since_last_race='idle',
        days_bucket_fresh='idle <= 14', days_bucket_normal='idle between 15 and 28', days_bucket_break='idle > 60',
        is_maiden='w = 0', runs_since_last_win='rn - 1 - coalesce(wrn, 0)',
        days_since_last_win='coalesce(race_date - wd, 365)',
        below_last_win_mark='coalesce(ro - wor, 0) < 0', above_career_high_or='coalesce(ro - hor, 0) > 0',
        is_big_weight_drop='coalesce(weight_lbs - lw, 0) < -3', entrant_rt_runs='rtn')},
  {dbls(entrant_win_rate=rate_sql('w', 'n'), entrant_win_rate_shrunk=shrink_sql('w', 'n', .1, 8),
        entrant_place_rate_shrunk=shrink_sql('p', 'n', .3, 8), entrant_non_finish_rate_shrunk=shrink_sql('x', 'n', .05, 10),
        entrant_avg_position='case when nf_ > 0 then cast(ps as double) / nf_ else num_runners / 2.0 end',
        entrant_pos_consistency=f"coalesce({roll('stddev_samp', 'fp', 5)}, 3.0)",
        entrant_win_pct_last3=f"coalesce({roll('avg', 'won', 3)}, 0)",
        entrant_non_finish_rate_5=f"coalesce({roll('avg', 'nonfin', 5)}, 0)",
        entrant_avg_lb_behind=f"coalesce({roll('avg', 'lb', 5)}, 3.0)",
        close_finish_rate=f"coalesce({roll('avg', 'case when lb <= 2.0 then 1.0 when lb > 2.0 then 0.0 end', 5)}, 0)",
        days_log='ln(1 + idle)', weight_change='coalesce(weight_lbs - lw, 0)', form_slope='slope',
        age_x_form_slope='case when age <= 3 then slope else 0 end', age_x_prev_races='age * ln(1 + n)',
        or_vs_last_win_mark='coalesce(ro - wor, 0)', or_vs_last_place_mark='coalesce(ro - por, 0)',
        or_vs_career_high_prev='coalesce(ro - hor, 0)',
        entrant_rt_specialist_edge=f"{shrink_sql('rtw', 'rtn', .1, 6)} - {shrink_sql('w', 'n', .1, 8)}")}
from v"""


@query("entrant_career", "E1 W1 W3 W5 W8 W10 W11 P38 P39", _CAREER_SQL)
def _(spark, sf):
    df = H.add_entrant_features(history_base(spark, sf), runner_skew(spark, sf))
    return pick(df, "entrant_prev_races entrant_prev_finishes entrant_wins entrant_places entrant_last_run_non_finish "
                    "days_since_last_race days_bucket_fresh days_bucket_normal days_bucket_break is_maiden "
                    "runs_since_last_win days_since_last_win below_last_win_mark above_career_high_or "
                    "is_big_weight_drop entrant_rt_runs",
                "entrant_win_rate entrant_win_rate_shrunk entrant_place_rate_shrunk entrant_non_finish_rate_shrunk "
                "entrant_avg_position entrant_pos_consistency entrant_win_pct_last3 entrant_non_finish_rate_5 "
                "entrant_avg_lb_behind close_finish_rate days_log weight_change form_slope age_x_form_slope "
                "age_x_prev_races or_vs_last_win_mark or_vs_last_place_mark or_vs_career_high_prev "
                "entrant_rt_specialist_edge")


@query("entrant_venue_distance_going_record", "E5", f"""{WITH_FLAGS}, w as (select *,
  {prior_sum('rs', 'entrant_id, track')} as tn, {prior_sum('won', 'entrant_id, track')} as tw,
  {prior_sum('rs', 'entrant_id, distance_furlongs')} as dn, {prior_sum('won', 'entrant_id, distance_furlongs')} as dw,
  {prior_sum('rs', 'entrant_id, going')} as gn, {prior_sum('won', 'entrant_id, going')} as gw from r)
select race_id, entrant_id, {ints(entrant_track_runs='tn', entrant_dist_runs='dn', entrant_going_runs='gn')},
  {dbls(entrant_track_win_rate=rate_sql('tw', 'tn'), entrant_track_wr_shrunk=shrink_sql('tw', 'tn', .1, 5),
        entrant_dist_wr_shrunk=shrink_sql('dw', 'dn', .1, 5), entrant_going_wr_shrunk=shrink_sql('gw', 'gn', .1, 5))}
from w""")
def _(spark, sf):
    df = H.add_track_features(history_base(spark, sf), runner_skew(spark, sf))
    return pick(df, "entrant_track_runs entrant_dist_runs entrant_going_runs",
                "entrant_track_win_rate entrant_track_wr_shrunk entrant_dist_wr_shrunk entrant_going_wr_shrunk")


@query("course_and_distance", "E8", f"""{WITH_FLAGS}, h as (select *, distance_furlongs * 2 / 2 as half from r),
w as (select *, {prior_sum('rs', 'entrant_id, track, half')} as n, {prior_sum('won', 'entrant_id, track, half')} as w,
  {prior_sum('won', 'entrant_id, track')} as cw from h)
select race_id, entrant_id, {ints(entrant_cd_runs='n', entrant_cd_winner='w > 0', entrant_course_winner='cw > 0')},
  {dbls(entrant_cd_win_rate=rate_sql('w', 'n'))} from w""")
def _(spark, sf):
    df = H.add_course_distance_features(history_base(spark, sf), runner_skew(spark, sf))
    return pick(df, "entrant_cd_runs entrant_cd_winner entrant_course_winner", "entrant_cd_win_rate")


_CLS = "cast(regexp_extract(race_class, '(\\d+)', 1) as integer)"


@query("class_change", "E7 P31 W8", f"""{WITH_FLAGS}, c as (select *, {_CLS} as cls from r),
w as (select *, coalesce(cls - lag(cls) {LAG}, 0) as d,
  coalesce(official_rating - lag(official_rating) {LAG}, 0) as o from c)
select race_id, entrant_id, {ints(class_change='d', class_dropped='d > 0', class_raised='d < 0')},
  {dbls(or_change='o')} from w""")
def _(spark, sf):
    df = H.add_class_change_features(history_base(spark, sf), runner_skew(spark, sf))
    return pick(df, "class_change class_dropped class_raised", "or_change")


_DC = ("(case when distance_furlongs <= 6.5 then 0 when distance_furlongs <= 8.5 then 1 "
       "when distance_furlongs <= 11.5 then 2 else 3 end)")


@query("distance_change", "E9 P32 W12", f"""{WITH_FLAGS}, c as (select *, {_DC} as dc from r),
w as (select *, coalesce(distance_furlongs - lag(distance_furlongs) {LAG}, 0) as d,
  {prior_sum('rs', 'entrant_id, dc')} as n, {prior_sum('won', 'entrant_id, dc')} as w,
  {prior_sum('rs', 'entrant_id, surface, dc')} as sn, {prior_sum('won', 'entrant_id, surface, dc')} as sw from c),
v as (select *, max(w) over ({HW} rows between unbounded preceding and current row) as best from w)
select race_id, entrant_id, {ints(dist_category='dc', stepping_up='d > 0.5', stepping_down='d < -0.5',
  entrant_dist_cat_runs='n', entrant_surface_dist_cat_runs='sn', at_preferred_dist='w = best and best > 0')},
  {dbls(distance_change='d', entrant_dist_cat_wr_shrunk=shrink_sql('w', 'n', .1, 5),
        entrant_surface_dist_cat_wr_shrunk=shrink_sql('sw', 'sn', .1, 8))} from v""")
def _(spark, sf):
    df = H.add_distance_change_features(history_base(spark, sf), runner_skew(spark, sf))
    return pick(df, "dist_category stepping_up stepping_down entrant_dist_cat_runs entrant_surface_dist_cat_runs "
                    "at_preferred_dist", "distance_change entrant_dist_cat_wr_shrunk entrant_surface_dist_cat_wr_shrunk")


@query("headgear", "E10 E12 P30", f"""{WITH_FLAGS}, c as (select *, cast(gear <> '' as integer) as g from r),
w as (select *, coalesce(lag(g) {LAG}, 0) as pg, {prior_sum('g')} as ever, lag(jockey) {LAG} as pj from c)
select race_id, entrant_id, {ints(has_headgear='g', first_time_headgear='g = 1 and ever = 0',
  headgear_off='g = 0 and pg = 1', blinkers_first_time="gear = 'b1'", cheekpieces_first_time="gear = 't3p1'",
  tongue_strap_first_time='0', visor_first_time='0', any_first_time_equip="gear in ('b1', 't3p1')",
  equip_count="case gear when '' then 0 when 't3p1' then 2 else 1 end",
  jockey_switch='coalesce(jockey <> pj, false)')} from w""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = H.add_jockey_intent_features(H.add_headgear_features(history_base(spark, sf), skew), skew)
    return pick(df, "has_headgear first_time_headgear headgear_off blinkers_first_time cheekpieces_first_time "
                    "tongue_strap_first_time visor_first_time any_first_time_equip equip_count jockey_switch")


@query("surface_record", "E11", f"""{WITH_FLAGS}, w as (select *, {prior_sum('rs', 'entrant_id, surface')} as n,
  {prior_sum('won', 'entrant_id, surface')} as w, {prior_sum('rs', 'entrant_id, surface, race_type')} as rn_,
  {prior_sum('won', 'entrant_id, surface, race_type')} as rw, lag(surface) {LAG} as ps from r)
select race_id, entrant_id, {ints(entrant_surface_runs='n', first_time_surface='n = 0',
  surface_switch='coalesce(surface <> ps, false)', entrant_surface_rt_runs='rn_')},
  {dbls(entrant_surface_wr_shrunk=shrink_sql('w', 'n', .1, 6), entrant_surface_rt_wr_shrunk=shrink_sql('rw', 'rn_', .1, 8))}
from w""")
def _(spark, sf):
    df = H.add_surface_features(history_base(spark, sf), runner_skew(spark, sf))
    return pick(df, "entrant_surface_runs first_time_surface surface_switch entrant_surface_rt_runs",
                "entrant_surface_wr_shrunk entrant_surface_rt_wr_shrunk")


@query("gelding_and_prize", "E22 E23 W11", f"""{WITH_FLAGS}, w as (select *,
  cast(sex = 'Gelding' as integer) as g, {prior_sum('rs')} as n, max(prize_money) over {PRIOR} as mx,
  {prior_sum('prize_money')} as ps from r),
v as (select *, coalesce(lag(g) {LAG}, 0) as pg, coalesce(mx, 0) as top,
  case when n > 0 then ps / n else 0 end as av from w)
select race_id, entrant_id, {ints(first_time_gelded='g = 1 and pg = 0 and n > 0',
  stepping_up_in_purse='n > 0 and prize_money > top * 1.5')},
  {dbls(4, entrant_max_prize_contested='top', entrant_avg_prize_contested='av',
        prize_money_change_vs_avg='prize_money - av')} from v""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = H.add_prize_money_features(H.add_medical_features(history_base(spark, sf), skew), skew)
    return pick(df, "first_time_gelded stepping_up_in_purse",
                "entrant_max_prize_contested entrant_avg_prize_contested prize_money_change_vs_avg", digits=4)


@query("collateral_form", "E24 J7 W9", f"""{WITH_FLAGS}, n as (select *,
  lead(race_date) {LAG} as nd, lead(finish_position) {LAG} as nfp, lag(race_id) {LAG} as pr from r),
a as (select c.race_id, c.entrant_id, count(*) as k, avg(cast(v.nfp = 1 as integer)) as wr,
    avg(cast(v.nfp between 1 and 3 as integer)) as pl
  from n c join n v on v.race_id = c.pr and v.entrant_id <> c.entrant_id and v.nd < c.race_date group by 1, 2)
select race_id, entrant_id, {ints(collateral_n_rivals='coalesce(k, 0)')},
  {dbls(collateral_next_win_rate='wr', collateral_next_place_rate='pl',
        collateral_next_win_rate_vs_field='wr - avg(wr) over (partition by race_id)')}
from r left join a using (race_id, entrant_id)""")
def _(spark, sf):
    df = H.add_collateral_form_features(history_base(spark, sf), runner_skew(spark, sf))
    return pick(df, "collateral_n_rivals",
                "collateral_next_win_rate collateral_next_place_rate collateral_next_win_rate_vs_field")


_LPF = "lengths_behind / pow(distance_furlongs, 0.6)"
_DAYS_BEFORE = ("(partition by cls order by race_date range between unbounded preceding "
                "and interval 1 day preceding)")


@query("speed_figures", "E14 W13 A1", f"""{WITH_FLAGS}, c as (select *, {_CLS} as cls,
  case when fp >= 1 then {_LPF} end as lpf from r),
d as (select *, lpf + (1 - greatest(least(1 - (cls - 1) * 0.1, 1.0), 0.4)) * 0.5 as adj,
  lpf - median(lpf) over (partition by race_id) as rel,
  (lpf - median(lpf) over {_DAYS_BEFORE}) / coalesce(nullif(stddev_samp(lpf) over {_DAYS_BEFORE}, 0), 1.0) as z from c)
select race_id, entrant_id, {dbls(
  speed_fig_avg_5=roll('avg', 'lpf', 5), speed_fig_avg_10=roll('avg', 'lpf', 10),
  speed_fig_best_5=roll('min', 'lpf', 5), speed_fig_rel_avg_5=roll('avg', 'rel', 5),
  speed_fig_adj_avg_5=roll('avg', 'adj', 5), speed_fig_adj_best_5=roll('min', 'adj', 5),
  speed_z_class_avg_5=roll('avg', 'z', 5), speed_z_class_best_5=roll('min', 'z', 5),
  speed_fig_trend=roll('avg', 'lpf', 5) + ' - ' + roll('avg', 'lpf', 10))} from d""")
def _(spark, sf):
    df = H.add_speed_figure_features(history_base(spark, sf), runner_skew(spark, sf))
    return pick(df, "", "speed_fig_avg_5 speed_fig_avg_10 speed_fig_best_5 speed_fig_rel_avg_5 speed_fig_adj_avg_5 "
                        "speed_fig_adj_best_5 speed_z_class_avg_5 speed_z_class_best_5 speed_fig_trend")


_CAL = "(partition by entrant_id order by race_date range between interval {} day preceding and interval 1 day preceding)"


@query("campaign_and_consistency", "E32 W6 W8 W11 P34 P19", f"""{WITH_FLAGS}, c as (select *, {_CLS} as cls, {_DC} as dc
  from r),
w as (select *, lag(trainer) {LAG} as pt, min(case when won = 1 then cls end) over {PRIOR} as bc,
  row_number() over (partition by entrant_id, dc order by race_date, race_id) as seen from c)
select race_id, entrant_id, {ints(
  races_in_last_14d=f"coalesce(sum(rs) over {_CAL.format(14)}, 0)",
  races_in_last_30d=f"coalesce(sum(rs) over {_CAL.format(30)}, 0)",
  trainer_switch='coalesce(trainer <> pt, false)', entrant_best_class_won='coalesce(bc, 7)',
  class_vs_best_won='cls - coalesce(bc, 7)',
  entrant_pos_range_10=f"coalesce({roll('max', 'fp', 10)} - {roll('min', 'fp', 10)}, 0)",
  entrant_n_dist_cats=f"sum(case when seen = 1 then 1 else 0 end) over ({HW} rows unbounded preceding)")},
  {dbls(entrant_pos_stddev_10=f"coalesce({roll('stddev_samp', 'fp', 10)}, 3.0)",
        entrant_class_trend=f"coalesce({roll('avg', 'cls', 3)} - {roll('avg', 'cls', 10)}, 0)",
        entrant_lb_stddev_5=f"coalesce({roll('stddev_samp', 'lengths_behind', 5)}, 3.0)",
        month_sin='sin(month(race_date) * 2 * pi() / 12)', month_cos='cos(month(race_date) * 2 * pi() / 12)')}
from w""")
def _(spark, sf):
    df = history_base(spark, sf).withColumn("dist_category", H.distance_category())
    df = H.add_supplementary_features(df, runner_skew(spark, sf))
    return pick(df, "races_in_last_14d races_in_last_30d trainer_switch entrant_best_class_won class_vs_best_won "
                    "entrant_pos_range_10 entrant_n_dist_cats",
                "entrant_pos_stddev_10 entrant_class_trend entrant_lb_stddev_5 month_sin month_cos")
