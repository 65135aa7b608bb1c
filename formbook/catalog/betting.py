"""Betting analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.features_entrant import KEY, dbls, ints, pick
from formbook.catalog.registry import WITH_RUNNERS, i64, query, r6, runner_skew, runner_table
from formbook.operators import betting as B
from formbook.operators import grid as G
from formbook.sources.predictions import PREDICTIONS_SQL, with_predictions

WITH_PREDS = f"{WITH_RUNNERS}, {PREDICTIONS_SQL.strip()}"
BY_RACE = "over (partition by race_id)"


def predictions(spark, sf):
    return with_predictions(runner_table(spark, sf), runner_skew(spark, sf))


DEMAND = "0.05 * sqrt(greatest(odds, 1.0) / 3.0)"


@query("value_bets", "B1 F5 P40 P29", f"""{WITH_PREDS}, v as (select *, model_prob - 1.0 / odds as edge from preds)
select race_id, entrant_id, {dbls(value_edge='edge', value_demand=DEMAND, value_clv='model_prob * odds',
  stake_share='greatest(0, ((odds - 1) * model_prob - (1 - model_prob)) / (odds - 1)) * 0.25')},
  case when odds - 1 < 0.585 then '1/2' when odds - 1 < 0.735 then '4/6' when odds - 1 < 0.9 then '4/5'
   when odds - 1 <= 1.25 then 'EVS' when odds - 1 <= 1.75 then '6/4' when odds - 1 <= 2.25 then '2/1'
   when odds - 1 <= 2.75 then '5/2' when odds - 1 <= 3.5 then '3/1' when odds - 1 <= 4.5 then '4/1'
   when odds - 1 <= 5.5 then '5/1' when odds - 1 <= 7 then '6/1' when odds - 1 <= 9 then '8/1'
   when odds - 1 <= 11 then '10/1' when odds - 1 <= 13 then '12/1' when odds - 1 <= 15 then '14/1'
   when odds - 1 <= 18 then '16/1' when odds - 1 <= 22.5 then '20/1' else '25/1' end as shown
from v where edge > {DEMAND}""")
def _(spark, sf):
    from formbook.functions.numeric import display_odds, kelly
    df = B.with_value_edges(predictions(spark, sf), 0.05).where("is_value_bet")
    df = df.withColumn("stake_share", kelly("model_prob", "odds", 0.25))
    return df.select(*KEY, *[r6(c) for c in ("value_edge", "value_demand", "value_clv", "stake_share")],
                     display_odds(F.round("odds", 1)).alias("shown"))


_TERMS = """terms as (select *, num_runners > 4 as elig,
  case when num_runners <= 4 then 0 when num_runners <= 7 then 2 when num_runners <= 15 then 3
    when handicap = 1 then 4 else 3 end as paid,
  cast(case when num_runners <= 4 then 0.0 when num_runners <= 7 then 0.25
    when num_runners >= 12 and handicap = 1 then 0.25 else 0.20 end as double) as frac from preds)"""


def newton_sql(src: str, steps: int = B.NEWTON_STEPS) -> str:
    """The place adjustment as a chain of common table expressions, ending in ``adj``."""
    def sig(d):
        return f"1.0 / (1.0 + exp(-least(greatest(z + {d}, -60), 60)))"

    out = [f"""z0 as (select *, ln(least(greatest(place_prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(place_prob, 1e-6),
  1 - 1e-6))) as z_, count(*) {BY_RACE} as nn, sum(place_prob) {BY_RACE} as tot from {src})""",
           f"""z1 as (select * exclude (z_), zm + least(greatest(1 - 2 * greatest(cast(paid as double) / nn - 0.25, 0), 0.5), 1)
  * (z_ - zm) as z, ln(least(greatest(cast(paid as double) / nn, 1e-6), 1 - 1e-6) / (1 - least(greatest(
  cast(paid as double) / nn, 1e-6), 1 - 1e-6))) - zm as d from (select *, avg(z_) {BY_RACE} as zm from z0))"""]
    for i in range(steps):
        s = sig("d")
        out.append(f"""s{i} as (select * exclude (d, p_), case when abs(sum(p_) {BY_RACE} - paid) >= 1e-8
  and sum(p_ * (1 - p_)) {BY_RACE} >= 1e-12 then d - (sum(p_) {BY_RACE} - paid) / sum(p_ * (1 - p_)) {BY_RACE} else d end as d
  from (select *, {s} as p_ from {'z1' if i == 0 else f's{i - 1}'}))""")
    out.append(f"""adj as (select *, case when paid <= 0 then 0.0 else least(greatest(greatest(case when paid >= nn then 1.0
  when tot < 1e-8 then cast(paid as double) / nn else {sig('d')} end, model_prob), 0), 1) end as pp from s{steps - 1})""")
    return ",\n".join(out)


@query("place_probability_adjustment", "M23 M24 D2", f"""{WITH_PREDS}, {_TERMS}, {newton_sql('terms')},
f as (select *, case when nn >= 8 then 3 when nn >= 5 then 2 else 0 end as k from adj),
g as (select *, case when k > 0 then greatest(1 - pow(1 - model_prob, cast(nn as double) / k), model_prob) end as fb from f)
select race_id, entrant_id, {dbls(place_prob_adj='pp', place_prob_fallback=
  f'case when sum(fb) {BY_RACE} > 0 then least(greatest(fb * (k / sum(fb) {BY_RACE}), 0), 1) else 0 end')} from g""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = B.adjust_place_probs(B.with_ew_terms(predictions(spark, sf)), skew=skew)
    return pick(B.fallback_place_probs(df, skew=skew), "", "place_prob_adj place_prob_fallback")


def ew_sql(pp: str) -> str:
    return f"""ew as (select *, elig and odds > 1 as live, 1 + (odds - 1) * frac as po, {pp} as pp_ from adj_),
ev as (select *, case when live then po else 0 end as place_odds, case when live then pp_ - 1 / po else 0 end as place_edge,
  case when live then pp_ * po - 1 else 0 end as place_ev,
  case when live then (model_prob * odds - 1 + pp_ * po - 1) / 2 else 0 end as ew_ev,
  greatest(0, ((odds - 1) * model_prob - (1 - model_prob)) / (odds - 1)) as kw,
  case when po > 1 then greatest(0, ((po - 1) * pp_ - (1 - pp_)) / (po - 1)) else 0 end as kp from ew)"""


@query("each_way_columns", "B3 B4 B6 B7", f"""{WITH_PREDS}, {_TERMS}, adj_ as (select * from terms), {ew_sql('place_prob')}
select race_id, entrant_id, {ints(ew_eligible='elig', ew_places='paid', ew_value='live and ew_ev > 0',
  place_value='live and place_ev > 0')},
  {dbls(ew_fraction='frac', place_odds='place_odds', place_edge='place_edge', place_ev='place_ev', ew_ev='ew_ev',
        ew_kelly='case when not live then 0 when kw <= 0 or kp <= 0 then greatest(kw, kp) * 0.5 * 0.25 '
                 'else (least(kw, kp) + 0.5 * abs(kw - kp)) * 0.25 end')} from ev""")
def _(spark, sf):
    df = B.with_ew_columns(predictions(spark, sf), skew=runner_skew(spark, sf))
    return pick(df, "ew_eligible ew_places ew_value place_value",
                "ew_fraction place_odds place_edge place_ev ew_ev ew_kelly")


_EW_OK = f"elig and odds between 4 and 51 and place_edge > {DEMAND} and place_ev > 0"
_BETS = f"""{WITH_PREDS}, {_TERMS}, {newton_sql('terms')}, adj_ as (select * from adj), {ew_sql('pp')},
sel as (select *, row_number() over (partition by race_id order by model_prob desc, entrant_id) as rk,
  max(model_prob) {BY_RACE} > min(model_prob) {BY_RACE} as told,
  cast(finish_position > 0 and finish_position <= paid as integer) as pl from ev),
bets as (
  select race_date, race_id, track, 'top_pick' as strategy, entrant_id, model_prob, odds, won, cast(null as integer) as placed,
    1.0 as stake, case when won = 1 then odds - 1 else -1.0 end as pnl, model_prob * odds as clv
  from sel where rk = 1 and told
  union all
  select race_date, race_id, track, 'value', entrant_id, model_prob, odds, won, null, 1.0,
    case when won = 1 then odds - 1 else -1.0 end, model_prob * odds from sel where model_prob - 1 / odds > {DEMAND}
  union all
  select race_date, race_id, track, 'each_way', entrant_id, model_prob, odds, won, greatest(pl, won), 2.0,
    case when won = 1 then odds + place_odds when pl = 1 then place_odds else 0 end - 2.0, model_prob * odds
  from sel where {_EW_OK})"""


def bets(spark, sf):
    return B.bet_table(predictions(spark, sf), 0.05, skew=runner_skew(spark, sf))


@query("bet_table", "B9 B2 B5 B8 F6 W16", f"""{_BETS} select race_date, race_id, strategy, entrant_id,
  {ints(won='won', placed='placed')}, {dbls(stake='stake', pnl='pnl', clv='clv')} from bets""")
def _(spark, sf):
    return pick(bets(spark, sf), "won placed", "stake pnl clv", ["race_date", "race_id", "strategy", "entrant_id"])


@query("walk_forward_bets", "B10 Q12", f"""{WITH_PREDS}, m as (select *, 1 / odds / sum(1 / odds) {BY_RACE} as mkt from preds)
select date_trunc('month', race_date)::date as fold, {ints(bets='count(*)', winners='sum(won)')},
  {dbls(pnl='sum(case when won = 1 then odds - 1 else -1.0 end)')}
from m where model_prob - mkt > {DEMAND} group by 1""")
def _(spark, sf):
    df = B.bet_table(predictions(spark, sf), 0.05, market_implied=True, skew=runner_skew(spark, sf))
    return df.where("strategy = 'value'").groupBy(F.trunc("race_date", "month").cast("date").alias("fold")).agg(
        i64(F.count(F.lit(1)), "bets"), i64(F.sum("won"), "winners"), r6(F.sum("pnl"), "pnl"))


_BO = "partition by strategy order by race_date, race_id, entrant_id rows unbounded preceding"
_CURVE = f"""{_BETS}, c as (select *, sum(pnl) over ({_BO}) as cum, sum(stake) over ({_BO}) as st, count(*) over ({_BO}) as nb
  from bets), d as (select *, max(cum) over ({_BO}) as peak from c)"""


@query("pnl_curves", "W18", f"""{_CURVE} select strategy, race_id, entrant_id, {ints(bet_number='nb')},
  {dbls(cum_pnl='cum', cum_staked='st', cum_roi_pct='cum / st * 100', drawdown='peak - cum')} from d""")
def _(spark, sf):
    df = B.with_curves(bets(spark, sf), skew=runner_skew(spark, sf))
    return pick(df, "bet_number", "cum_pnl cum_staked cum_roi_pct drawdown", ["strategy", *KEY])


@query("strategy_stats", "A2 B15 D4", f"""{_CURVE} select strategy, {ints(bets='count(*)', winners='sum(won)',
  placed='sum(coalesce(placed, won))')},
  {dbls(total_staked='sum(stake)', pnl='sum(pnl)', strike_rate='avg(won) * 100',
        place_rate='avg(coalesce(placed, won)) * 100', roi='sum(pnl) / sum(stake) * 100',
        avg_odds_winners='coalesce(avg(case when won = 1 then odds end), 0)', avg_odds_all='avg(odds)',
        max_drawdown='max(peak - cum)', avg_clv='avg(clv)', sharpe='avg(pnl) / stddev_pop(pnl)')}
from d group by strategy""")
def _(spark, sf):
    df = B.strategy_stats(bets(spark, sf), skew=runner_skew(spark, sf))
    return pick(df, "bets winners placed", "total_staked pnl strike_rate place_rate roi avg_odds_winners avg_odds_all "
                                           "max_drawdown avg_clv sharpe", ["strategy"])


@query("value_bet_quality", "A3", f"""{WITH_PREDS} select {ints(bets='count(*)')},
  {dbls(avg_edge='avg(model_prob - 1 / odds)', avg_clv='avg(model_prob * odds)',
        expected_roi='avg(model_prob * odds - 1) * 100', selected_brier='avg((model_prob - won) * (model_prob - won))',
        selected_log_loss='avg(-(won * ln(m) + (1 - won) * ln(1 - m)))')}
from (select *, least(greatest(model_prob, 1e-15), 1 - 1e-15) as m from preds) where model_prob - 1 / odds > {DEMAND}""")
def _(spark, sf):
    df = B.value_quality(predictions(spark, sf), 0.05)
    return pick(df, "bets", "avg_edge avg_clv expected_roi selected_brier selected_log_loss", [])


@query("daily_pnl", "A4", f"""{_BETS}, d as (select strategy, race_date, sum(pnl) as p, count(*) as n, sum(won) as w
  from bets group by 1, 2)
select strategy, race_date, {ints(daily_bets='n', daily_wins='w')}, {dbls(daily_pnl='p',
  cum_pnl='sum(p) over (partition by strategy order by race_date)')} from d""")
def _(spark, sf):
    return pick(B.daily_pnl(bets(spark, sf)), "daily_bets daily_wins", "daily_pnl cum_pnl", ["strategy", "race_date"])


@query("value_bets_by_odds_band", "A5 P32", f"""{_BETS} select case when odds <= 3 then '1-3' when odds <= 5 then '3-5'
  when odds <= 8 then '5-8' when odds <= 12 then '8-12' when odds <= 20 then '12-20' else '20+' end as odds_band,
  {ints(bets='count(*)', winners='sum(won)')}, {dbls(pnl='sum(pnl)', strike_rate='avg(won) * 100', roi='avg(pnl) * 100')}
from bets where strategy = 'value' group by 1""")
def _(spark, sf):
    return pick(B.by_odds_band(bets(spark, sf).where("strategy = 'value'")), "bets winners", "pnl strike_rate roi",
                ["odds_band"])


@query("calibration_by_bucket", "A6 P32", f"""{WITH_PREDS} select case when model_prob <= 0.05 then '0-5%'
  when model_prob <= 0.10 then '5-10%' when model_prob <= 0.15 then '10-15%' when model_prob <= 0.20 then '15-20%'
  when model_prob <= 0.30 then '20-30%' when model_prob <= 0.50 then '30-50%' else '50%+' end as prob_bucket,
  {ints(runners='count(*)', actual_wins='sum(won)')},
  {dbls(actual_win_rate='avg(won) * 100', avg_model_pct='avg(model_prob) * 100')} from preds group by 1""")
def _(spark, sf):
    return pick(B.calibration_by_bucket(predictions(spark, sf)), "runners actual_wins",
                "actual_win_rate avg_model_pct", ["prob_bucket"])


# ---- parameter grids -----------------------------------------------------------

_PRE = f"""{WITH_PREDS}, {_TERMS}, terms_ as (select * exclude (frac),
  case when elig then 0.25 else 0.0 end as frac from terms), {newton_sql('terms_')}, adj_ as (select * from adj),
{ew_sql('pp')}, pre as (select *, (model_prob - 1 / odds) / sqrt(odds / 3.0) as ne,
  case when won = 1 then odds - 1 else -1.0 end as vp, elig and (ew_ev > 0 or place_ev > 0) as isv,
  cast(finish_position > 0 and finish_position <= paid as integer) as pl from ev),
pre_ as (select *, case when won = 1 then odds + place_odds when pl = 1 then place_odds else 0 end - 2.0 as ep from pre)"""


def axis(name: str, values) -> str:
    return f"(select unnest([{', '.join(f'{float(v)}::double' for v in values)}]) as {name})"


_GRID = {k: G.DEFAULT_GRID[k] for k in ("value_threshold", "min_place_edge", "min_odds", "max_odds")}
_AXES = f"""axes as (select * from {' cross join '.join(axis(k, v) for k, v in _GRID.items())} where min_odds < max_odds)"""
_VHALF = """vh as (select value_threshold, min_odds, max_odds, count(ne) as n, coalesce(sum(vp), 0) as pnl,
  coalesce(sum(vp * vp), 0) as sq, coalesce(sum(won), 0) as won, coalesce(sum(odds), 0) as odds
  from (select distinct value_threshold, min_odds, max_odds from axes) left join {src}
    on ne > value_threshold and odds >= min_odds and odds <= max_odds group by 1, 2, 3)"""
_EHALF = """eh as (select min_place_edge, min_odds, max_odds, count(ne) as n, coalesce(sum(ep), 0) as pnl,
  coalesce(sum(ep * ep), 0) as sq, coalesce(sum(greatest(pl, won)), 0) as placed
  from (select distinct min_place_edge, min_odds, max_odds from axes) left join {src}
    on isv and place_edge > min_place_edge and odds >= min_odds and odds <= max_odds group by 1, 2, 3)"""


PATH_KEYS_SQL = f"{_AXES}, {_VHALF.format(src='pre_')}"


def div(a: str, b: str, scale: int = 1) -> str:
    return f"case when {b} > 0 then {a} / {b} * {scale} else 0 end"


@query("strategy_grid_flat", "B12 J17 B15", f"""{_PRE}, {_AXES}, {_VHALF.format(src='pre_')}, {_EHALF.format(src='pre_')},
g as (select a.*, v.n as vn, v.pnl as vpnl, v.sq as vsq, v.won as vwon, v.odds as vodds, e.n as en, e.pnl as epnl,
  e.sq as esq, e.placed as epl from axes a join vh v using (value_threshold, min_odds, max_odds)
  join eh e using (min_place_edge, min_odds, max_odds))
select value_threshold, min_place_edge, min_odds, max_odds, {ints(value_bets='vn', value_winners='vwon', ew_bets='en',
  ew_placed='epl')},
  {dbls(value_pnl='vpnl', value_roi=div('vpnl', 'vn', 100), value_avg_odds=div('vodds', 'vn'), ew_pnl='epnl',
        combined_pnl='vpnl + epnl', combined_roi=div('(vpnl + epnl)', '(vn + 2.0 * en)', 100),
        value_sharpe='case when vn >= 2 and vsq / vn - (vpnl / vn) * (vpnl / vn) > 1e-18 then vpnl / vn / '
                     'sqrt(vsq / vn - (vpnl / vn) * (vpnl / vn)) else 0 end')} from g""")
def _(spark, sf):
    pre = G.analysis_columns(predictions(spark, sf), skew=runner_skew(spark, sf))
    return pick(G.grid_search_flat(pre), "value_bets value_winners ew_bets ew_placed",
                "value_pnl value_roi value_avg_odds ew_pnl combined_pnl combined_roi value_sharpe", list(_GRID))


@query("strategy_grid_drawdown", "B15 W18", f"""{_PRE}, {_AXES}, p as (select value_threshold, min_odds, max_odds,
  race_date, race_id, entrant_id, vp from (select distinct value_threshold, min_odds, max_odds from axes) join pre_
  on ne > value_threshold and odds >= min_odds and odds <= max_odds),
c as (select *, sum(vp) over (partition by value_threshold, min_odds, max_odds order by race_date, race_id, entrant_id
  rows unbounded preceding) as cum from p),
d as (select *, max(cum) over (partition by value_threshold, min_odds, max_odds order by race_date, race_id, entrant_id
  rows unbounded preceding) - cum as dd from c)
select value_threshold, min_odds, max_odds, {dbls(value_max_dd='max(dd)')} from d group by 1, 2, 3""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = G.grid_drawdowns(G.analysis_columns(predictions(spark, sf), skew=skew))
    return pick(df, "", "value_max_dd", G.PATH_KEYS)


_SMALL = {"value_threshold": [0.05, 0.10], "min_place_edge": [0.05], "min_odds": [2.0, 5.0], "max_odds": [21.0],
          "kelly_fraction": [0.10, 0.25]}


@query("strategy_grid_kelly", "B11 B13 D2", f"""{_PRE}, ax as (select * from {axis('value_threshold', [.05, .1])}
  cross join {axis('min_odds', [2, 5])} cross join {axis('kelly_fraction', [.1, .25])}),
b as (select ax.*, race_date, race_id, entrant_id, odds, won, greatest(0, ((odds - 1) * model_prob - (1 - model_prob))
  / (odds - 1) * kelly_fraction) as k from ax join pre_ on ne > value_threshold and odds >= min_odds and odds <= 21),
l as (select value_threshold, min_odds, kelly_fraction, list({{'bank': 100.0::double, 'n': 0, 'k': k, 'o': odds, 'w': won,
    'dummy': 0}} order by race_date, race_id, entrant_id) as xs from b where k > 0 group by 1, 2, 3),
f as (select *, list_reduce(xs, lambda s, x: {{'bank': s.bank + case when s.bank <= 0 or
    least(round(x.k * s.bank, 4), s.bank, 50.0) < 0.01 then 0 when x.w = 1 then
    least(round(x.k * s.bank, 4), s.bank, 50.0) * (x.o - 1) else -least(round(x.k * s.bank, 4), s.bank, 50.0) end,
  'n': s.n + case when s.bank <= 0 or least(round(x.k * s.bank, 4), s.bank, 50.0) < 0.01 then 0 else 1 end,
  'k': 0.0::double, 'o': 0.0::double, 'w': 0, 'dummy': 0}},
  {{'bank': 100.0::double, 'n': 0, 'k': 0.0::double, 'o': 0.0::double, 'w': 0, 'dummy': 0}}) as s from l)
select value_threshold, min_odds, kelly_fraction, {ints(value_bets='s.n')}, {dbls(2, value_pnl='s.bank - 100')} from f""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = G.grid_search_kelly(G.analysis_columns(predictions(spark, sf), skew=skew), _SMALL, skew=skew)
    return pick(df, "value_bets", "value_pnl", ["value_threshold", "min_odds", "kelly_fraction"], digits=2)


@query("strategy_grid_validated", "B14 J16 F9", f"""{_PRE}, {_AXES},
pa as (select * from pre_ where race_date < date '1998-06-01'), pb as (select * from pre_ where race_date >= date '1998-06-01'),
{_VHALF.format(src='pa')}, {_EHALF.format(src='pa')},
{_VHALF.format(src='pb').replace('vh as', 'vh2 as')}, {_EHALF.format(src='pb').replace('eh as', 'eh2 as')},
g as (select a.*, v.n as vn, e.n as en, {div('(v.pnl + e.pnl)', '(v.n + 2.0 * e.n)', 100)} as roi,
  {div('(w.pnl + f.pnl)', '(w.n + 2.0 * f.n)', 100)} as oos, v.pnl + e.pnl as pnl
  from axes a join vh v using (value_threshold, min_odds, max_odds) join eh e using (min_place_edge, min_odds, max_odds)
  join vh2 w using (value_threshold, min_odds, max_odds) join eh2 f using (min_place_edge, min_odds, max_odds))
select value_threshold, min_place_edge, min_odds, max_odds, {ints(value_bets='vn', ew_bets='en')},
  {dbls(combined_pnl='pnl', combined_roi='roi', oos_combined_roi='oos', roi_decay='roi - oos',
        stability_ratio='case when roi <> 0 then least(greatest(oos / roi, -2), 2) end')}
from g where vn >= 10 and en >= 10""")
def _(spark, sf):
    pre = G.analysis_columns(predictions(spark, sf), skew=runner_skew(spark, sf))
    df = G.validated_grid_search(pre, F.lit("1998-06-01").cast("date"))
    return pick(df, "value_bets ew_bets", "combined_pnl combined_roi oos_combined_roi roi_decay stability_ratio",
                list(_GRID))
