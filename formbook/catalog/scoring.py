"""Metrics, calibration, splits and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.betting import BY_RACE, WITH_PREDS, predictions
from formbook.catalog.features_entrant import KEY, dbls, ints, pick
from formbook.catalog.registry import WITH_RUNNERS, i64, query, r6, runner_skew, runner_table
from formbook.operators import calibration as C
from formbook.operators import metrics as M
from formbook.operators import splits as S

LL = "-(won * ln(p) + (1 - won) * ln(1 - p))"
WITH_P = f"{WITH_PREDS}, pp as (select *, least(greatest(model_prob, 1e-15), 1 - 1e-15) as p from preds)"


@query("brier_and_log_loss", "M17", f"""{WITH_P} select {ints(rows='count(*)')},
  {dbls(brier_score='avg((p - won) * (p - won))', log_loss=f'avg({LL})')} from pp""")
def _(spark, sf):
    return pick(M.probability_scores(predictions(spark, sf)), "rows", "brier_score log_loss", [])


_BINS = f"""{WITH_P}, b as (select cast(least(floor(p * 10), 9) as bigint) as bin, count(*) as n, avg(p) as mp,
  avg(won) as obs from pp group by 1)"""


@query("reliability_bins", "M17", f"{_BINS} select bin, {ints(rows='n')}, {dbls(mean_pred='mp', obs_rate='obs')} from b")
def _(spark, sf):
    return pick(M.reliability_bins(predictions(spark, sf)), "bin rows", "mean_pred obs_rate", [])


@query("calibration_error", "M17 D4", f"{_BINS} select {dbls(ece='sum(abs(mp - obs) * n) / sum(n)')} from b")
def _(spark, sf):
    return pick(M.calibration_error(predictions(spark, sf)), "", "ece", [])


@query("ranking_scores", "M18 T3 W16", f"""{WITH_PREDS}, g as (select *, case finish_position when 1 then 5 when 2 then 2
  when 3 then 1 else 0 end as g from preds where finish_position > 0),
k as (select *, row_number() over (partition by race_id order by score desc, entrant_id) as rs,
  row_number() over (partition by race_id order by g desc, entrant_id) as rg from g
  qualify count(*) {BY_RACE} >= 2 and max(g) {BY_RACE} > min(g) {BY_RACE} and max(score) {BY_RACE} > min(score) {BY_RACE}),
d as (select *, avg(case when rs <= 1 then 1 / log2(rs + 1) else 0 end) over (partition by race_id, score) as d1,
  avg(case when rs <= 3 then 1 / log2(rs + 1) else 0 end) over (partition by race_id, score) as d3 from k),
r_ as (select race_id, sum(g * d1) / sum(case when rg <= 1 then g / log2(rg + 1) else 0 end) as n1,
  sum(g * d3) / sum(case when rg <= 3 then g / log2(rg + 1) else 0 end) as n3,
  max(case when rg = 1 and rs = 1 then 1 else 0 end) as t1, max(case when rg = 1 and rs <= 3 then 1 else 0 end) as t3
  from d group by 1)
select {ints(total_races='count(*)')}, {dbls(ndcg_at_1='avg(n1)', ndcg_at_3='avg(n3)', top1_accuracy='avg(t1)',
  win_in_top3='avg(t3)')} from r_""")
def _(spark, sf):
    df = M.ranking_scores(predictions(spark, sf), skew=runner_skew(spark, sf))
    return pick(df, "total_races", "ndcg_at_1 ndcg_at_3 top1_accuracy win_in_top3", [])


@query("rank_probability_score", "M19 W20", f"""{WITH_PREDS}, f as (select * from preds where finish_position > 0
  qualify count(*) {BY_RACE} >= 2),
c as (select *, sum(model_prob) over (partition by race_id order by finish_position, entrant_id rows unbounded preceding)
  as cum, row_number() over (partition by race_id order by finish_position, entrant_id) as k, count(*) {BY_RACE} as n from f),
r_ as (select race_id, sum(case when k < n then (cum - 1) * (cum - 1) else 0 end) / (max(n) - 1) as r from c group by 1)
select {ints(races='count(*)')}, {dbls(rps='avg(r)')} from r_""")
def _(spark, sf):
    return pick(M.rank_probability_score(predictions(spark, sf), skew=runner_skew(spark, sf)), "races", "rps", [])


@query("decile_calibration", "M20 W21", f"""{WITH_PREDS}, s as (select model_prob as p, won,
  row_number() over (order by model_prob, race_id, entrant_id) as i, count(*) over () as n from preds),
d as (select *, least((i - 1) // (n // 10), 9) + 1 as decile from s)
select {ints(decile='decile', rows='count(*)')}, {dbls(prob_lo='min(p)', prob_hi='max(p)', mean_pred='avg(p)',
  obs_rate='avg(won)')} from d group by decile""")
def _(spark, sf):
    return pick(M.decile_calibration(predictions(spark, sf)), "decile rows", "prob_lo prob_hi mean_pred obs_rate", [])


_K3 = """case when num_runners <= 4 then 3 when num_runners <= 7 then 2 when num_runners <= 15 then 3
  when handicap = 1 then 4 else 3 end"""


@query("place_scores", "M21 M34", f"""{WITH_PREDS}, f as (select *, {_K3} as k,
  row_number() over (partition by race_id order by place_prob desc, entrant_id) as r_,
  row_number() over (partition by race_id order by score desc, entrant_id) as s_ from preds where finish_position > 0),
y as (select *, cast(finish_position <= k as integer) as y from f),
t as (select race_id, sum(cast(s_ <= 3 and finish_position <= 3 as integer)) as h, sum(cast(s_ <= 3 as integer)) as n
  from f group by 1)
select {dbls(brier_calibrated='(select avg((place_prob - y) * (place_prob - y)) from y)',
  place_precision='(select cast(sum(case when r_ <= k then y else 0 end) as double) / sum(y) from y)',
  top3_accuracy='(select cast(sum(h) as double) / sum(n) from t)', place_hits='(select avg(h) from t)')}""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = predictions(spark, sf)
    a = M.place_scores(df, skew=skew)
    b = M.top_three_overlap(df, skew=skew)
    return pick(a.join(F.broadcast(b)), "", "brier_calibrated place_precision top3_accuracy place_hits", [])


@query("market_baseline", "M22 W17 F10", f"""{WITH_PREDS}, k as (select *, 1 / odds / sum(1 / odds) {BY_RACE} as m,
  1.0 / num_runners as u from preds where true qualify sum(won) {BY_RACE} = 1),
l as (select won, unnest(['base', 'market', 'model']) as model, unnest([u, m, model_prob]) as v from k),
c as (select *, least(greatest(v, 1e-15), 1 - 1e-15) as p from l)
select model, {ints(rows='count(*)')}, {dbls(brier_score='avg((p - won) * (p - won))', log_loss=f'avg({LL})')}
from c group by 1""")
def _(spark, sf):
    from formbook.plans.within import with_totals
    skew = runner_skew(spark, sf)
    df = with_totals(predictions(spark, sf), ["race_id"], {"_w": F.sum("won")}, skew).where("_w = 1")
    df = M.with_market_probs(df, skew=skew).withColumn("base_rate", 1.0 / F.col("num_runners"))
    df = M.model_comparison(df, {"model": "model_prob", "market": "market_prob", "base": "base_rate"})
    return pick(df, "rows", "brier_score log_loss", ["model"])


@query("ensemble", "M31 W17", f"""{WITH_PREDS}, l as (select race_id, entrant_id, unnest([model_prob,
  1 / odds / sum(1 / odds) {BY_RACE}, 1.0 / num_runners]) as p from preds),
a as (select race_id, entrant_id, avg(p) as m from l group by 1, 2)
select race_id, entrant_id, {dbls(ensemble_prob=f'm / sum(m) {BY_RACE}')} from a""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = M.with_market_probs(predictions(spark, sf), skew=skew)
    long = df.select(*KEY, F.explode(F.array("model_prob", "market_prob", 1.0 / F.col("num_runners"))).alias("p"))
    return pick(M.ensemble(long, skew=skew), "", "ensemble_prob")


_FEATS = ["odds", "weight_lbs", "official_rating", "lengths_behind", "num_runners"]


@query("feature_drift", "M8 P33 D4", f"""{WITH_RUNNERS}, l as (select race_date >= date '1999-01-01' as t,
  unnest({_FEATS}) as feature, unnest([odds, weight_lbs, official_rating, lengths_behind, num_runners::double]) as v
  from runners),
e as (select feature, list_distinct(list_sort(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as ed
  from l where not t and v is not null group by 1),
b as (select l.feature, t, len(list_filter(list_sort(ed)[2:-2], lambda x: x <= v)) as b from l join e using (feature)
  where v is not null and v between list_min(ed) - 1e-9 and list_max(ed) + 1e-9),
c as (select feature, b, sum(cast(not t as integer)) as a, sum(cast(t as integer)) as z from b group by 1, 2),
p as (select *, greatest(cast(a as double) / sum(a) over (partition by feature), 1e-9) as pa,
  greatest(cast(z as double) / sum(z) over (partition by feature), 1e-9) as pz from c),
s as (select feature, sum((pz - pa) * ln(pz / pa)) as psi from p group by 1)
select feature, {dbls(psi='psi')}, case when psi >= 0.2 then 'high' when psi >= 0.1 then 'moderate' else 'stable' end
  as level from s""")
def _(spark, sf):
    df = M.stability_index(runner_table(spark, sf), _FEATS, F.col("race_date") >= F.lit("1999-01-01").cast("date"))
    return df.select("feature", r6("psi"), "level")


@query("ranker_agreement", "B25 W14", f"""{WITH_PREDS}, k as (select *,
  rank() over (partition by race_id order by model_prob desc) as cr, rank() over (partition by race_id order by score desc)
  as sr, row_number() over (partition by race_id order by model_prob desc, entrant_id) as c_,
  row_number() over (partition by race_id order by score desc, entrant_id) as s_ from preds),
t as (select *, abs(cr - sr) as gap, max(cast(c_ = 1 and s_ = 1 as integer)) {BY_RACE} as same,
  avg(case when cr <= 3 or sr <= 3 then abs(cr - sr) end) {BY_RACE} as mg from k)
select race_id, entrant_id, {ints(rank_gap='gap', disagrees_top='(cr = 1) <> (sr = 1)')},
  case when same = 0 then 'split' when mg <= 0.75 then 'strong' when mg <= 1.5 then 'moderate' else 'narrow' end as consensus,
  case when (cr = 1) <> (sr = 1) and cr = 1 then 'split' when gap >= 2 then 'caution' when gap <= 0 then 'aligned'
    when gap <= 1 then 'supported' end as confidence from t""")
def _(spark, sf):
    df = M.ranker_agreement(predictions(spark, sf), skew=runner_skew(spark, sf))
    return df.select(*KEY, i64("rank_gap"), i64("disagrees_top"), "consensus", "confidence")


@query("importance_concentration", "A22", f"""{WITH_RUNNERS}, i as (select trainer as feature,
  sum(cast(floor(prize_money) as bigint)) as importance from runners group by 1),
k as (select *, row_number() over (order by importance, feature) as i, count(*) over () as n,
  sum(importance) over () as t, sum(importance) over (order by importance, feature) as c from i),
g as (select *, 2.0 * sum(cast(i * importance as double)) over () / (n * t) - (n + 1.0) / n as gini from k)
select feature, {dbls(share_of_features='cast(i as double) / n', share_of_importance='cast(c as double) / t', gini='gini')}
from g""")
def _(spark, sf):
    imp = runner_table(spark, sf).groupBy(F.col("trainer").alias("feature")).agg(F.sum("prize_money").alias("importance"))
    return pick(M.concentration(imp), "", "share_of_features share_of_importance gini", ["feature"])


# ---- fits ----------------------------------------------------------------------


def blend_sql(steps: int = 8) -> str:
    """Newton steps of the market blend as chained common table expressions."""
    out = [f"""m0 as (select *, 1 / odds / sum(1 / odds) {BY_RACE} as mk from preds where true
  qualify sum(won) {BY_RACE} = 1 and min(odds) {BY_RACE} > 1.01)""",
           """m1 as (select race_id, won, ln(least(greatest(model_prob, 1e-6), 1 - 1e-6)) as x,
  ln(least(greatest(mk, 1e-6), 1 - 1e-6)) as z from m0)""", "p0 as (select 0.3::double as a, 0.8::double as b)"]
    for i in range(steps):
        out.append(f"""e{i} as (select m1.*, a, b, exp(a * x + b * z) as e from m1, p{i}),
r{i} as (select race_id, any_value(a) as a, any_value(b) as b, sum(e * x) / sum(e) as mx, sum(e * z) / sum(e) as mz,
  sum(e * x * x) / sum(e) as xx, sum(e * x * z) / sum(e) as xz, sum(e * z * z) / sum(e) as zz, sum(won * x) as wx,
  sum(won * z) as wz from e{i} group by 1),
g{i} as (select any_value(a) as a, any_value(b) as b, sum(wx - mx) as gx, sum(wz - mz) as gz, sum(xx - mx * mx) as hxx,
  sum(xz - mx * mz) as hxz, sum(zz - mz * mz) as hzz from r{i}),
p{i + 1} as (select a + (hzz * gx - hxz * gz) / (hxx * hzz - hxz * hxz) as a,
  b + (hxx * gz - hxz * gx) / (hxx * hzz - hxz * hxz) as b from g{i})""")
    return ",\n".join(out)


@query("market_blend", "M14 F10", f"""{WITH_PREDS}, {blend_sql()},
k as (select *, 1 / odds / sum(1 / odds) {BY_RACE} as mk from preds),
e as (select k.*, exp(a * ln(least(greatest(model_prob, 1e-6), 1 - 1e-6)) + b * ln(least(greatest(mk, 1e-6), 1 - 1e-6))) as e
  from k, p8)
select race_id, entrant_id, {dbls(5, blended_prob=f'e / sum(e) {BY_RACE}')} from e""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = M.with_market_probs(predictions(spark, sf), skew=skew)
    fit = C.fit_market_blend(df, skew=skew)
    return pick(C.apply_market_blend(df, **fit, skew=skew), "", "blended_prob", digits=5)


def scoring_sql(src: str, start: str, s: str, u: str, v: str, update: str, steps: int) -> str:
    """Scoring steps of a race-normalised fit; ``src`` has race_id, won and x; the result is ``q<steps>``."""
    out = [f"q0 as (select {start})"]
    for i in range(steps):
        out.append(f"""f{i} as (select race_id, won, a, b, {s} as s, {u} as u, {v} as v from {src}, q{i}),
t{i} as (select *, greatest(sum(s) {BY_RACE}, 1e-12) as t, sum(s * u) {BY_RACE} as su, sum(s * v) {BY_RACE} as sv from f{i}),
c{i} as (select *, least(greatest(s / t, 1e-12), 1 - 1e-12) as c, u - su / t as du, v - sv / t as dv from t{i} where s / t < 1 - 1e-12),
h{i} as (select any_value(a) as a, any_value(b) as b, (select count(*) from t{i}) * 1e-6 as rg, sum((won - c) / (1 - c) * du) as gu,
  sum((won - c) / (1 - c) * dv) as gv, sum(c / (1 - c) * du * du) as hu, sum(c / (1 - c) * du * dv) as hm,
  sum(c / (1 - c) * dv * dv) as hv from c{i}),
q{i + 1} as (select {update} from h{i})""")
    return ",\n".join(out)


_DET = "((hu + rg) * (hv + rg) - hm * hm)"
_TWO = (f"least(greatest(a + least(greatest(((hv + rg) * gu - hm * gv) / {_DET}, -1), 1), 0.1), 5) as a, "
        f"least(greatest(b + least(greatest(((hu + rg) * gv - hm * gu) / {_DET}, -1), 1), -3), 3) as b")
_SIG = "(1 / (1 + exp(-least(greatest(a * x + b, -60), 60))))"
_LOGIT = "ln(least(greatest({p}, 1e-9), 1 - 1e-9) / (1 - least(greatest({p}, 1e-9), 1 - 1e-9)))"


@query("win_calibration", "M11 M13", f"""{WITH_PREDS}, lp as (select race_id, entrant_id, won, {_LOGIT.format(p='model_prob')} as x
  from preds), {scoring_sql('lp', '1.0::double as a, 0.0::double as b', _SIG, f'(1 - {_SIG}) * x', f'1 - {_SIG}', _TWO,
  C.FIT_STEPS)},
o as (select race_id, entrant_id, {_SIG} as s from lp, q{C.FIT_STEPS})
select race_id, entrant_id, {dbls(5, win_probability=f's / sum(s) {BY_RACE}')} from o""")
def _(spark, sf):
    """Platt parameters by win log-loss, applied and normalised in the race."""
    skew = runner_skew(spark, sf)
    df = predictions(spark, sf)
    return pick(C.calibrate_win(df, "model_prob", C.fit_platt(df, skew=skew), skew=skew), "", "win_probability", digits=5)


@query("isotonic_calibration", "M12 M13 M32")
def _(spark, sf):
    """Platt and monotone curve fitted on the earlier races, applied to the later ones."""
    skew = runner_skew(spark, sf)
    df = S.with_slab(predictions(spark, sf)).withColumn("won", F.col("won").cast("double"))
    fit = df.where("part = 'fit'")
    platt = C.fit_platt(fit, skew=skew)
    iso = C.fit_isotonic(C.calibrate_win(fit, "model_prob", platt, skew=skew), "win_probability", "won")
    out = C.calibrate_win(df.where("part = 'calibrate'"), "model_prob", platt, iso, skew=skew)
    return pick(out, "", "win_probability")


@query("softmax_temperature", "M15 W17", f"""{WITH_PREDS}, lp as (select race_id, entrant_id, won,
  score - max(score) {BY_RACE} as x from preds), {scoring_sql('lp', '1.0::double as a, 0.0::double as b', 'exp(x * a)', 'x',
  '0.0', 'least(greatest(a + least(greatest(gu / (hu + rg), -1), 1), 1 / 6.0), 5) as a, b', 12)},
o as (select race_id, entrant_id, exp(x * a) as s from lp, q12)
select race_id, entrant_id, {dbls(5, win_probability=f's / sum(s) {BY_RACE}')} from o""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = predictions(spark, sf)
    t = C.fit_temperature(df, skew=skew)
    return pick(C.softmax(df, "score", "win_probability", t, skew), "", "win_probability", digits=5)


def brier_sql(steps: int) -> str:
    out = ["q0 as (select 1.0::double as a, 0.0::double as b)"]
    for i in range(steps):
        out.append(f"""f{i} as (select y, x, a, b, {_SIG} as p from lp, q{i}),
h{i} as (select any_value(a) as a, any_value(b) as b, count(*) * 1e-6 as rg, sum((y - p) * p * (1 - p) * x) as gu,
  sum((y - p) * p * (1 - p)) as gv, sum(p * (1 - p) * x * p * (1 - p) * x) as hu,
  sum(p * (1 - p) * x * p * (1 - p)) as hm, sum(p * (1 - p) * p * (1 - p)) as hv from f{i}),
q{i + 1} as (select {_TWO} from h{i})""")
    return ",\n".join(out)


@query("place_calibration", "M11", f"""{WITH_PREDS}, lp as (select race_id, entrant_id, {_LOGIT.format(p='place_prob')} as x,
  cast(finish_position > 0 and finish_position <= {_K3} as integer) as y from preds), {brier_sql(C.FIT_STEPS)}
select race_id, entrant_id, {dbls(5, place_cal=_SIG)} from lp, q{C.FIT_STEPS}""")
def _(spark, sf):
    df = S.with_targets(predictions(spark, sf), skew=runner_skew(spark, sf))
    a, b = C.fit_place_platt(df)
    return pick(df.withColumn("place_cal", C.apply_platt("place_prob", a, b)), "", "place_cal", digits=5)


@query("preferred_market_probability", "M6 W17", f"""{WITH_PREDS}, k as (select *,
  case when bsp > 1 then 1 / bsp end as e, case when odds > 1 then 1 / odds end as s from preds)
select race_id, entrant_id, {dbls(market_pref=f'coalesce(e / sum(e) {BY_RACE}, s / sum(s) {BY_RACE})')} from k""")
def _(spark, sf):
    return pick(M.preferred_market(predictions(spark, sf), skew=runner_skew(spark, sf)), "", "market_pref")


# ---- splits, weights, targets --------------------------------------------------


@query("degenerate_races", "F2 F1 X4", f"""{WITH_RUNNERS}, b as (select race_id from runners where finish_position > 0
  group by 1 having max(num_runners) <= 1 or count(distinct finish_position) <= 1 or min(odds) < 1.01)
select race_id, entrant_id, finish_position::bigint as finish_position from runners
where race_id not in (select race_id from b)""")
def _(spark, sf):
    return S.drop_degenerate_races(runner_table(spark, sf)).select(*KEY, i64("finish_position"))


@query("burn_in_split_purge", "F3 F4 M1", f"""{WITH_RUNNERS}, w as (select * from runners, (select min(race_date) as a,
  max(race_date) as z from runners) where a + interval 4 month >= z or race_date >= a + interval 4 month),
s as (select *, row_number() over (order by race_date, race_id, entrant_id) - 1 as i, count(*) over () as n from w),
t as (select *, min(i) over (partition by race_id) > floor(n * 0.8) as is_test from s),
f as (select min(race_date) as t0 from t where is_test)
select race_id, entrant_id, cast(is_test as bigint) as is_test from t, f
where is_test or race_date <= t0 - interval 7 day""")
def _(spark, sf):
    df = S.purge(S.with_test_flag(S.burn_in(runner_table(spark, sf))))
    return df.select(*KEY, i64("is_test"))


@query("walk_forward_folds", "M3 F4", f"""{WITH_RUNNERS}, m as (select date_trunc('month', race_date)::date as test_month,
  min(race_date) as test_start, max(race_date) as test_end, count(*) as test_rows from runners group by 1),
t as (select test_month, any_value(test_start) as test_start, any_value(test_end) as test_end,
  any_value(test_rows) as test_rows, count(r.race_id) as train_rows from m left join runners r
  on r.race_date <= test_month - interval 8 day group by 1)
select test_month, test_start, test_end, (test_month - interval 8 day)::date as train_end,
  {ints(train_rows='train_rows', test_rows='test_rows')} from t where train_rows >= 50 and test_rows >= 10""")
def _(spark, sf):
    df = S.monthly_folds(runner_table(spark, sf))
    return df.select("test_month", "test_start", "test_end", "train_end", i64("train_rows"), i64("test_rows"))


@query("expanding_folds", "M2", f"""{WITH_RUNNERS}, p as (select *, race_date - min(race_date) over () as d,
  ceil((max(race_date) over () - min(race_date) over () + 1) / 4.0) as size from runners),
f as (select *, unnest([1, 2, 3]) as fold from p),
g as (select *, case when floor(d / size) = fold then 'valid' when d < fold * size - 7 then 'train' end as part from f)
select {ints(fold='fold', rows='count(*)')}, part from g where part is not null group by fold, part""")
def _(spark, sf):
    return S.with_folds(runner_table(spark, sf)).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows")).select(
        i64("fold"), "part", i64("rows"))


@query("calibration_slab", "M32 M33", f"""{WITH_RUNNERS}, s as (select *, row_number() over (order by race_date, race_id,
  entrant_id) - 1 as i, count(*) over () as n from runners),
t as (select *, min(i) over (partition by race_id) as i0 from s),
e as (select *, i0 > floor(n * 0.9) as v from t), f as (select min(race_date) as v0 from e where v)
select case when i0 > floor(n * (1 - (1.0 - 0.8))) then 'calibrate' else 'fit' end as part,
  cast(v as bigint) as is_validation, count(*) as rows from e, f where v or race_date <= v0 - interval 7 day
group by 1, 2""")
def _(spark, sf):
    df = S.with_early_stop(S.with_slab(runner_table(spark, sf)))
    return df.groupBy("part", i64("is_validation")).agg(F.count(F.lit(1)).alias("rows"))


_W = {"exp": "exp(-ln(2.0) * ago / 180)", "poly": "1.0 / (1.0 + ago / 180)", "linear": "greatest(0.0, 1 - ago / 360.0)"}


@query("recency_weights", "M4", f"""{WITH_RUNNERS}, a as (select *, cast(max(race_date) over () - race_date as double) as ago,
  1.0 + 0.15 * cast(month(race_date) = month(max(race_date) over ()) as integer) as s from runners)
select race_id, entrant_id, {dbls(**{f'w_{k}': f'{v} * s / avg({v} * s) over ()' for k, v in _W.items()})} from a""")
def _(spark, sf):
    df = runner_table(spark, sf).select(*KEY, "race_date")
    for shape in _W:
        df = S.recency_weights(df, shape=shape, name=f"w_{shape}")
    return pick(df, "", " ".join(f"w_{s}" for s in _W))


@query("training_targets", "M5 M6 Q10", f"""{WITH_PREDS}, k as (select *, sum(1 / odds) {BY_RACE} as book,
  max(lengths_behind) {BY_RACE} as far, {_K3} as k from preds),
v as (select *, 1 / odds / book as ip from k)
select race_id, entrant_id, {ints(y_placed='finish_position > 0 and finish_position <= k',
  y_rel='case finish_position when 1 then 5 when 2 then 2 when 3 then 1 else 0 end')},
  {dbls(y_resid='won - ip', y_norm_pos='case when finish_position > 0 then (finish_position - 1) / '
        'cast(greatest(num_runners - 1, 1) as double) end',
        y_lengths='coalesce(case when finish_position >= 1 then lengths_behind else far + 10 end, 30)',
        y_soft='0.5 * ip + 0.5 * won')} from v""")
def _(spark, sf):
    df = S.with_targets(predictions(spark, sf), blend=0.5, skew=runner_skew(spark, sf))
    return pick(df, "y_placed y_rel", "y_resid y_norm_pos y_lengths y_soft")
