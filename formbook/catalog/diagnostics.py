"""Table upkeep, reconciliation joins, disagreement, exchange and trade reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from formbook.catalog.betting import _BETS, _PRE, BY_RACE, PATH_KEYS_SQL, WITH_PREDS, bets, predictions
from formbook.catalog.features_race import PACE_SQL
from formbook.catalog.features_entrant import KEY, dbls, ints, pick
from formbook.catalog.parsing import BOOK_SQL, order_books
from formbook.catalog.registry import WITH_RUNNERS, i64, query, r6, runner_skew, runner_table
from formbook.features import race as R
from formbook.features import venue as V
from formbook.operators import diagnostics as D
from formbook.operators import grid as G
from formbook.operators import joins as J
from formbook.operators import metrics as M
from formbook.operators import tables as T
from formbook.session import checkpoint_root
from formbook.sources import nested as N
from formbook.sources.runners import table


def day(text: str):
    return F.lit(text).cast("date")


# ---- tables --------------------------------------------------------------------


@query("lookback_scan", "S2 S9 S10 T1", f"""{WITH_RUNNERS} select race_id, entrant_id, race_date from runners
where race_date >= date '2001-01-01' - 90""")
def _(spark, sf):
    path = f"{checkpoint_root(spark)}/partitioned-{uuid.uuid4().hex}"
    T.write_runners(runner_table(spark, sf).select(*KEY, "race_date", "odds"), path)
    df = T.read_tolerant(spark, path, [*KEY, "race_date", "year", "month", "not_there"])
    # The year filter prunes folders; the date filter is pushed to the files.
    return T.since(df.where(F.col("year") >= 2000), day("2001-01-01"), 90).select(*KEY, "race_date")


@query("idempotent_insert", "S3 S4 X2 J10 T5", f"""{WITH_RUNNERS}, batch as (select * from runners where race_date >= date
  '1999-01-01'), done as (select race_id from batch group by 1 having max(finish_position) > 0)
select race_id, entrant_id, {ints(finish_position='finish_position')} from batch
where race_id in (select race_id from done) and race_date >= date '2000-01-01'""")
def _(spark, sf):
    df = runner_table(spark, sf)
    batch = df.where(F.col("race_date") >= day("1999-01-01"))
    stored = df.where(F.col("race_date") < day("2000-01-01"))
    return T.new_rows(batch.unionByName(batch.where("entrant_id % 3 = 0")), stored).select(*KEY, i64("finish_position"))


@query("missing_days", "S5 S6 S7 X2", f"""{WITH_RUNNERS}, k as (select distinct track, race_date from runners),
c as (select track, unnest(generate_series(date '1998-01-01', date '1998-06-30', interval 1 day))::date as race_date
  from (select distinct track from k))
select track, race_date, 'missing' as kind from c anti join k using (track, race_date)
union all select track, unnest(generate_series(m + interval 1 day, timestamp '2001-08-20', interval 1 day))::date, 'gap'
from (select track, max(race_date) as m from k group by 1)""")
def _(spark, sf):
    df = runner_table(spark, sf)
    a = T.missing_dates(df, day("1998-01-01"), day("1998-06-30"), keys=["track"]).withColumn("kind", F.lit("missing"))
    return a.unionByName(T.gap_days(df, day("2001-08-21"), keys=["track"]).withColumn("kind", F.lit("gap")))


@query("table_summary", "S8 S22 A19", f"""{WITH_RUNNERS} select {ints(rows='count(*)', dates='count(distinct race_date)',
  tracks='count(distinct track)', races='count(distinct race_id)', span_days='max(race_date) - min(race_date) + 1',
  months="count(distinct date_trunc('month', race_date))")}, min(race_date) as first_date, max(race_date) as last_date
from runners""")
def _(spark, sf):
    return pick(T.table_summary(runner_table(spark, sf)), "rows dates tracks races span_days months", "",
                ["first_date", "last_date"])


_PRINTED = ("age dam damsire distance_furlongs draw entrant_id entrant_name finish_pos_label finish_position going handicap "
            "jockey lengths_behind num_runners odds off_minute official_rating prize_money race_class race_date race_id "
            "race_type sex sire surface track trainer weight_lbs won").split()
_DOUBLES = {"distance_furlongs", "lengths_behind", "odds", "official_rating", "prize_money", "weight_lbs"}
_ROW_TEXT = " || '|' || ".join("coalesce({}, '\\N')".format(
    f"cast(cast(round({c} * 10000) as bigint) as varchar)" if c in _DOUBLES else f"cast({c} as varchar)") for c in _PRINTED)


@query("content_fingerprint", "S21 U7", f"""{WITH_RUNNERS}, t as (select handicap, race_date, cast('0x' || substr(md5({_ROW_TEXT}), 1, 12) as bigint) as h from runners),
p as (select 'all' as part, * from t union all select 'handicaps', * from t where handicap = 1),
s as (select part, count(*) as n, cast(sum(h % 2147483648) as bigint) as a, bit_xor(h) as x, cast(min(race_date) as varchar) as lo,
  cast(max(race_date) as varchar) as hi from p group by 1)
select part, {ints(rows='n', h1='a', h2='x')}, lo, hi,
  sha1('{','.join(_PRINTED)}' || '|' || n || '|' || a || '|' || x || '|' || lo || '|' || hi) as key from s""")
def _(spark, sf):
    # The check builds headgear in its parsed form only.
    df = runner_table(spark, sf).drop("headgear")
    return T.fingerprint(df).withColumn("part", F.lit("all")).unionByName(
        T.fingerprint(df.where("handicap = 1")).withColumn("part", F.lit("handicaps")))


@query("missing_share", "S23 A17", f"""{WITH_RUNNERS} select 'lengths_behind' as "column",
  {dbls(missing_pct='avg(case when lengths_behind is null then 100.0 else 0 end)')} from runners
union all select 'headgear', {dbls(missing_pct="avg(case when gear = '' then 100.0 else 0 end)")} from runners""")
def _(spark, sf):
    df = T.missing_share(runner_table(spark, sf), ["lengths_behind", "headgear"])
    return df.select("column", r6("missing_pct"))


@query("cheapest_price_merge", "S16 X1 T5", f"""{WITH_PREDS}, u as (select race_id, entrant_id, bsp as price from preds
  union all select race_id, entrant_id, price_300s from preds where entrant_id % 2 = 0)
select race_id, entrant_id, {dbls(price='min(price)')} from u group by 1, 2""")
def _(spark, sf):
    p = predictions(spark, sf)
    a = p.select(*KEY, F.col("bsp").alias("price"))
    b = p.where("entrant_id % 2 = 0").select(*KEY, F.col("price_300s").alias("price"), F.lit("late").alias("source"))
    return pick(T.merge_cheapest(a, b, KEY, "price"), "", "price")


# ---- joins ---------------------------------------------------------------------


def cards(spark, sf, source: str):
    """The runners as two sources print them: different case, spacing and off-time layout."""
    df = predictions(spark, sf)
    hh = F.lpad((F.col("off_minute") / 60).cast("int").cast("string"), 2, "0")
    mm = F.lpad((F.col("off_minute") % 60).cast("string"), 2, "0")
    if source == "a":
        return df.withColumn("off_time", F.concat(hh, F.lit(":"), mm))
    keep = df.where((F.col("entrant_id") + F.col("race_id")) % 4 != 0)
    return keep.select("race_id", "race_date", F.concat(F.lit(" "), F.upper("track")).alias("track"),
                       F.concat(hh, mm).alias("off_time"), F.upper("entrant_name").alias("entrant_name"), "bsp", "won")


@query("exchange_prices_attached", "J3 J2 P20 P21", f"""{WITH_PREDS} select race_id, entrant_id,
  {dbls(bsp_attached='case when (entrant_id + race_id) % 4 <> 0 then bsp end')},
  {ints(matched='(entrant_id + race_id) % 4 <> 0')} from preds""")
def _(spark, sf):
    right = cards(spark, sf, "b").withColumnRenamed("bsp", "bsp_attached")
    doubled = right.unionByName(right.where("race_id % 2 = 0").withColumn("bsp_attached", F.lit(None).cast("double")))
    df = J.attach_by_runner_keys(cards(spark, sf, "a"), doubled, ["bsp_attached"], [F.col("bsp_attached").isNull()],
                                 exchange=True, marker="matched")
    return pick(df, "matched", "bsp_attached")


@query("pedigree_filled", "J1", f"""{WITH_RUNNERS} select race_id, entrant_id, case when race_id % 3 = 0 and entrant_id % 2 = 1
  then null else sire end as sire, dam from runners""")
def _(spark, sf):
    df = runner_table(spark, sf)
    blank = df.withColumn("sire", F.when(F.col("race_id") % 3 == 0, " ").otherwise(F.col("sire")))
    ped = df.where("entrant_id % 2 = 0").select("entrant_id", "sire", "dam", "damsire").distinct()
    return J.fill_pedigree(blank, ped).select(*KEY, "sire", "dam")


@query("weather_refresh", "J6", f"""{WITH_RUNNERS} select race_id, entrant_id,
  {dbls(weight_lbs='case when entrant_id % 5 = 0 and race_id % 2 = 1 then null else weight_lbs end')},
  {ints(was_filled='entrant_id % 5 = 0 and race_id % 2 = 0')} from runners""")
def _(spark, sf):
    df = runner_table(spark, sf).select(*KEY, "weight_lbs")
    holes = df.withColumn("weight_lbs", F.when(F.col("entrant_id") % 5 != 0, F.col("weight_lbs")))
    return pick(J.fill_missing(holes, df.where("race_id % 2 = 0"), KEY, ["weight_lbs"]), "was_filled", "weight_lbs")


_REASON = """case when (entrant_id + race_id) % 4 = 0 then 'no_key_match' when entrant_id % 9 = 0 then
  'key_match_but_no_metrics' else 'key_match' end"""


@query("coverage_audit", "J11 A8", f"""{WITH_RUNNERS}, k as (select *, {_REASON} as reason from runners)
select race_type, reason, {ints(rows='count(*)')}, {dbls(pct='count(*) * 100.0 / sum(count(*)) over (partition by race_type)')}
from k group by 1, 2""")
def _(spark, sf):
    from formbook.plans.within import with_totals
    df = runner_table(spark, sf)
    cache = df.where("(entrant_id + race_id) % 4 <> 0").select(
        *KEY, F.when(F.col("entrant_id") % 9 != 0, F.col("odds")).alias("m1"), F.lit(None).cast("double").alias("m2"))
    out = J.coverage_reasons(df, cache, KEY, ["m1", "m2"]).groupBy("race_type", "reason").agg(
        F.count(F.lit(1)).alias("rows"))
    out = with_totals(out, ["race_type"], {"_t": F.sum("rows")})
    return out.select("race_type", "reason", i64("rows"), r6(F.col("rows") * 100.0 / F.col("_t"), "pct"))


@query("race_reconciliation", "J12 A9 A10 X2 X3", f"""{WITH_RUNNERS}, a as (select distinct race_date, track, race_id from runners
  where race_id % 3 <> 0 and track <> 'NATION_7'),
b as (select distinct race_date, track, race_id from runners where race_id % 5 <> 0),
g as (select race_date, track, race_id, 'right' as missing_in, (race_date, track) in (select (race_date, track) from b) as p
  from a where race_id not in (select race_id from b)
  union all select race_date, track, race_id, 'left', (race_date, track) in (select (race_date, track) from a)
  from b where race_id not in (select race_id from a))
select race_date, track, race_id, missing_in, case when p then 'partial_card' else 'whole_meeting' end as kind from g""")
def _(spark, sf):
    df = runner_table(spark, sf)
    return J.reconcile_races(df.where("race_id % 3 <> 0 and track <> 'NATION_7'"), df.where("race_id % 5 <> 0"),
                             ["race_date", "track", "race_id"], ["race_date", "track"])


@query("pending_lookups", "J21 T2", f"""{WITH_RUNNERS} select entrant_id, max(race_date) as last_seen from runners
where entrant_id % 3 <> 0 group by 1""")
def _(spark, sf):
    df = runner_table(spark, sf)
    return J.pending_entities(df, df.where("entrant_id % 3 = 0").select("entrant_id").distinct(), "entrant_id", "race_date")


@query("occurrence_alignment", "J20", f"""{WITH_RUNNERS}, a as (select *, row_number() over (partition by jockey, race_date
  order by race_id, entrant_id) as n from runners), b as (select * from a where true)
select a.race_id, a.entrant_id, {dbls(other='b.odds')} from a left join (select jockey, race_date, odds, row_number() over (
  partition by jockey, race_date order by race_id desc, entrant_id desc) as n from runners) b using (jockey, race_date, n)""")
def _(spark, sf):
    df = runner_table(spark, sf).select(*KEY, "jockey", "race_date", "odds")
    right = df.select("jockey", "race_date", (-F.col("race_id")).alias("r"), (-F.col("entrant_id")).alias("h"),
                      F.col("odds").alias("other"))
    out = J.align_occurrences(df, right, ["jockey", "race_date"], KEY, ["r", "h"], ["other"], runner_skew(spark, sf))
    return pick(out, "", "other")


@query("card_refresh_and_settlement", "J23 J24 J10 A14", f"""{WITH_PREDS}, c as (select * from preds where entrant_id % 10 <> 0),
r_ as (select * from runners where race_id % 4 <> 0 and entrant_id % 7 <> 0),
d as (select race_id from r_ group by 1 having max(finish_position) > 0),
j as (select c.race_id, c.entrant_id, case when c.race_id % 2 = 0 then c.odds + 1 else c.odds end as o, r_.finish_position as fp,
  r_.won as w, d.race_id is not null as has from c left join r_ on c.race_id = r_.race_id and c.entrant_id = r_.entrant_id
  left join d on c.race_id = d.race_id)
select race_id, entrant_id, {dbls(odds='o')}, {ints(settled='has and fp is not null', non_runner='has and fp is null',
  result_won='case when has and fp is not null then w end')} from j""")
def _(spark, sf):
    p = predictions(spark, sf)
    card = p.where("entrant_id % 10 <> 0").select(*KEY, F.when(F.col("race_id") % 2 == 0, F.col("odds") + 1).alias("odds"))
    results = runner_table(spark, sf).where("race_id % 4 <> 0 and entrant_id % 7 <> 0")
    df = J.settle_predictions(J.refresh_card(p.select(*KEY, "odds", "model_prob"), card), results)
    return pick(df, "settled non_runner result_won", "odds")


@query("shortcoming_slices", "A7 J13 F9", f"""{WITH_PREDS}, l as (select race_id, model_prob as p, won as y,
  unnest(['going', 'race_type', 'lost']) as dimension, unnest([going, race_type, case when entrant_id % 2 = 0 then 'even' end])
  as v from preds)
select dimension, coalesce(v, 'Unknown') as value, {ints(rows='count(*)', races='count(distinct race_id)', winners='sum(y)')},
  {dbls(win_rate='avg(y)', brier='avg((p - y) * (p - y))')} from l group by 1, 2""")
def _(spark, sf):
    df = predictions(spark, sf).withColumn("lost", F.when(F.col("entrant_id") % 2 == 0, "even"))
    return pick(D.slice_summary(df, ["going", "race_type", "lost"]), "rows races winners", "win_rate brier",
                ["dimension", "value"])


# ---- disagreement --------------------------------------------------------------

_DIS = f"""{WITH_PREDS}, g as (select *, least(greatest(1 / odds / sum(1 / odds) {BY_RACE}, 1e-6), 1 - 1e-6) as market_prob from preds),
x as (select *, model_prob - market_prob as disagree from g)"""


def disagreement(spark, sf):
    return D.with_disagreement(M.with_market_probs(predictions(spark, sf), skew=runner_skew(spark, sf)))


@query("disagreement_deciles", "B20 P33", f"""{_DIS}, e as (select list_sort(list_distinct(quantile_cont(round(disagree, 9),
  [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as e from x),
b as (select x.*, len(list_filter(e[2:-2], lambda q: q < round(disagree, 9))) as bucket from x, e),
s as (select bucket, count(*) as n, avg(model_prob) as mp, avg(market_prob) as kp, avg(won) as ac from b group by 1)
select {ints(bucket='bucket', n='n')}, {dbls(model_p='mp', market_p='kp', actual='ac')},
  case when abs(mp - ac) < abs(kp - ac) then 'model' else 'market' end as closer from s""")
def _(spark, sf):
    df = disagreement(spark, sf).withColumn("disagree", F.round("disagree", 9))
    out = D.disagreement_deciles(df)
    return out.select(i64("bucket"), i64("n"), r6("model_p"), r6("market_p"), r6("actual"), "closer")


@query("disagreement_direction", "B20 P32", f"""{_DIS} select case when disagree > 0 then 'likes' else 'dislikes' end as direction,
  case when abs(disagree) <= 0.02 then '0-2%' when abs(disagree) <= 0.05 then '2-5%' when abs(disagree) <= 0.1 then '5-10%'
  else '10%+' end as edge_band, {ints(n='count(*)')}, {dbls(model_p='avg(model_prob)', actual='avg(won)')}
from x where abs(disagree) > 1e-9 group by 1, 2""")
def _(spark, sf):
    return pick(D.directional_edges(disagreement(spark, sf).where("abs(disagree) > 1e-9")), "n", "model_p actual",
                ["direction", "edge_band"])


@query("weak_segments", "B20 F9 A7", f"""{_DIS}, l as (select unnest(['field_band', 'hcap', 'going', 'dist_band', 'odds_band', 'race_type', 'race_class']) as segment, unnest([
  case when num_runners <= 7 then '1-7' when num_runners <= 11 then '8-11' when num_runners <= 15 then '12-15' else '16+' end,
  case when handicap > 0 then 'Handicap' else 'Non-Hcap' end, going, case when distance_furlongs <= 0 or distance_furlongs > 99
    then null when distance_furlongs <= 6.5 then 'Sprint' when distance_furlongs <= 8.5 then 'Mile'
    when distance_furlongs <= 11.5 then 'Middle' else 'Staying' end, case when odds <= 0 then null when odds <= 3 then '<3'
    when odds <= 6 then '3-6' when odds <= 11 then '6-11' when odds <= 21 then '11-21' else '21+' end, race_type, race_class])
  as value, model_prob as m, market_prob as k, won from x)
select segment, value, {ints(n='count(*)')}, {dbls(gap='avg((m - won) * (m - won)) - avg((k - won) * (k - won))')}
from l where value is not null group by 1, 2 having count(*) >= 200""")
def _(spark, sf):
    df = D.weak_segments(D.with_bands(disagreement(spark, sf)))
    return pick(df, "n", "gap", ["segment", "value"])


@query("worst_disagreements", "T2 B20", f"""{_DIS}, z as (select *, round(disagree, 9) as dg from x),
o as (select 'over' as kind, race_id, entrant_id, dg from z where dg > 0 and won = 0 order by dg desc, race_id, entrant_id limit 15),
u as (select 'under' as kind, race_id, entrant_id, dg from z where dg < 0 and won = 1 order by dg, race_id, entrant_id limit 15)
select kind, race_id, entrant_id, {dbls(disagree='dg')} from (select * from o union all select * from u)""")
def _(spark, sf):
    df = D.worst_disagreements(disagreement(spark, sf).withColumn("disagree", F.round("disagree", 9)))
    return pick(df, "", "disagree", ["kind", *KEY])


@query("top_pick_against_favourite", "J18 W16", f"""{_DIS}, p as (select race_id,
  arg_max({{'h': entrant_id, 'w': won}}, {{'p': round(model_prob, 9), 'h': -entrant_id}}) as m,
  arg_max({{'h': entrant_id, 'w': won}}, {{'p': round(market_prob, 9), 'h': -entrant_id}}) as k from x group by 1)
select {ints(races='count(*)', agree='sum(cast(m.h = k.h as integer))')},
  {dbls(model_pick_wins='avg(case when m.h <> k.h then m.w end)', favourite_wins='avg(case when m.h <> k.h then k.w end)',
        agreed_pick_wins='avg(case when m.h = k.h then m.w end)')} from p""")
def _(spark, sf):
    df = disagreement(spark, sf).withColumn("market_prob", F.round("market_prob", 9))
    return pick(D.top_pick_against_favourite(df), "races agree", "model_pick_wins favourite_wins agreed_pick_wins", [])


@query("metric_correlations", "A18 W14", f"""{WITH_PREDS}, l as (select unnest(['odds', 'weight_lbs', 'model_prob']) as metric,
  unnest([odds, weight_lbs, model_prob]) as x, lengths_behind as y from preds where lengths_behind is not null),
k as (select *, rank() over (partition by metric order by x) + (count(*) over (partition by metric, x) - 1) / 2.0 as rx,
  rank() over (partition by metric order by y) + (count(*) over (partition by metric, y) - 1) / 2.0 as ry from l)
select metric, {ints(n='count(*)')}, {dbls(pearson='corr(x, y)', spearman='corr(rx, ry)')} from k group by 1""")
def _(spark, sf):
    return pick(D.correlations(predictions(spark, sf), ["odds", "weight_lbs", "model_prob"], "lengths_behind"), "n",
                "pearson spearman", ["metric"])


# ---- exchange ------------------------------------------------------------------

_BSP_BETS = f"""{_BETS}, eb as (select b.*, p.bsp, p.price_300s from bets b join preds p using (race_id, entrant_id)
  where p.bsp is not null)"""


def priced_bets(spark, sf):
    prices = predictions(spark, sf).select(*KEY, "bsp", "price_300s")
    return bets(spark, sf).join(prices, KEY)


@query("exchange_settlement", "B16 J3", f"""{_BSP_BETS} select strategy, {ints(bets='count(*)')}, {dbls(
  roi_sp='sum(case when won = 1 then (odds - 1) * stake else -stake end) / sum(stake)',
  roi_exchange='sum(case when won = 1 then (bsp - 1) * 0.98 * stake else -stake end) / sum(stake)')} from eb group by 1""")
def _(spark, sf):
    return pick(D.exchange_settlement(priced_bets(spark, sf)), "bets", "roi_sp roi_exchange", ["strategy"])


@query("late_price_drift", "B18", f"""{_BSP_BETS}, d as (select bsp / price_300s as d from eb where strategy = 'value'
  and price_300s > 0)
select {ints(n='count(*)')}, {dbls(median_drift='median(d)', mean_drift='avg(d)',
  shortened='avg(cast(d < 1 as integer))', drifted='avg(cast(d > 1 as integer))')} from d""")
def _(spark, sf):
    df = priced_bets(spark, sf).where("strategy = 'value'")
    return pick(D.late_drift(df), "n", "median_drift mean_drift shortened drifted", [])


_PNL_EX = "case when won = 1 then (bsp - 1) * 0.98 else -1.0 end"


@query("no_skill_baselines", "B17", f"""{WITH_PREDS}, f as (select * from preds where bsp is not null),
s as (select race_id, arg_min({_PNL_EX}, {{'b': bsp, 'h': entrant_id}}) as p from f group by 1)
select 'every_runner' as baseline, {ints(n='count(*)')}, {dbls(roi=f'avg({_PNL_EX})')} from f
union all select 'favourite', {ints(n='count(*)')}, {dbls(roi='avg(p)')} from s""")
def _(spark, sf):
    return pick(D.no_skill_baselines(predictions(spark, sf)), "n", "roi", ["baseline"])


@query("edge_over_exchange", "B19 W17", f"""{WITH_PREDS}, f as (select *, case when bsp > 1 then 1 / bsp end as r_ from preds),
g as (select *, least(greatest(r_ / sum(r_) {BY_RACE}, 1e-6), 1 - 1e-6) as x, least(greatest(model_prob, 1e-6), 1 - 1e-6) as m,
  r_ is not null as ok from f), h as (select * from g where ok and model_prob - 1 / odds > 0.05)
select {ints(n='count(*)')}, {dbls(ll_model='avg(-(won * ln(m) + (1 - won) * ln(1 - m)))',
  ll_exchange='avg(-(won * ln(x) + (1 - won) * ln(1 - x)))', brier_model='avg((m - won) * (m - won))',
  model_higher='avg(cast(m > x as integer))')} from h""")
def _(spark, sf):
    df = D.selected_edge(predictions(spark, sf), F.col("model_prob") - 1.0 / F.col("odds") > 0.05)
    return pick(df, "n", "ll_model ll_exchange brier_model model_higher", [])


@query("bootstrap_interval", "A21 B16")
def _(spark, sf):
    df = bets(spark, sf).withColumn("_key", F.concat_ws("|", "race_id", "entrant_id"))
    return pick(D.bootstrap_interval(df, "pnl", "_key", ["strategy"]), "", "low high", ["strategy"])


@query("source_validation", "J22 X3 A18", f"""{WITH_PREDS}, b as (select * from preds where race_id % 3 <> 0
  and entrant_id % 8 <> 0 and bsp is not null), s as (select * from preds where race_id in (select race_id from b)),
m as (select s.odds, b.bsp as p, b.race_id is not null as hit from s left join b using (race_id, entrant_id)),
k as (select odds, p, rank() over (order by odds) + (count(*) over (partition by odds) - 1) / 2.0 as ra,
  rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rb from m where hit)
select {dbls(match_rate='(select avg(cast(hit as integer)) from m)', outcome_agreement='1.0',
  median_a='(select median(odds) from m where hit)', median_b='(select median(p) from m)',
  rank_corr='(select corr(ra, rb) from k)')}""")
def _(spark, sf):
    p = predictions(spark, sf)
    b = p.where("race_id % 3 <> 0 and entrant_id % 8 <> 0 and bsp is not null")
    return pick(D.source_agreement(p, b, KEY, "odds", "bsp"), "", "match_rate outcome_agreement median_a median_b "
                                                                  "rank_corr", [])


# ---- signals and trades --------------------------------------------------------

_SIG = f"""with {BOOK_SQL}, a as (select *, coalesce(best_back_odds, best_lay_odds) as an from book),
p as (select *, case when an > 1 then 1 / an else 0.01 end as r_ from a),
w as (select *, r_ / sum(r_) over (partition by event_id) as wp from p),
s as (select *, coalesce(wp - 1 / best_back_odds >= 0.02 and best_back_available >= 10, false) as bk,
  coalesce(1 / best_lay_odds - wp >= 0.02 and best_lay_available >= 10, false) as ly from w)"""


def signals(spark, sf):
    book = N.flatten_order_book(order_books(spark, sf)).select(
        "event_id", "entrant_name", "best_back_odds", "best_back_available", "best_lay_odds", "best_lay_available")
    return D.price_signals(D.market_probabilities(book))


@query("price_signals", "B21 J15", f"""{_SIG} select event_id, entrant_name, {dbls(win_probability='wp', fair_odds=
  '1 / greatest(wp, 1e-9)', spread='best_lay_odds / best_back_odds - 1')},
  case when bk and ly then 'BACK / LAY' when bk then 'BACK' when ly then 'LAY' else '' end as signal from s""")
def _(spark, sf):
    return signals(spark, sf).select("event_id", "entrant_name", r6("win_probability"), r6("fair_odds"), r6("spread"), "signal")


@query("paper_trades_settled", "B22 B23 J14 U6", f"""{_SIG}, t as (select event_id, entrant_name, 'BACK' as side,
    best_back_odds as eo from s where bk union all select event_id, entrant_name, 'LAY', best_lay_odds from s where ly),
n as (select t.*, cast(replace(entrant_name, 'Entrant ', '') as bigint) % 4 as w, event_id % 3 <> 0 as has from t)
select event_id, entrant_name, side, case when has then 'SETTLED' else 'OPEN' end as status,
  {dbls(pnl="case when has then (case when w = 0 then eo - 1 else -1 end) * (case when side = 'BACK' then 1 else -1 end) end")}
from n""")
def _(spark, sf):
    trades = D.trades_from_signals(signals(spark, sf))
    entrant = F.regexp_extract("entrant_name", r"(\d+)", 1).cast("long")
    results = signals(spark, sf).where("event_id % 3 <> 0").select(
        "event_id", "entrant_name", F.lit(1).alias("finish_position"), (entrant % 4 == 0).cast("int").alias("won"))
    df = D.settle_trades(trades, results, ["event_id", "entrant_name"])
    return df.select("event_id", "entrant_name", "side", "status", r6("pnl"))


@query("trade_ledger", "S20", f"""{_SIG}, t as (select event_id, entrant_name, 'BACK' as side, best_back_odds as eo, event_id % 4 as part from s where bk
  union all select event_id, entrant_name, 'LAY', best_lay_odds, event_id % 4 from s where ly)
select 'part-' || part as batch_id, event_id, entrant_name, side, {dbls(odds='eo')} from t where part < 3""")
def _(spark, sf):
    """Trades appended in three batches, each twice, beside a batch that was never committed."""
    folder = f"{checkpoint_root(spark)}/ledger-{uuid.uuid4().hex}"
    path = f"{folder}-trades"
    D.trades_from_signals(signals(spark, sf)).write.parquet(path)
    trades = spark.read.parquet(path)
    for k in (0, 1, 2, 1, 0, 2):
        T.append_once(trades.where(F.col("event_id") % 4 == k), folder, f"part-{k}")
    trades.where(F.col("event_id") % 4 == 3).withColumn("batch_id", F.lit("part-3")).write.parquet(f"{folder}/rows/part-3")
    return T.ledger(spark, folder).select("batch_id", "event_id", "entrant_name", "side", r6("entry_odds", "odds"))


_CSV_INTS, _CSV_DOUBLES = "num_runners age draw handicap finish_position won", "distance_furlongs prize_money weight_lbs odds lengths_behind"


@query("csv_round_trip", "S1 S9", f"""{WITH_RUNNERS} select cast(race_id as varchar) as race_id, cast(entrant_id as varchar) as entrant_id, track, going, cast(jockey as varchar) as jockey, cast(trainer as varchar) as trainer,
  {ints(**{c: c for c in _CSV_INTS.split()})}, {dbls(**{c: c for c in _CSV_DOUBLES.split()})}, cast(0 as bigint) as bad from runners
union all select null, null, null, null, null, null, {', '.join('null' for _ in (_CSV_INTS + ' ' + _CSV_DOUBLES).split())}, count(*) from runners where race_id % 50 = 0""")
def _(spark, sf):
    """The runner table written as CSV beside lines with text where numbers belong, and read back."""
    path = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    runners = runner_table(spark, sf)
    named = [f.name for f in T.RAW_SCHEMA if f.name in runners.columns]
    text = runners.select(*[F.col(c).cast("string").alias(c) for c in named])
    broken = text.where(F.col("race_id").cast("long") % 50 == 0).withColumn("age", F.lit("old"))
    T.write_csv(text.unionByName(broken), path)
    schema = type(T.RAW_SCHEMA)([f for f in T.RAW_SCHEMA if f.name in named])
    T.read_csv(spark, path, schema).write.parquet(f"{path}-read")  # parsed once, then split
    df = spark.read.parquet(f"{path}-read")
    good = pick(df.where(F.col(T.BAD_RECORD).isNull()).withColumn("bad", F.lit(0)), _CSV_INTS + " bad", _CSV_DOUBLES, [*KEY, "track", "going", "jockey", "trainer"])
    bad = df.where(F.col(T.BAD_RECORD).isNotNull()).agg(F.count(F.lit(1)).alias("bad"))
    return good.unionByName(bad, allowMissingColumns=True).select(*good.columns)


# ---- runs, races, pace ---------------------------------------------------------


@query("fold_rollup", "A11 A12 A13", f"""{_BETS}, f as (select strategy, date_trunc('month', race_date) as fold, count(*) as n,
  sum(pnl) as p, sum(stake) as s, sum(won) as w from bets group by 1, 2)
select strategy, {ints(folds='count(*)', bets='sum(n)', winners='sum(w)', profitable_folds='sum(cast(p > 0 as integer))')},
  {dbls(pnl='sum(p)', roi='sum(p) / sum(s) * 100', mean_fold_roi='avg(p / s * 100)')} from f group by 1""")
def _(spark, sf):
    return pick(D.fold_rollup(bets(spark, sf)), "folds bets winners profitable_folds", "pnl roi mean_fold_roi", ["strategy"])


@query("combined_fold_roi", "A13 A14", f"""{_BETS} select date_trunc('month', race_date)::date as fold,
  {dbls(value_pnl="sum(case when strategy = 'value' then pnl else 0 end)",
        each_way_stake="sum(case when strategy = 'each_way' then stake else 0 end)", pnl='sum(pnl)', staked='sum(stake)',
        roi='sum(pnl) / sum(stake) * 100')} from bets group by 1""")
def _(spark, sf):
    return pick(D.combined_roi(bets(spark, sf)), "", "value_pnl each_way_stake pnl staked roi", ["fold"])


@query("race_headers", "A10 A15 A24", f"""{WITH_RUNNERS} select race_id, min(race_date) as race_date, any_value(track) as track,
  any_value(race_class) as race_class, {ints(off_minute='min(off_minute)', runners='count(*)')},
  max(case when won = 1 then entrant_name end) as winner from runners group by 1""")
def _(spark, sf):
    df = D.race_headers(runner_table(spark, sf))
    return df.select("race_id", "race_date", "track", "race_class", i64("off_minute"), i64("runners"), "winner")


@query("yearly_ranges", "A23", f"""{WITH_RUNNERS} select {ints(year='year(race_date)')}, min(race_date) - 3 as start,
  max(race_date) as "end" from runners group by year(race_date)""")
def _(spark, sf):
    return D.yearly_ranges(runner_table(spark, sf)).select(i64("year"), "start", "end")


@query("grid_heatmap", "A16", f"""{_PRE}, {PATH_KEYS_SQL} select value_threshold, {dbls(
  **{f'c_{k}_0': f'max(case when min_odds = {k} then pnl end)' for k in range(2, 7)})} from vh group by 1""")
def _(spark, sf):
    pre = G.analysis_columns(predictions(spark, sf), skew=runner_skew(spark, sf))
    df = D.parameter_heatmap(G.grid_search_flat(pre), "value_threshold", "min_odds", G.DEFAULT_GRID["min_odds"], "value_pnl")
    return pick(df, "", "c_2_0 c_3_0 c_4_0 c_5_0 c_6_0", ["value_threshold"])


@query("pace_report", "B26", f"""{PACE_SQL}, g as (select *, coalesce(fr, false) as a, coalesce(fr, false) and nf_ = 1 as l,
  coalesce(cl, false) as c, coalesce(greatest(bias, 0) * nf_ / num_runners >= 0.08, false) as u from f)
select race_id, entrant_id, {ints(pace_role='a::int + 2 * l::int + 4 * c::int + 8 * u::int', n_pushers='nf_',
  n_closers=f'sum(c::int) {BY_RACE}', pace_state='case when nf_ = 1 then 2 when nf_ >= 3 then 1 else 0 end')} from g""")
def _(spark, sf):
    from formbook.catalog.features_race import _with_metrics
    skew = runner_skew(spark, sf)
    df = R.add_pace_style_features(V.add_speed_metric_features(_with_metrics(spark, sf), skew), skew)
    return D.pace_roles(df).join(D.pace_shape(df), "race_id").select(
        *KEY, i64("pace_role"), i64("n_pushers"), i64("n_closers"), i64("pace_state"))


@query("metric_tables", "M16 M29 M30 M35 A17", f"""{WITH_PREDS}, b as (select 'model' as model, avg((model_prob - won) *
  (model_prob - won)) as brier_score, avg(won * model_prob) as roi from preds union all select 'market', avg((1 / odds - won) *
  (1 / odds - won)), avg(won / odds) from preds)
select model, {dbls(brier_score='brier_score', roi='roi')} from b union all select 'market - model', {dbls(
  brier_score="max(case when model = 'market' then brier_score end) - max(case when model = 'model' then brier_score end)",
  roi="max(case when model = 'market' then roi end) - max(case when model = 'model' then roi end)")} from b""")
def _(spark, sf):
    p = predictions(spark, sf)
    q = 1.0 / F.col("odds")
    nested = F.to_json(F.struct(*[F.struct(
        F.struct(F.avg((c - F.col("won")) * (c - F.col("won"))).alias("brier_score"), F.avg(c * F.col("won")).alias("roi"))
        .alias("scores")).alias(n) for n, c in (("model", F.col("model_prob")), ("market", q))]))
    flat = M.flatten_metrics(p.agg(nested.alias("json")), "json", [])
    parts = F.split("name", r"\.")
    rows = flat.select(parts[0].alias("model"), parts[2].alias("name"), "value")
    return pick(M.metric_snapshot(rows, ["brier_score", "roi"], "model", "market"), "", "brier_score roi", ["model"])


@query("model_gap_tables", "M29 M30", f"""{WITH_PREDS}, l as (select year(race_date) as y, unnest(['brier_score', 'roi']) as name,
  unnest([(model_prob - won) * (model_prob - won), model_prob * won]) as v, unnest([(1 / odds - won) * (1 / odds - won),
  won / odds]) as k from preds),
t as (select name, avg(v) filter (y < 1999) as oof, avg(v) filter (y >= 1999) as va, avg(v) as a, avg(k) as b from l group by 1)
select name, {dbls(gap="case when name = 'roi' then oof - va else va - oof end",
  edge="case when name = 'roi' then a - b else b - a end")},
  case when (case when name = 'roi' then a - b else b - a end) > 0 then 'left' else 'right' end as leader,
  case when g >= 0.15 then 'high' when g >= 0.08 then 'moderate' when g >= 0.03 then 'watch' else 'healthy' end as status
from (select *, case when name = 'roi' then oof - va else va - oof end as g from t)""")
def _(spark, sf):
    y, p = F.col("won"), F.col("model_prob")
    q = 1.0 / F.col("odds")

    def values(df, c):
        return df.agg(F.avg((c - y) * (c - y)).alias("brier_score"), F.avg(c * y).alias("roi")).unpivot(
            [], ["brier_score", "roi"], "name", "value")

    df = predictions(spark, sf)
    gap = M.generalisation_gap(values(df.where("year(race_date) < 1999"), p), values(df.where("year(race_date) >= 1999"), p))
    edge = M.model_tradeoff(values(df, p), values(df, q))
    return gap.join(edge, "name").select("name", r6("gap"), r6("edge"), "leader", "status")


@query("metric_trend", "M30 W8", f"""{WITH_PREDS}, m as (select date_trunc('month', race_date)::date as run,
  avg((model_prob - won) * (model_prob - won)) as v from preds group by 1)
select run, {dbls(value='v', change='v - lag(v) over (order by run)')} from m""")
def _(spark, sf):
    p = (F.col("model_prob") - F.col("won")) * (F.col("model_prob") - F.col("won"))
    runs = predictions(spark, sf).groupBy(F.trunc("race_date", "month").cast("date").alias("run")).agg(
        F.avg(p).alias("value")).withColumn("name", F.lit("brier"))
    return pick(M.metric_trend(runs, "run"), "", "value change", ["run"])
