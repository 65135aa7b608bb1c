"""Ratings, swept day by day.

Sweeps are compared at three decimals: a daily sweep multiplies what two engines round differently."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.features_entrant import KEY, _DC, dbls, ints, pick
from formbook.catalog.history import history_base
from formbook.catalog.registry import WITH_FLAGS, WITH_RUNNERS, query, runner_skew
from formbook.features.entrant import add_opposition_strength_features, distance_category
from formbook.operators import ratings as A

EXP = "1 / (1 + pow(10.0, (b.rating - a.rating) / 400.0))"


def base(spark, sf):
    return history_base(spark, sf).withColumn("dist_category", distance_category())


# Ratings before a race, derived from the keys: the input of a one-race update.
_PRE = f"""{WITH_RUNNERS}, p as (select *, cast(1400 + entrant_id * 37 % 200 as double) as rating, entrant_id % 40 as runs,
  cast(60 + entrant_id % 90 as double) as rd, max(case when finish_position > 0 then lengths_behind end) over (partition by
  race_id) as far from runners), f as (select *, count(*) over (partition by race_id) as n from p where finish_position > 0)"""


def one_race(spark, sf, margin: bool):
    rows = A.rating_rows(base(spark, sf), [A.Pool("x", "entrant_id", margin=margin)], runner_skew(spark, sf))
    h = F.col("entrant_id")
    return rows.select("*", (1400 + h * 37 % 200).cast("double").alias("rating"), (h % 40).alias("runs"), (60 + h % 90).cast("double").alias("rd"))


@query("elo_race_update", "R1 R2 J8", f"""{_PRE} select a.race_id, a.entrant_id, {dbls(delta=f'(8 + 8 * exp(-0.05 * any_value(a.runs))) '
  f'/ (any_value(a.n) - 1) * sum(case when a.finish_position < b.finish_position then 1.0 when a.finish_position = '
  f'b.finish_position then 0.5 else 0 end - {EXP})')}
from f a join f b on a.race_id = b.race_id and a.entrant_id <> b.entrant_id group by 1, 2""")
def _(spark, sf):
    return pick(A.elo_race(one_race(spark, sf, False), runner_skew(spark, sf)).where("active"), "", "delta")


@query("margin_elo_race_update", "R3 R4", f"""{_PRE}, g as (select *, case when finish_position > 0 then lengths_behind
  else coalesce(far, 0) + 30 end as v, 3.0 * distance_furlongs / 8.0 as sc, count(*) over (partition by race_id) as m from p)
select a.race_id, a.entrant_id, {dbls(delta=f'(8 + 8 * exp(-0.05 * any_value(a.runs))) / (any_value(a.m) - 1) * sum(0.5 + '
  f'sign(b.v - a.v) * 0.5 * (1 - exp(-abs(b.v - a.v) / a.sc)) - {EXP})')}
from g a join g b on a.race_id = b.race_id and a.entrant_id <> b.entrant_id group by 1, 2""")
def _(spark, sf):
    return pick(A.elo_race(one_race(spark, sf, True), runner_skew(spark, sf)).where("active"), "", "delta")


_G = "(1 / sqrt(1 + 3 * q * q * b.rd * b.rd / (pi() * pi())))"
_E = f"(1 / (1 + pow(10.0, {_G} * (b.rating - a.rating) / 400.0)))"


@query("glicko_race_update", "R9", f"""{_PRE}, c as (select *, ln(10.0) / 400.0 as q from f),
s as (select a.race_id, a.entrant_id, any_value(a.q) as q, any_value(a.rd) as rd, any_value(a.rating) as rating,
  sum({_G.replace('q', 'a.q')} * {_G.replace('q', 'a.q')} * {_E.replace('q * q', 'a.q * a.q')} * (1 - {_E.replace('q * q', 'a.q * a.q')})) as info,
  sum({_G.replace('q', 'a.q')} * (case when a.finish_position < b.finish_position then 1.0 else 0 end - {_E.replace('q * q', 'a.q * a.q')})) as gain
  from c a join c b on a.race_id = b.race_id and a.entrant_id <> b.entrant_id group by 1, 2)
select race_id, entrant_id, {dbls(new_rating='rating + q / (1 / (rd * rd) + q * q * info) * gain',
  new_rd='least(greatest(sqrt(1 / (1 / (rd * rd) + q * q * info)), 50), 350)')} from s""".replace(" sa.qrt(", " sqrt("))
def _(spark, sf):
    df = A.glicko_race(one_race(spark, sf, False), runner_skew(spark, sf)).where("active")
    rating, rd = A.glicko_update(F.col("rating"), F.col("rd"), F.col("info"), F.col("gain"), F.sqrt)
    df = df.withColumns({"new_rating": rating, "new_rd": F.least(F.greatest(rd, F.lit(A.RD_MIN)), F.lit(A.RD_START))})
    return pick(df, "", "new_rating new_rd")


def daily_sql(columns: str, fresh: str, grown: str, pair: str, after: str, state: str) -> str:
    """A sweep day by day: ``sweep`` keeps the newest state of each entity ('e') and each runner's morning state ('r').

    ``b`` holds the runners by day number.  ``fresh`` and ``grown`` are the morning state of new and
    known entities, ``pair`` the sums over a runner's opponents, ``after`` the state after the day.
    """
    return f"""days as materialized (select race_date, row_number() over (order by race_date) as d from (select distinct race_date from b0)),
b as materialized (select b0.*, d, count(v) over (partition by dm, race_id) as n from b0 join days using (race_date)),
sweep(kind, k1, k2, step, {columns}) using key (kind, k1, k2) as (
  select '' as kind, '' as k1, '' as k2, 0::bigint as step, {fresh}
  union
  (with s as (select max(step) + 1 as s from sweep),
  c as materialized (select b.*, {grown} from b left join recurring.sweep o on o.kind = 'e' and o.k1 = b.e and o.k2 = b.dm where d = (select s from s)),
  p as (select a.race_id, a.entrant_id, {pair} from c a join c b on a.race_id = b.race_id and a.dm = b.dm
    where a.v is not null and b.v is not null and a.n >= 2 group by a.race_id, a.entrant_id, a.dm),
  a as (select c.e, c.dm, any_value(c.d) as step, any_value(race_date) as day, {after} from c join p using (race_id, entrant_id) group by c.e, c.dm)
  select 'r', race_id::varchar, entrant_id::varchar, d, {state.replace('@', 'c')} from c
  union all select 'e', e, dm, step, {state.replace('@', 'a')} from a)),
res as (select k1::bigint as race_id, k2::bigint as entrant_id, {columns} from sweep where kind = 'r'),
fin as (select k1 as entity, k2 as dim, {columns} from sweep where kind = 'e')"""


def entrants_sql(value: str, entity: str, dim: str) -> str:
    """``b0``: whom a pool rates in which race, and by which value."""
    return f"""b0 as materialized (select race_id, entrant_id, race_date, cast({entity} as varchar) as e, {dim} as dm, {value} as v,
  3.0 * distance_furlongs / 8.0 as sc from r_)"""


def elo_sql(value: str, entity: str, dim: str, score: str) -> str:
    delta = f"(8 + 8 * exp(-0.05 * any_value(a.runs))) / (any_value(a.n) - 1) * sum(case when a.e <> b.e then {score} - {EXP} else 0 end) as delta"
    return entrants_sql(value, entity, dim) + ",\n" + daily_sql(
        "rating, runs", "1500.0::double as rating, 0::bigint as runs", "coalesce(o.rating, 1500.0) as rating, coalesce(o.runs, 0) as runs",
        delta, "any_value(c.rating) + sum(delta) as rating, any_value(c.runs) + count(*) as runs", "@.rating, @.runs")


_RANK = "case when a.v < b.v then 1.0 when a.v = b.v then 0.5 else 0 end"
_R = f"{WITH_FLAGS.replace('with ', 'with recursive ', 1)}, r_ as (select *, {_DC} as dc, max(case when fp > 0 then lengths_behind end) over (partition by race_id) as far from r)"


DIGITS = 3


def sweep(spark, sf, pool):
    rows, _ = A.rate_history(base(spark, sf), "elo", [pool])
    return pick(rows, "runs", "rating", digits=DIGITS)


_SHOWN = f"select race_id, entrant_id, {ints(runs='runs')}, {dbls(DIGITS, rating='rating')} from res"


@query("elo_entrant", "R5 R2 D3", f"""{_R}, {elo_sql('fp', 'entrant_id', "'all'", _RANK)} {_SHOWN}""")
def _(spark, sf):
    return sweep(spark, sf, A.Pool("entrant", "entrant_id"))


@query("elo_jockey_by_race_type", "R7 Q15", f"""{_R}, {elo_sql('fp', 'jockey', 'race_type', _RANK)} {_SHOWN}""")
def _(spark, sf):
    return sweep(spark, sf, A.Pool("jockey_rt", "jockey", "race_type"))


_MARGIN = "0.5 + sign(b.v - a.v) * 0.5 * (1 - exp(-abs(b.v - a.v) / a.sc))"
_LENGTHS = "case when fp >= 1 then lengths_behind else coalesce(far, 0) + 30 end"


@query("elo_margin", "R4 R5", f"""{_R}, {elo_sql(_LENGTHS, 'entrant_id', "'all'", _MARGIN)} {_SHOWN}""")
def _(spark, sf):
    return sweep(spark, sf, A.Pool("margin", "entrant_id", margin=True))


@query("elo_features", "R5 R6 R7 R8 E29 W19 J9")
def _(spark, sf):
    df = base(spark, sf)
    rows, _ = A.rate_history(df, "elo", A.ELO_POOLS)
    df = A.add_elo_features(df, rows, runner_skew(spark, sf))
    df = add_opposition_strength_features(df, runner_skew(spark, sf))
    return pick(df, "has_entrant_elo entrant_elo_rank entrant_elo_top",
                "entrant_elo jockey_elo trainer_elo entrant_elo_vs_field combined_elo entrant_elo_momentum entrant_margin_elo "
                "entrant_elo_surface_edge jockey_elo_rt_edge opposition_elo field_avg_elo_5 elo_vs_field_ewma", digits=DIGITS)


_QG = "(ln(10.0) / 400.0)"
_GD = f"(1 / sqrt(1 + 3 * {_QG} * {_QG} * b.rd * b.rd / (pi() * pi())))"
_ED = f"(1 / (1 + pow(10.0, {_GD} * (b.rating - a.rating) / 400.0)))"
_WEIGHT = f"(1 / (any_value(c.rd) * any_value(c.rd)) + {_QG} * {_QG} * sum(info))"
_GLICKO = entrants_sql("fp", "entrant_id", "'all'") + ",\n" + daily_sql(
    "rating, rd, runs, last", "1500.0::double as rating, 350.0::double as rd, 0::bigint as runs, null::date as last",
    """coalesce(o.rating, 1500.0) as rating, coalesce(least(sqrt(o.rd * o.rd + 4900.0 * date_diff('day', o.last, race_date) / 30.44), 350.0), 350.0) as rd,
    coalesce(o.runs, 0) as runs, o.last""",
    f"sum(case when a.e <> b.e then {_GD} * {_GD} * {_ED} * (1 - {_ED}) else 0 end) as info, sum(case when a.e <> b.e then {_GD} * ({_RANK} - {_ED}) else 0 end) as gain",
    f"""any_value(c.rating) + {_QG} / {_WEIGHT} * sum(gain) as rating, least(greatest(sqrt(1 / {_WEIGHT}), 50.0), 350.0) as rd,
    any_value(c.runs) + count(*) as runs, any_value(race_date) as last""", "@.rating, @.rd, @.runs, @.last")


@query("glicko_features", "R10 R13", f"""{_R}, {_GLICKO},
g as (select race_id, entrant_id, round(rating, 6) as rating, rd, runs from res),
m as (select *, avg(rating) over (partition by race_id) as fr, avg(rd) over (partition by race_id) as fd from g)
select race_id, entrant_id, {ints(has_entrant_glicko='case when runs > 0 then 1 else 0 end', entrant_glicko_rank='rank() over (partition by race_id order by rating desc)')},
  {dbls(DIGITS, entrant_glicko='rating', entrant_glicko_rd='rd', entrant_glicko_lcb='rating - rd', entrant_glicko_vs_field='rating - fr',
        entrant_glicko_rd_vs_field='rd - fd')} from m""")
def _(spark, sf):
    df = base(spark, sf)
    rows, _ = A.rate_history(df, "glicko", [A.Pool("entrant", "entrant_id")])
    rows = rows.withColumn("rating", F.round("rating", 6))  # equal ratings tie whatever the order of their sums
    df = A.add_glicko_features(df, rows, runner_skew(spark, sf))
    return pick(df, "has_entrant_glicko entrant_glicko_rank", "entrant_glicko entrant_glicko_rd entrant_glicko_lcb "
                                                          "entrant_glicko_vs_field entrant_glicko_rd_vs_field", digits=DIGITS)


@query("glicko2_ratings", "R11 D3")
def _(spark, sf):
    rows, _ = A.rate_history(base(spark, sf), "glicko2", [A.Pool("entrant", "entrant_id")])
    return pick(rows, "runs", "mu phi sigma")


@query("skill_ratings", "R12 D3")
def _(spark, sf):
    rows, _ = A.rate_history(base(spark, sf), "skill", [A.Pool("entrant", "entrant_id")])
    return pick(rows, "runs", "mu sigma")


def final_sql(entity: str) -> str:
    """States of an Elo pool after the last day."""
    return f"""{_R}, {elo_sql('fp', entity, "'all'", _RANK)} select entity, {ints(runs='runs')}, {dbls(DIGITS, rating='rating')} from fin"""


@query("rating_state_resumed", "R14 U1", final_sql("trainer"))
def _(spark, sf):
    """State after the first years, handed to a second sweep over the rest."""
    df = base(spark, sf)
    pools = [A.Pool("trainer", "trainer")]
    _, state = A.rate_history(df.where("race_date < '1998-01-01'"), "elo", pools)
    _, state = A.rate_history(df.where("race_date >= '1998-01-01'"), "elo", pools, seed=state)
    return pick(state, "runs", "rating", ["entity"], digits=DIGITS)
