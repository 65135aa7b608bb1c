"""Queries over a runner's own past."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.registry import WITH_FLAGS, i64, query, r6, r6_sql, runner_skew, runner_table
from formbook.features.flags import ORDER, add_result_flags
from formbook.functions.numeric import rate, shrink
from formbook.plans.ewma import with_ewma
from formbook.plans.ordered import Rolling, Running, ordered
from formbook.plans.within import with_ranks


def history_base(spark, sf):
    return add_result_flags(runner_table(spark, sf))


HW = "partition by entrant_id order by race_date, race_id"
PRIOR = f"({HW} rows between unbounded preceding and 1 preceding)"


@query("prior_win_rate_in_race", "W1 P39 W14", f"""{WITH_FLAGS},
w as (select race_id, entrant_id, coalesce(sum(rs) over {PRIOR}, 0) as runs, coalesce(sum(won) over {PRIOR}, 0) as wins
      from r),
s as (select *, (runs * (case when runs > 0 then cast(wins as double) / runs else 0 end) + 0.8) / (runs + 8.0)
        as shrunk from w)
select race_id, entrant_id, cast(runs as bigint) as runs, cast(wins as bigint) as wins,
  {r6_sql('shrunk', 'win_rate_shrunk')},
  rank() over (partition by race_id order by round(cast(shrunk as double) + 3.1415926e-8, 6) desc) as race_rank from s""")
def _(spark, sf):
    skew = runner_skew(spark, sf)
    df = history_base(spark, sf).select("race_id", "race_date", "entrant_id", "rs", "won")
    df = ordered(df, ["entrant_id"], ORDER, {
        "runs": Running("sum", F.col("rs")), "wins": Running("sum", F.col("won"))}, skew)
    df = df.fillna(0, ["runs", "wins"])
    df = df.withColumn("win_rate_shrunk", r6(shrink(rate("wins", "runs"), "runs", 0.10, 8.0), "win_rate_shrunk"))
    df = with_ranks(df, ["race_id"], {"race_rank": ("min", "win_rate_shrunk", True)}, skew=skew)
    return df.select("race_id", "entrant_id", i64("runs"), i64("wins"), "win_rate_shrunk", i64("race_rank"))


@query("rolling_form", "W3", f"""{WITH_FLAGS}
select race_id, entrant_id,
  {r6_sql('avg(fp) over (' + HW + ' rows between 3 preceding and 1 preceding)', 'avg_pos_3')},
  {r6_sql('avg(fp) over (' + HW + ' rows between 10 preceding and 1 preceding)', 'avg_pos_10')},
  cast(sum(won) over ({HW} rows between 20 preceding and 1 preceding) as bigint) as wins_20,
  cast(min(fp) over ({HW} rows between 5 preceding and 1 preceding) as bigint) as best_5,
  cast(max(fp) over ({HW} rows between 5 preceding and 1 preceding) as bigint) as worst_5,
  {r6_sql('stddev_samp(fp) over (' + HW + ' rows between 5 preceding and 1 preceding)', 'std_5')}
from r""")
def _(spark, sf):
    fp = F.col("fp")
    df = ordered(history_base(spark, sf), ["entrant_id"], ORDER, {
        "avg_pos_3": Rolling("mean", fp, 3), "avg_pos_10": Rolling("mean", fp, 10),
        "wins_20": Rolling("sum", F.col("won_hist"), 20), "best_5": Rolling("min", fp, 5),
        "worst_5": Rolling("max", fp, 5), "std_5": Rolling("std", fp, 5)}, runner_skew(spark, sf))
    return df.select("race_id", "entrant_id", r6("avg_pos_3"), r6("avg_pos_10"), i64("wins_20"), i64("best_5"),
                     i64("worst_5"), r6("std_5"))


# s = sum of weights * value over the entrant's earlier finishes, newest heaviest.
@query("ewma_form", "W4 D2", f"""{WITH_FLAGS},
n as (select race_id, entrant_id, race_date, fp, count(fp) over {PRIOR} as m from r),
t as (select *, exp(m * ln(2.0) / 3) * fp * (case when m = 0 then 1 else 1 - exp(-ln(2.0) / 3) end) as w3,
             exp(m * ln(2.0) / 7) * fp * (case when m = 0 then 1 else 1 - exp(-ln(2.0) / 7) end) as w7 from n)
select race_id, entrant_id,
  {r6_sql(f'sum(w3) over {PRIOR} * exp(-(m - 1) * ln(2.0) / 3)', 'ewma_pos_3')},
  {r6_sql(f'sum(w7) over {PRIOR} * exp(-(m - 1) * ln(2.0) / 7)', 'ewma_pos_7')}
from t""")
def _(spark, sf):
    df = with_ewma(history_base(spark, sf), ["entrant_id"], ORDER,
                   {"ewma_pos_3": ("fp", 3), "ewma_pos_7": ("fp", 7)}, runner_skew(spark, sf))
    return df.select("race_id", "entrant_id", r6("ewma_pos_3"), r6("ewma_pos_7"))
