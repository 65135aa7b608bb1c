"""A deterministic model output over the runner table: odds tilted by key arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.plans.within import with_totals


def hundredths(c: Column) -> Column:
    return F.floor(c * 100) / F.lit(100.0)


def with_predictions(runners: DataFrame, skew=None) -> DataFrame:
    """Add ``model_prob`` (sums to 1 in a race), ``place_prob``, ``score`` and exchange prices."""
    h, r = F.col("entrant_id"), F.col("race_id")
    raw = (1.0 / F.col("odds")) * (1.0 + ((h * 31 + r * 17) % 81 - 40) / F.lit(100.0))
    df = with_totals(runners.withColumn("_raw", raw), ["race_id"], {"_tot": F.sum("_raw")}, skew)
    # Nine digits: equal chances compare equal whatever order the total was summed in.
    p = F.round(F.col("_raw") / F.col("_tot"), 9)
    bsp = F.when((h + r) % 5 != 0, hundredths(F.col("odds") * (1.0 + ((h * 7 + r) % 21 - 8) / F.lit(50.0))))
    return df.select(
        *runners.columns, p.alias("model_prob"),
        F.least(F.lit(0.95), p * 2.2 + 0.02).alias("place_prob"),
        (h * 13 % 29 + r % 7 + 10 * p).cast("double").alias("score"),
        bsp.alias("bsp"), hundredths(bsp * (1.0 + ((h + r * 3) % 11 - 5) / F.lit(100.0))).alias("price_300s"))


PREDICTIONS_SQL = """
raw_ as (select *, (1.0 / odds) * (1.0 + ((entrant_id * 31 + race_id * 17) % 81 - 40) / cast(100 as double)) as raw_p
  from runners),
tot_ as (select *, round(raw_p / sum(raw_p) over (partition by race_id), 9) as model_prob from raw_),
preds as (select * exclude (raw_p), least(0.95, model_prob * 2.2 + 0.02) as place_prob,
  cast(entrant_id * 13 % 29 + race_id % 7 + 10 * model_prob as double) as score,
  case when (entrant_id + race_id) % 5 <> 0 then floor(odds * (1.0 + ((entrant_id * 7 + race_id) % 21 - 8)
    / cast(50 as double)) * 100) / cast(100 as double) end as bsp,
  case when (entrant_id + race_id) % 5 <> 0 then floor(floor(odds * (1.0 + ((entrant_id * 7 + race_id) % 21 - 8)
    / cast(50 as double)) * 100) / cast(100 as double) * (1.0 + ((entrant_id + race_id * 3) % 11 - 5)
    / cast(100 as double)) * 100) / cast(100 as double) end as price_300s
  from tot_)
"""
