from datetime import date, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.operators import betting as B


def test_daily_totals_make_every_bet_once(spark):
    made = spark.sparkContext.accumulator(0)

    def strategy(_: int) -> str:
        made.add(1)
        return "value"

    i = F.col("id")
    bets = spark.range(40).select(
        F.udf(strategy, T.StringType())(i).alias("strategy"), F.date_add(F.lit(date(2001, 1, 1)), (i % 4).cast("int")).alias("race_date"),
        i.cast("double").alias("pnl"), (i % 2).cast("int").alias("won"))
    got = {r.race_date: (r.daily_pnl, r.daily_bets, r.cum_pnl) for r in B.daily_pnl(bets).collect()}
    days = [date(2001, 1, 1) + timedelta(k) for k in range(4)]
    assert got == {d: (180.0 + 10 * k, 10, sum(180.0 + 10 * j for j in range(k + 1))) for k, d in enumerate(days)}
    assert made.value == 40
