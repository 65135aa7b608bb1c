"""Curves of many bets: stored once, and the same whatever the ranges they are dealt by."""

import random

import pytest
from pyspark.sql import functions as F

from formbook.operators.betting import with_curves
from formbook.operators.grid import grid_drawdowns
from formbook.plans.skew import SkewProfile


@pytest.fixture(scope="module")
def bets(spark):
    rnd = random.Random(8)
    rows = [(i // 9, i // 3, i, rnd.choice([3.0, 4.5, 8.0, 25.0, 60.0]), rnd.uniform(-0.02, 0.2), float(rnd.randint(-3, 4))) for i in range(400)]
    return spark.createDataFrame(rows, "race_date int, race_id long, entrant_id long, odds double, normalized_edge double, value_pnl_flat double")


def test_drawdowns_do_not_depend_on_ranges(bets):
    def values(**how):
        return {tuple(r)[:3]: round(r["value_max_dd"], 9) for r in grid_drawdowns(bets, **how).collect()}

    path, want = bets.orderBy("race_date", "race_id", "entrant_id").collect(), {}
    for key in values():
        total, peak, drop = 0.0, float("-inf"), 0.0
        for r in path:
            if r["normalized_edge"] > key[0] and key[1] <= r["odds"] <= key[2]:
                total += r["value_pnl_flat"]
                peak = max(peak, total)
                drop = max(drop, peak - total)
        want[key] = round(drop, 9)
    assert len(want) == 120 and values() == want and values(fold_rows=13) == want


def test_hot_curves_read_stored_bets(bets):
    rows = bets.select(F.lit("value").alias("strategy"), "race_date", "race_id", "entrant_id", F.col("value_pnl_flat").alias("pnl"), F.lit(1.0).alias("stake"))
    df = with_curves(rows, skew=SkewProfile.of(rows, [("race_id",)], 25))
    assert df.inputFiles() and all("/stage-" in f for f in df.inputFiles())
    total = 0.0
    for r in sorted(df.collect(), key=lambda r: r["bet_number"]):
        total += r["pnl"]
        assert r["cum_pnl"] == total
