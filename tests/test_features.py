"""Hand-made cases and look-ahead checks."""

import pytest
from pyspark.sql import functions as F

from formbook.features import entrant as H
from formbook.features import people as P
from formbook.features.build import strip_outcomes
from formbook.features.flags import add_result_flags
from formbook.operators import betting as B
from formbook.operators import calibration as C
from formbook.operators import diagnostics as D
from formbook.sources.runners import load_runners

SF = "/root/testdata/sf0.001"


def test_collateral_form_key_race(spark):
    rows = [("r1", "2025-01-01", "A", 1), ("r1", "2025-01-01", "B", 2), ("r1", "2025-01-01", "C", 3),
            ("r2", "2025-01-10", "B", 1), ("r2", "2025-01-10", "X", 2), ("r3", "2025-01-10", "C", 1),
            ("r3", "2025-01-10", "Y", 2), ("r4", "2025-02-01", "A", 1), ("r4", "2025-02-01", "Z", 2)]
    df = spark.createDataFrame(rows, "race_id string, race_date string, entrant_id string, finish_position int")
    df = df.withColumn("race_date", F.col("race_date").cast("date"))
    got = {(r["race_id"], r["entrant_id"]): r for r in H.add_collateral_form_features(df).collect()}
    a = got["r4", "A"]
    assert (a["collateral_n_rivals"], a["collateral_next_win_rate"], a["collateral_next_place_rate"]) == (2, 1.0, 1.0)
    assert got["r1", "A"]["collateral_n_rivals"] == 0


def test_rematch_on_the_same_day_is_not_known_yet(spark):
    rows = [("r1", "2025-01-01", "A", 1), ("r1", "2025-01-01", "B", 2), ("r2", "2025-02-01", "A", 1), ("r2", "2025-02-01", "B", 2)]
    df = spark.createDataFrame(rows, "race_id string, race_date string, entrant_id string, finish_position int")
    df = df.withColumn("race_date", F.col("race_date").cast("date"))
    got = {(r["race_id"], r["entrant_id"]): r for r in H.add_collateral_form_features(df).collect()}
    assert got["r2", "A"]["collateral_n_rivals"] == 0
    assert got["r2", "A"]["collateral_next_win_rate"] is None


def test_stripping_todays_results_changes_no_feature(spark):
    runners = load_runners(spark, SF).cache()
    last = runners.agg(F.max("race_date")).first()[0]
    today = F.col("race_date") == F.lit(last)
    blind = runners.where(~today).unionByName(strip_outcomes(runners.where(today)))

    def build(df):
        df = add_result_flags(df).withColumn("dist_category", H.distance_category())
        df = P.add_jockey_features(H.add_entrant_features(df))
        df = H.add_speed_figure_features(P.add_target_encoded_features(df))
        cols = ("entrant_win_rate_shrunk", "entrant_ewma_pos_3", "runs_since_last_win", "jockey_wr_30d", "jockey_wins_10",
                "trainer_te_norm_pos", "going_te_ewma", "speed_z_class_avg_5")
        rows = df.where(today).select("race_id", "entrant_id", *[F.round(c, 8).alias(c) for c in cols]).collect()
        return sorted(map(tuple, rows), key=repr)

    full, stripped = build(runners), build(blind)
    assert full and full == stripped


def test_row_order_does_not_matter(spark):
    df = add_result_flags(load_runners(spark, SF))

    def build(d):
        out = H.add_entrant_features(d).select("race_id", "entrant_id", F.round("entrant_ewma_pos_3", 8), "entrant_prev_races")
        return sorted(map(tuple, out.collect()), key=repr)

    assert build(df) == build(df.repartition(13, F.rand(1)))


@pytest.mark.parametrize("n,handicap,places,fraction", [
    (4, 0, 0, 0.0), (5, 0, 2, 0.25), (7, 1, 2, 0.25), (8, 0, 3, 0.20), (11, 1, 3, 0.20), (12, 1, 3, 0.25),
    (15, 0, 3, 0.20), (16, 1, 4, 0.25), (20, 0, 3, 0.20)])
def test_each_way_terms(spark, n, handicap, places, fraction):
    r = B.with_ew_terms(spark.createDataFrame([(n, handicap)], "num_runners int, handicap int")).first()
    assert (r["ew_places"], r["ew_fraction"]) == (places, fraction)


def test_settlement(spark):
    r = spark.createDataFrame([(5.0, 2.0, 1, 0), (5.0, 2.0, 0, 1), (5.0, 2.0, 0, 0)],
                              "odds double, po double, won int, placed int").select(
        B.win_pnl("odds", "won").alias("w"), B.ew_pnl("odds", "po", "won", "placed").alias("e")).collect()
    assert [(x["w"], x["e"]) for x in r] == [(4.0, 5.0), (-1.0, 0.0), (-1.0, -2.0)]


def test_place_probabilities_sum_to_the_places(spark):
    rows = [(1, h, 0.1, 0.2 + 0.05 * h, 3) for h in range(9)] + [(2, h, 0.3, 0.5, 3) for h in range(3)]
    df = spark.createDataFrame(rows, "race_id int, entrant_id int, model_prob double, place_prob double, ew_places int")
    got = B.adjust_place_probs(df).groupBy("race_id").agg(F.sum("place_prob_adj").alias("s")).orderBy("race_id").collect()
    assert got[0]["s"] == pytest.approx(3.0, abs=1e-6) and got[1]["s"] == 3.0


def test_market_blend_needs_enough_races_and_finds_the_market(spark):
    rows = []
    for race in range(400):
        p = [0.5, 0.3, 0.2]
        win = 0 if race % 10 < 5 else 1 if race % 10 < 8 else 2
        rows += [(race, h, 1 / 3, p[h], 1 if h == win else 0, True) for h in range(3)]
    df = spark.createDataFrame(rows, "race_id int, entrant_id int, model_prob double, market_prob double, won int, market_ok boolean")
    noisy = df.withColumn("model_prob", F.when((F.col("race_id") + F.col("entrant_id")) % 2 == 0, 0.3).otherwise(0.4))
    assert C.fit_market_blend(noisy)["beta"] == pytest.approx(1.0, abs=0.1)
    assert C.fit_market_blend(noisy.where("race_id < 40")) is None


def test_bootstrap_interval_covers_the_mean_and_repeats(spark):
    df = spark.range(3000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    a = D.bootstrap_interval(df, "x", "id", replicates=300).first()
    b = D.bootstrap_interval(df.repartition(7), "x", "id", replicates=300).first()
    assert a["low"] < 4.5 < a["high"] and 0.1 < a["high"] - a["low"] < 0.4
    assert (a["low"], a["high"]) == pytest.approx((b["low"], b["high"]))
