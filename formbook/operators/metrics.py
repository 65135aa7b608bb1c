"""Scoring of probabilities and rankings, drift, and comparison tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.functions.numeric import bin_index, clip, log_loss_term
from formbook.operators.betting import places_paid
from formbook.operators.splits import relevance
from formbook.plans.ordered import Running, ordered, with_ordinal
from formbook.plans.quantiles import exact_percentiles
from formbook.plans.within import with_ranks, with_totals
from formbook.session import hot_row_limit

RACE = ["race_id"]


def probability_scores(df: DataFrame, prob: str = "model_prob", won: str = "won") -> DataFrame:
    """Brier score and log-loss over all rows."""
    y, p = F.col(won), clip(prob, 1e-15, 1 - 1e-15)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg((p - y) * (p - y)).alias("brier_score"),
                  F.avg(log_loss_term(y, p)).alias("log_loss"))


def reliability_bins(df: DataFrame, prob: str = "model_prob", won: str = "won", bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate in equal-width bins."""
    p = clip(prob, 1e-15, 1 - 1e-15)
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return df.select(b.alias("bin"), p.alias("p"), F.col(won).alias("y")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_pred"), F.avg("y").alias("obs_rate"))


def calibration_error(df: DataFrame, prob: str = "model_prob", won: str = "won", bins: int = 10) -> DataFrame:
    """Expected calibration error; a fold over the handful of reliability bins."""
    r = reliability_bins(df, prob, won, bins)
    return r.agg((F.sum(F.abs(F.col("mean_pred") - F.col("obs_rate")) * F.col("rows")) / F.sum("rows")).alias("ece"))


def ranking_scores(df: DataFrame, score: str = "score", position: str = "finish_position", tie: str = "entrant_id",
                   skew=None) -> DataFrame:
    """NDCG@1/@3, top-1 accuracy and winner-in-top-3 over races that can be told apart.

    Rows with tied scores share the mean discount of their places.
    """
    df = df.where(F.col(position) > 0).select("race_id", tie, F.col(score).alias("s"), relevance(position).alias("g"))
    df = with_totals(df, RACE, {"_n": F.count(F.lit(1)), "_gmax": F.max("g"), "_gmin": F.min("g"),
                                "_smax": F.max("s"), "_smin": F.min("s")}, skew)
    df = df.where((F.col("_n") >= 2) & (F.col("_gmax") > F.col("_gmin")) & (F.col("_smax") > F.col("_smin")))
    df = with_ranks(df, RACE, {"_rs": ("first", "s", True), "_rg": ("first", "g", True)}, tie=tie, skew=skew)

    def discount(rank: str, k: int) -> Column:
        return F.when(F.col(rank) <= k, 1.0 / F.log2(F.col(rank) + 1.0)).otherwise(0.0)

    df = with_totals(df, ["race_id", "s"], {f"_d{k}": F.avg(discount("_rs", k)) for k in (1, 3)}, skew)
    aggs = []
    for k in (1, 3):
        aggs += [F.sum(F.col("g") * F.col(f"_d{k}")).alias(f"dcg{k}"),
                 F.sum(F.col("g") * discount("_rg", k)).alias(f"ideal{k}")]
    winner = F.col("_rg") == 1
    races = df.groupBy("race_id").agg(
        *aggs, F.max(F.when(winner & (F.col("_rs") == 1), 1).otherwise(0)).alias("top1"),
        F.max(F.when(winner & (F.col("_rs") <= 3), 1).otherwise(0)).alias("top3"))
    return races.agg(F.count(F.lit(1)).alias("total_races"), F.avg(F.col("dcg1") / F.col("ideal1")).alias("ndcg_at_1"),
                     F.avg(F.col("dcg3") / F.col("ideal3")).alias("ndcg_at_3"), F.avg("top1").alias("top1_accuracy"),
                     F.avg("top3").alias("win_in_top3"))


def rank_probability_score(df: DataFrame, prob: str = "model_prob", position: str = "finish_position",
                           tie: str = "entrant_id", skew=None) -> DataFrame:
    """Mean over races of the squared shortfall of the cumulative probability of the actual top k."""
    df = df.where(F.col(position) > 0).select("race_id", position, tie, F.col(prob).alias("p"))
    df = with_totals(df, RACE, {"_n": F.count(F.lit(1))}, skew).where("_n >= 2")
    df = ordered(df, RACE, [position, tie], {"_c": Running("sum", F.col("p"), current=True),
                                             "_k": Running("count", F.lit(1), current=True)}, skew)
    gap = (F.col("_c") - 1.0) * (F.col("_c") - 1.0)
    races = df.groupBy("race_id").agg(
        (F.sum(F.when(F.col("_k") < F.col("_n"), gap).otherwise(0.0)) / (F.max("_n") - 1)).alias("r"))
    return races.agg(F.count(F.lit(1)).alias("races"), F.avg("r").alias("rps"))


def decile_calibration(df: DataFrame, prob: str = "model_prob", won: str = "won",
                       tie: Sequence[str] = ("race_id", "entrant_id")) -> DataFrame:
    """Ten equal-count bins of the sorted probabilities; the last takes the remainder."""
    df = df.select(F.lit(0).alias("_all"), F.col(prob).alias("p"), F.col(won).alias("y"), *tie)
    total = df.agg(F.count(F.lit(1)).alias("_n"))  # one row
    df = with_ordinal(df, ["_all"], ["p", *tie], "_i", hot_row_limit(df.sparkSession)).join(F.broadcast(total))
    d = F.least(F.floor((F.col("_i") - 1) / F.floor(F.col("_n") / 10)), F.lit(9)) + 1
    return df.where("_n >= 20").groupBy(d.cast("int").alias("decile")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("p").alias("prob_lo"), F.max("p").alias("prob_hi"),
        F.avg("p").alias("mean_pred"), F.avg("y").alias("obs_rate"))


def place_scores(df: DataFrame, prob: str = "place_prob", raw: str | None = None, tie: str = "entrant_id",
                 skew=None) -> DataFrame:
    """Brier (calibrated and raw) and precision of the k best place probabilities per race."""
    raw = raw or prob
    k = places_paid("num_runners", "handicap", "three")
    y = (F.col("finish_position") <= k).cast("int")
    df = df.where(F.col("finish_position") > 0)
    df = with_ranks(df, RACE, {"_r": ("first", prob, True)}, tie=tie, skew=skew)
    p, q = F.col(prob), F.col(raw)
    return df.agg(F.avg((p - y) * (p - y)).alias("brier_calibrated"), F.avg((q - y) * (q - y)).alias("brier_raw"),
                  (F.sum(F.when(F.col("_r") <= k, y).otherwise(0)) / F.greatest(F.sum(y), F.lit(1)))
                  .alias("place_precision"))


def top_three_overlap(df: DataFrame, score: str = "score", tie: str = "entrant_id", skew=None) -> DataFrame:
    """Share of the predicted top three that finished in the top three, and hits per race."""
    df = df.where(F.col("finish_position") > 0)
    df = with_ranks(df, RACE, {"_r": ("first", score, True)}, tie=tie, skew=skew)
    pick = F.col("_r") <= 3
    hit = (pick & (F.col("finish_position") <= 3)).cast("int")
    races = df.groupBy("race_id").agg(F.sum(hit).alias("h"), F.sum(pick.cast("int")).alias("n"))
    return races.agg(F.count(F.lit(1)).alias("races"), (F.sum("h") / F.sum("n")).alias("top3_accuracy"),
                     F.avg("h").alias("place_hits"))


def with_market_probs(df: DataFrame, odds: str = "odds", skew=None) -> DataFrame:
    """``market_prob`` without overround; ``market_ok`` where every runner of the race has a usable price."""
    o = F.col(odds)
    ok = o.isNotNull() & (o > 1.01)
    df = df.withColumn("_ip", F.when(ok, 1.0 / F.greatest(o, F.lit(1.01))).otherwise(1.0))
    df = with_totals(df, RACE, {"_s": F.sum("_ip"), "_ok": F.min(ok.cast("int"))}, skew)
    return df.select("*", clip(F.col("_ip") / F.greatest("_s", F.lit(1e-12)), 1e-6, 1 - 1e-6).alias("market_prob"),
                     (F.col("_ok") == 1).alias("market_ok")).drop("_ip", "_s", "_ok")


def preferred_market(df: DataFrame, exchange: str = "bsp", starting: str = "odds", skew=None) -> DataFrame:
    """``market_pref``: exchange-implied probability where there is a price, starting price otherwise."""
    def raw(c: str) -> Column:
        return F.when(F.col(c) > 1.0, 1.0 / F.col(c))

    df = with_totals(df.select("*", raw(exchange).alias("_e"), raw(starting).alias("_s")), RACE,
                     {"_te": F.sum("_e"), "_ts": F.sum("_s")}, skew)
    return df.withColumn("market_pref", F.coalesce(F.col("_e") / F.col("_te"), F.col("_s") / F.col("_ts"))
                         ).drop("_e", "_s", "_te", "_ts")


def model_comparison(df: DataFrame, models: dict[str, str], won: str = "won") -> DataFrame:
    """Brier and log-loss of several probability columns in one pass, one row per model."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("p"))
                               for n, c in models.items()]))
    long = df.select(F.col(won).alias("y"), rows.alias("m")).select("y", "m.*").where(F.col("p").isNotNull())
    p, y = clip("p", 1e-15, 1 - 1e-15), F.col("y")
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.avg((p - y) * (p - y)).alias("brier_score"),
                                     F.avg(log_loss_term(y, p)).alias("log_loss"))


def ensemble(df: DataFrame, prob: str = "p", keys: Sequence[str] = ("race_id", "entrant_id"), skew=None) -> DataFrame:
    """Mean of several models' rows per runner, normalised in the race."""
    df = df.groupBy(*keys).agg(F.avg(prob).alias("_m"))
    df = with_totals(df, RACE, {"_t": F.sum("_m")}, skew)
    return df.select(*keys, (F.col("_m") / F.col("_t")).alias("ensemble_prob"))


# ---- drift ---------------------------------------------------------------------


def stability_index(df: DataFrame, features: Sequence[str], test: Column, buckets: int = 10) -> DataFrame:
    """Population stability index of each feature between training and test rows.

    Bins are the training deciles (equal ones merged).  Rows are unpivoted and
    counted per (feature, bin), so all features share two aggregations.
    """
    long = df.select(test.alias("t"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")
    ).select("t", "x.feature", "x.v").where(F.col("v").isNotNull())
    steps = [i / buckets for i in range(buckets + 1)]
    edges = exact_percentiles(long.where(~F.col("t")), "v", steps, ["feature"]).select("feature", F.array_distinct("q").alias("edges"))
    # One row per feature.
    edges = edges.where(F.size("edges") >= 3)
    inside = F.col("v").between(F.element_at("edges", 1) - 1e-9, F.element_at("edges", -1) + 1e-9)
    # Left-closed bins: count inner edges at or below the value.
    inner = F.slice("edges", 2, F.size("edges") - 2)
    b = F.size(F.filter(inner, lambda e: e <= F.col("v")))
    counted = long.join(F.broadcast(edges), "feature").where(inside).groupBy("feature", b.alias("b"), F.size(
        "edges").alias("k")).agg(F.sum((~F.col("t")).cast("int")).alias("a"), F.sum(F.col("t").cast("int")).alias("z"))
    totals = with_totals(counted, ["feature"], {"_a": F.sum("a"), "_z": F.sum("z"), "_bins": F.count(F.lit(1))})
    p = F.greatest(F.col("a") / F.greatest("_a", F.lit(1e-9)), F.lit(1e-9))
    q = F.greatest(F.col("z") / F.greatest("_z", F.lit(1e-9)), F.lit(1e-9))
    psi = totals.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    return psi.withColumn("level", F.when(F.col("psi") >= 0.2, "high").when(F.col("psi") >= 0.1, "moderate")
                          .otherwise("stable"))


# ---- metric tables -------------------------------------------------------------


def flatten_metrics(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Nested JSON metrics to (name, value) rows; names joined by dots, non-numbers left out.

    One level a round, until no object is left."""
    level = df.select(*keys, F.lit("").alias("name"), F.col(column).alias("json"))
    out = None
    while out is None or not level.isEmpty():
        entries = F.from_json("json", "map<string,string>")
        rows = level.select(*keys, "name", F.explode(entries).alias("k", "v")).select(
            *keys, F.when(F.col("name") == "", F.col("k")).otherwise(F.concat_ws(".", "name", "k")).alias("name"),
            F.col("v").alias("json"))
        leaf = rows.select(*keys, "name", F.col("json").try_cast("double").alias("value")).where(
            F.col("value").isNotNull())
        out = leaf if out is None else out.unionByName(leaf)
        level = rows.where(F.col("json").startswith("{"))
    return out


# Metrics where a lower value is better; all others are better when higher.
LOWER_IS_BETTER = (
    "brier_calibrated",
    "brier_raw",
    "brier_score",
    "ece",
    "log_loss",
    "value_bet_brier",
    "value_bet_log_loss",
    "rps",
)
# Gaps from which a metric is watched, moderate and high.
WATCH_GAP, MODERATE_GAP, HIGH_GAP = 0.03, 0.08, 0.15


def better_when_higher(name: str | Column = "name") -> Column:
    return ~(F.col(name) if isinstance(name, str) else name).isin(*LOWER_IS_BETTER)


def generalisation_gap(oof: DataFrame, validation: DataFrame) -> DataFrame:
    """Out-of-fold against validation metrics; positive gap means validation is worse."""
    df = oof.select("name", F.col("value").alias("oof")).join(
        validation.select("name", F.col("value").alias("validation")), "name")
    gap = F.when(better_when_higher(), F.col("oof") - F.col("validation")).otherwise(
        F.col("validation") - F.col("oof"))
    rel = gap / F.greatest(F.abs("oof"), F.lit(1e-9)) * 100
    return df.select("name", "oof", "validation", gap.alias("gap"), rel.alias("gap_pct"),
                     F.when(gap >= HIGH_GAP, "high").when(gap >= MODERATE_GAP, "moderate")
                     .when(gap >= WATCH_GAP, "watch").otherwise("healthy").alias("status"))


def model_tradeoff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two models' metrics side by side with the direction-aware edge and the leader."""
    df = left.select("name", F.col("value").alias("left_value")).join(
        right.select("name", F.col("value").alias("right_value")), "name")
    edge = F.when(better_when_higher(), F.col("left_value") - F.col("right_value")).otherwise(
        F.col("right_value") - F.col("left_value"))
    return df.select("*", edge.alias("edge"), F.when(edge > 0, "left").when(edge < 0, "right").otherwise("tie")
                     .alias("leader"))


def metric_trend(metrics: DataFrame, order: str) -> DataFrame:
    """Change of each metric from run to run."""
    from formbook.plans.ordered import Shift
    df = ordered(metrics, ["name"], [order], {"_prev": Shift(F.col("value"))})
    return df.withColumn("change", F.col("value") - F.col("_prev")).drop("_prev")


def metric_snapshot(metrics: DataFrame, names: Sequence[str], base: str, other: str) -> DataFrame:
    """Models as rows, metrics as columns, and a row with the difference of two models."""
    wide = metrics.groupBy("model").pivot("name", list(names)).agg(F.first("value"))
    delta = wide.where(F.col("model").isin(base, other)).agg(*[
        (F.max(F.when(F.col("model") == other, F.col(n))) - F.max(F.when(F.col("model") == base, F.col(n)))).alias(n)
        for n in names]).select(F.lit(f"{other} - {base}").alias("model"), *names)
    return wide.unionByName(delta)


def concentration(importances: DataFrame, value: str = "importance", name: str = "feature") -> DataFrame:
    """Lorenz curve of feature importances with the Gini coefficient and top-share (one row per feature)."""
    total = importances.withColumn("_all", F.lit(0))
    df = ordered(total, ["_all"], [value, name], {"_cum": Running("sum", F.col(value), current=True),
                                                 "_i": Running("count", F.lit(1), current=True)})
    df = with_totals(df, ["_all"], {"_n": F.count(F.lit(1)), "_t": F.sum(value),
                                    "_w": F.sum(F.col("_i") * F.col(value))})
    gini = 2.0 * F.col("_w") / (F.col("_n") * F.col("_t")) - (F.col("_n") + 1.0) / F.col("_n")
    return df.select(name, value, (F.col("_i") / F.col("_n")).alias("share_of_features"),
                     (F.col("_cum") / F.col("_t")).alias("share_of_importance"), gini.alias("gini"))


# Mean rank gaps of the top band up to which agreement is strong and moderate.
TOP_BAND, STRONG_GAP, MODERATE_RANK_GAP = 3, 0.75, 1.5


def ranker_agreement(df: DataFrame, prob: str = "model_prob", score: str = "score", tie: str = "entrant_id",
                     skew=None) -> DataFrame:
    """Classifier against ranker: rank gap and confidence per runner, consensus per race.

    The consensus asks whether both put the same runner first and how far their ranks differ
    on average among the runners that either puts in the top band."""
    df = with_ranks(df, RACE, {"class_rank": ("min", prob, True), "ranker_rank": ("min", score, True),
                               "_c": ("first", prob, True), "_s": ("first", score, True)}, tie=tie, skew=skew)
    gap = F.abs(F.col("class_rank") - F.col("ranker_rank"))
    top = (F.col("class_rank") == 1) != (F.col("ranker_rank") == 1)
    band = (F.col("class_rank") <= TOP_BAND) | (F.col("ranker_rank") <= TOP_BAND)
    same = ((F.col("_c") == 1) & (F.col("_s") == 1)).cast("int")
    df = with_totals(df, RACE, {"_same": F.max(same), "_gap": F.avg(F.when(band, gap))}, skew)
    confidence = (F.when(top & (F.col("class_rank") == 1), "split").when(gap >= 2, "caution").when(gap <= 0, "aligned")
                  .when(gap <= 1, "supported"))
    consensus = (F.when(F.col("_same") == 0, "split").when(F.col("_gap") <= STRONG_GAP, "strong")
                 .when(F.col("_gap") <= MODERATE_RANK_GAP, "moderate").otherwise("narrow"))
    return df.select("*", gap.alias("rank_gap"), top.cast("int").alias("disagrees_top"), consensus.alias("consensus"),
                     confidence.alias("confidence")).drop("_c", "_s", "_same", "_gap")
