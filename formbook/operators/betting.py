"""Bet selection, each-way terms, settlement and the bet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.functions.numeric import clip, col, cut, finite, kelly, log_loss_term, logit, sigmoid, value_threshold
from formbook.plans.ordered import Running, ordered
from formbook.plans.skew import SkewProfile, profile_for
from formbook.plans.within import with_ranks, with_totals
from formbook.session import stored

# Odds band and stake of an each-way bet.
EW_MIN_ODDS, EW_MAX_ODDS, EW_STAKE = 4.0, 51.0, 2.0

BET_SCHEMA = (
    "race_date date, race_id long, track string, strategy string, entrant_id long, model_prob double, odds double, "
    "won int, placed int, stake double, pnl double, clv double"
)


# ---- scalar rules --------------------------------------------------------------


def win_pnl(odds: str | Column, won: str | Column, stake: float | Column = 1.0) -> Column:
    s = stake if isinstance(stake, Column) else F.lit(float(stake))
    return F.when(col(won) == 1, s * (col(odds) - 1.0)).otherwise(-s)


def places_paid(n: str | Column, handicap: str | Column, small_field: str = "none") -> Column:
    """Places by field size.  ``small_field`` sets what four runners or fewer pay:
    ``none`` (betting terms), ``all`` (base rates) or ``three`` (training target)."""
    n, h = col(n), F.coalesce(col(handicap).cast("int"), F.lit(0)) != 0
    few = {"none": F.lit(0), "all": n, "three": F.lit(3)}[small_field]
    return F.when(n <= 4, few).when(n <= 7, 2).when(n <= 15, 3).when(h, 4).otherwise(3)


def place_fraction(n: str | Column, handicap: str | Column, override: float | None = None) -> Column:
    """Share of the win odds paid for a place."""
    n, h = col(n), F.coalesce(col(handicap).cast("int"), F.lit(0)) != 0
    standard = F.when(n <= 7, 0.25).when((n >= 12) & h, 0.25).otherwise(0.20)
    return F.when(n <= 4, 0.0).otherwise(standard if override is None else F.lit(float(override)))


def with_ew_terms(df: DataFrame, extra_places: int = 0, override: float | None = None,
                  n: str = "num_runners", handicap: str = "handicap") -> DataFrame:
    eligible = F.col(n) > 4
    return df.select(
        "*", eligible.alias("ew_eligible"),
        F.when(eligible, places_paid(n, handicap) + extra_places).otherwise(0).alias("ew_places"),
        place_fraction(n, handicap, override).alias("ew_fraction"))


def place_odds(odds: str | Column, fraction: str | Column) -> Column:
    return 1.0 + (col(odds) - 1.0) * col(fraction)


def with_ew_columns(df: DataFrame, win_prob: str = "model_prob", place_prob: str = "place_prob",
                    extra_places: int = 0, override: float | None = None, skew: SkewProfile | None = None) -> DataFrame:
    """Each-way terms, place odds, edges, values and Kelly shares per runner."""
    if "num_runners" not in df.columns:
        df = with_totals(df, ["race_id"], {"num_runners": F.count(F.lit(1))}, skew)
    if "handicap" not in df.columns:
        df = df.withColumn("handicap", F.lit(0))
    df = with_ew_terms(df, extra_places, override)
    live = F.col("ew_eligible") & (F.col("odds") > 1.0)
    po = place_odds("odds", "ew_fraction")
    wp, pp = F.col(win_prob), F.col(place_prob)
    win_ev, place_ev = wp * F.col("odds") - 1.0, pp * po - 1.0

    def only(x: Column, off=0.0) -> Column:
        return F.when(live, x).otherwise(F.lit(off))

    kw, kp = kelly(wp, "odds"), kelly(pp, po)
    both = F.least(kw, kp) + 0.5 * F.abs(kw - kp)
    ew_kelly = F.when((kw <= 0) | (kp <= 0), F.greatest(kw, kp) * 0.5).otherwise(both)
    return df.select(
        "*", only(po).alias("place_odds"), only(pp - 1.0 / po).alias("place_edge"), only(win_ev).alias("win_ev"),
        only(place_ev).alias("place_ev"), only((win_ev + place_ev) / 2.0).alias("ew_ev"),
        only((win_ev + place_ev) > 0, False).alias("ew_value"), only(place_ev > 0, False).alias("place_value"),
        only(kw * 0.25).alias("win_kelly"), only(kp * 0.25).alias("place_kelly"), only(ew_kelly * 0.25).alias("ew_kelly"))


def ew_placed(finish: str | Column, paid: str | Column) -> Column:
    f = F.coalesce(col(finish), F.lit(0))
    return ((f > 0) & (f <= col(paid))).cast("int")


def ew_pnl(odds: str | Column, p_odds: str | Column, won: str | Column, placed: str | Column) -> Column:
    """Two units staked: both legs pay a winner, the place leg alone pays a place."""
    return (F.when(col(won) == 1, col(odds) + col(p_odds)).when(col(placed) == 1, col(p_odds)).otherwise(0.0)
            - F.lit(EW_STAKE))


# ---- selection -----------------------------------------------------------------


def with_value_edges(df: DataFrame, base: float | Column, prob: str = "model_prob",
                     implied: Column | None = None) -> DataFrame:
    """Edge over the implied probability, the edge demanded, and the selection flag.

    ``implied`` defaults to ``1/odds``; pass the race-normalised market
    probability to take out the overround.
    """
    odds = F.col("odds")
    imp = F.when(odds > 0, 1.0 / odds).otherwise(0.0) if implied is None else implied
    p = finite(prob)
    edge = p - imp
    ok = (odds > 0) & finite("odds").isNotNull() & p.isNotNull()
    return df.select(
        "*", imp.alias("value_implied"), edge.alias("value_edge"), value_threshold(base, odds).alias("value_demand"),
        (p * odds).alias("value_clv"), (p * odds - 1.0).alias("value_expected_roi"),
        F.coalesce(ok & (edge > value_threshold(base, odds)), F.lit(False)).alias("is_value_bet"))


def ew_selected(base: float) -> Column:
    """Odds inside the band, place edge above the demanded edge, place leg worth backing."""
    odds = F.col("odds")
    return (F.col("ew_eligible") & odds.between(EW_MIN_ODDS, EW_MAX_ODDS)
            & (F.col("place_edge") > value_threshold(base, odds)) & (F.col("place_ev") > 0))


def ew_value_bets(df: DataFrame, base: float = 0.05) -> DataFrame:
    """Each-way picks, best place edge first."""
    return df.where(ew_selected(base)).orderBy(F.desc("place_edge"), "race_id", "entrant_id")


# ---- place probabilities -------------------------------------------------------

NEWTON_STEPS = 20


def _newton(zs: Column, start: Column, k: Column) -> Column:
    """The shift at which the sigmoids of ``zs`` sum to ``k``; it stays put once the sum is met."""

    def step(d: Column, _: Column) -> Column:
        sums = F.aggregate(zs, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("v")), lambda a, z: F.transform(
            F.array(sigmoid(z + d)), lambda p: F.struct((a["s"] + p).alias("s"), (a["v"] + p * (1.0 - p)).alias("v")))[0])
        return F.transform(F.array(sums), lambda t: F.when(
            (F.abs(t["s"] - k) >= 1e-8) & (t["v"] >= 1e-12), d - (t["s"] - k) / t["v"]).otherwise(d))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)


def adjust_place_probs(df: DataFrame, paid: str = "ew_places", win_prob: str = "model_prob",
                       place_prob: str = "place_prob", name: str = "place_prob_adj",
                       skew: SkewProfile | None = None) -> DataFrame:
    """Turn P(top 3) into P(paid place): squeeze in small fields, then shift until the race sums to the places.

    The shift is found by at most NEWTON_STEPS Newton steps, ending when the race's sum is met.
    An ordinary race is gathered once into an array, at its first row, and iterated there; in
    races above the hot-key limit every step is a group total.
    """
    race = ["race_id"]
    p = clip(place_prob, 1e-6, 1.0 - 1e-6)
    df = df.withColumn("_z", logit(p))
    df = with_totals(df, race, {"_n": F.count(F.lit(1)), "_zm": F.avg("_z"), "_raw": F.sum(place_prob)}, skew)
    k, n = F.col(paid).cast("double"), F.col("_n")
    squeeze = clip(1.0 - 2.0 * F.greatest(k / n - 0.25, F.lit(0.0)), 0.5, 1.0)
    start = logit(clip(k / n, 1e-6, 1.0 - 1e-6)) - F.col("_zm")
    z = (F.col("_zm") + squeeze * (F.col("_z") - F.col("_zm"))).alias("_z")
    rest = [c for c in df.columns if c not in ("_z", "_zm")]
    df = df.select(*rest, z, start.alias("_d"))
    cold, hot = profile_for(df, race, skew).split(df, race)
    w = Window.partitionBy(*race)
    cold = cold.select("*", F.collect_list("_z").over(w).alias("_zs"), F.row_number().over(w.orderBy("_z")).alias("_first"))
    solved = F.when((F.col("_first") == 1) & (k > 0) & (k < n), _newton(F.col("_zs"), F.col("_d"), k)).when(F.col("_first") == 1, F.col("_d"))
    cold = cold.withColumn("_d", solved).withColumn("_d", F.max("_d").over(w)).drop("_zs", "_first")
    if hot is not None:
        for _ in range(NEWTON_STEPS):
            s = sigmoid(F.col("_z") + F.col("_d"))
            hot = with_totals(hot, race, {"_sum": F.sum(s), "_slope": F.sum(s * (1.0 - s))}, skew)
            gap = F.col("_sum") - k
            step = F.when((F.abs(gap) >= 1e-8) & (F.col("_slope") >= 1e-12), gap / F.col("_slope")).otherwise(0.0)
            hot = hot.select(*rest, "_z", (F.col("_d") - step).alias("_d"))
        cold = cold.unionByName(hot)
    df = cold
    value = (F.when(k <= 0, 0.0).when(k >= n, F.lit(1.0)).when(F.col("_raw") < 1e-8, k / n)
             .otherwise(sigmoid(F.col("_z") + F.col("_d"))))
    floor = F.when(k <= 0, 0.0).otherwise(F.greatest(value, F.col(win_prob)))
    return df.withColumn(name, clip(floor, 0.0, 1.0)).drop("_z", "_n", "_raw", "_d")


def fallback_place_probs(df: DataFrame, win_prob: str = "model_prob", name: str = "place_prob_fallback",
                         skew=None) -> DataFrame:
    """``1 - (1 - p)^(n/k)`` scaled to the places, for models without a place classifier."""
    race = ["race_id"]
    df = with_totals(df, race, {"_n": F.count(F.lit(1))}, skew)
    k = F.when(F.col("_n") >= 8, 3).when(F.col("_n") >= 5, 2).otherwise(0)
    raw = F.greatest(1.0 - F.pow(1.0 - F.col(win_prob), F.col("_n") / k), F.col(win_prob))
    df = with_totals(df.withColumn("_f", F.when(k > 0, raw)), race, {"_t": F.sum("_f")}, skew)
    return df.withColumn(name, F.when(F.col("_t") > 0, clip(F.col("_f") * (k / F.col("_t")), 0, 1)).otherwise(0.0)
                         ).drop("_n", "_f", "_t")


# ---- bet tables ----------------------------------------------------------------


def bet_table(preds: DataFrame, value_base: float = 0.05, ew_base: float | None = None,
              market_implied: bool = False, skew: SkewProfile | None = None) -> DataFrame:
    """Flat-stake bets of three strategies in the fixed bet schema.

    ``top_pick``: best probability of a race that the model can tell apart;
    ``value``: edge above the odds-scaled threshold; ``each_way``: place edge.
    ``market_implied`` measures the value edge against the race-normalised price.
    """
    race = ["race_id"]
    df = with_totals(preds, race, {"_hi": F.max("model_prob"), "_lo": F.min("model_prob"),
                                   "_book": F.sum(1.0 / F.col("odds"))}, skew)
    df = with_ranks(df, race, {"_pick": ("first", "model_prob", True)}, tie="entrant_id", skew=skew)
    df = with_value_edges(df, value_base,
                          implied=1.0 / F.col("odds") / F.col("_book") if market_implied else None)
    df = adjust_place_probs(with_ew_terms(df), skew=skew).drop("ew_eligible", "ew_places", "ew_fraction")
    df = with_ew_columns(df, place_prob="place_prob_adj", skew=skew)
    placed = ew_placed("finish_position", "ew_places")
    none = F.lit(None).cast("int")

    def bet(strategy: str, placed_col: Column, stake: float, pnl: Column) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), placed_col.cast("int").alias("placed"),
                        F.lit(stake).alias("stake"), pnl.cast("double").alias("pnl"))

    top = (F.col("_pick") == 1) & (F.col("_hi") > F.col("_lo"))
    ew = ew_selected(value_base if ew_base is None else ew_base)
    bets = F.array_compact(F.array(
        F.when(top, bet("top_pick", none, 1.0, win_pnl("odds", "won"))),
        F.when(F.col("is_value_bet"), bet("value", none, 1.0, win_pnl("odds", "won"))),
        F.when(ew, bet("each_way", F.greatest(placed, F.col("won")), EW_STAKE,
                       ew_pnl("odds", "place_odds", "won", placed)))))
    return df.select("*", F.explode(bets).alias("b")).select(
        "race_date", "race_id", "track", "b.strategy", "entrant_id", "model_prob", "odds", "won", "b.placed", "b.stake",
        F.col("b.pnl").alias("pnl"), (F.col("model_prob") * F.col("odds")).alias("clv"))


BET_ORDER = ("race_date", "race_id", "entrant_id")


def with_curves(bets: DataFrame, keys: Sequence[str] = ("strategy",), order: Sequence[str] = BET_ORDER,
                skew: SkewProfile | None = None) -> DataFrame:
    """Running P&L, stake and ROI, the peak so far and the drawdown from it.

    A strategy of many bets is one hot key: its bets are stored once, as the chunked frames read them several times.
    """
    keys = list(keys)
    bets = stored(bets)
    skew = SkewProfile.of(bets, [tuple(keys)], skew.limit if skew else None)
    df = ordered(bets, keys, order, {
        "cum_pnl": Running("sum", F.col("pnl"), current=True),
        "cum_staked": Running("sum", F.col("stake"), current=True),
        "bet_number": Running("count", F.lit(1), current=True)}, skew)
    if skew.hot(bets, keys) is not None:
        df = stored(df)
    df = ordered(df, keys, order, {"peak": Running("max", F.col("cum_pnl"), current=True)}, skew)
    return df.select("*", F.when(F.col("cum_staked") > 0, F.col("cum_pnl") / F.col("cum_staked") * 100)
                     .otherwise(0.0).alias("cum_roi_pct"), (F.col("peak") - F.col("cum_pnl")).alias("drawdown"))


def strategy_stats(bets: DataFrame, keys: Sequence[str] = ("strategy",), skew=None) -> DataFrame:
    """Counts, strike and place rates, ROI, mean odds, drawdown and CLV per strategy."""
    won = F.col("won") == 1
    return with_curves(bets, keys, skew=skew).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bets"), F.sum("won").alias("winners"),
        F.sum(F.coalesce("placed", "won")).alias("placed"), F.sum("stake").alias("total_staked"),
        F.sum("pnl").alias("pnl"), (F.avg("won") * 100).alias("strike_rate"),
        (F.avg(F.coalesce("placed", "won")) * 100).alias("place_rate"),
        (F.sum("pnl") / F.sum("stake") * 100).alias("roi"), F.avg("stake").alias("avg_stake"),
        F.coalesce(F.avg(F.when(won, F.col("odds"))), F.lit(0.0)).alias("avg_odds_winners"),
        F.avg("odds").alias("avg_odds_all"), F.max("drawdown").alias("max_drawdown"), F.avg("clv").alias("avg_clv"),
        F.when(F.stddev_pop("pnl") > 1e-9, F.avg("pnl") / F.stddev_pop("pnl")).otherwise(0.0).alias("sharpe"))


def value_quality(preds: DataFrame, base: float = 0.05) -> DataFrame:
    """Edge, CLV and scoring of the selected value bets."""
    sel = with_value_edges(preds, base).where("is_value_bet")
    y, p = F.col("won"), clip("model_prob", 1e-15, 1 - 1e-15)
    return sel.agg(
        F.count(F.lit(1)).alias("bets"), F.avg("value_edge").alias("avg_edge"), F.avg("value_clv").alias("avg_clv"),
        (F.avg("value_expected_roi") * 100).alias("expected_roi"), F.avg((p - y) * (p - y)).alias("selected_brier"),
        F.avg(log_loss_term(y, p)).alias("selected_log_loss"))


def daily_pnl(bets: DataFrame, keys: Sequence[str] = ("strategy",), skew=None) -> DataFrame:
    """Daily totals with a running total.

    The totals, a row a day, are stored: the bets are made once, also when the days of a key are counted first.
    """
    keys = list(keys)
    daily = stored(bets.groupBy(*keys, "race_date").agg(
        F.sum("pnl").alias("daily_pnl"), F.count(F.lit(1)).alias("daily_bets"), F.sum("won").alias("daily_wins")))
    return ordered(daily, keys, ["race_date"], {"cum_pnl": Running("sum", F.col("daily_pnl"), current=True)}, skew)


# Reporting bands.
ODDS_BANDS = ([0, 3, 5, 8, 12, 20, 9999], ["1-3", "3-5", "5-8", "8-12", "12-20", "20+"])
PROB_BUCKETS = ([0, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 1.01],
                ["0-5%", "5-10%", "10-15%", "15-20%", "20-30%", "30-50%", "50%+"])


def by_odds_band(bets: DataFrame) -> DataFrame:
    return bets.withColumn("odds_band", cut("odds", *ODDS_BANDS)).where(F.col("odds_band").isNotNull()).groupBy(
        "odds_band").agg(F.count(F.lit(1)).alias("bets"), F.sum("won").alias("winners"), F.sum("pnl").alias("pnl"),
                         (F.avg("won") * 100).alias("strike_rate"), (F.avg("pnl") * 100).alias("roi"))


def calibration_by_bucket(preds: DataFrame) -> DataFrame:
    return preds.withColumn("prob_bucket", cut("model_prob", *PROB_BUCKETS)).where(
        F.col("prob_bucket").isNotNull()).groupBy("prob_bucket").agg(
        F.count(F.lit(1)).alias("runners"), F.sum("won").alias("actual_wins"),
        (F.avg("won") * 100).alias("actual_win_rate"), (F.avg("model_prob") * 100).alias("avg_model_pct"))
