"""Hot keys must give the same values as ordinary ones."""

import random

import pytest
from pyspark.sql import functions as F

from formbook.plans.ewma import with_ewma
from formbook.plans.medians import expanding_median
from formbook.plans.ordered import Ordinal, Rolling, Running, Shift, ordered, with_ordinal
from formbook.plans.skew import SkewProfile
from formbook.plans.within import with_percent_ranks, with_ranks, with_totals


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(600):
        key = "a" if i < 300 else rnd.choice("bcdef")
        v = None if rnd.random() < 0.1 else float(rnd.randint(0, 12))
        data.append((key, rnd.randint(0, 40), i, v))
    return spark.createDataFrame(data, "k string, day int, id long, v double").cache()


def both(rows, keys, fn):
    """The operator with everything ordinary and with small limits."""
    plain = fn(SkewProfile.of(rows, [keys], 10**9)).collect()
    split = fn(SkewProfile.of(rows, [keys], 25)).collect()
    def norm(r):
        return sorted(
            [tuple(round(x, 9) if isinstance(x, float) else x for x in t) for t in r], key=repr)
    assert norm(plain) == norm(split)
    return plain


def test_ordered_frames(rows):
    v = F.col("v")
    out = both(rows, ("k",), lambda s: ordered(rows, ["k"], ["day", "id"], {
        "n": Ordinal(), "s": Running("sum", v), "c": Running("count", v, current=True), "m": Running("max", v),
        "l": Running("last", v), "r": Rolling("mean", v, 5), "sd": Rolling("std", v, 7), "p": Shift(v, 2),
        "q": Shift(F.col("id"), -1)}, s))
    by_key = {}
    for r in sorted(out, key=lambda r: (r["k"], r["day"], r["id"])):
        past = by_key.setdefault(r["k"], [])
        seen = [x for x in past if x is not None]
        assert r["n"] == len(past) + 1
        assert r["s"] == (sum(seen) if seen else None)
        window = [x for x in past[-5:] if x is not None]
        assert r["r"] == (pytest.approx(sum(window) / len(window)) if window else None)
        assert r["l"] == (seen[-1] if seen else None)
        past.append(r["v"])


def test_ewma_matches_recurrence(rows):
    out = both(rows, ("k",), lambda s: with_ewma(rows, ["k"], ["day", "id"], {"e": ("v", 3)}, s))
    alpha, state = 1 - 0.5 ** (1 / 3), {}
    for r in sorted(out, key=lambda r: (r["k"], r["day"], r["id"])):
        s = state.get(r["k"])
        assert r["e"] == (pytest.approx(s) if s is not None else None)
        if r["v"] is not None:
            state[r["k"]] = r["v"] if s is None else alpha * r["v"] + (1 - alpha) * s


def test_totals_and_ranks(rows):
    both(rows, ("k",), lambda s: with_totals(rows, ["k"], {"t": F.sum("v"), "m": F.median("v"), "d": F.stddev_samp("v")}, s))
    both(rows, ("k",), lambda s: with_ranks(rows, ["k"], {
        "a": ("min", "v", True), "b": ("pct", "v", False), "c": ("first", "v", True)}, tie="id", skew=s))
    both(rows, ("k",), lambda s: with_percent_ranks(rows, ["k"], {"a": ("v", True), "b": ("day", False)}, s))


def test_ordinal_with_one_tied_value(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit(3.0).alias("v"), F.col("id"))
    out = with_ordinal(df, ["k"], ["v", "id"], "o", 40).orderBy("id").collect()
    assert [r["o"] for r in out] == list(range(1, 501))


def test_expanding_median_with_small_leaves(rows):
    got = {(r["k"], r["d"]): r["median"] for r in expanding_median(
        rows.withColumn("d", F.date_from_unix_date("day")), ["k"], "d", "v", ("id",), leaf=16, fan_out=4).collect()}
    data = rows.collect()
    import datetime
    import statistics
    for k, day in {(r["k"], r["day"]) for r in data}:
        past = [r["v"] for r in data if r["k"] == k and r["day"] < day and r["v"] is not None]
        want = statistics.median(past) if past else None
        assert got.get((k, datetime.date(1970, 1, 1) + datetime.timedelta(days=day))) == want


def test_ranks_of_any_type(spark):
    import datetime
    rnd = random.Random(8)
    data = []
    for i in range(120):
        n = rnd.randint(0, 12)
        data.append(("a" if i < 80 else "b", i, datetime.date(2020, 1, 1) + datetime.timedelta(n), f"common prefix {n:02d}",
                     (1 << 60) + n, float("nan") if n == 7 else None if n == 8 else float(n)))
    rows = spark.createDataFrame(data, "k string, id long, d date, s string, l long, x double").cache()
    cases = {"r_d": ("min", "d", True), "r_s": ("first", "s", True), "r_l": ("min", "l", False), "r_x": ("min", "x", True)}
    got = both(rows, ("k",), lambda s: with_ranks(rows, ["k"], cases, tie="id", skew=s).select("k", "id", *cases))
    assert len({(r.k, r.r_s) for r in got}) == len(got)


def test_exact_percentiles(spark, rows):
    from formbook.plans.quantiles import exact_median, exact_percentiles
    from formbook.session import HOT_ROWS_CONF
    steps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = rows.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(s) for s in steps])).alias("q")).collect()
    for limit in ("1000000", "9"):
        spark.conf.set(HOT_ROWS_CONF, limit)
        got = {r.k: r.q for r in exact_percentiles(rows, "v", steps, ["k"]).collect()}
        assert got == {r.k: pytest.approx(r.q) for r in want}
        assert exact_median(rows, "v", "m").first().m == pytest.approx(rows.agg(F.median("v")).first()[0])
    spark.conf.unset(HOT_ROWS_CONF)
    assert exact_median(rows.where("false"), "v", "m").first().m is None
