"""URL filter: host and path rules, and for all other URLs a logistic regression on hashed character n-grams.

A rule such as ``example.com/en/`` holds for its host and all subdomains, for paths that start
with its path; the longest rule that fits a URL decides it.  What no rule decides is judged by
a model: the 3- and 4-grams of the marked host and of the marked path, hashed into ``BUCKETS``
weights, host and path apart.  The model is fitted to a small table of labelled URLs by
gradient steps; each step is one aggregation over that table and brings back at most one
number a bucket.  The registered query labels URLs by the rules themselves, so the model
carries the rules' tastes over to hosts that no rule names; of the distinct labelled URLs at
most ``LABELLED`` of each verdict are used, those with the smallest hashes.

All work on rows is column expressions; the driver only moves the ``BUCKETS`` weights.

Edge cases: a null URL and one without ``://`` have an empty host and path, fit no rule and
are judged by the model's constant alone; hosts are compared as written after lower-casing
A-Z, user names and ports included; an empty path is not ``/`` and fits no rule; repeated rows
are judged each; extra columns stay, and the added ones give way to their names; URLs of any
length are read whole, in time that grows with their length; without labels, or with labels
of one verdict only, the model says that verdict (``allow`` without any); an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import free_name, let, query, stored, table

ALLOW, BLOCK = "allow", "block"
RULES: Mapping[str, str] = {
    "com/": ALLOW, "example.com/en/": BLOCK, "www.example.com/en/": ALLOW, "net/es/": BLOCK, "net/fr/": BLOCK,
}
BUCKETS = 4096
SIZES = (3, 4)
# Labelled URLs of each verdict that a model is fitted to, at most.
LABELLED = 2000
# Squares start at FLOOR, so that rounding of a gradient near zero cannot move a weight.
STEPS, RATE, RIDGE, FLOOR = 40, 1.0, 1e-4, 1e-6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Buckets of all n-grams of ``^host$`` and ``^path$``, repeats included."""

    def of(part: int, text: Column) -> Column:
        def windows(c: Column) -> Column:
            def of_size(n: int) -> Column:
                starts = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
                return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(part), F.concat(*[F.get(c, i + k) for k in range(n)])), F.lit(BUCKETS)).cast("int"))

            return F.concat(*[of_size(n) for n in SIZES])

        return let(F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), F.lit(0)), windows)

    return F.concat(of(0, host), of(1, path))


@dataclass(frozen=True)
class Model:
    """Weights of the buckets and a constant; positive sums speak for ``block``."""

    weights: tuple[float, ...]
    constant: float

    def margin(self, buckets: Column) -> Column:
        """Sum of the weights, over the root of their number."""
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")  # folded to one literal
        total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(weights, b))
        return self.constant + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))

    def score(self, host: Column, path: Column) -> Column:
        """Probability of ``block``."""
        return 1.0 / (1.0 + F.exp(-let(grams(host, path), self.margin)))


def fit(labelled: DataFrame, steps: int = STEPS) -> Model:
    """A model of (host, path, verdict) rows, both verdicts weighing the same; null verdicts are left out.

    Full gradients with a step size per bucket that falls with the squares of its gradients.
    """
    blocked = F.col("verdict") == BLOCK
    rows = stored(labelled.where(F.col("verdict").isNotNull()).select(blocked.cast("double").alias("y"), grams(F.col("host"), F.col("path")).alias("g")), "urls")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights, constant = [0.0] * BUCKETS, 0.0
    if len(n) < 2:
        return Model(tuple(weights), 1.0 if 1.0 in n else -1.0)
    share = F.when(F.col("y") == 1.0, 0.5 / n[1.0]).otherwise(0.5 / n[0.0])
    squares = [FLOOR] * (BUCKETS + 1)
    for _ in range(steps):
        miss = rows.select("g", (share * (1.0 / (1.0 + F.exp(-Model(tuple(weights), constant).margin(F.col("g")))) - F.col("y"))).alias("d"))
        each = F.explode(F.concat(F.transform("g", lambda b: F.struct(b.alias("b"), (F.col("d") / F.sqrt(F.size("g"))).alias("d"))), F.array(F.struct(F.lit(BUCKETS).alias("b"), F.col("d").alias("d")))))
        for b, d in miss.select(each.alias("e")).groupBy("e.b").agg(F.sum("e.d")).collect():
            d += RIDGE * (weights[b] if b < BUCKETS else 0.0)
            squares[b] += d * d
            step = RATE * d / math.sqrt(squares[b])
            if b < BUCKETS:
                weights[b] -= step
            else:
                constant -= step
    return Model(tuple(weights), constant)


def labelled_by_rules(parts: DataFrame, rules: Mapping[str, str], bound: int = LABELLED) -> DataFrame:
    """(host, path, verdict) of the distinct URLs that a rule decides, at most ``bound`` of each verdict by smallest hash."""
    verdict = F.lit(None).cast("string")
    for rule, v in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    distinct = stored(parts.where(F.col("rule").isNotNull()).select("host", "path", verdict.alias("verdict")).distinct(), "ruled")
    some = [distinct.where(F.col("verdict") == v).orderBy(F.xxhash64("host", "path"), "host", "path").limit(bound) for v in (ALLOW, BLOCK)]
    return some[0].unionByName(some[1])


def judge(df: DataFrame, rules: Mapping[str, str], model: Model | None = None, url_col: str = "url", prefix: str = "") -> DataFrame:
    """All columns of ``df`` and host, path, rule, score (of ``block``) and verdict, with longer names where taken.

    Without a model one is fitted to the URLs of ``df`` that a rule decides.
    """
    names = {c: free_name(prefix + c, df.columns) for c in ("host", "path", "rule", "score", "verdict")}
    url = F.col(f"`{url_col}`")
    parts = df.select("*", host_of(url).alias(names["host"]), path_of(url).alias(names["path"]))
    parts = parts.withColumn(names["rule"], rule_of(F.col(names["host"]), F.col(names["path"]), list(rules)))
    if model is None:
        plain = parts.select(*[F.col(f"`{names[c]}`").alias(c) for c in ("host", "path", "rule")])
        model = fit(labelled_by_rules(plain, rules))
    parts = parts.withColumn(names["score"], model.score(F.col(names["host"]), F.col(names["path"])))
    verdict = F.when(F.col(names["score"]) > 0.5, BLOCK).otherwise(ALLOW)
    for rule, v in rules.items():
        verdict = F.when(F.col(names["rule"]) == rule, F.lit(v)).otherwise(verdict)
    return parts.withColumn(names["verdict"], verdict)


@query("op12_url_filter")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")
