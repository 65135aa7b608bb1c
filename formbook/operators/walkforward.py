"""Walk-forward validation with a fit for every fold, all folds in the same passes.

A fold's model is a ridge logistic regression on the features as its own training rows
standardise them.  Newton's method needs, for each fold, the sum of a gradient and of products
of features over its rows; one map over the rows gathers these sums for all folds at once (a row
counts in every fold that trains on its day), so a pass reads the rows once, whatever the number
of folds, and shuffles only sums.  What comes to the driver is bounded by months times squared
features, and days times features for the means.

Missing and infinite feature values count as zero; rows without a date or label are left out;
a constant feature gets no weight; without a fold the results are empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.functions.numeric import clip, finite
from formbook.operators.splits import monthly_folds
from formbook.plans.within import with_totals

RIDGE = 1.0  # penalty on half the squared weights of the standardised features
TASKS = 2000  # tasks that hand in sums; more partitions are read together
_CELLS = 1 << 20


@dataclass(frozen=True)
class FoldModels:
    """Intercept and weights on the raw features, a row a fold."""

    months: list[date]
    train_rows: np.ndarray
    weights: np.ndarray
    passes: int


def _values(features: Sequence[str]) -> list:
    return [F.coalesce(finite(c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]


def _moments(rows: DataFrame, p: int, ends: np.ndarray) -> tuple:
    """(means, deviations over all rows; rows, label sum, means, deviations of each fold in units of the former)."""
    x = [f"x{i}" for i in range(p)]
    first = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in x], *[F.stddev_pop(c).alias(f"s_{c}") for c in x]).first()
    mean, sd = (np.array([first[f"{k}_{c}"] or 0.0 for c in x]) for k in "ms")
    sd[sd < 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
    unit = [((F.col(c) - float(m)) / float(s)) for c, m, s in zip(x, mean, sd)]
    # One row a calendar day.
    days = rows.groupBy("day").agg(F.count(F.lit(1)), F.sum("y"), *[F.sum(u) for u in unit], *[F.sum(u * u) for u in unit]).orderBy("day").collect()
    sums = np.vstack([np.zeros(2 + 2 * p), np.cumsum([[float(v) for v in r[1:]] for r in days], axis=0).reshape(-1, 2 + 2 * p)])
    at = sums[np.searchsorted([r[0] for r in days], ends, "right")]
    n = np.maximum(at[:, :1], 1.0)
    fold_mean = at[:, 2:2 + p] / n
    fold_sd = np.sqrt(np.maximum(at[:, 2 + p:] / n - fold_mean**2, 0.0))
    return mean, sd, at[:, 0], at[:, 1], fold_mean, fold_sd


def _sums(rows: DataFrame, ends: np.ndarray, mean: np.ndarray, sd: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each fold the loss, the gradient and the products of the features (upper triangle), summed over its rows."""
    p = len(mean)
    left, right = np.triu_indices(p + 1)
    width = 1 + (p + 1) + len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ends), width))
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for i in range(0, b.num_rows, step := max(1, _CELLS // max(len(left), len(ends)))):
                day, y, *x = (c[i:i + step] for c in cols)
                x = np.vstack([np.ones(len(day)), *[(v - m) / s for v, m, s in zip(x, mean, sd)]]).T
                inside = day[:, None] <= ends
                score = np.clip(x @ weights.T, -500, 500)
                prob = 1.0 / (1.0 + np.exp(-score))
                total[:, 0] += (inside * (np.logaddexp(0.0, score) - y[:, None] * score)).sum(axis=0)
                total[:, 1:p + 2] += (inside * (prob - y[:, None])).T @ x
                total[:, p + 2:] += (inside * prob * (1.0 - prob)).T @ (x[:, left] * x[:, right])
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(ends)), width), pa.int32()), pa.array(np.tile(np.arange(width), len(ends)), pa.int32()),
                               pa.array(total.ravel())], names=["fold", "at", "v"])

    parts = rows.coalesce(TASKS).mapInArrow(run, "fold int, at int, v double")
    out = np.zeros((len(ends), width))
    for r in parts.groupBy("fold", "at").agg(F.sum("v").alias("v")).collect():
        out[r["fold"], r["at"]] = r["v"]
    return out


def fit_folds(df: DataFrame, folds: DataFrame, features: Sequence[str], label: str = "won", day: str = "race_date",
              ridge: float = RIDGE, max_passes: int = 40, tolerance: float = 1e-9) -> FoldModels:
    """A model for each row of ``folds`` (``test_month``, ``train_end``) from the rows of ``df`` up to its ``train_end``.

    ``df`` is read once a pass; store it before.  A step that makes a fold's loss larger is halved.
    """
    plan = folds.select("test_month", F.unix_date("train_end").alias("end")).orderBy("test_month").collect()  # one row a month
    months, ends, p = [r["test_month"] for r in plan], np.array([r["end"] for r in plan], dtype=np.int64), len(features)
    if not plan:
        return FoldModels([], np.zeros(0), np.zeros((0, p + 1)), 0)
    rows = df.where(F.col(day).isNotNull() & F.col(label).isNotNull()).select(
        F.unix_date(day).cast("long").alias("day"), F.col(label).cast("double").alias("y"), *_values(features))
    mean, sd, n, won, fold_mean, fold_sd = _moments(rows, p, ends)
    flat = fold_sd < 1e-9
    scale = np.where(flat, 1.0, fold_sd)
    # a[f] takes (1, features in common units) to (1, features as fold f standardises them).
    a = np.zeros((len(ends), p + 1, p + 1))
    a[:, 0, 0] = 1.0
    a[:, range(1, p + 1), range(1, p + 1)] = np.where(flat, 0.0, 1.0 / scale)
    a[:, 1:, 0] = np.where(flat, 0.0, -fold_mean / scale)
    rate = np.clip(won / np.maximum(n, 1.0), 1e-6, 1 - 1e-6)
    w = np.zeros((len(ends), p + 1))
    w[:, 0] = np.log(rate / (1 - rate))
    penalty = np.diag([0.0, *[ridge] * p])
    best, kept, step = np.full(len(ends), math.inf), w.copy(), np.zeros_like(w)
    left, right = np.triu_indices(p + 1)
    passes = 0
    while passes < max_passes:
        passes += 1
        sums = _sums(rows, ends, mean, sd, np.einsum("fi,fij->fj", w, a))
        loss = sums[:, 0] + 0.5 * ridge * (w[:, 1:] ** 2).sum(axis=1)
        for f in range(len(ends)):
            if loss[f] > best[f] + 1e-9 * max(1.0, abs(best[f])):
                step[f] /= 2.0
            else:
                h = np.zeros((p + 1, p + 1))
                h[left, right] = h[right, left] = sums[f, p + 2:]
                gradient = a[f] @ sums[f, 1:p + 2] + penalty @ w[f]
                curve = a[f] @ h @ a[f].T + penalty + np.diag([0.0, *flat[f].astype(float)])
                step[f] = np.linalg.lstsq(curve, -gradient, rcond=None)[0]
                best[f], kept[f] = loss[f], w[f]
        w = kept + step
        if np.abs(step).max() < tolerance:
            break
    common = np.einsum("fi,fij->fj", w, a)
    raw = common.copy()
    raw[:, 1:] = common[:, 1:] / sd
    raw[:, 0] -= (common[:, 1:] * mean / sd).sum(axis=1)
    return FoldModels(months, n.astype(np.int64), raw, passes)


def model_table(spark, models: FoldModels) -> DataFrame:
    """One row a fold: ``test_month``, ``train_rows``, intercept and weights on the raw features."""
    rows = [(m, int(n), float(w[0]), [float(v) for v in w[1:]]) for m, n, w in zip(models.months, models.train_rows, models.weights)]
    return spark.createDataFrame(rows, "test_month date, train_rows long, intercept double, weights array<double>")


def out_of_fold(df: DataFrame, models: FoldModels, features: Sequence[str], day: str = "race_date", name: str = "model_prob", skew=None) -> DataFrame:
    """The rows of the folds' test months with ``fold`` (its month), its ``train_rows`` and the probability its model gives,
    scaled to a sum of one a race."""
    table = model_table(df.sparkSession, models).withColumnRenamed("test_month", "fold").withColumnRenamed("weights", "_w").withColumnRenamed("intercept", "_b")
    rows = df.drop("fold", "train_rows").withColumn("fold", F.trunc(day, "month").cast("date"))
    rows = rows.join(F.broadcast(table), "fold")  # one row a month
    score = sum((F.col("_w")[i] * F.coalesce(finite(c), F.lit(0.0)) for i, c in enumerate(features)), F.col("_b"))
    rows = rows.withColumn("_p", clip(1.0 / (1.0 + F.exp(-score)), 1e-9, 1 - 1e-9)).drop("_w", "_b")
    rows = with_totals(rows, ["race_id"], {"_all": F.sum("_p")}, skew)
    return rows.withColumn(name, F.col("_p") / F.col("_all")).drop("_p", "_all")


def walk_forward(df: DataFrame, features: Sequence[str], label: str = "won", purge_days: int = 7, min_train: int = 50, min_test: int = 10,
                 skew=None) -> DataFrame:
    """Out-of-fold probabilities of every test month; ``df`` should be stored, it is read several times."""
    df = df.where(F.col("finish_position") > 0)
    folds = monthly_folds(df, purge_days, min_train, min_test)
    return out_of_fold(df, fit_folds(df, folds, features, label), features, skew=skew)


def fold_report(oof: DataFrame, bets: DataFrame) -> DataFrame:
    """One row a fold: sizes, Brier score, and number, winners and profit of each strategy's bets."""
    p = F.col("model_prob")
    sizes = oof.groupBy("fold").agg(F.max("train_rows").alias("train_rows"), F.count(F.lit(1)).alias("test_rows"),
                                    F.avg((p - F.col("won")) ** 2).alias("brier"))
    sums = []
    for s in ("top_pick", "value"):
        here = F.col("strategy") == s
        sums += [F.count(F.when(here, 1)).alias(f"{s}_bets"), F.coalesce(F.sum(F.when(here, F.col("won"))), F.lit(0)).alias(f"{s}_winners"),
                 F.coalesce(F.sum(F.when(here, F.col("pnl"))), F.lit(0.0)).alias(f"{s}_pnl")]
    per = bets.withColumn("fold", F.trunc("race_date", "month").cast("date")).groupBy("fold").agg(*sums)
    zero = {c: 0 for c in per.columns if c != "fold"}
    return sizes.join(per, "fold", "left").fillna(zero)
