"""Fits of all folds in the same passes against one plain fit a fold."""

import datetime as dt
import math

import numpy as np
import pytest

from formbook.operators import splits as S
from formbook.operators import walkforward as W

START = dt.date(2020, 1, 1)
X = ["a", "b", "c", "flat"]


def plain(x, y, ridge):
    """Gradient of a ridge logistic fit brought to zero by damped Newton steps on standardised features."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), np.where(sd > 1e-9, (x - mean) / np.where(sd > 1e-9, sd, 1), 0)])
    pen = np.diag([0.0, *[ridge] * x.shape[1]])
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        w -= 0.5 * np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (p - y) + pen @ w)
    return 1 / (1 + np.exp(-z @ w)), lambda q: 1 / (1 + np.exp(-np.column_stack([np.ones(len(q)), np.where(sd > 1e-9, (q - mean) / np.where(sd > 1e-9, sd, 1), 0)]) @ w))


@pytest.fixture(scope="module")
def races(spark):
    r = np.random.default_rng(5)
    rows = []
    for race in range(900):
        day, n = START + dt.timedelta(int(race // 4)), int(r.integers(4, 9))
        x = r.normal(size=(n, 3)) * [1, 40, 0.01] + [0, 1000, 5]
        win = int(np.argmax(x[:, 0] + (x[:, 1] - 1000) / 40 + r.gumbel(size=n)))
        for k in range(n):
            a = [None, math.nan, math.inf][race % 3] if r.random() < 0.02 else float(x[k, 0])
            rows.append((race, k, day, a, float(x[k, 1]), float(x[k, 2]), 3.0, int(k == win), 1 + (k - win) % n, float(r.uniform(1.2, 20)), n, 0, "t"))
    ddl = "race_id long, entrant_id long, race_date date, a double, b double, c double, flat double, won int, finish_position int, odds double, num_runners int, handicap int, track string"
    df = spark.createDataFrame(rows, ddl).repartition(5)
    return df.cache(), rows


def test_every_fold_equals_a_fit_of_its_own(races):
    df, rows = races
    oof = {(r.race_id, r.entrant_id): r for r in W.walk_forward(df, X).collect()}
    values = np.array([[0.0 if v is None or not math.isfinite(v) else v for v in r[3:7]] for r in rows])
    day, won, race = np.array([r[2] for r in rows]), np.array([r[7] for r in rows]), np.array([r[0] for r in rows])
    months = sorted({d.replace(day=1) for d in day})
    checked = 0
    for m in months:
        train = day <= m - dt.timedelta(days=8)
        test = np.array([d.replace(day=1) == m for d in day])
        if train.sum() < 50 or test.sum() < 10:
            assert not any(r.fold == m for r in oof.values())
            continue
        _, predict = plain(values[train], won[train], W.RIDGE)
        p = predict(values[test])
        for k, i in enumerate(np.flatnonzero(test)):
            r = oof[rows[i][0], rows[i][1]]
            assert r.fold == m and r.train_rows == train.sum()
            assert r.model_prob == pytest.approx(p[k] / p[race[test] == rows[i][0]].sum(), abs=1e-7)
            checked += 1
    assert checked == len(oof) > 3000


def test_the_future_changes_no_earlier_fold(races):
    df, _ = races
    early = df.where("race_date < '2020-05-01'")
    folds = [S.monthly_folds(x) for x in (df, early)]
    whole, part = (W.fit_folds(x, f, X[:3]) for x, f in zip((df, early), folds))
    assert part.months == whole.months[:len(part.months)] and len(part.months) >= 3
    assert np.allclose(part.weights, whole.weights[:len(part.months)], atol=1e-6)


def test_separable_constant_and_empty_data(spark, races):
    df, _ = races
    certain = df.withColumn("a", df.won * 100.0)
    models = W.fit_folds(certain, S.monthly_folds(certain), ["a", "flat"])
    assert np.isfinite(models.weights).all() and (models.weights[:, 1] > 0).all() and (models.weights[:, 2] == 0).all()
    assert W.walk_forward(df.where("false"), X).count() == 0
    assert W.walk_forward(df.where("race_date < '2020-01-09'"), X).count() == 0
