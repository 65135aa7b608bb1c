"""A sample of the registered queries against their check SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from formbook.catalog.registry import COVERS

ROOT = Path(__file__).resolve().parent.parent
SAMPLE = ["prior_win_rate_in_race", "market", "bet_table", "price_stream_flattened", "race_reconciliation", "ranker_agreement",
          "degenerate_races", "model_gap_tables", "content_fingerprint", "stream_card_changes", "missing_days"]


def test_contract_loads_without_a_session():
    code = "import __spark_entry__ as c; assert set(c.oracle_sql()) <= set(c.queries()); print(len(c.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracle import TABLES, rows_of
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = contract.queries()[name](spark, sf)
    cur = con.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_every_query_names_what_it_covers():
    contract.queries()
    assert all(COVERS.values())


def test_bootstrap_with_all_replicates(spark, monkeypatch):
    from formbook.operators import diagnostics as D

    seen, real = [], D.bootstrap_sums
    monkeypatch.setattr(D, "bootstrap_sums", lambda df, value, key, groups, replicates, seed: seen.append(replicates) or real(df, value, key, groups, replicates, seed))
    rows = contract.queries()["bootstrap_interval"](spark, contract.SMOKE_DIR).collect()
    assert seen == [2000] and rows and all(r.low <= r.high for r in rows)


def test_models_take_all_columns_folds_and_iterations(spark, monkeypatch):
    from pyspark.sql import functions as F

    from formbook.catalog import models

    dates = spark.range(400).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("race_date"), F.lit(False).alias("is_validation"))
    seen = []
    monkeypatch.setattr(models, "training_table", lambda *_: dates)
    monkeypatch.setattr(models, "halves", lambda df: (df, df))
    monkeypatch.setattr(models.S, "with_early_stop", lambda df: df)
    monkeypatch.setattr(models.ml, "search", lambda folds, features, grid: seen.append((folds.select("fold").distinct().count(), features)) or dates)
    monkeypatch.setattr(models.ml, "fit_trees", lambda *a, **k: seen.append(k))
    monkeypatch.setattr(models.ml, "importances", lambda *_: {})
    monkeypatch.setattr(models.ml, "prune_features", lambda df, features, _: features)
    monkeypatch.setattr(models.ml, "predict", lambda *_, **__: dates)
    monkeypatch.setattr(models, "pick", lambda df, *_: df)
    monkeypatch.setattr(models, "runner_skew", lambda *_: None)
    contract.queries()["hyperparameter_search"](spark, contract.SMOKE_DIR)
    contract.queries()["tree_model_predictions"](spark, contract.SMOKE_DIR)
    assert seen[0] == (3, models.FEATURES) and len(seen) == 3
    assert all("max_iter" not in k and k["validation"] == "is_validation" for k in seen[1:])
