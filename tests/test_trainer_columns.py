import __spark_entry__ as contract
from formbook.plans import ordered
from formbook.session import HOT_ROWS_CONF


def test_hot_trainers_are_stored_without_the_columns_of_others(spark, monkeypatch):
    seen, real = [], ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df, *parts: seen.append(df.columns) or real(df, *parts))
    fn, sf = contract.queries()["trainer_record"], contract.SMOKE_DIR
    want = sorted(map(str, fn(spark, sf).collect()))
    spark.conf.set(HOT_ROWS_CONF, "100")
    try:
        got = sorted(map(str, fn(spark, sf).collect()))
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert got == want
    assert seen and not any({"entrant_name", "headgear", "sire"} & set(c) for c in seen)
