"""A stream query over a table of many files."""

import __spark_entry__ as contract
from formbook.catalog import registry
from formbook.session import prepare


def test_cards_are_counted_once_a_run_however_many_files_there_are(spark, tmp_path):
    sf = contract.SMOKE_DIR
    fn = contract.queries()["stream_card_changes"]
    want = sorted(map(tuple, fn(spark, sf).collect()))
    key = (spark.sparkContext.applicationId, sf)
    before = registry.runner_table(prepare(spark), sf)
    known = registry._tables[key]
    before.repartition(130).write.parquet(f"{tmp_path}/runners")
    registry._tables[key] = f"{tmp_path}/runners"
    try:
        got = sorted(map(tuple, fn(spark, sf).collect()))
    finally:
        registry._tables[key] = known
    assert got == want and max(r[3] for r in got) == 2
