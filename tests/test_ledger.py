import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.operators import tables


def test_a_batch_counts_once_and_only_when_committed(spark, tmp_path):
    folder, df = str(tmp_path / "ledger"), spark.range(20).select(F.col("id"), (F.col("id") * 0.5).alias("x"))
    assert tables.append_once(df.where("id < 10"), folder, "a")
    assert not tables.append_once(df.where("id < 10"), folder, "a")
    # A batch that died before its commit record is invisible, and written anew when it comes again.
    df.where("id = 19").withColumn("batch_id", F.lit("b")).write.parquet(f"{folder}/rows/b")
    assert tables.ledger(spark, folder).count() == 10
    assert tables.append_once(df.where("id >= 10"), folder, "b")
    assert sorted(r["id"] for r in tables.ledger(spark, folder).collect()) == list(range(20))
    with pytest.raises(ValueError):
        tables.append_once(df.where("id < 9"), folder, "a")


def test_csv_keeps_bad_lines_apart(spark, tmp_path):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    path = str(tmp_path / "csv")
    tables.write_csv(spark.createDataFrame([('a "b", c', "1"), (None, "2"), ("x", "many")], "name string, n string"), path)
    tables.read_csv(spark, path, schema).write.parquet(f"{path}-read")
    got = {(r["name"], r["n"], r[tables.BAD_RECORD]) for r in spark.read.parquet(f"{path}-read").collect()}
    assert got == {('a "b", c', 1, None), (None, 2, None), ("x", None, "x,many")}
