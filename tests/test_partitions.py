"""Shuffle partitions that grow with the input."""

from formbook.session import PARTITION_ROWS, PARTITIONS_CONF, fit_partitions


def test_partitions_grow_with_the_input(spark):
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        fit_partitions(spark, 10)
        assert int(spark.conf.get(PARTITIONS_CONF)) == given
        fit_partitions(spark, 50 * PARTITION_ROWS + 1)
        assert int(spark.conf.get(PARTITIONS_CONF)) == 51
    finally:
        spark.conf.unset(PARTITIONS_CONF)
