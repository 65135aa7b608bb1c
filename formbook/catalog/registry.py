"""Named queries and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.plans.skew import SkewProfile
from formbook.session import checkpoint_root, fit_partitions, hot_row_limit, prepare
from formbook.sources.runners import FLAGS_SQL, RUNNERS_SQL, load_runners, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

WITH_RUNNERS = f"with {RUNNERS_SQL.strip()}"
WITH_FLAGS = f"with {RUNNERS_SQL.strip()}, {FLAGS_SQL.strip()}"


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``covers`` lists the SURVEY ids it shows."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            fit_partitions(spark, input_rows(spark, sf_dir))
            return fn(spark, sf_dir)

        assert name not in QUERIES, name
        QUERIES[name] = run
        COVERS[name] = covers
        if sql:
            ORACLES[name] = sql
        return fn

    return add


ENTITY_KEYS = [
    ("race_id",), ("entrant_id",), ("jockey",), ("trainer",), ("track",), ("going",), ("surface",),
    ("race_type",), ("race_class",), ("sire",), ("dam",), ("damsire",),
]

_profiles: dict[tuple, SkewProfile] = {}
_tables: dict[tuple, str] = {}
_sizes: dict[tuple, int] = {}


def input_rows(spark: SparkSession, sf_dir: str) -> int:
    """Order lines of the input, the rows its runners are made of; counted once per session, from the file footers."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sizes:
        _sizes[key] = table(spark, sf_dir, "lineitem").count()
    return _sizes[key]


def runner_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runner table, written once per session next to the checkpoints.

    The stages scan it several times, each time a few columns; a stored table
    gives them column pruning and saves rebuilding it from order lines.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        path = f"{checkpoint_root(spark)}/runners-{uuid.uuid4().hex}"
        load_runners(spark, sf_dir).write.parquet(path)
        _tables[key] = path
    return spark.read.parquet(_tables[key])


def runner_skew(spark: SparkSession, sf_dir: str) -> SkewProfile:
    """Skew profile of the runner table, counted once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, hot_row_limit(spark))
    if key not in _profiles:
        _profiles[key] = SkewProfile.of(runner_table(spark, sf_dir), ENTITY_KEYS)
    return _profiles[key]


# Added before rounding, so that an exact decimal half is not decided by the
# order in which an engine happened to add.
NUDGE = 3.1415926e-8


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded double for comparison across engines."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double") + F.lit(NUDGE), digits).alias(name or c)


def r6_sql(expr: str, name: str, digits: int = 6) -> str:
    return f"round(cast({expr} as double) + {NUDGE}, {digits}) as {name}"


def i64(c: str | Column, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name or c)
