"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of one key that a single window task is allowed to sort.  Keys above the
# limit take the chunked route of formbook.plans.
HOT_ROWS_CONF = "spark.formbook.hotKeyRows"
HOT_ROWS_DEFAULT = 1_000_000

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Compressed bytes a task reads; its rows take several times as much, in every sort of the stage.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Bytes a Python task is given at once: rows may be whole arrays.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


# Rows of the largest input table for each shuffle partition.
PARTITION_ROWS = 250_000
PARTITIONS_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def fit_partitions(spark: SparkSession, rows: int) -> None:
    """Let the number of shuffle partitions grow with the input, so that what a task sorts does not.

    Adaptive execution joins partitions again where a shuffle turns out small.
    """
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(PARTITIONS_CONF, str(max(given, -(-rows // PARTITION_ROWS))))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a fresh one in local runs only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for stage tables, reachable from every executor."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` written once as a stage table (in folders by ``parts``) and read back, for plans that scan it several times."""
    path = f"{checkpoint_root(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def local_session(cores: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("formbook")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
