"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.session import checkpoint_root, prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ASCII white space that ends a word, as a regular-expression class body.
SPACE = "\\x20\\x09-\\x0D"
# Rows and bytes of one Arrow batch; a batch ends with the row that passes either.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its DuckDB SQL where SQL can say it."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings these operators rely on."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back; later jobs survive lost executors."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``use``: a lambda variable is never inlined, a projected column may be."""
    return F.transform(F.array(value), use)[0]


def bucket(key: Column, n: int) -> Column:
    """crc32 of the key's text modulo ``n``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, lengthened by underscores until no column has it (case does not matter to Spark)."""
    have = {t.lower() for t in taken}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


# ---- check SQL --------------------------------------------------------------

#: A common table expression with the 256 remainders of the checksum polynomial in one list ``t``.
CRC_TABLE_SQL = """crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(k)))"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes, where ``crc_table`` is in scope."""
    octet = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    octets = f"list_transform(range(octet_length(encode({text}))::BIGINT), lambda i: {octet})"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
