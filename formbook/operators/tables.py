"""Table upkeep: loading, idempotent inserts, gaps, summaries, fingerprints, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.operators.joins import latest_per_key

RAW_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "race_id", "race_date", "off_time", "track", "region", "race_name", "race_class", "race_type", "going",
        "entrant_name", "entrant_id", "jockey", "trainer", "sex", "headgear", "form", "surface", "finish_pos_label")
] + [T.StructField(n, T.DoubleType()) for n in (
        "distance_furlongs", "prize_money", "weight_lbs", "odds", "lengths_behind", "official_rating")
] + [T.StructField(n, T.IntegerType()) for n in (
        "num_runners", "age", "draw", "days_since_last_run", "handicap", "finish_position", "won")])


#: Column of :func:`read_csv` that keeps a line as it was where it does not fit the schema.
BAD_RECORD = "bad_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """CSV scan with a declared schema (no inference pass); lines that do not fit are kept in ``bad_record``."""
    kept = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    return (spark.read.schema(kept).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", BAD_RECORD).option("escape", '"').option("multiLine", False).csv(path))


def read_tolerant(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Parquet scan of the wanted columns that exist; only those are read."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in wanted if c in df.columns])


def write_runners(df: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned sink: the date filter of later scans prunes year and month folders.

    Rows are gathered by month, but a large month is split into several tasks."""
    (df.withColumn("year", F.year("race_date")).withColumn("month", F.month("race_date"))
     .hint("rebalance", "year", "month").write.mode(mode).partitionBy("year", "month").parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_once(df: DataFrame, folder: str, batch_id: str) -> bool:
    """Append a batch to a ledger; a batch that is there already changes nothing.

    The rows come first, in a folder of the batch; a commit record with their number and
    fingerprint makes them count, so a batch that died in between is written anew.  Another
    content under a committed id is refused.  Returns whether rows were added.
    """
    spark = df.sparkSession
    sign = fingerprint(df, None).select(F.lit(batch_id).alias("batch_id"), "rows", "key")
    known = [r for r in _commits(spark, folder).where(F.col("batch_id") == batch_id).collect()]
    if known:
        now = sign.first()
        if (known[0]["rows"], known[0]["key"]) != (now["rows"], now["key"]):
            raise ValueError(f"batch {batch_id} is committed with other rows")
        return False
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/rows/{batch_id}")
    stored = spark.read.parquet(f"{folder}/rows/{batch_id}").drop("batch_id")
    fingerprint(stored, None).select(F.lit(batch_id).alias("batch_id"), "rows", "key").coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return True


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    empty = spark.range(0).select(F.lit("").alias("batch_id"), F.lit(0).cast("long").alias("rows"), F.lit("").alias("key"))
    try:
        return spark.read.parquet(f"{folder}/commits")
    except AnalysisException:  # nothing committed yet
        return empty


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all committed batches, with their ``batch_id``; folders without a commit record are not opened."""
    ids = [r["batch_id"] for r in _commits(spark, folder).select("batch_id").distinct().collect()]  # one a batch
    return spark.read.parquet(*[f"{folder}/rows/{i}" for i in sorted(ids)])


def since(df: DataFrame, reference: Column, days_back: int, date: str = "race_date") -> DataFrame:
    """Rows of the last ``days_back`` days before ``reference``."""
    return df.where(F.col(date) >= F.date_sub(reference, days_back))


def resolved_races(df: DataFrame) -> DataFrame:
    """Only races in which somebody finished."""
    done = df.where(F.col("finish_position") > 0).select("race_id").distinct()
    return df.join(done, "race_id", "left_semi")


def new_rows(batch: DataFrame, stored: DataFrame, keys: Sequence[str] = ("race_id", "entrant_id"),
             order: Sequence[str] = ()) -> DataFrame:
    """Rows of resolved races whose key is not stored yet; one row per key."""
    fresh = resolved_races(batch).join(stored.select(*keys), list(keys), "left_anti")
    rest = [c for c in fresh.columns if c not in keys]
    return latest_per_key(fresh, keys, [F.col(c) for c in (order or sorted(rest))])


def missing_dates(df: DataFrame, start: Column, end: Column, date: str = "race_date", keys: Sequence[str] = ()) -> DataFrame:
    """Calendar days of the window without a row, for each key (for the whole table without keys)."""
    each = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    calendar = each.select(*keys, F.explode(F.sequence(start, end)).alias(date))
    return calendar.join(df.select(*keys, date).distinct(), [*keys, date], "left_anti")


def gap_days(df: DataFrame, target: Column, date: str = "race_date", keys: Sequence[str] = ()) -> DataFrame:
    """Days between the last stored day and the target day, both excluded, for each key."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_m"))
    return last.where(F.date_add("_m", 1) <= F.date_sub(target, 1)).select(
        *keys, F.explode(F.sequence(F.date_add("_m", 1), F.date_sub(target, 1))).alias(date))


def table_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("race_date").alias("dates"),
                  F.countDistinct("track").alias("tracks"), F.countDistinct("race_id").alias("races"),
                  F.min("race_date").alias("first_date"), F.max("race_date").alias("last_date"),
                  (F.datediff(F.max("race_date"), F.min("race_date")) + 1).alias("span_days"),
                  F.countDistinct(F.trunc("race_date", "month")).alias("months"))


def row_text(df: DataFrame) -> Column:
    """A row as text that any engine can build: columns by name, doubles in ten-thousandths, nulls as ``\\N``."""
    kinds = dict(df.dtypes)
    parts = [F.round(F.col(c) * 10000).cast("long") if kinds[c] in ("double", "float") else F.col(c) for c in sorted(df.columns)]
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])


def fingerprint(df: DataFrame, date: str | None = "race_date") -> DataFrame:
    """Order-insensitive content hash of a table, with its size and date range."""
    h = F.conv(F.substring(F.md5(row_text(df).cast("binary")), 1, 12), 16, 10).cast("long")
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(h, F.lit(2**31))).alias("h1"), F.bit_xor(h).alias("h2")]
    if date:
        aggs += [F.min(date).cast("string").alias("lo"), F.max(date).cast("string").alias("hi")]
    parts = ["rows", "h1", "h2", *(["lo", "hi"] if date else [])]
    return df.agg(*aggs).select(
        *parts, F.sha1(F.concat_ws("|", F.lit(",".join(sorted(df.columns))), *[F.col(p).cast("string") for p in parts]))
        .alias("key"))


def missing_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Percentage of null (or blank text) values per column, one row per column."""
    kinds = dict(df.dtypes)

    def blank(c: str) -> Column:
        miss = F.col(c).isNull()
        return miss | (F.trim(c) == "") if kinds[c] == "string" else miss

    wide = df.agg(*[F.avg(F.when(blank(c), 100.0).otherwise(0.0)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "missing_pct")


def merge_cheapest(existing: DataFrame, added: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """Union by name, one row per key: lowest price, unpriced rows last."""
    both = existing.unionByName(added, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, price)]
    return latest_per_key(both, keys, [F.col(price).isNull(), F.col(price), *[F.col(c) for c in sorted(rest)]])


def numeric_text_columns(df: DataFrame, cols: Sequence[str], share: float = 0.5) -> DataFrame:
    """Cast text columns to double when more than ``share`` of their values are numbers."""
    row = df.agg(*[(F.count(F.col(c).try_cast("double")) / F.greatest(F.count(F.when(F.trim(c) != "", F.lit(1))),
                                                                     F.lit(1))).alias(c) for c in cols]).first()
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in cols and (row[c] or 0) > share else F.col(c)
                       for c in df.columns])


def narrow_integers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Store whole-number columns in the smallest integer type their range allows."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()

    def kind(c: str) -> str:
        lo, hi = row[f"lo_{c}"] or 0, row[f"hi_{c}"] or 0
        for name, bits in (("byte", 7), ("short", 15), ("int", 31)):
            if -(2**bits) <= lo and hi < 2**bits:
                return name
        return "long"

    return df.select(*[F.col(c).cast(kind(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# Identifiers, outcomes and leaking columns that are no model inputs.
NOT_FEATURES = [
    "race_id", "race_date", "off_time", "entrant_id", "entrant_name", "jockey", "trainer", "track", "won",
    "finish_position", "finish_pos_label", "lengths_behind", "entrant_runs_scraped", "status", "rs", "finished",
    "nonfin", "fp", "won_hist", "placed_hist", "relevance",
]
MARKET_COLUMNS = [
    "odds", "implied_prob", "norm_implied_prob", "odds_rank", "is_favourite", "log_odds", "odds_vs_field",
    "overround",
]


def feature_columns(df: DataFrame, with_market: bool = True) -> list[str]:
    """Numeric columns that may be used as model inputs."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    skip = set(NOT_FEATURES) | (set() if with_market else set(MARKET_COLUMNS))
    return [c for c, t in df.dtypes if t in numeric and c not in skip]
