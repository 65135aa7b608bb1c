"""Result flags every history feature starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("race_date", "race_id")

FLAG_COLUMNS = ("rs", "finished", "nonfin", "fp", "won_hist", "placed_hist", "status")


def add_result_flags(df: DataFrame) -> DataFrame:
    """Tell finishers, non-finishers and pending runners apart.

    ``fp``, ``won_hist`` and ``placed_hist`` are null for pending rows, so that
    aggregates over the past skip them.
    """
    pos = F.coalesce(F.col("finish_position"), F.lit(0))
    finished = pos > 0
    label = F.trim(F.coalesce(F.col("finish_pos_label"), F.lit(""))) if "finish_pos_label" in df.columns else F.lit("")
    nonfin = ~finished & (label != "")
    started = finished | nonfin
    return df.select(
        "*",
        started.cast("int").alias("rs"),
        finished.cast("int").alias("finished"),
        nonfin.cast("int").alias("nonfin"),
        F.when(finished, pos).alias("fp"),
        F.when(started, F.col("won")).alias("won_hist"),
        F.when(started, pos.between(1, 3).cast("int")).alias("placed_hist"),
        F.when(finished, "FINISHED").when(nonfin, "NON_FINISHER").otherwise("PENDING").alias("status"),
    )
