"""Finding keys too large for one window task.

A window partitions by its key, so one key lands in one task.  Before ordering
a key's rows the operators ask a :class:`SkewProfile` whether any key is larger
than the session's limit.  The answer costs one map-side combined count over the
key columns only; it decides which plan runs, never what the result is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.session import hot_row_limit

# Hot-key hashes are shipped to every task only up to this many (8 bytes each).
BROADCAST_KEYS = 100_000


def key_hash(keys: Iterable[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


class SkewProfile:
    """Which keys of a dataset hold more rows than one task should sort."""

    def __init__(self, limit: int, hot: dict[tuple[str, ...], DataFrame | None]):
        self.limit = limit
        self._hot = hot

    @classmethod
    def of(cls, df: DataFrame, keysets: Iterable[Iterable[str]], limit: int | None = None) -> SkewProfile:
        """Count every key set in one job: a row fans out to one hash per key set
        and is combined map-side, so only the distinct hashes travel."""
        keysets = [tuple(k) for k in keysets]
        limit = limit or hot_row_limit(df.sparkSession)
        tagged = F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), key_hash(k).alias("h")) for i, k in enumerate(keysets)])
        )
        heavy = (
            df.select(tagged.alias("t"))
            .groupBy("t.i", "t.h")
            .count()
            .where(F.col("count") > limit)
            .select("i", "h")
        )
        found = heavy.limit(BROADCAST_KEYS + 1).collect()
        hot: dict[tuple[str, ...], DataFrame | None] = {}
        if len(found) > BROADCAST_KEYS:
            heavy = heavy.checkpoint()
            for i, k in enumerate(keysets):
                hot[k] = heavy.where(F.col("i") == i).select("h")
        else:
            for i, k in enumerate(keysets):
                rows = [(r["h"],) for r in found if r["i"] == i]
                hot[k] = F.broadcast(df.sparkSession.createDataFrame(rows, "h long")) if rows else None
        return cls(limit, hot)

    def hot(self, df: DataFrame, keys: Iterable[str]) -> DataFrame | None:
        """Hashes of the hot keys, or None when every key fits one task."""
        keys = tuple(keys)
        if keys in self._hot:
            return self._hot[keys]
        # A combination never holds more rows than any of its parts.
        for part, found in self._hot.items():
            if found is None and set(part) <= set(keys):
                self._hot[keys] = None
                return None
        found = SkewProfile.of(df, [keys], self.limit)._hot[keys]
        self._hot[keys] = found
        return found

    def split(self, df: DataFrame, keys: Iterable[str]) -> tuple[DataFrame, DataFrame | None]:
        """(rows of ordinary keys, rows of hot keys or None)."""
        keys = tuple(keys)
        hot = self.hot(df, keys)
        if hot is None:
            return df, None
        marked = df.withColumn("_kh", key_hash(keys))
        hot = hot.withColumnRenamed("h", "_kh")
        return (
            marked.join(hot, "_kh", "left_anti").drop("_kh"),
            marked.join(hot, "_kh", "left_semi").drop("_kh"),
        )


def profile_for(df: DataFrame, keys: Iterable[str], skew: SkewProfile | None) -> SkewProfile:
    return skew if skew is not None else SkewProfile.of(df, [tuple(keys)])
