"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent one- to three-letter sequences, in order.  A
document's own most frequent sequences are ranked the same way; its distance to a language is
the sum of how far each sequence is out of place, a sequence missing from the profile counting
as the profile's size.  The nearest language is predicted.

Profiles are learned from a bounded sample of labelled documents (``SAMPLE`` a language, drawn
by a hash of the id); prediction is a narrow map over all documents and sees nothing but text.
Letters are lower-cased; whatever is not a letter is one space, so sequences know word ends.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing could be learned; equal distances go to the smaller language code; equal counts to the
smaller sequence; documents without an id or a language are not learned from; repeated rows
are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from formbook.llm.common import bucket, query, table

PROFILE = 400  # sequences of a profile
SAMPLE = 3000  # labelled documents a language to learn from, about
UNKNOWN = "und"
HELD_OUT_OF = 5
_SPACE = 0x20
_SHIFT = 21  # bits of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(k))[0] == "L" for k in range(sys.maxunicode + 1)])


def sequences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, count) of a text's one- to three-letter sequences, by sequence; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    letter = _letters()[codes]
    before = np.concatenate([[False], letter[:-1]])
    codes = np.where(letter, codes, _SPACE)[letter | before]
    if not len(codes):
        return codes, codes
    padded = np.concatenate([[_SPACE], codes, [_SPACE] if codes[-1] != _SPACE else []]).astype(np.int64)
    two = padded[:-1] << _SHIFT | padded[1:]
    three = two[:-1] << _SHIFT | padded[2:]
    grams = np.concatenate([codes[codes != _SPACE], two, three])
    grams.sort()
    edges = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]]))
    return grams[edges[:-1]], np.diff(edges)


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent sequences in order; equal counts in order of the sequence."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of all languages over the union of their sequences; ``size`` stands for a missing one."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int = PROFILE) -> Profiles:
        """From (language, sequence, rank from 0)."""
        languages = tuple(sorted({r[0] for r in rows}))
        grams = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        ranks = np.full((len(languages), len(grams)), size, dtype=np.int64)
        for language, gram, rank in rows:
            ranks[languages.index(language), np.searchsorted(grams, gram)] = rank
        return cls(languages, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): one less the distance's share of the largest possible."""
        grams, counts = sequences(text or "")
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        mine = top(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        known = self.grams[at] == mine
        place = np.flatnonzero(known)
        out = np.abs(self.ranks[:, at[known]] - place)
        out[self.ranks[:, at[known]] == self.size] = self.size
        distance = out.sum(axis=1) + self.size * (len(mine) - len(place))
        best = int(np.argmin(distance))
        return self.languages[best], float(1.0 - distance[best] / (self.size * len(mine)))


def learn(df: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles from the rows where ``allowed`` holds and language and id are given.

    As many rows come to the driver as the languages' profiles have entries."""
    spark = df.sparkSession
    rows = df.where(allowed & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = {r["lang"]: sample / r["count"] for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Profiles.of([], size)
    parts = 1 << 30
    drawn = spark.createDataFrame([(k, int(min(1.0, v) * parts)) for k, v in share.items()], "lang string, upto long")
    rows = rows.join(F.broadcast(drawn), "lang").where(F.pmod(F.xxhash64("i"), F.lit(parts)) < F.col("upto")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, []).append(sequences(text or ""))
            for lang, parts_ in found.items():
                grams, inverse = np.unique(np.concatenate([g for g, _ in parts_]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([c for _, c in parts_]), minlength=len(grams)).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    return Profiles.of([(r["lang"], r["gram"], r["rank"] - 1) for r in best], size)


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """Add the predicted language and its score to every row; columns of these names are replaced."""
    kept = [c for c in df.columns if c.lower() not in (lang_as.lower(), score_as.lower())]
    schema = df.select(*kept).schema.add(lang_as, "string").add(score_as, "double")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             names=[*kept, lang_as, score_as])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def production(docs: DataFrame) -> Profiles:
    """Profiles from the documents that are not held out."""
    return learn(docs, bucket(F.col("doc_id"), HELD_OUT_OF) != 0)


@query("op3_rank_order_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), production(docs))
    return found.select("doc_id", F.coalesce(bucket(F.col("doc_id"), HELD_OUT_OF) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
