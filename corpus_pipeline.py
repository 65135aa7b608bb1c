"""The corpus pipeline: language, toxicity, near-copies, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns
the columns of ``docs``; the last returns the packed pieces.  Rows keep their values: stages
only decide which rows stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm import language, packing, simhash, toxicity
from formbook.llm.common import free_name, ready, stored, table

# A text whose most frequent letter sequences stand this far from every profile is in no known language.
LEAST_SIMILARITY = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts unlike every learned language."""
    ready(spark)
    lang, score = free_name("lang_pred", docs.columns), free_name("lang_score", docs.columns)
    found = language.identify(docs, language.production(docs), lang_as=lang, score_as=score)
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SIMILARITY)).select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that the toxicity models predict to be toxic."""
    ready(spark)
    name = free_name("toxicity", docs.columns)
    classifier = toxicity.production(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, classifier, score_as=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near-copies."""
    ready(spark)
    return simhash.survivors(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    ready(spark)
    return packing.packed(docs)


STAGES = [("language", identify_language), ("toxicity", reject_toxic), ("near_copies", drop_near_copies), ("packing", pack)]

# Fingerprints, trained models and tokenizers have no DuckDB form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
