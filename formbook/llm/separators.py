"""Token counts from flat token files by a scan for end-of-document ids.

A token file is one stream of fixed-width ids, each document followed by the separator, with
no index; it is kept in blocks of equal size that pay no heed to documents.  The scan finds
the separators of a block with one vector comparison and keeps only their places.  Documents
that cross blocks are stitched by a prefix scan over block summaries: how many tokens and
separators come before a block, and where the last separator before it stands.  The prefix
scan has two levels (blocks in groups, groups in files), so that even one file with most of
the tokens is no long window.

Edge cases: a null text is an empty document (0 tokens); consecutive separators are empty
documents; tokens after a file's last separator are a document marked as not ended; a block
without a separator only adds length; repeated rows are counted each; no rows give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from formbook.llm.common import query, stored, table

BLOCK = 1 << 16  # tokens of a block
GROUP = 1 << 10  # blocks of a group in the prefix scan
END_ID = 50256
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def load(path: str) -> tiktoken.Encoding:
    """Called inside tasks, once per worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def width_of(end_id: int) -> int:
    """Bytes of an id; the separator is the largest."""
    return 2 if end_id < 1 << 16 else 4


def token_files(df: DataFrame, path: str, end_id: int = END_ID, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store one token file a task: (file, block, data, ended), ``ended`` naming the documents whose separator is in the block.

    The scan reads ``data`` alone; ``ended`` is the writer's own list, to name what the scan finds."""
    dtype = f"<u{width_of(end_id)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file, number = load(path), TaskContext.get().partitionId(), 0
        held, ended, size = [], [], 0  # ids not written yet; (place of the separator, document)

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, ended, size, number
            ids = np.concatenate(held) if held else np.zeros(0, dtype=dtype)
            upto = len(ids) if final else len(ids) // block * block
            for at in range(0, upto, block):
                here = [d for place, d in ended if at <= place < at + block]
                yield pa.record_batch([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([ids[at:at + block].tobytes()], pa.binary()), pa.array([here], pa.list_(pa.int64()))],
                                      names=["file", "block", "data", "ended"])
                number += 1
            held, ended, size = [ids[upto:]], [(p - upto, d) for p, d in ended if p >= upto], len(ids) - upto

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encoding.encode_ordinary(text or ""), end_id], dtype=dtype)
                held.append(ids)
                size += len(ids)
                ended.append((size - 1, doc))
                if size >= 4 * block:
                    yield from cut(False)
        yield from cut(True)

    written = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "file int, block long, data binary, ended array<long>")
    return stored(written, "token-files")


def separators(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file, block, n, at): tokens of each block and the places of its separators."""
    dtype = f"<u{width_of(end_id)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at = [], []
            for data in b.column(2).to_pylist():
                ids = np.frombuffer(data, dtype=dtype)
                n.append(len(ids))
                at.append(np.flatnonzero(ids == end_id))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["file", "block", "n", "at"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file int, block long, n long, at array<int>")


def _prefix(df: DataFrame, value: Column, how: Callable, name: str) -> DataFrame:
    """Add ``name``: ``how`` (a sum or a maximum) of ``value`` over the file's earlier blocks, in two levels; null before the first."""
    inner = W.partitionBy("file", "group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("file").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = df.groupBy("file", "group").agg(how(value).alias("_v")).withColumn("_before", how("_v").over(outer)).select("file", "group", "_before")
    inside = df.withColumn("_inside", how(value).over(inner)).join(groups, ["file", "group"])
    both = F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_inside"), F.lit(0)) if how is F.sum else F.greatest("_before", "_inside")
    return inside.withColumn(name, both).drop("_before", "_inside")


def count_tokens(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """One row per document of the files: file, block and place ``k`` of its separator in the block,
    ordinal in the file, start, n_tokens (without the separator), ended."""
    found = stored(separators(blocks, end_id), "separators").withColumn("group", F.floor(F.col("block") / GROUP))
    placed = _prefix(found, F.col("n"), F.sum, "first")
    placed = _prefix(placed, F.size("at").cast("long"), F.sum, "earlier")
    last = F.when(F.size("at") > 0, F.col("first") + F.element_at("at", -1) + 1)
    placed = _prefix(placed.withColumn("after", last), F.col("after"), F.max, "open")
    # Where each document of the block starts: after the separator before it, here or in an earlier block.
    whole = placed.select("file", "block", "first", "earlier", F.coalesce("open", F.lit(0).cast("long")).alias("open"), "at", F.posexplode("at").alias("k", "place"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("first") + F.get("at", F.col("k") - 1) + 1)
    rows = whole.withColumn("start", start).select(
        "file", "block", "k", (F.col("earlier") + F.col("k")).alias("ordinal"), "start",
        (F.col("first") + F.col("place") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    files = placed.groupBy("file").agg(F.sum("n").alias("n"), F.sum(F.size("at")).alias("docs"), F.coalesce(F.max("after"), F.lit(0).cast("long")).alias("open"))
    tails = files.where("n > open").select(
        "file", F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("k"), F.col("docs").alias("ordinal"),
        F.col("open").alias("start"), (F.col("n") - F.col("open")).alias("n_tokens"), F.lit(False).alias("ended"))
    return rows.union(tails)


def named(counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add the writer's doc_id to each document that the scan found."""
    names = blocks.select("file", "block", F.posexplode("ended").alias("k", "doc_id"))
    return counts.join(names, ["file", "block", "k"], "left")


@query("op1_separator_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return named(count_tokens(blocks), blocks).select("doc_id", "n_tokens", "file", "ordinal", "start", "ended")
