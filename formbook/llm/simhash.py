"""Near-copies by 64-bit SimHash, found with anchor points of a covering code.

Two fingerprints at distance 4 or less agree, up to one bit, on one of three parts of the
64 bits (four errors cannot put two into each).  A part's first 15 bits are covered by the
codewords of the perfect Hamming code, radius 1; its other bits are kept.  The anchors of a
part are all pairs of a codeword and other bits: every fingerprint has exactly one home
anchor within the covering radius, and whatever is within one bit of it on the part lies
within radius plus one of that home.  So each distinct fingerprint is replicated to every
anchor within radius plus one (about 14 a part), and each anchor compares what it holds.
For larger inputs the parts are pairs out of five blocks (ten parts of about 26 bits, still
at most one error), which keeps anchors small at more replicas; the links are the same.

Fingerprints are compared once each however many documents share them.  An anchor with more
rows than ``ANCHOR_ROWS`` is cut into pieces: homes and visitors are dealt into chunks and
each pair of chunks is one piece, so that no task holds a whole group of near-copies and no
link is lost.  In a crowded piece a spanning forest is returned instead of all pairs.

Edge cases: null and wordless texts have fingerprint zero and link like any other; repeated
rows keep one result row each; documents without an id take part, and a component of nothing
but such documents has a null id; extra columns are not looked at; no rows give no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import query, stored, table
from formbook.llm.components import components

SEED = 42
SHINGLE = 4
DISTANCE = 4
# Distinct fingerprints from which ten parts are used instead of three.
MANY_FINGERPRINTS = 100_000_000
# Rows of an anchor that one task compares at most.
ANCHOR_ROWS = 8192
# Rows up to which a piece returns its pairs, not a forest.
CROWD = 32
# Hot anchors are broadcast up to this many (16 bytes each).
BROADCAST_ANCHORS = 100_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes) -> int:
    """SimHash of the 4-word shingles, repeats included, as an unsigned 64-bit number."""
    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = list(itertools.accumulate(map(len, words), lambda a, x: a + x + 1))
    starts = [0, *(e + 1 for e in ends[:n - SHINGLE])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1:])), np.uint64, n - SHINGLE + 1)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t or b"") for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")).mapInArrow(run, "doc_id long, fp long")


# ---- anchors ----------------------------------------------------------------

_COLUMNS = np.arange(1, 16)  # parity checks of the Hamming code: column k is the number k


def _syndromes() -> np.ndarray:
    words = np.arange(1 << 15)
    out = np.zeros(1 << 15, dtype=np.int64)
    for k, column in enumerate(_COLUMNS):
        out ^= np.where(words >> k & 1, column, 0)
    return out


def _near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word its home codeword, and the up to seven others within distance two (-1: none)."""
    words, syndrome = np.arange(1 << 15), _syndromes()
    home = np.where(syndrome == 0, words, words ^ (1 << np.maximum(syndrome - 1, 0)))
    near = np.full((1 << 15, 7), -1, dtype=np.int64)
    filled = np.zeros(1 << 15, dtype=np.int64)
    for i, j in itertools.combinations(range(15), 2):
        hit = np.flatnonzero(syndrome == (_COLUMNS[i] ^ _COLUMNS[j]))
        near[hit, filled[hit]] = words[hit] ^ (1 << i) ^ (1 << j)
        filled[hit] += 1
    return home, near


HOME, NEAR = _near_codewords()


def parts(many: bool) -> list[list[int]]:
    """Bit positions of each part: three parts of a third, or all pairs out of five blocks."""
    if not many:
        return [list(b) for b in np.array_split(np.arange(64), 3)]
    blocks = [list(b) for b in np.array_split(np.arange(64), 5)]
    return [a + b for a, b in itertools.combinations(blocks, 2)]


def _gather(fps: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, bit in enumerate(bits):
        out |= (fps >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def anchors(fps: np.ndarray, many: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, whether the anchor is its home) of every replica."""
    keys, rows, homes = [], [], []
    index = np.arange(len(fps))
    for p, bits in enumerate(parts(many)):
        value = _gather(fps, bits)
        rest = (value >> 15 << 15) | (p << 40)
        word = value & 0x7FFF
        keys.append(rest | HOME[word])
        rows.append(index)
        homes.append(np.ones(len(fps), dtype=bool))
        near = NEAR[word]
        k, j = np.nonzero(near >= 0)
        keys.append(rest[k] | near[k, j])
        rows.append(k)
        # One error in the kept bits leaves none for the codeword: only the home is that near.
        for bit in range(15, len(bits)):
            keys.append((rest ^ (1 << bit)) | HOME[word])
            rows.append(index)
        homes.append(np.zeros(len(k) + len(fps) * (len(bits) - 15), dtype=bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def replicas(distinct: DataFrame, many: bool = False) -> DataFrame:
    """(anchor, fp, home) of every anchor that a fingerprint is replicated to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, row, home = anchors(fps, many)
            yield pa.record_batch([pa.array(key), pa.array(fps[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _pairs(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs inside runs of equal keys, by comparing rows at growing offsets."""
    left, right = [], []
    live = np.arange(len(key) - 1)
    for d in range(1, len(key)):
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]
        if not len(live):
            break
        hit = live[_popcount(fps[live] ^ fps[live + d]) <= DISTANCE]
        left.append(fps[hit])
        right.append(fps[hit + d])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links among ``fps`` connect: a breadth-first search, each step one vector."""
    left, right = [], []
    rest = np.unique(fps)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _popcount(rest ^ at) <= DISTANCE
            found = rest[near]
            if len(found):
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (anchor, piece, fp) rows; a group may go on in the next batch."""

    def links(anchor: np.ndarray, piece: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        group = np.concatenate([[0], np.cumsum((np.diff(anchor) != 0) | (np.diff(piece) != 0))]) if len(anchor) else anchor
        sizes = np.bincount(group) if len(group) else np.zeros(0, dtype=np.int64)
        small = sizes[group] <= CROWD if len(group) else np.zeros(0, dtype=bool)
        found = [_pairs(group[small], fps[small])]
        ends = np.cumsum(sizes)
        found += [forest(fps[ends[g] - sizes[g]:ends[g]]) for g in np.flatnonzero(sizes > CROWD)]
        a, b = np.concatenate([f[0] for f in found]).view(np.int64), np.concatenate([f[1] for f in found]).view(np.int64)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.record_batch([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["a", "b"])

    held = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0, dtype=np.uint64)]
    for b in batches:
        new = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        held = [np.concatenate([x, y.astype(x.dtype) if k < 2 else y.view(np.uint64)]) for k, (x, y) in enumerate(zip(held, new))]
        if not len(held[0]):
            continue
        cut = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        upto = cut[-1] + 1 if len(cut) else 0
        if upto:
            yield links(*(x[:upto] for x in held))
            held = [x[upto:] for x in held]
    yield links(*held)


def links(distinct: DataFrame, many: bool = False, limit: int = ANCHOR_ROWS) -> DataFrame:
    """Pairs (a, b) of linked fingerprints; crowded anchors give a forest that connects the same."""
    copies = replicas(distinct, many)
    crowded = stored(copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
                     .select("anchor", F.ceil(2 * F.col("n") / limit).cast("int").alias("chunks")), "anchors")
    small = crowded.count() <= BROADCAST_ANCHORS
    dealt = copies.join(F.broadcast(crowded) if small else crowded, "anchor", "left")
    # Chunk c of the homes meets every chunk of all rows: pieces (c, 0), (c, 1), ...
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    visits = F.transform(every, lambda c: c * F.col("chunks") + chunk)
    hosts = F.transform(every, lambda c: chunk * F.col("chunks") + c)
    pieces = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(F.col("home"), F.array_union(hosts, visits)).otherwise(visits)
    rows = dealt.select("anchor", F.explode(pieces).alias("piece"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "anchor", "piece").sortWithinPartitions("anchor", "piece").mapInArrow(_compare, "a long, b long").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: bool | None = None, limit: int = ANCHOR_ROWS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id that links lead to)."""
    prints = stored(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    if many is None:
        many = distinct.count() > MANY_FINGERPRINTS
    labels = components(links(distinct, many, limit))
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = named.join(ids, "label").select("fp", "component_id")
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is its component's smallest, once each; rows without an id stay."""
    kept = near_copies(df, id_col, text_col).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id_col))
    named = df.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.select(*df.columns).union(df.where(F.col(id_col).isNull()))


@query("op9_simhash_components")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
