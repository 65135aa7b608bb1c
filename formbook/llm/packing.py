"""Packing token sequences by non-negative least squares over length combinations.

Documents are tokenised and stored once, with their rank among the documents of the same
remainder in the same chunk (a task's output).  Full windows stand alone.  The remainders'
histogram, at most as long as the window, comes to the driver, where a plan is made that does
not grow with the data: combinations of up to three length classes that fill a window are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
rounded down, classes are resolved to exact lengths, and what is left is packed greedily,
best fit first; once as many windows are open as the left-over tokens need, a piece that fits
nowhere is cut to fill a gap.  A document finds its place by its global rank: chunk counts are
summed up to its chunk, and the plan maps (remainder, rank) to windows.  One shuffle, on
(chunk, remainder), moves the ids; no group is gathered.

Edge cases: a null text is an empty document (only the end id); repeated rows are packed each;
a null id is kept; an empty table gives no pieces; any document length is cut as needed.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from formbook.llm.common import query, stored, table
from formbook.llm.words import load

WINDOW = 4096
CLASSES = 256  # length classes of a window for the least-squares fit
MIN_CUT = 64  # a piece is not cut to fill a smaller gap
END_ID = 2
VOCABULARY = "word_bpe_49k.json"


# ---- the plan ---------------------------------------------------------------


def combinations(n: int) -> list[tuple[int, ...]]:
    """All ways to fill n with one, two or three classes, in falling order."""
    out: list[tuple[int, ...]] = [(n,)]
    out += [(n - a, a) for a in range(1, n // 2 + 1)]
    out += [(n - a - b, b, a) for a in range(1, n // 3 + 1) for b in range(a, (n - a) // 2 + 1)]
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, tolerance: float = 1e-9, rounds: int = 2000) -> np.ndarray:
    """Non-negative x with the least ||matrix x - target||, by active sets."""
    n = matrix.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    slack = tolerance * max(1.0, float(np.abs(target).max(initial=0.0)))
    for _ in range(rounds):
        pull = matrix.T @ (target - matrix @ x)
        pull[active] = -np.inf
        best = int(np.argmax(pull))
        if pull[best] <= slack:
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            part = matrix[:, columns]
            gram = part.T @ part
            gram[np.diag_indices(len(columns))] += 1e-10
            trial = np.linalg.solve(gram, part.T @ target)
            if (trial > 0).all():
                x[:] = 0
                x[columns] = trial
                break
            low = columns[trial <= 0]
            now, aim = x[low], trial[trial <= 0]
            step = float(np.min(now / np.maximum(now - aim, 1e-300)))
            x[columns] += step * (trial - x[columns])
            active[columns[x[columns] <= slack]] = False
            x[~active] = 0
    return x


@dataclass
class Plan:
    """``places[length]``: runs of (first rank, documents, pieces), a piece being (start, length, first sequence, offset)."""

    window: int
    sequences: int = 0
    places: dict[int, list[tuple[int, int, list[tuple[int, int, int, int]]]]] = field(default_factory=dict)


class _Builder:
    """Deals ranks of each length to runs of equal sequences."""

    def __init__(self, window: int, counts: Mapping[int, int]):
        self.window = window
        self.left = {l: c for l, c in counts.items() if c > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.cuts: dict[int, list[tuple[int, int, tuple[int, int, int, int]]]] = {}  # length -> (rank, count, piece)

    def take(self, length: int, count: int) -> int:
        first = self.rank[length]
        self.rank[length] += count
        self.left[length] -= count
        return first

    def put(self, length: int, first: int, count: int, start: int, size: int, sequence: int, offset: int) -> None:
        self.cuts.setdefault(length, []).append((first, count, (start, size, sequence, offset)))

    def open(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def plan(self) -> Plan:
        """Cut each length's ranks where any of its pieces begins or ends."""
        out = Plan(self.window, self.sequences)
        for length, pieces in self.cuts.items():
            edges = sorted({e for first, count, _ in pieces for e in (first, first + count)})
            runs: list[tuple[int, int, list]] = [(a, b - a, []) for a, b in zip(edges, edges[1:])]
            for first, count, (start, size, sequence, offset) in pieces:
                for k in range(bisect.bisect_left(edges, first), bisect.bisect_left(edges, first + count)):
                    runs[k][2].append((start, size, sequence + runs[k][0] - first, offset))
            for run in runs:
                run[2].sort()
            out.places[length] = runs
        return out


def make_plan(counts: Mapping[int, int], window: int = WINDOW, classes: int = CLASSES, min_cut: int = MIN_CUT) -> Plan:
    """A plan for ``counts`` documents of each length below the window."""
    build = _Builder(window, counts)
    classes = min(classes, window)
    step = -(-window // classes)
    members: dict[int, list[int]] = {}
    for length in sorted(build.left, reverse=True):
        members.setdefault(-(-length // step), []).append(length)
    target = np.zeros(window // step + 1)
    for length, count in build.left.items():
        target[-(-length // step)] += count
    # Combinations of classes that occur; a missing class would only be left empty.
    combos = [c for c in combinations(window // step) if all(target[k] for k in c)]
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, count), sorted
    if combos:
        matrix = np.zeros((len(target), len(combos)))
        for j, combo in enumerate(combos):
            for k in combo:
                matrix[k, j] += 1
        repeats = np.floor(nnls(matrix, target) + 1e-6).astype(np.int64)
        for j in np.flatnonzero(repeats):
            wanted = int(repeats[j])
            while wanted:
                # Exact lengths of this run: the longest left of each class, as often as all allow.
                lengths = []
                for k in combos[j]:
                    fit = next((l for l in members[k] if build.left[l] > lengths.count(l)), None)
                    if fit is None:
                        break
                    lengths.append(fit)
                if len(lengths) < len(combos[j]):
                    break
                count = min(wanted, *(build.left[l] // lengths.count(l) for l in lengths))
                first, offset = build.open(count), 0
                for length in lengths:
                    build.put(length, build.take(length, count), count, 0, length, first, offset)
                    offset += length
                wanted -= count
                if offset < window:
                    bisect.insort(gaps, (window - offset, first, count))
    # What is left: items are (-size, length, first rank, count, start within the remainder).
    items = [(-l, l, build.rank[l], c, 0) for l, c in build.left.items() if c]
    heapq.heapify(items)
    allowed = -(-sum(-s * c for s, _, _, c, _ in items) // window)
    while items:
        size, length, rank, count, start = heapq.heappop(items)
        size = -size
        at = bisect.bisect_left(gaps, (size,))
        if at < len(gaps):
            gap, first, room = gaps.pop(at)
        elif allowed > 0 or not gaps or gaps[-1][0] < min_cut:
            if allowed <= 0:  # only gaps too small to cut for are left
                allowed = -(-size * count // window)
            room = min(count, allowed)
            allowed -= room
            gap, first = window, build.open(room)
        else:
            gap, first, room = gaps.pop()
        n = min(count, room)
        part = min(size, gap)
        build.put(length, rank, n, start, part, first, window - gap)
        if room > n:
            bisect.insort(gaps, (gap, first + n, room - n))
        if gap > part:
            bisect.insort(gaps, (gap - part, first, n))
        if count > n:
            heapq.heappush(items, (-size, length, rank + n, count - n, start))
        if size > part:
            heapq.heappush(items, (part - size, length, rank, n, start + part))
    return build.plan()


# ---- DataFrame operators ----------------------------------------------------

_ENCODED = "doc_id long, chunk int, n long, rest int, rank long, full_before long, ids binary"


def tokenised(df: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the ids of every document with its chunk and its ranks inside the chunk.

    ``rest`` is the length beyond full windows, ``rank`` counts earlier documents of the chunk
    with this rest, ``full_before`` earlier full windows.  The ranks belong to the one task
    attempt whose output was committed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        narrow = f"<u{tokenizer.width}"
        chunk, seen, full = TaskContext.get().partitionId(), {}, 0
        for b in batches:
            rows = []
            for data in tokenizer.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                ids = np.append(np.frombuffer(data, dtype="<u4"), np.uint32(end_id)).astype(narrow)
                rest = len(ids) % window
                rows.append((len(ids), rest, seen.get(rest, 0), full, ids.tobytes()))
                seen[rest] = seen.get(rest, 0) + 1
                full += len(ids) // window
            n, rest, rank, before, ids = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([
                b.column(0), pa.array([chunk] * b.num_rows, pa.int32()), pa.array(n, pa.int64()), pa.array(rest, pa.int32()),
                pa.array(rank, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "chunk", "n", "rest", "rank", "full_before", "ids"])

    return stored(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _ENCODED), "tokens")


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Sequences of one full window are numbered from here on, by chunk and place in it.
FULL = 1 << 40


def _place(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    firsts = {length: [run[0] for run in runs] for length, runs in plan.places.items()}
    window = plan.window
    for b in batches:
        out: list[tuple] = []
        for doc, chunk, n, rest, rank, full, data in zip(*(c.to_pylist() for c in b.columns)):
            ids = np.frombuffer(data, dtype=f"<u{len(data) // n}").astype("<u4")
            for k in range(n // window):
                out.append((doc, k * window, window, ids[k * window:(k + 1) * window].tobytes(), n, (chunk + 1) * FULL + full + k, 0))
            if rest:
                first, _, pieces = plan.places[rest][bisect.bisect_right(firsts[rest], rank) - 1]
                for start, length, sequence, offset in pieces:
                    at = n - rest + start
                    out.append((doc, at, length, ids[at:at + length].tobytes(), n, sequence + rank - first, offset))
        cols = list(zip(*out)) if out else [[]] * len(_PIECES)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _PIECES)], schema=_PIECES)


def pack(df: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset."""
    docs = tokenised(df, path, end_id, window, id_col, text_col)
    counts = stored(docs.groupBy("chunk", "rest").agg(F.count(F.lit(1)).alias("c")), "counts")
    histogram = {r["rest"]: r["c"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}
    plan = make_plan(histogram, window)
    before = W.partitionBy("rest").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("chunk", "rest", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    ranked = docs.join(bases.hint("shuffle_hash"), ["chunk", "rest"]).select(
        "doc_id", "chunk", "n", "rest", (F.col("base") + F.col("rank")).alias("rank"), "full_before", "ids")
    return ranked.mapInArrow(lambda batches: _place(plan, batches), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


@query("op2_nnls_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """The production packing of documents, with a checksum in the place of the ids."""
    pieces = pack(docs, public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
