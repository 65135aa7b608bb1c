"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, toxic and ordinary, give the probability of each letter after up to five before
it in its word.  Both discount their own counts and hand the rest to one shared Kneser-Ney
model of all labelled texts (continuation counts below the top order), with ``PRIOR`` further
counts, so a rare expression is judged by what both classes share and says nothing by itself.
A text's score compares its two log-likelihoods, normalised by length: the mean difference
over all letters, and how far single words exceed it.  A logistic calibration on labelled
texts that the models have not seen turns these into a probability.

Learning uses every labelled text once: of exact copies with one label one speaks for all.
Counts, continuation counts and differences of all letter sequences are Spark tables, so the
model grows with the input; only the calibration sample is bounded, by ``CALIBRATION``.  A
finished model of up to ``PACKED_BYTES`` (16 bytes a sequence; its size is counted first) goes
with the tasks as two sorted arrays, and scoring is a narrow step over the texts.  A larger
one stays a table: the documents are cut into blocks, the contexts of each block's words are
joined with the model, and the block is scored by what it asked for.  Both ways give the same
scores up to rounding.

Edge cases: null and wordless texts have neutral features and get the calibrated score of
such; labels with a null id or label are not used, an id labelled twice is toxic if any row
says so; without both classes among the labels every difference is zero and the score is the
share of toxic labels; repeated rows are scored each; texts are read whole, whatever their
length; other columns stay as they are, one of the score's name is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from formbook.llm.common import bucket, query, stored, table

ORDER = 6
DISCOUNT = 0.75
PRIOR = 50.0
LETTERS = 256  # the uniform model under the shared one
BLOCK_ROWS, BLOCK_BYTES = 20_000, 32 << 20  # documents scored by one part of the model, and their bytes
CALIBRATION = 20_000  # labelled texts to calibrate on, about
BROADCAST_ROWS = 200_000  # ids with labels are broadcast up to this many (16 bytes each)
PACKED_BYTES = 128 << 20  # models up to this size go with the tasks
REMEMBERED = 150_000  # words remembered by a worker
EXCESS = 1.0  # log-likelihood difference from which a word stands out
FOLDS, HELD_OUT, CALIBRATED = 4, 2, 3
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(word: str) -> list[str]:
    """Each letter of the word, and its end, with up to five letters before it; ``^`` starts a word, ``$`` ends it."""
    marked = f"^{word}$"
    return [marked[max(0, k - ORDER + 1):k + 1] for k in range(1, len(marked))]


# ---- a packed model ---------------------------------------------------------

_STEP, _AFTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of each slice of at most ``ORDER`` letters; no letter is zero."""
    out = np.zeros(len(start), np.uint64)
    for k in range(ORDER):
        at = start + k
        out = np.where(at < end, out * _STEP + points[np.minimum(at, max(0, len(points) - 1))], out)
    return out


class PackedModel:
    """``LetterModel`` as sorted hashes and differences; contexts' defaults are under hashes of their own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def parts(contexts: list[str], letters: list[str], differences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, values) of rows of ``model_table``."""
        keys, values = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for context, after, data in zip(contexts, letters, differences):
            head = 0
            for c in context:
                head = (head * int(_STEP) + ord(c) + 1) & (1 << 64) - 1
            heads = np.full(1, head, np.uint64)
            keys.append(np.concatenate([heads ^ _AFTER, heads * _STEP + _points(after)]))
            values.append(np.frombuffer(data, ">f8").astype(np.float64))
        return np.concatenate(keys), np.concatenate(values)

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        return at, self.keys[at] == wanted

    def words(self, words: list[str]) -> list[float]:
        """``LetterModel.word`` of each."""
        if not words or not len(self.keys):
            return [0.0] * len(words)
        points = _points("".join(f"^{w}$" for w in words))
        size = np.array([len(w) + 2 for w in words], np.int64)
        first = np.cumsum(size) - size
        at = np.arange(len(points))
        begin = np.repeat(first, size)
        gram = at > begin
        at, begin = at[gram], begin[gram]
        start = np.maximum(begin, at - ORDER + 1)
        found, known = self._find(_hashes(points, start, at + 1))
        value = np.where(known, self.values[found], 0.0)
        rest = np.flatnonzero(~known)
        found, known = self._find(_hashes(points, start[rest], at[rest]) ^ _AFTER)
        value[rest] = np.where(known, self.values[found], 0.0)
        return np.add.reduceat(value, first - np.arange(len(words))).tolist()


# ---- learning ---------------------------------------------------------------


@dataclass
class LetterModel:
    """Log-likelihood differences (toxic less ordinary) of letter sequences; ``default`` is for the unseen letter after a context."""

    grams: dict[str, float]
    default: dict[str, float]

    @classmethod
    def from_contexts(cls, rows: pa.Table) -> LetterModel:
        """From rows of ``model_table``."""
        grams, default = {}, {}
        for context, letters, values in zip(*(rows[c].to_pylist() for c in ("context", "letters", "differences"))):
            default[context], *rest = np.frombuffer(values, ">f8").tolist()
            grams.update((context + c, v) for c, v in zip(letters, rest))
        return cls(grams, default)

    def word(self, word: str) -> float:
        out = 0.0
        for g in grams_of(word):
            d = self.grams.get(g)
            out += self.default.get(g[:-1], 0.0) if d is None else d
        return out


class Scorer:
    """A packed model with a bounded memory of words."""

    def __init__(self, model: PackedModel):
        self.model = model
        self._known: dict[str, float] = {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: mean difference a letter; excess of single words by length and by its root; mean of the three highest."""
        counts = [Counter(words_of(t)) for t in texts]
        new = list(set().union(*counts).difference(self._known))
        if len(self._known) + len(new) > REMEMBERED:
            self._known.clear()
            new = list(set().union(*counts))
        for k in range(0, len(new), REMEMBERED):
            part = new[k:k + REMEMBERED]
            self._known.update(zip(part, self.model.words(part)))
        value = self._known.__getitem__
        rows = [features_of(np.fromiter(map(value, c), float, len(c)), np.fromiter(c.values(), np.int64, len(c)), np.fromiter(map(len, c), np.int64, len(c)) + 1) for c in counts]
        return np.array(rows, dtype=np.float64).reshape(-1, FEATURES)


FEATURES = 4


def features_of(value: np.ndarray, times: np.ndarray, letters: np.ndarray) -> tuple[float, ...]:
    """Of a text's distinct words: their differences, how often they occur, their letters and ends."""
    if not len(value):
        return (0.0,) * FEATURES
    excess = float(np.maximum(value - EXCESS, 0.0).sum())
    return float(value @ times) / float(letters @ times), excess / len(value), excess / math.sqrt(len(value)), float(np.sort(value)[-3:].mean())


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with a small ridge: (mean, scale, weights with the constant last)."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = (x.std(axis=0) if len(x) else np.zeros(x.shape[1])) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = 1e-2 * np.diag([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


@dataclass
class Calibration:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Classifier:
    contexts: DataFrame  # of model_table
    packed: Broadcast | None  # of PackedModel, unless it is too large
    calibration: Calibration

    @property
    def model(self) -> LetterModel:
        """The whole model in one place, to look at small ones; scoring does not use it."""
        return LetterModel.from_contexts(self.contexts.toArrow())

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.scores(x)


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is known to be small enough."""
    df = stored(df, "labels")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """(i, text, toxic, fold) of the labelled documents to learn from, one of each set of equal texts with one label."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed)
    usable = _bounded(usable.groupBy(F.col("doc_id").alias("i")).agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic")))
    texts = docs.where(F.col("text").isNotNull() & allowed).select(F.col("doc_id").alias("i"), "text")
    keyed = texts.join(usable, "i").select("i", "toxic", F.sha2("text", 256).alias("k"))
    chosen = _bounded(keyed.groupBy("k", "toxic").agg(F.min("i").alias("i")).select("i", "toxic"))
    return texts.join(chosen, "i").select("i", "text", "toxic", bucket(F.col("i"), FOLDS).alias("fold"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): in how many (text, word) pairs of each class the sequence occurs."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (Counter(), Counter())
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[0 if toxic else 1].update(set(words_of(text)))
            every = list(found[0].keys() | found[1].keys())
            yield pa.record_batch([pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in found)], names=["word", "toxic", "ordinary"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (Counter(), Counter())
            for word, *ns in zip(*(c.to_pylist() for c in b.columns)):
                for c, n in zip(found, ns):
                    if n:
                        for g in grams_of(word):
                            c[g] += n
            every = list(found[0].keys() | found[1].keys())
            yield pa.record_batch([pa.array(every, pa.string()), *(pa.array([c[g] for g in every], pa.int64()) for c in found)], names=["gram", "toxic", "ordinary"])

    sums = [F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")]
    by_word = rows.select("text", "toxic").mapInArrow(words, "word string, toxic long, ordinary long").groupBy("word").agg(*sums)
    return by_word.mapInArrow(grams, "gram string, toxic long, ordinary long").groupBy("gram").agg(*sums)


def _shared(counts: DataFrame) -> DataFrame:
    """(gram, p) of ``SharedModel`` for the grams of (gram, n): continuation counts going down, probabilities coming up."""
    levels = [counts]
    for _ in range(ORDER - 1):
        shorter = levels[-1].where(F.length("gram") > 1).groupBy(F.substring("gram", 2, ORDER).alias("gram"))
        levels.append(stored(shorter.agg(F.count(F.lit(1)).alias("n")), "continuations"))
    lower = None
    for level in reversed(levels):
        within = Window.partitionBy(F.substring("gram", F.lit(1), F.length("gram") - 1))  # as many rows as there are letters
        level = level.select("gram", "n", F.sum("n").over(within).alias("total"), F.count(F.lit(1)).over(within).alias("types"))
        uniform = F.lit(1.0 / LETTERS)
        if lower is None:
            level, below = level.withColumn("p", F.lit(None).cast("double")), uniform
        else:
            level = level.withColumn("suffix", F.substring("gram", 2, ORDER)).join(lower.withColumnRenamed("gram", "suffix"), "suffix", "left")
            below = F.coalesce("p", uniform)
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * below) / F.col("total")
        lower = level.select("gram", p.alias("p"))
    return lower


def model_table(counts: DataFrame) -> DataFrame:
    """``LetterModel`` of all (gram, toxic, ordinary), a row a context: (context, letters, differences).

    The letters are one string; ``differences`` holds the default and those of the letters, eight bytes each.
    """
    grams = counts.withColumn("context", F.substring("gram", F.lit(1), F.length("gram") - 1))
    within = Window.partitionBy("context")
    for c in ("toxic", "ordinary"):
        kinds = F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(within)
        grams = grams.withColumns({f"{c}_a": DISCOUNT * kinds + PRIOR, f"{c}_n": F.sum(c).over(within) + PRIOR})
    grams = grams.join(_shared(counts.select("gram", (F.col("toxic") + F.col("ordinary")).alias("n"))), "gram")

    def part(c: str) -> Column:
        return F.log((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + F.col(f"{c}_a") * F.col("p")) / F.col(f"{c}_n"))

    default = F.log(F.col("toxic_a") / F.col("toxic_n")) - F.log(F.col("ordinary_a") / F.col("ordinary_n"))
    letters = grams.select("context", default.alias("default"), F.struct(F.substring("gram", -1, 1).alias("c"), (part("toxic") - part("ordinary")).alias("d")).alias("letter"))
    rows = letters.groupBy("context").agg(F.first("default").alias("default"), F.collect_list("letter").alias("letter"))
    both = counts.agg(F.coalesce(F.max("toxic") > 0, F.lit(False)) & F.coalesce(F.max("ordinary") > 0, F.lit(False))).first()[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letter = b.column(2).to_pylist()
            values = [np.array([d, *(x["d"] for x in xs)], ">f8").tobytes() for d, xs in zip(b.column(1).to_pylist(), letter)]
            yield pa.record_batch([b.column(0), pa.array(["".join(x["c"] for x in xs) for xs in letter], pa.string()), pa.array(values, pa.binary())], names=["context", "letters", "differences"])

    rows = rows.mapInArrow(packed, "context string, letters string, differences binary")
    return stored(rows if both else rows.where("false"), "letter-model")


def packed_model(contexts: DataFrame) -> Broadcast | None:
    """The rows of ``model_table`` for the tasks, if they are at most ``PACKED_BYTES``."""
    size = contexts.agg(F.sum(F.length("letters") + 1)).first()[0] or 0
    if 16 * size > PACKED_BYTES:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in PackedModel.parts(*(c.to_pylist() for c in b.columns))], names=["keys", "values"])

    parts = contexts.mapInArrow(pack, "keys binary, `values` binary").toArrow()
    keys, values = (np.frombuffer(b"".join(parts[c].to_pylist()), kind) for c, kind in (("keys", np.uint64), ("values", np.float64)))
    return contexts.sparkSession.sparkContext.broadcast(PackedModel(keys, values))


def _with_features(
    df: DataFrame, text_col: str, kept: list[str], contexts: DataFrame, packed: Broadcast | None, name: str, kind: DataType, finish: Callable[[np.ndarray], pa.Array],
) -> DataFrame:
    """The ``kept`` columns of every row and, as ``name``, what ``finish`` makes of the features of its text."""
    if packed is None:
        return _in_blocks(df, text_col, kept, contexts, name, kind, finish)

    @F.arrow_udf(kind)
    def values(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(packed.value)
        for t in texts:
            yield finish(scorer.features(t.to_pylist()))

    return df.select(*[F.col(f"`{c}`") for c in kept], values(F.col(f"`{text_col}`")).alias(name))


def _in_blocks(df: DataFrame, text_col: str, kept: list[str], contexts: DataFrame, name: str, kind: DataType, finish: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """``_with_features`` by a model that is a table."""
    columns = kept if text_col in kept else [*kept, text_col]
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    at, width = columns.index(text_col), len(kept)
    schema = StructType(df.schema.fields[:width]).add(name, kind)

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The rows with the numbers of their texts' distinct words (as steps) and how often each occurs, and the words once."""
        number: dict[str, int] = {}
        sink, out = pa.BufferOutputStream(), None
        for b in batches:
            steps, times = [], []
            for text in b.column(at).to_pylist():
                counts = sorted((number.setdefault(w, len(number)), n) for w, n in Counter(words_of(text)).items())
                steps.append(np.diff([k for k, _ in counts], prepend=0).astype(np.int32))
                times.append(np.array([n for _, n in counts], np.int32))
            rows = pa.RecordBatch.from_arrays([*b.columns[:width], *(pa.array(v, pa.list_(pa.int32())) for v in (steps, times))], names=[str(k) for k in range(width + 2)])
            out = out or pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))
            out.write_batch(rows)
        out.close()
        words, asked = " ".join(number).encode(), {g[:-1] for w in number for g in grams_of(w)}
        values = [uuid.uuid4().int >> 65, sink.getvalue().to_pybytes(), pa.compress(words, "zstd", asbytes=True), len(words), list(asked)]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.string())))], names=["block", "data", "words", "size", "contexts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK_ROWS or sum(x.nbytes for x in held) >= BLOCK_BYTES:
                yield block(held)
                held = []
        if held:
            yield block(held)

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        model, out = LetterModel.from_contexts(answers), []
        for data, words, size in zip(*(blocks[c].to_pylist() for c in ("data", "words", "size"))):
            known = pa.decompress(words, size, "zstd", asbytes=True).decode().split(" ") if size else []
            value, letters = np.array([model.word(w) for w in known]), np.array([len(w) + 1 for w in known])
            for b in pa.ipc.open_stream(data):
                which = [np.cumsum(np.array(s, np.int64)) for s in b.column(width).to_pylist()]
                x = [features_of(value[k], np.array(n), letters[k]) if len(k) else (0.0,) * FEATURES for k, n in zip(which, b.column(width + 1).to_pylist())]
                out.append(pa.RecordBatch.from_arrays([*b.columns[:width], finish(np.array(x, dtype=np.float64).reshape(-1, FEATURES))], names=[*kept, name]))
        return pa.Table.from_batches(out)

    blocks = stored(df.mapInArrow(cut, "block long, data binary, words binary, size long, contexts array<string>"), "blocks")
    answers = blocks.select(F.col("block").alias("asked_by"), F.explode("contexts").alias("context")).join(contexts, "context")
    return blocks.drop("contexts").groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column) -> Classifier:
    """Models from the rows where ``allowed`` holds of doc_id, calibrated on one fold of them."""
    rows = stored(labelled(docs, labels, allowed), "labelled")
    contexts = model_table(stored(gram_counts(rows.where(F.col("fold") != CALIBRATED)), "grams"))
    fold = rows.where(F.col("fold") == CALIBRATED)
    share = CALIBRATION / max(1, fold.count())
    sample = fold.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    packed = packed_model(contexts)
    listed = _with_features(sample, "text", ["toxic"], contexts, packed, "x", ArrayType(DoubleType()), lambda x: pa.array(x.tolist(), pa.list_(pa.float64())))
    found = listed.collect()
    x = np.array([r["x"] for r in found], dtype=np.float64).reshape(-1, FEATURES)
    y = np.array([r["toxic"] for r in found], dtype=np.float64)
    return Classifier(contexts, packed, Calibration(*calibrate(x, y)))


def score(df: DataFrame, classifier: Classifier, text_col: str = "text", score_as: str = "score", columns: list[str] | None = None) -> DataFrame:
    """Add the toxicity score to every row, of all columns or those listed; a column of that name is replaced."""
    kept = [c for c in columns or df.columns if c.lower() != score_as.lower()]
    calibration = classifier.calibration
    return _with_features(df, text_col, kept, classifier.contexts, classifier.packed, score_as, DoubleType(), lambda x: pa.array(calibration.scores(x), pa.float64()))


def production(docs: DataFrame, labels: DataFrame) -> Classifier:
    return learn(docs, labels, bucket(F.col("doc_id"), FOLDS) != HELD_OUT)


@query("op8_kneser_ney_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, production(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
