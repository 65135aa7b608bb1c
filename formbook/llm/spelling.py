"""Spelling variants of a corpus vocabulary by search schemes on FM-indexes.

Two words are near if one inserted, deleted or replaced code point makes them equal.  One
error leaves one half of a word untouched, so a word is searched twice: its first half is
matched exactly from the left delimiter and extended to the right, its second half exactly
from the right delimiter and extended to the left, each time allowing one error in the other
half.  Extending to the right walks an index over the reversed words, to the left one over the
words themselves.  A search state is an interval of suffix ranks; all words of a shard step
together as arrays.

The vocabulary is cut into shards by the half that is matched exactly: a word of length L asks
with (side, L, half), and a word is indexed under the halves that askers one shorter, as long
or one longer would have.  So no two near words miss each other, a shard holds about
``SHARD_ROWS`` rows, and a half shared by more words than that is dealt into several shards,
all of which its askers visit.  Nothing of the vocabulary is collected on the driver.

A word's form is its near word with the largest count, if that is ``RATIO`` times its own;
roots follow forms to their end by pointer doubling (counts rise tenfold a link, so chains
are short).

Edge cases: null, empty and wordless texts give no words; a null id is the empty string in
front of the colon; repeated rows count each; texts are read whole and words may be of any
length; ties between forms go to the smallest word in code-point order; other columns of the
table are not looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import CRC_TABLE_SQL, crc32_sql, query, stored, table

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
DAMAGED_ONE_IN = 31
# Rows of a shard, about; a shard is searched by one task.
SHARD_ROWS = 40_000
# Distinct words a counting task holds before it hands them on.
HELD_WORDS = 200_000
# Halves shared by more than a shard of words are broadcast up to this many (12 bytes each).
BROADCAST_HALVES = 100_000
# Intervals up to this size are read, larger ones are asked for every symbol.
READ_ROWS = 24
MAX_LINKS = 64

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_LOWER = {c: c + 32 for c in range(65, 91)}


# ---- vocabulary -------------------------------------------------------------


def damaged(prefix: int, run: str) -> str:
    """The run, or for one (document, run) in ``DAMAGED_ONE_IN`` the run less a code point; ``prefix`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DAMAGED_ONE_IN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def words_in(doc_id: str | None, text: str) -> Counter:
    """The words of one document, of at least ``LEAST_LETTERS`` code points, and how often they occur."""
    prefix, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    runs = Counter()
    for run, n in Counter(_RUN.findall(text)).items():
        runs[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    for run, n in runs.items():
        word = damaged(prefix, run)
        if len(word) >= LEAST_LETTERS:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that occur at least ``LEAST_COUNT`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    held.update(words_in(doc_id, text))
                    if len(held) > HELD_WORDS:
                        yield out()
                        held = Counter()
        yield out()

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- one shard --------------------------------------------------------------


class Index:
    """FM-index over strings of symbols 1, 2, ..., each ended by the delimiter 0, searched from its end to the left.

    Suffixes are compared up to their delimiter, equal ones by the number of their string, so
    ranks of the delimiters are the numbers of the strings.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        """``symbols`` holds all strings one after another, without delimiters."""
        ends = np.cumsum(lengths + 1)
        self.n, self.strings = int(ends[-1]) if len(ends) else 0, len(lengths)
        text = np.zeros(self.n, np.int64)
        inside = np.ones(self.n, bool)
        inside[ends - 1] = False
        text[inside] = symbols
        starts = ends - lengths - 1
        order = self._sorted(text, np.repeat(ends, lengths + 1))
        before = np.where(np.isin(order, starts, assume_unique=True), 0, text[order - 1])
        by_symbol = np.argsort(before, kind="stable")
        #: Symbol before each suffix, and (symbol, rank) of all suffixes in one sorted array of numbers.
        self.before, self.step = before, before[by_symbol] * (self.n + 1) + by_symbol
        # Whole strings, in the order of their ranks.
        number = np.searchsorted(starts, order[before == 0])
        self.whole = number

    @staticmethod
    def _sorted(text: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Positions in the order of their suffixes, by doubling ranks of the first so many symbols."""
        n = len(text)
        bits = max(1, int(text.max(initial=0)).bit_length())
        width = max(1, 62 // bits)
        position = np.arange(n)
        key = np.zeros(n, np.int64)
        for k in range(width):
            at = position + k
            key = key << bits | np.where(at < end, text[np.minimum(at, n - 1)], 0)
        order = np.argsort(key, kind="stable")
        longest = int((end - position).max(initial=1))
        while True:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0) + 1
            if width >= longest:
                return order
            at = position + width
            key = rank * (n + 2) + np.where(at < end, rank[np.minimum(at, n - 1)], 0)
            order = np.argsort(key, kind="stable")
            width *= 2

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes that have ``symbol`` before those of each interval."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.step, base + lo), np.searchsorted(self.step, base + hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of every symbol but the delimiter that comes before an interval's suffixes."""
        size = hi - lo
        small, large = np.flatnonzero(size <= READ_ROWS), np.flatnonzero(size > READ_ROWS)
        which = np.repeat(small, size[small])
        rank = np.arange(len(which)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + lo[which]
        found = np.unique(which * (sigma + 1) + self.before[rank])
        every = (large[:, None] * (sigma + 1) + np.arange(1, sigma + 1)).ravel()
        both = np.concatenate([found, every])
        state, symbol = both // (sigma + 1), both % (sigma + 1)
        keep = symbol > 0
        return state[keep], symbol[keep]

    def wholes(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, string) of the intervals that are at the start of a string."""
        a, b = np.searchsorted(self.step, lo), np.searchsorted(self.step, hi)
        at = np.flatnonzero(b > a)  # at most one: strings are distinct
        return at, self.whole[a[at]]


def _reversed(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return symbols[np.repeat(ends + ends - lengths, lengths) - 1 - np.arange(len(symbols))]


def search(words: list[str], asking: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asker, near word) as positions in ``words``, which are distinct: all near pairs that share the exact half.

    ``asking[k]`` is a position, ``left[k]`` tells whether its first half is matched exactly, else its second.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    alphabet, symbols = np.unique(letters, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    found = []
    for side in (True, False):
        ask = asking[left == side]
        if len(ask):
            backward = _reversed(symbols, lengths)
            line, indexed = (symbols, backward) if side else (backward, symbols)
            exact = lengths[ask] // 2 if side else lengths[ask] - lengths[ask] // 2
            which, near = _scheme(Index(indexed, lengths), line, np.cumsum(lengths)[ask] - lengths[ask], lengths[ask], exact, len(alphabet))
            found.append(ask[which] * len(words) + near)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // max(1, len(words)), pairs % max(1, len(words))


def _scheme(index: Index, line: np.ndarray, start: np.ndarray, length: np.ndarray, exact: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, string) with one error after the first ``exact`` symbols of each query, which is in ``line`` from ``start``."""
    q = np.arange(len(start))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.strings)
    for t in range(int(exact.max(initial=0))):
        on = np.flatnonzero(t < exact[q])
        a, b = index.extend(lo[on], hi[on], line[start[q[on]] + t])
        lo[on], hi[on] = a, b
        keep = hi > lo
        q, lo, hi = q[keep], lo[keep], hi[keep]
    none = np.zeros(0, np.int64)
    one = (none, none, none)  # states after the error: query, interval
    out_q, out_w = [none], [none]
    for j in range(int((length - exact).max(initial=-1)) + 1):
        alive = exact[q] + j <= length[q]
        q, lo, hi = q[alive], lo[alive], hi[alive]
        t = exact[q] + j
        inner = t < length[q]
        here = np.where(inner, line[np.minimum(start[q] + t, len(line) - 1)], 0)
        state, symbol = index.branches(lo, hi, sigma)
        other = symbol != here[state]  # inserting the symbol that follows is the same as inserting it later
        state, symbol = state[other], symbol[other]
        a, b = index.extend(lo[state], hi[state], symbol)
        full = b > a
        state, a, b = state[full], a[full], b[full]
        # Inserted symbols do not move on in the query.
        e, x, y = (np.concatenate(p) for p in zip(one, (q[state], a, b)))
        done = exact[e] + j == length[e]
        at, strings = index.wholes(x[done], y[done])
        out_q.append(e[done][at])
        out_w.append(strings)
        e, x, y = e[~done], x[~done], y[~done]
        x, y = index.extend(x, y, line[start[e] + exact[e] + j])
        # Replaced symbols move on, so does a deleted one (the last of a run of equal ones).
        swap = inner[state]
        after = np.where(t + 1 < length[q], line[np.minimum(start[q] + t + 1, len(line) - 1)], 0)
        cut = inner & (after != here)
        one = tuple(np.concatenate(p) for p in zip((e, x, y), (q[state[swap]], a[swap], b[swap]), (q[cut], lo[cut], hi[cut])))
        keep = one[2] > one[1]
        one = tuple(v[keep] for v in one)
        q, lo, hi, here = q[inner], lo[inner], hi[inner], here[inner]
        lo, hi = index.extend(lo, hi, here)
        keep = hi > lo
        q, lo, hi = q[keep], lo[keep], hi[keep]
    # Queries whose last symbol was the error.
    e, x, y = one
    at, strings = index.wholes(x, y)
    return np.concatenate([*out_q, e[at]]), np.concatenate([*out_w, strings])


# ---- all shards -------------------------------------------------------------


def _halves(word: Column, shift: int) -> Column:
    """Both exact halves of an asker whose length differs by ``shift``, as (left, key) structs."""
    n = F.length(word) + shift
    half = F.floor(n / 2).cast("int")

    def entry(left: bool, part: Column) -> Column:
        return F.struct(F.lit(left).alias("left"), F.xxhash64(F.lit(left), n, part).alias("key"), F.lit(shift == 0).alias("asks"))

    return F.array(entry(True, F.substring(word, F.lit(1), half)), entry(False, F.substring(word, F.length(word) - (n - half) + 1, n - half)))


def near_pairs(words: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n, near, near_n) of all near words of ``words`` (word, n), whose words are distinct; a pair may come twice."""
    total = words.count()
    shards = max(1, -(-6 * total // shard_rows))
    keyed = words.select("word", "n", F.explode(F.concat(*[_halves(F.col("word"), d) for d in (-1, 0, 1)])).alias("h")).select("word", "n", "h.*")
    crowded = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > shard_rows), "halves")
    n_crowded = crowded.count()
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_HALVES else crowded
        keyed = keyed.join(crowded, "key", "left")
        parts = F.ceil(F.coalesce(F.col("k"), F.lit(1)) / shard_rows)
        home = F.pmod(F.xxhash64("word"), parts)
        visits = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(home))
        keyed = keyed.withColumn("home", home).withColumn("part", F.explode(visits))
        shard = F.xxhash64("key", "part")
        indexed = F.col("part") == F.col("home")
    else:
        shard, indexed = F.col("key"), F.lit(True)
    rows = keyed.select(F.pmod(shard, F.lit(shards)).alias("shard"), "word", "n", "left", "asks", indexed.alias("indexed"))

    def run(t: pa.Table) -> pa.Table:
        coded = t["word"].combine_chunks().dictionary_encode()
        every, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        n = np.zeros(len(every), np.int64)
        n[code] = t["n"].to_numpy()
        is_in, asks, left = (t[c].to_numpy() for c in ("indexed", "asks", "left"))
        # Words that only visit a crowded half are found by the shard they belong to.
        held = np.zeros(len(every), bool)
        held[code[is_in]] = True
        who = np.unique(code[asks].astype(np.int64) * 2 + left[asks])
        a, b = search(every, who // 2, who % 2 == 1)
        keep = held[b]
        a, b = a[keep], b[keep]
        names = pa.array(every, pa.string())
        return pa.table({"word": names.take(pa.array(a)), "n": pa.array(n[a]), "near": names.take(pa.array(b)), "near_n": pa.array(n[b])})

    return rows.groupBy("shard").applyInArrow(run, "word string, n long, near string, near_n long")


def variants(words: DataFrame, shard_rows: int = SHARD_ROWS, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n)."""
    words = stored(words, "vocabulary")
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    pairs = near_pairs(words, shard_rows).unionByName(none).repartition("word").groupBy("word", "n", "near").agg(F.first("near_n").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    grouped = pairs.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    forms = stored(grouped.select(
        "word", "n", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    roots = stored(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_LINKS):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if not moved.where("moved").head(1):
            break
    return forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
found AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
runs AS MATERIALIZED (
  SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM found WHERE length(run) >= {LEAST_LETTERS} GROUP BY 1, 2),
hashed AS MATERIALIZED (SELECT run, c, {crc32_sql("d || ':' || run")} AS h FROM runs, crc_table),
words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DAMAGED_ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(c) >= {LEAST_COUNT}),
cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM words, unnest(range(length(word))) u(i)),
pairs AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS stop, 0 AS k FROM forms
  UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN forms f ON w.stop = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(stop, k) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)
"""


@query("op13_spelling_variants", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(vocabulary(table(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
