"""Licence scans with a positional index of rare words.

A template is the whole word sequence of a licence with its mandatory key phrases
(:mod:`formbook.llm.license_texts`).  Document frequencies of the templates' words are counted
over all documents.  The index posts every rare word of a key phrase with the phrase and the
place in it; rare is what has at least the smallest, over all phrases, of a phrase's highest
inverse document frequency, so that no phrase is without a posting.  Each file's rare words are
looked up; a looked-up word puts the phrase at one place, and places on which all of the
phrase's postings agree are verified word by word.  A template stands where all its key
phrases do, each within SLACK words of where the one before puts it.  Its share says how much
of the licence is there: the template words found within SLACK words of their place beside a
neighbour of theirs, divided by the template's words and the words its phrases are off by.
The index has a few thousand entries and goes with the task; documents are never shuffled, and
the work on a file grows with its words.

Edge cases: a null text is empty; no word gives zero words, null places and no label;
repeated rows are scanned each on their own, extra columns of any name are left out; equal
document frequencies are broken by the word; a very long text is a batch of its own; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import query, table
from formbook.llm.license_texts import BASE, MORE, TEMPLATES, Template, words_of

__all__ = ["BASE", "MORE", "TEMPLATES", "Template"]

SLACK = 4  # words by which a key phrase may be off from where the one before it puts it
_CELLS = 1 << 20  # template words compared at a time

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


@dataclass
class Words:
    """The words of a batch of files: file of each word, first word and word count of each file, vocabulary ids."""

    file: np.ndarray
    first: np.ndarray
    count: np.ndarray
    ids: np.ndarray


class Vocabulary:
    """Words of up to 16 bytes, looked up by their first and last eight bytes and their length."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        raw = [w.encode() for w in self.words]
        if any(not 0 < len(w) <= 16 for w in raw):
            raise ValueError("licence words have 1 to 16 bytes")
        head = np.array([int.from_bytes(w[:8].ljust(8, b"\0"), "little") for w in raw], dtype=np.uint64)
        tail = np.array([int.from_bytes(w[-8:].ljust(8, b"\0"), "little") for w in raw], dtype=np.uint64)
        self._order = np.lexsort((tail, head))
        size = np.array([len(w) for w in raw], dtype=np.uint64)
        mixed = self._mix(head, tail, size)
        if len(np.unique(mixed)) != len(raw):
            raise ValueError("two words have one key")
        order = np.argsort(mixed)
        self._heads = np.unique(head)
        self._mixed, self._head, self._tail, self._size = mixed[order], head[order], tail[order], size[order]
        self._number = (order + 1).astype(np.int16)

    @staticmethod
    def _mix(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (head * np.uint64(0x9E3779B97F4A7C15)) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F) + size)

    def scan(self, texts: Sequence[bytes]) -> Words:
        """ids: 1 + index of the word in the vocabulary, 0 if it is not there."""
        data = b"\0".join(texts).translate(_LOWER) + b"\0" * 9
        codes = np.frombuffer(data, dtype=np.uint8)
        edges = np.diff(_IS_WORD[codes].view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        bounds = np.cumsum([len(t) + 1 for t in texts]) if len(texts) else np.zeros(0, dtype=np.int64)
        upto = np.searchsorted(start, bounds)
        count = np.diff(upto, prepend=0)
        file = np.repeat(np.arange(len(texts)), count)
        ids = np.zeros(len(start), dtype=np.int16)
        if len(start) and len(self._heads):
            size = end - start
            at8 = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
            head = at8[start] & _MASKS[np.minimum(size, 8)]
            at = np.minimum(np.searchsorted(self._heads, head), len(self._heads) - 1)
            found = np.flatnonzero(self._heads[at] == head)
            head, size = head[found], size[found].astype(np.uint64)
            # For short words the tail is the head; longer ones have eight bytes before their end.
            tail = np.where(size > 8, at8[np.maximum(end[found] - 8, 0)], head)
            at = np.minimum(np.searchsorted(self._mixed, self._mix(head, tail, size)), len(self._mixed) - 1)
            same = (self._head[at] == head) & (self._tail[at] == tail) & (self._size[at] == size)
            ids[found] = np.where(same, self._number[at], 0)
        return Words(file, upto - count, count, ids)


def vocabulary(templates: Sequence[Template] = TEMPLATES) -> Vocabulary:
    return Vocabulary(sorted({w for t in templates for w in words_of(t.text)}))


def document_frequencies(df: DataFrame, templates: Sequence[Template] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """(word, n_docs) over all documents, for the words of the templates; word null: all documents."""
    vocab = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, docs = np.zeros(len(vocab.words) + 1, dtype=np.int64), 0
        for b in batches:
            w = vocab.scan([t or b"" for t in b.column(0).to_pylist()])
            docs += b.num_rows
            known = np.flatnonzero(w.ids)
            pairs = np.unique(w.file[known] * (len(vocab.words) + 1) + w.ids[known])
            totals += np.bincount(pairs % (len(vocab.words) + 1), minlength=len(totals))
        yield pa.record_batch([pa.array([*vocab.words, None], pa.string()), pa.array([*totals[1:], docs], pa.int64())], names=["word", "n_docs"])

    counts = df.select(F.col(text_col).cast("binary").alias("data")).mapInArrow(run, "word string, n_docs long")
    return counts.groupBy("word").agg(F.sum("n_docs").alias("n_docs"))


@dataclass(frozen=True)
class Index:
    """Phrases and templates as word ids, and the postings of the rare words.

    Rare word ``i`` is posted at ``post_phrase[post_from[i]:post_from[i + 1]]`` with the place in
    each phrase beside it; ``n_rare`` counts the postings of a phrase.
    """

    words: tuple[str, ...]
    idf: np.ndarray
    phrases: tuple[tuple[int, ...], ...]
    post_from: np.ndarray
    post_phrase: np.ndarray
    post_at: np.ndarray
    n_rare: np.ndarray
    templates: tuple[tuple[str, bool, tuple[tuple[int, int], ...]], ...]  # label, base, (position, phrase)
    texts: tuple[np.ndarray, ...]


def build_index(frequencies: Mapping[str | None, int], templates: Sequence[Template] = TEMPLATES) -> Index:
    words = vocabulary(templates).words
    total = frequencies.get(None, 0)
    idf = np.array([0.0] + [math.log((1 + total) / (1 + frequencies.get(w, 0))) for w in words])
    number = {w: i + 1 for i, w in enumerate(words)}
    texts = list(dict.fromkeys(p for t in templates for _, p in t.phrases))
    phrases = tuple(tuple(number[w] for w in p.split()) for p in texts)
    rare = min((max(idf[i] for i in p) for p in phrases), default=0.0)
    posted = sorted((i, k, at) for k, p in enumerate(phrases) for at, i in enumerate(p) if idf[i] >= rare)
    ids, owners, places = np.array(posted, dtype=np.int64).reshape(-1, 3).T
    return Index(
        tuple(words), idf, phrases, np.searchsorted(ids, np.arange(len(words) + 2)), owners, places,
        np.bincount(owners, minlength=len(phrases)), tuple((t.label, t.base, tuple((at, texts.index(p)) for at, p in t.phrases)) for t in templates),
        tuple(np.array([number[w] for w in words_of(t.text)], dtype=np.int16) for t in templates))


def find_phrases(index: Index, words: Words) -> list[np.ndarray]:
    """For each phrase the words of the batch at which it starts, in order, by way of the postings of rare words."""
    n_posts = np.diff(index.post_from)
    spots = np.flatnonzero(n_posts[words.ids])
    ids = words.ids[spots].astype(np.int64)
    per = n_posts[ids]
    post = np.repeat(index.post_from[ids] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    start = np.repeat(spots, per) - index.post_at[post]
    owner = index.post_phrase[post]
    out = []
    for k, phrase in enumerate(index.phrases):
        at, votes = np.unique(start[owner == k], return_counts=True)
        at = at[(votes == index.n_rare[k]) & (at >= 0) & (at + len(phrase) <= len(words.ids))]
        at = at[words.file[at] == words.file[at + len(phrase) - 1]]
        for j, word in enumerate(phrase):
            at = at[words.ids[at + j] == word]
        out.append(at)
    return out


def _nearest(places: np.ndarray, wanted: np.ndarray, file: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(the place of the same file nearest to each wanted one, how far it is); the earlier of two, far off if there is none."""
    best, far = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), SLACK + 1, dtype=np.int64)
    right = np.searchsorted(places, wanted)
    for at in (right - 1, right) if len(places) else ():
        there = places[np.clip(at, 0, len(places) - 1)]
        off = np.abs(there - wanted)
        closer = (at >= 0) & (at < len(places)) & (words.file[there] == file) & (off < far)
        best, far = np.where(closer, there, best), np.where(closer, off, far)
    return best, far


def _found(text: np.ndarray, shift: np.ndarray, file: np.ndarray, words: Words) -> np.ndarray:
    """Template words found for each place; ``shift`` puts each word of the template (column) at a word of the batch."""
    low, high = words.first[file][:, None], (words.first[file] + words.count[file])[:, None]
    found = np.zeros(shift.shape, dtype=bool)
    for d in range(-SLACK, SLACK + 1):
        at = shift + d
        same = (at >= low) & (at < high)
        same &= words.ids[np.clip(at, 0, len(words.ids) - 1)] == text
        beside = np.zeros_like(same)
        beside[:, 1:] |= same[:, :-1]
        beside[:, :-1] |= same[:, 1:]
        found |= same & beside if len(text) > 1 else same
    return found.sum(axis=1)


def find_templates(index: Index, words: Words) -> list[tuple[int, int, int, float]]:
    """(file, template, start of its first key phrase in the file, share) of every place of a template."""
    places = find_phrases(index, words)
    out = []
    for t, ((_, _, keys), text) in enumerate(zip(index.templates, index.texts)):
        start = places[keys[0][1]]
        chain, off = start[None, :], np.zeros(len(start), dtype=np.int64)
        for (before, _), (at, k) in zip(keys, keys[1:]):
            there, far = _nearest(places[k], chain[-1] + at - before, words.file[start], words)
            near = far <= SLACK
            start, chain, off = start[near], np.vstack([chain, there])[:, near], (off + far)[near]
        # The key phrase that a word of the template follows tells where to look for it.
        column = np.arange(len(text))
        leader = np.maximum(np.searchsorted([at for at, _ in keys], column, "right") - 1, 0)
        step = column - np.array([at for at, _ in keys])[leader]
        for i in range(0, len(start), max(1, _CELLS // len(text))):
            part = slice(i, i + max(1, _CELLS // len(text)))
            file = words.file[start[part]]
            share = _found(text, chain[leader, part].T + step, file, words) / (len(text) + off[part])
            out += zip(file.tolist(), [t] * len(file), (start[part] - words.first[file]).tolist(), share.tolist())
    return out


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("base", pa.bool_()), ("share", pa.float64())])))])
_OUT_DDL = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
            "places array<struct<label: string, start: long, base: boolean, share: double>>")


def scan(df: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: word count, places of base phrases, labels, every place found and, as score, the largest share."""
    vocab = Vocabulary(index.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = vocab.scan([t or b"" for t in b.column(1).to_pylist()])
            found: dict[int, list] = {}
            for file, t, start, share in find_templates(index, words):
                label, base, _ = index.templates[t]
                found.setdefault(file, []).append((start, label, base, share))
            rows = []
            for k in range(b.num_rows):
                hits = sorted(found.get(k, ()))
                base = [s for s, _, is_base, _ in hits if is_base]
                rows.append((
                    len(base), base[0] if base else None, base[-1] if base else None, ",".join(sorted({x[1] for x in hits if x[2]})),
                    ",".join(sorted({x[1] for x in hits})), max((x[3] for x in hits), default=0.0),
                    [{"label": x[1], "start": x[0], "base": x[2], "share": x[3]} for x in hits]))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.record_batch([b.column(0), pa.array(words.count, pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(_OUT)[2:]))], schema=_OUT)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")).mapInArrow(run, _OUT_DDL)


def index_of(df: DataFrame, templates: Sequence[Template] = TEMPLATES, text_col: str = "text") -> Index:
    """The index with document frequencies counted over all of ``df``; as many rows come to the driver as templates have words."""
    return build_index({r["word"]: r["n_docs"] for r in document_frequencies(df, templates, text_col).collect()}, templates)


SQL = """
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
p AS (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM w),
hit AS (
  SELECT k, i - 1 AS place, CASE
    WHEN words[i] = 'under' AND words[i + 1] = 'the' AND words[i + 2] = 'mit' AND words[i + 3] = 'license' THEN 'mit'
    WHEN words[i] = 'apache' AND words[i + 1] = 'license' AND words[i + 2] = 'version' AND words[i + 3] = '2' THEN 'apache-2'
    WHEN words[i] = 'cc' AND words[i + 1] = 'by' AND words[i + 2] = 'nc' THEN 'cc-by-nc' END AS label
  FROM p WHERE words[i] IN ('under', 'apache', 'cc'))
SELECT w.doc_id, any_value(len(words))::BIGINT AS n_words, count(label)::BIGINT AS n_base, min(place) FILTER (label IS NOT NULL) AS first_word,
       max(place) FILTER (label IS NOT NULL) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN hit USING (k) GROUP BY w.k, w.doc_id
"""


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, index_of(docs)).drop("places")
