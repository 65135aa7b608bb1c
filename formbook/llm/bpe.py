"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

A text is cut at added tokens and then into pieces by the public splitting pattern; a piece
is encoded on its own.  For every prefix of a piece exactly one token can come last in its
encoding.  The suffix automaton of the vocabulary lists the tokens that end at a position;
token t is the last one if it spans the whole prefix, or if the last token of the prefix
before it and t are compatible, that is, if merging their joint bytes gives the two back.
The last tokens are stored as back-pointers and followed from the end.

Compatibility is decided from the merges alone: on the right edge of the first token and the
left edge of the second, merges happen by rank; the pair is broken if a merge across the
border comes before the next merge of the tokens it would take from.

Work is a narrow map over documents; encodings of pieces are remembered per Python worker in
a bounded table.  Edge cases: a null text is empty (no ids); special-token strings in a text
become those tokens, as the public library does by default; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import query, table

# Pieces remembered by a worker: some hundred bytes each; the older half goes when it is full.
REMEMBERED = 400_000
VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixBpe:
    """A vocabulary ready to encode and decode."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        # Bytes are kept as Latin-1 strings, one character a byte, for the automaton.
        raw = {t: bytes(byte_of[c] for c in t).decode("latin-1") for t in vocab if t not in added}
        self.id_of = {raw[t]: i for t, i in vocab.items() if t in raw}
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()], default=-1) + 1)
        for t, i in self.id_of.items():
            self.bytes_of[i] = t.encode("latin-1")
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        self.added = added
        self._parts: dict[int, tuple[int, int]] = {}
        self._rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = self.id_of[raw[a]], self.id_of[raw[b]], self.id_of[raw[a] + raw[b]]
            self._rank.setdefault((left, right), rank)
            self._parts.setdefault(whole, (left, right))
        self._edges: tuple[dict, dict] = ({}, {})
        self._compatible: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self._automaton.add_word(t, (i, len(t)))
        self._automaton.make_automaton()
        self._added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._split = regex.compile(public_tokenizers.PATTERN)
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens on an edge from the byte up, each with the rank of the merge that takes it into the next."""
        found = self._edges[side].get(token)
        if found is None:
            found, rank = [], float("inf")
            at = token
            while True:
                found.append((at, rank))
                parts = self._parts.get(at)
                if parts is None:
                    break
                rank, at = self._rank[parts], parts[1 - side]
            found.reverse()
            self._edges[side][token] = found
        return found

    def compatible(self, first: int, second: int) -> bool:
        key = (first, second)
        known = self._compatible.get(key)
        if known is None:
            right, left = self._edge(first, 0), self._edge(second, 1)
            i = j = 0
            known = True
            while True:
                (a, out_a), (b, out_b) = right[i], left[j]
                across = self._rank.get((a, b))
                # Of equal merges the leftmost is done first: the first token's own, then across.
                if across is not None and across < out_a and across <= out_b:
                    known = False
                    break
                if i == len(right) - 1 and j == len(left) - 1:
                    break
                if out_a <= out_b:
                    i += 1
                else:
                    j += 1
            if len(self._compatible) >= 8 * REMEMBERED:
                self._compatible.clear()
            self._compatible[key] = known
        return known

    def encode_bytes(self, data: str) -> tuple[int, ...]:
        """The ids of one piece, given as one Latin-1 character a byte."""
        whole = self.id_of.get(data)
        if whole is not None and (len(data) == 1 or whole in self._parts):
            return (whole,)
        n = len(data)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        compatible = self.compatible
        at, placed = -1, False
        for end, (token, size) in self._automaton.iter(data):
            if end != at:
                at, placed = end, False
            if placed:
                continue
            start = end + 1 - size
            before = last[start]
            if start == 0 or (before is not None and compatible(before[0], token)):
                last[end + 1] = (token, size)
                placed = True
        out, at = [], n
        while at:
            token, size = last[at]
            out.append(token)
            at -= size
        out.reverse()
        return tuple(out)

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self._older.get(piece)
        if ids is None:
            ids = self.encode_bytes(piece.encode().decode("latin-1"))
        if len(piece) <= 64:
            if len(self._known) >= REMEMBERED // 2:
                self._older, self._known = self._known, {}
            self._known[piece] = ids
        return ids

    def _ordinary(self, text: str, out: list[int]) -> None:
        known, extend = self._known.get, out.extend
        for piece in self._split.findall(text):
            ids = known(piece)
            if ids is None:
                ids = self._piece(piece)
                known = self._known.get
            extend(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self._added.finditer(text) if self._added else ():
            self._ordinary(text[at:m.start()], out)
            out.append(self.added[m.group()])
            at = m.end()
        self._ordinary(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    """Read a vocabulary file; called inside tasks, once per worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return PrefixBpe(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode from the ids, and hash both where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = [str(k) for k in range(len(bpe.bytes_of))].__getitem__
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op4_bpe_prefix_dp")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
