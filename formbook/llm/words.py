"""The public word-end BPE tokenizer, with a table of known pieces in front of it.

The library is the authority.  Its splitting pattern cuts a text into pieces that are encoded
on their own, so a text of ordinary Latin letters is cut here and each piece's ids are looked
up; unknown pieces go to the library together, a space between them.  Any other text, and any
text with a special token's string, goes to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# Pieces remembered by a worker; the older half goes when it is full.
REMEMBERED = 400_000
_LAST = 0x12F
# Composed Latin letters, printable ASCII and the usual white space: normalisation leaves them alone
# and lower-casing maps one character to one.
_PLAIN = re.compile(f"[\t-\r\x20-\x7e\xa0-{chr(_LAST)}]*")
_END = "</w>"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(k)) for k in range(_LAST + 1) if unicodedata.category(chr(k)).startswith(kind))


class WordTokenizer:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._ends = np.zeros(1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]), dtype=bool)
        self._ends[[i for t, i in vocab.items() if t.endswith(_END)]] = True
        letters, numbers = _class("L"), _class("N")
        self._split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @property
    def width(self) -> int:
        """Bytes that hold any id."""
        return 2 if len(self._ends) <= 1 << 16 else 4

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        # Offsets are not needed, and the fast call does not track them.
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        ids, = self._ids([" ".join(pieces)])
        cuts = (4 * np.flatnonzero(self._ends[ids]) + 4).tolist()
        if len(cuts) != len(pieces):  # never seen; then each on its own
            return dict(zip(pieces, (x.tobytes() for x in self._ids(pieces))))
        data = ids.tobytes()
        return {p: data[a:b] for p, a, b in zip(pieces, [0, *cuts], cuts)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned little-endian 32-bit numbers."""
        cut = [self._split.findall(t.lower()) if _PLAIN.fullmatch(t) and not any(s in t for s in self._special) else None for t in texts]
        if len(self._known) > REMEMBERED // 2:
            self._older, self._known = self._known, {}
        known = self._known
        new: dict[str, None] = {}
        for pieces in cut:
            if pieces:
                for p in set(pieces).difference(known):
                    old = self._older.get(p)
                    if old is None:
                        new[p] = None
                    else:
                        known[p] = old
        fresh = list(new)
        for k in range(0, len(fresh), 10_000):
            known.update(self._learn(fresh[k:k + 10_000]))
        get = known.__getitem__
        return [self._ids([t])[0].tobytes() if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut)]


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    """Called inside tasks, once per worker."""
    return WordTokenizer(path)
