import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from formbook.llm import bpe, packing, separators, words
from formbook.llm.common import table
from tests.llm.conftest import ODD, SMALL

ALPHABETS = ["abcdefghij ", "the ing tion er re", "éàüßİ漢字\U0001f642́Σ", "  \n\t\r 　", "0123456789½²", "'S't'll <|endoftext|>", "\x00\x1c\x85"]


def strange_texts(n=1500):
    r = random.Random(7)
    made = ["".join(r.choice("".join(r.sample(ALPHABETS, 2))) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return made + ["<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a" * 3000, " " * 999, ""]


def test_prefix_bpe_is_the_library():
    path = public_tokenizers.path(bpe.VOCABULARY)
    library, own = Tokenizer.from_file(path), bpe.load(path)
    for text in strange_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pairs_are_compatible_exactly_if_merging_gives_them_back():
    path = public_tokenizers.path(bpe.VOCABULARY)
    own, library, r = bpe.load(path), Tokenizer.from_file(path), random.Random(3)
    ascii_tokens = [i for t, i in own.id_of.items() if t.isascii() and t.isalpha() and len(t) < 6]
    for _ in range(3000):
        a, b = r.choice(ascii_tokens), r.choice(ascii_tokens)
        joined = (own.bytes_of[a] + own.bytes_of[b]).decode()
        assert own.compatible(a, b) == (library.encode(joined, add_special_tokens=False).ids == [a, b]), joined


def test_bpe_edge_cases(odd, empty):
    path = public_tokenizers.path(bpe.VOCABULARY)
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t or "") for d, t, *_ in ODD)
    assert bpe.digests(empty, path).count() == 0


def test_word_tokenizer_is_the_library():
    own = words.load(public_tokenizers.path(packing.VOCABULARY))
    texts = strange_texts()
    for text, data in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(data, "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids, text


def check_pieces(rows, ids_of, window):
    """Every id in one piece, offsets without gaps, no sequence beyond the window; the share of ids in the sequences."""
    at, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, n, sequence, offset in rows:
        assert n == len(ids_of[doc]) and zlib.crc32(ids_of[doc][start:start + length].tobytes()) == crc
        at[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for group in (*at.values(), *sequences.values()):
        place = 0
        for start, length in sorted(group):
            assert start == place and length > 0
            place += length
    assert all(sum(l for _, l in at[d]) == len(x) for d, x in ids_of.items())
    assert all(sum(l for _, l in s) <= window for s in sequences.values())
    return sum(map(len, ids_of.values())) / (window * len(sequences))


def test_packing_whole_table(llm):
    docs = table(llm, SMALL, "documents")
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for r in docs.collect()}
    assert check_pieces([tuple(r) for r in packing.packed(docs).collect()], ids, packing.WINDOW) > 0.97


def test_packing_edge_cases(odd, empty):
    got = packing.packed(odd).collect()
    assert {r.doc_id for r in got} == {d for d, *_ in ODD}
    assert sum(r.length for r in got if r.doc_id is None) == sum({(r.start, r.doc_tokens): r.doc_tokens for r in got if r.doc_id is None}.values())
    assert packing.packed(empty).count() == 0


def test_plans_fill_windows():
    r = random.Random(5)
    for counts in ({}, {1: 1}, {4095: 7}, {2048: 1001}, {1365: 3000}, {3000: 50}, {k: r.randint(0, 40) for k in range(1, 4096)}, {60: 5000, 4000: 4000}):
        plan = packing.make_plan(counts)
        fill = defaultdict(list)
        for length, runs in plan.places.items():
            assert sum(c for _, c, _ in runs) == counts[length]
            for first, count, pieces in runs:
                assert sum(p[1] for p in pieces) == length
                for k in range(count):
                    for _, size, sequence, offset in pieces:
                        fill[sequence + k].append((offset, size))
        for pieces in fill.values():
            place = 0
            for offset, size in sorted(pieces):
                assert offset == place
                place += size
            assert place <= packing.WINDOW
        total = sum(k * c for k, c in counts.items())
        assert len(fill) == plan.sequences <= max(1, 1.03 * total / packing.WINDOW + 2) or not total


def test_nnls_finds_the_best_fit():
    rng = np.random.default_rng(1)
    a = rng.random((12, 30))
    x = packing.nnls(a, b := rng.random(12) * 9)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-6).all() and np.abs(gradient[x > 1e-9]).max() < 1e-6


def stream(llm, files, block):
    rows = [(f, k // block, np.array(ids[k:k + block], "<u2").tobytes()) for f, ids in files.items() for k in range(0, len(ids), block)]
    return llm.createDataFrame(rows, "file int, block long, data binary")


def test_separator_scan_stitches_blocks(llm, monkeypatch):
    monkeypatch.setattr(separators, "GROUP", 3)
    r = random.Random(2)
    end = separators.END_ID
    files = {f: [end if r.random() < 0.2 else r.randint(0, 9) for _ in range(r.randint(1, 90))] for f in range(5)}
    files[5] = [end] * 9
    files[6] = [1] * 25
    want = set()
    for f, ids in files.items():
        start = ordinal = 0
        for k, x in enumerate(ids):
            if x == end:
                want.add((f, ordinal, start, k - start, True))
                start, ordinal = k + 1, ordinal + 1
        if start < len(ids):
            want.add((f, ordinal, start, len(ids) - start, False))
    got = separators.count_tokens(stream(llm, files, 4)).select("file", "ordinal", "start", "n_tokens", "ended").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_token_files_count_what_was_written(llm, odd, empty):
    path = public_tokenizers.path(separators.VOCABULARY)
    encoding = separators.load(path)
    blocks = separators.token_files(odd, path, block=64)
    got = separators.named(separators.count_tokens(blocks), blocks).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(encoding.encode_ordinary(t or ""))) for d, t, *_ in ODD)
    assert separators.count_tokens(separators.token_files(empty, path)).count() == 0
