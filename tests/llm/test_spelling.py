import random
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import rows_of

from formbook.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def plain(counts, ratio=spelling.RATIO):
    """(word, n, n_near, form, form_n, root) by comparing every word with every other."""
    form, out = {}, []
    for w, n in counts.items():
        close = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(close, default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
        out.append([w, n, len(close), form[w], -best[0] if form[w] is not None else None])
    for row in out:
        root = row[0]
        while form[root] is not None:
            root = form[root]
        row.append(root)
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("letters,n", [("ab", 300), ("abcé", 600), ("a", 40)])
def test_search_finds_every_near_word(letters, n):
    rnd = random.Random(n)
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(7, 11))) for _ in range(n)})
    asking = np.repeat(np.arange(len(words)), 2)
    a, b = spelling.search(words, asking, np.tile([True, False], len(words)))
    assert list(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(len(words)) for j in range(len(words)) if near(words[i], words[j])]


@pytest.mark.parametrize("shard_rows", [spelling.SHARD_ROWS, 60, 7])
def test_variants_equal_brute_force_with_crowded_halves_too(llm, shard_rows):
    rnd = random.Random(5)
    # Half of all words share their first half.
    words = {"commons" + "".join(rnd.choice("xy") for _ in range(rnd.randint(2, 7))) for _ in range(60)}
    words |= {"".join(rnd.choice("abü") for _ in range(rnd.randint(7, 9))) for _ in range(60)}
    counts = {w: 2 * 10 ** rnd.randint(0, 5) + rnd.randint(0, 1) for w in sorted(words)}
    got = spelling.variants(llm.createDataFrame(list(counts.items()), "word string, n long"), shard_rows)
    assert rows_of(got.select("word", "n", "n_near", "form", "form_n", "root")) == plain(counts)


def test_roots_follow_chains_and_ties_take_the_smallest(llm):
    words = {"aaaaaaa": 10_000, "aaaaaab": 1_000, "aaaaabb": 100, "aaaabbb": 10, "zzzzzzz": 2, "zzzzzzx": 20, "zzzzzzy": 20}
    got = {r["word"]: r for r in spelling.variants(llm.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaabbb"]["root"] == "aaaaaaa" and got["aaaabbb"]["form"] == "aaaaabb"
    assert got["zzzzzzz"]["form"] == "zzzzzzx" and got["zzzzzzx"]["form"] is None and got["zzzzzzx"]["n_near"] == 2


def test_vocabulary_of_odd_rows(odd, empty):
    wanted = Counter()
    for r in odd.collect():
        wanted.update(spelling.words_in(None if r["doc_id"] is None else str(r["doc_id"]), r["text"] or ""))
    got = dict(rows_of(spelling.vocabulary(odd)))
    assert got == {w: n for w, n in wanted.items() if n >= 2} and "another" in got
    assert rows_of(spelling.variants(spelling.vocabulary(empty))) == []


def test_case_accents_and_very_long_runs(llm):
    long = "ab" * 30_000
    docs = llm.createDataFrame([(1, f"Straßen STRAßEN ÉCOLIERS écoliers {long} {long}"), (2, "straßenĀstraßen")], "doc_id long, text string")
    got = dict(rows_of(spelling.vocabulary(docs)))
    assert all(not any("A" <= c <= "Z" for c in w) for w in got)
    assert any(len(w) >= 59_999 for w in got)
    found = spelling.variants(llm.createDataFrame([(long, 40), (long[:-1], 4), (long[:500] + long[501:], 2)], "word string, n long"))
    assert {r["root"] == long for r in found.collect()} == {True}


def test_query_equals_its_sql(llm, duck):
    from tests.llm.conftest import SMALL
    order = "word form root n n_near form_n".split()
    assert rows_of(spelling.op13(llm, SMALL).select(*order)) == sorted(duck.sql(f"select {', '.join(order)} from ({spelling.SQL})").fetchall(), key=repr)
