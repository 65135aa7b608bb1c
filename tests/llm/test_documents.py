import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook.llm import components, language, licenses, simhash, toxicity, transport
from formbook.llm.license_texts import words_of
from formbook.llm.common import QUERIES, bucket, table
from formbook.llm.catalog import MODULES  # noqa: F401
from tests.llm import plain_toxicity
from tests.llm.conftest import ODD, SMALL, rows_of

# ---- language ---------------------------------------------------------------


def slow_grams(text):
    line = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    line = f" {line} " if line else ""
    return Counter(line[k:k + n] for n in (1, 2, 3) for k in range(len(line) - n + 1) if line[k:k + n] != " ")


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_sequences_by_brute_force():
    for text in ["", "...", "a", "Aa, bA! aa", "é è-é", "x1y2", "  The   end."]:
        grams, counts = language.sequences(text)
        assert dict(zip(grams.tolist(), counts.tolist())) == {code(g): n for g, n in slow_grams(text).items()}, text


def slow_distance(profile, text, size):
    mine = [g for g, _ in sorted(slow_grams(text).items(), key=lambda x: (-x[1], code(x[0])))[:size]]
    return sum(abs(k - profile[g]) if g in profile else size for k, g in enumerate(mine)) / (size * len(mine))


def test_prediction_by_brute_force():
    texts = {"en": "the cat and the hat of the thing " * 5, "de": "der hund und die katze nicht ohne den ball " * 5}
    size = 40
    profiles = {l: {g: k for k, (g, _) in enumerate(sorted(slow_grams(t).items(), key=lambda x: (-x[1], code(x[0])))[:size])} for l, t in texts.items()}
    model = language.Profiles.of([(l, code(g), k) for l, p in profiles.items() for g, k in p.items()], size)
    for text in ["the dog", "die maus", "zzz", "hat and ball", "q"]:
        distances = {l: slow_distance(p, text, size) for l, p in profiles.items()}
        best = min(sorted(distances), key=distances.get)
        got = model.predict(text)
        assert got[0] == best and got[1] == pytest.approx(1 - distances[best])
    assert model.predict(None) == model.predict("12 !") == ("und", 0.0)


def test_held_out_languages(llm):
    got = QUERIES["op3_rank_order_language"](llm, SMALL).join(table(llm, SMALL, "documents").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.95 and got.where("score < 0 or score > 1").count() == 0


def test_language_edge_cases(odd, empty):
    model = language.learn(odd, F.lit(True))
    got = language.identify(odd, model)
    assert got.columns.count("lang_pred") == 1 and got.count() == len(ODD)
    assert {r.lang_pred for r in got.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert language.identify(odd, language.learn(empty, F.lit(True))).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, model).count() == 0


# ---- licences ---------------------------------------------------------------


def test_base_places_match_sql(llm, duck):
    got = QUERIES["op6_license_scan"](llm, SMALL).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(got) == sorted(duck.sql(licenses.SQL).fetchall(), key=repr)


def test_places_by_brute_force():
    words = [*"under the mit license apache version 2 cc by nc gnu general public 3 x é".split(), *(t.phrases[0][1] for t in licenses.BASE)]
    r = random.Random(4)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["UNDER-the/MIT license", "", "cc by nc" * 3, "a" * 99 + " cc by nc"]
    index = licenses.build_index({None: 10, "the": 9})
    scanned = licenses.Vocabulary(index.words).scan([t.encode() for t in texts])
    found = Counter((f, index.templates[t][0], s) for f, t, s, _ in licenses.find_templates(index, scanned) if index.templates[t][1])
    want = Counter()
    for k, t in enumerate(texts):
        ws = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        for template in licenses.BASE:
            phrase = template.phrases[0][1].split()
            want.update((k, template.label, j) for j in range(len(ws)) if ws[j:j + len(phrase)] == phrase)
    assert found == want and sum(want.values()) > 500


def test_templates_need_all_key_phrases(llm):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License", "gnu general public license or version 3", "version 3 " + "x " * 20 + "gnu general public license"]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df, licenses.index_of(df)).collect()}
    assert got[0] == ("gpl-3", 1.0) and got[1] == got[3] == ("", 0.0)
    assert got[2][0] == "gpl-3" and 0 < got[2][1] < 1


def brute_templates(words):
    """(label, start, share) by trying every chain of key phrases and every word of the template."""
    for t in licenses.TEMPLATES:
        text = words_of(t.text)
        places = [[i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()] for _, p in t.phrases]
        for start in places[0]:
            chain, off = [start], 0
            for k in range(1, len(places)):
                want = chain[-1] + t.phrases[k][0] - t.phrases[k - 1][0]
                near = sorted((abs(i - want), i) for i in places[k] if abs(i - want) <= licenses.SLACK)
                if not near:
                    break
                off += near[0][0]
                chain.append(near[0][1])
            else:
                found = 0
                at = [max([k for k in range(len(chain)) if t.phrases[k][0] <= j], default=0) for j in range(len(text))]
                put = [chain[k] + j - t.phrases[k][0] for j, k in enumerate(at)]
                for j in range(len(text)):
                    for d in range(-licenses.SLACK, licenses.SLACK + 1):
                        ok = [0 <= x < len(text) and 0 <= put[x] + d < len(words) and words[put[x] + d] == text[x] for x in (j - 1, j, j + 1)]
                        if ok[1] and (ok[0] or ok[2] or len(text) == 1):
                            found += 1
                            break
                yield t.label, start, round(found / (len(text) + off), 9)


def test_template_shares_by_brute_force():
    r = random.Random(9)
    texts = []
    for n in range(120):
        parts = []
        for t in r.sample(licenses.TEMPLATES, 3):
            words = words_of(t.text)
            cut = words[:r.randint(len(words) // 4, len(words))]
            for _ in range(r.randint(0, 3)):  # words added, left out or changed
                k = r.randrange(len(cut) + 1)
                cut[k:k + r.randint(0, 2)] = r.choice([[], ["acme"], ["the", "license"]])
            parts += cut
        texts.append(" ".join(parts))
    index = licenses.build_index({None: 1000, "the": 990, "software": 300, "license": 400})
    found = licenses.find_templates(index, licenses.Vocabulary(index.words).scan([t.encode() for t in texts]))
    got = Counter((f, index.templates[t][0], s, round(share, 9)) for f, t, s, share in found)
    assert got == Counter((k, *x) for k, t in enumerate(texts) for x in brute_templates(words_of(t)))
    assert len({x[1] for x in got}) > 10 and any(0.3 < x[3] < 0.7 for x in got) and any(x[3] == 1 for x in got)


def test_partial_license_has_its_share(llm):
    whole = next(t for t in licenses.TEMPLATES if t.label == "mit" and not t.base)
    words = words_of(whole.text)
    texts = ["Copyright (c) 2020 A. Person\n" + whole.text, "x " * 50 + " ".join(words[:len(words) // 2]), " ".join(words[30:])]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df, licenses.index_of(df)).collect()}
    assert got[0] == ("mit", 1.0) and got[2] == ("", 0.0)
    assert got[1][0] == "mit" and abs(got[1][1] - 0.5) < 0.03


def test_repeated_phrases_take_linear_time():
    index = licenses.build_index({None: 10})
    vocab = licenses.Vocabulary(index.words)

    def seconds(n):
        start = time.process_time()
        found = licenses.find_templates(index, vocab.scan([b"gnu general public license version 3 " * n]))
        assert sum(index.templates[t][0] == "gpl-3" and share == 1 for _, t, _, share in found) == n
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.05)


def test_license_edge_cases(odd, empty):
    index = licenses.index_of(odd)
    got = licenses.scan(odd, index).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[7].n_base, by[7].first_word, by[7].last_word, by[7].base_labels) == (2, 0, 4, "mit")
    assert by[2].n_words == 0 and by[2].first_word is None
    assert licenses.scan(empty, licenses.index_of(empty)).count() == 0


# ---- transport streams ------------------------------------------------------


def test_streams_give_their_payload_back():
    r = random.Random(1)
    for n in [*range(0, 400, 7), 32767, 32768, 32769, 100_000]:
        payload = transport.padded(r.randbytes(n))
        stream = transport.mux(payload)
        read = transport.demux(stream)
        assert len(payload) % 64 == 0 and len(stream) % 188 == 0 and read.ok
        assert b"".join(u[3] for u in read.units) == payload
        assert [u[1] for u in read.units] == [k * transport.TICKS for k in range(len(read.units))]
        assert len(read.random_access) == len(read.units) and read.programs and read.streams


def test_damage_is_seen():
    stream = transport.mux(transport.padded(b"some text" * 200))
    lost = transport.demux(stream[:188 * 4] + stream[188 * 5:])
    assert lost.discontinuities == 1 and not lost.ok
    twice = transport.demux(stream[:188 * 5] + stream[188 * 4:])
    assert twice.ok and twice.units[0][3] == transport.padded(b"some text" * 200)
    table_ = bytearray(stream)
    table_[15] ^= 1
    assert transport.demux(bytes(table_)).bad_tables and not transport.demux(bytes(table_)).ok
    assert not transport.demux(stream[:-5]).ok and not transport.demux(None).ok and not transport.demux(b"junk").ok


def test_media_edge_cases(odd, empty):
    got = transport.read_media(transport.store_media(odd)).collect()
    assert Counter((r.doc_id, r.payload) for r in got) == Counter((d, transport.padded((t or "").encode())) for d, t, *_ in ODD)
    assert all(r.ok for r in got) and transport.read_media(transport.store_media(empty)).count() == 0


# ---- near-copies ------------------------------------------------------------


def united(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    import xxhash
    words = [w for w in (text or "").translate({**{k: k + 32 for k in range(65, 91)}, **dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_brute_force():
    for text in [None, "", "one", "One two THREE", "a b c d", "a b c d e f g a b c d", "é É\x0bß", *(t for _, t, *_ in ODD if t and len(t) < 999)]:
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_near_copies_by_brute_force(llm, duck):
    docs = duck.sql("select doc_id, text from documents").fetchall()
    prints = {d: slow_fingerprint(t) for d, t in docs[:150]}
    label = united(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    some = llm.createDataFrame([d for d in docs if d[0] in prints], "doc_id long, text string")
    for many, limit in ((False, simhash.ANCHOR_ROWS), (False, 2), (True, simhash.ANCHOR_ROWS)):
        got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_copies(some, many=many, limit=limit).collect()}
        assert got == {d: (prints[d], label[d]) for d in prints}


def test_no_link_is_lost_at_any_distance_up_to_four():
    rng = np.random.default_rng(9)
    fps = set()
    for base in rng.integers(0, 1 << 63, 40, dtype=np.uint64):
        fps.add(int(base))
        for _ in range(6):
            x = int(base)
            for k in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    want = {(int(a), int(b)) for a, b in itertools.combinations(fps, 2) if int(a ^ b).bit_count() <= 4}
    for many in (False, True):
        key, row, home = simhash.anchors(fps, many)
        assert home.sum() == len(fps) * len(simhash.parts(many))
        order = np.argsort(key, kind="stable")
        a, b = simhash._pairs(key[order], fps[row[order]])
        assert set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) == want
    a, b = simhash.forest(fps)
    assert united(fps.tolist(), zip(a.tolist(), b.tolist())) == united(fps.tolist(), want) and len(a) < len(fps)


def test_components_of_chains_and_hubs(llm):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (7, 6), (-4, 200)]
    got = {r.node: r.label for r in components.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == united({n for e in clean for n in e}, clean)
    assert components.components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_near_copy_edge_cases(odd, empty):
    got = simhash.near_copies(odd)
    assert got.count() == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got.where("fp = 0").collect()} == {(2, 2), (3, 2), (4, 2), (None, 2)}
    kept = simhash.survivors(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 5, 6, 7, None, None])
    assert simhash.near_copies(empty).count() == 0 and simhash.survivors(empty).count() == 0


# ---- toxicity ---------------------------------------------------------------


def test_shared_model_is_a_distribution():
    counts = Counter(g for w in ("ab", "abc", "bca", "cab", "abab") for g in toxicity.grams_of(w))
    model = plain_toxicity.SharedModel(dict(counts))
    letters = [chr(k) for k in range(toxicity.LETTERS)]
    assert set("^$abc") <= set(letters)
    for context in ("^", "^a", "^ab", "^abc", "^zz"):
        assert sum(model.probability(context + c) for c in letters) == pytest.approx(1.0, abs=1e-6)


def test_both_classes_are_distributions():
    rows = [("^a", 5, 9), ("^b", 0, 4), ("^ab", 5, 1), ("^ac", 0, 8), ("^ab$", 5, 1), ("^ac$", 0, 8), ("^b$", 0, 4)]
    model = plain_toxicity.letter_model(rows)
    assert model.grams["^ab"] > 0.2 > 0 > model.grams["^ac"]
    assert plain_toxicity.letter_model([("^a", 0, 3)]).word("a") == 0.0 and model.word("") == pytest.approx(model.word(""))


def test_held_out_toxicity(llm):
    sf = SMALL.replace("0.001", "0.01")
    got = QUERIES["op8_kneser_ney_toxicity"](llm, sf).join(table(llm, sf, "labels"), "doc_id").where("held_out").select("score", "toxic").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8


def test_toxicity_edge_cases(llm, odd, empty):
    labels = llm.createDataFrame([(1, 1, 1), (5, 1, 0), (7, 1, None), (None, 1, 1), (6, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for docs, marks in ((odd, labels), (odd, labels.where("false")), (empty, labels)):
        classifier = toxicity.learn(docs, marks, bucket(F.col("doc_id"), 4) != 2)
        got = toxicity.score(odd, classifier)
        assert got.columns.count("score") == 1 and got.count() == len(ODD) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, classifier).count() == 0


@pytest.mark.parametrize("packed_bytes", [0, toxicity.PACKED_BYTES])
def test_model_of_every_sequence(llm, monkeypatch, packed_bytes):
    """However many sequences there are, all of them count: both forms of the model equal that of all counts in one place."""
    monkeypatch.setattr(toxicity, "PACKED_BYTES", packed_bytes)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 7, raising=False)
    docs, labels = table(llm, SMALL, "documents"), table(llm, SMALL, "labels")
    allowed = bucket(F.col("doc_id"), 4) != 2
    rows = toxicity.labelled(docs, labels, allowed).where(F.col("fold") != toxicity.CALIBRATED)
    want = plain_toxicity.letter_model([tuple(r) for r in toxicity.gram_counts(rows).collect()])
    classifier = toxicity.learn(docs, labels, allowed)
    assert (classifier.packed is None) == (not packed_bytes)
    got = classifier.model
    assert len(want.grams) > 1000 and got.grams == pytest.approx(want.grams, abs=1e-9) and got.default == pytest.approx(want.default, abs=1e-9)
    slow = {r.doc_id: classifier.scores(plain_toxicity.features(want, r.text))[0] for r in docs.collect()}
    assert {r.doc_id: r.score for r in toxicity.score(docs, classifier).collect()} == pytest.approx(slow, abs=1e-9)


def test_only_equal_texts_speak_for_each_other(llm):
    passage = "this very passage is in all of them"
    texts = [passage + "".join(f" {w}{k}" for w in ("own", "other", "last")) for k in range(20)]
    docs = llm.createDataFrame(list(enumerate([*texts, texts[3], texts[3]])), "doc_id long, text string")
    labels = llm.createDataFrame([(k, int(k in (3, 21))) for k in range(22)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, F.lit(True)).collect()
    assert sorted((r.i, r.toxic) for r in got) == [(k, int(k == 3)) for k in range(21)]


# ---- the pipeline -----------------------------------------------------------


def test_pipeline_by_its_operators(llm):
    import corpus_pipeline

    docs = table(llm, SMALL, "documents")
    lang = {r.doc_id: r for r in language.identify(docs, language.production(docs), lang_as="p", score_as="s").collect()}
    kept = docs.where(F.col("doc_id").isin([d for d, r in lang.items() if r.p != "und" and r.s >= corpus_pipeline.LEAST_SIMILARITY]))
    classifier = toxicity.production(kept, table(llm, SMALL, "labels"))
    model = classifier.model
    clean = [r for r in kept.collect() if classifier.scores(plain_toxicity.features(model, r.text))[0] < toxicity.THRESHOLD]
    prints = {r.doc_id: slow_fingerprint(r.text) for r in clean}
    label = united(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = corpus_pipeline.run(llm, SMALL)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == set(label.values())


def test_stages_keep_the_columns(llm, odd):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(llm, odd, SMALL).columns == odd.columns
        assert stage(llm, odd.where("false"), SMALL).count() == 0
