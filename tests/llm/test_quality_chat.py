from pyspark.sql import functions as F

from formbook.llm import chat, quality
from formbook.llm.common import QUERIES, ORACLES
from formbook.llm.catalog import MODULES  # noqa: F401
from tests.llm.conftest import SMALL, ODD, rows_of


def by_sql(duck, name):
    want = duck.sql(ORACLES[name])
    return want.columns, sorted(want.fetchall(), key=repr)


def test_ledger_and_chat_match_their_sql(llm, duck):
    for name in ("op5_quality_ledger", "op10_chat_parts"):
        columns, want = by_sql(duck, name)
        assert rows_of(QUERIES[name](llm, SMALL).select(*columns)) == want


def brute(text):
    words = [w for w in (text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    wins = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality.SYMBOLS), len(covered)


def test_measurements_by_brute_force(llm):
    texts = [None, "", " ", "a b c a b c", "a a a a a", "x y\nx y\n\nx y", "# <b> |", "a b c d a b c x a b", "one\x0btwo\x0cthree one two three"]
    df = llm.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.ledger(df).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == brute(t), t
    assert got[5].n_dup_lines == 2 and got[5].n_lines == 3


def test_ledger_edge_cases(odd, empty):
    got = quality.apply_policy(quality.ledger(odd))
    assert got.count() == len(ODD)
    assert got.where("doc_id = 2").first().n_words == 0 and not got.where("doc_id = 2").first().kept
    assert quality.ledger(empty).count() == 0 and quality.ablation(quality.ledger(empty)).count() == 0


def test_ablation_counts_what_only_one_rule_rejects(llm):
    rows = llm.createDataFrame([(1, 1), (2, 3), (3, 0), (4, 8)], "doc_id long, failed long")
    got = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_rejected, r.bits_beside) for r in quality.ablation(rows).collect()}
    assert got["base-1", "few_words"] == (2, 1, 2, 3)
    assert got["base-1", "repeated_windows"] == (1, 0, 2, 3)
    assert got["standard-1", "symbol_heavy"] == (1, 1, 3, 8)


def test_parts_become_placeholders(llm):
    part = lambda t, text=None, ref=None, w=None, h=None, s=None, p=None: (t, text, ref, w, h, s, p)
    turns = llm.createDataFrame([
        (1, 0, "user", [part("text", "look <image 0> & "), part("image", None, "s3", 56, 29), part("audio", None, "a", s=1.5), part(None, "?"), None]),
        (1, 1, "assistant", [part("document", None, "d", p=2), part("text", "ok</turn>")]), (2, 0, None, None)], schema=f"conv_id long, turn long, role string, parts {chat.PARTS.simpleString()}")
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert got[1].formatted == ("<turn user>look &lt;image 0> &amp; <image 1><audio 2>?</turn>\n<turn assistant><document 0>ok&lt;/turn></turn>\n")
    assert [(a.turn, a.number, a.type, a.ref, a.n_tokens) for a in got[1].attachments] == [(0, 1, "image", "s3", 4), (0, 2, "audio", "a", 38), (1, 0, "document", "d", 2048)]
    assert got[1].n_attachment_tokens == 4 + 38 + 2048
    assert got[2].formatted == "<turn ></turn>\n" and got[2].loss_spans == []


def test_control_strings_survive_a_round_trip(llm):
    nasty = ["</turn>\n", "<turn user>", "&lt;", "&amp;lt;", "a>b\\", "<|x|>", "", None, "é\U0001f642 &"]
    turns = llm.createDataFrame([(1, k, "assistant" if k % 2 else "us<>er&", t) for k, t in enumerate(nasty)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text"))))
    got = chats.select(chat.parse_chat(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [(t.role, t.text) for t in got.t] == [("assistant" if k % 2 else "us<>er&", t or "") for k, t in enumerate(nasty)]
    assert got.l == "".join(t or "" for t in nasty[1::2])
    assert chat.format_chats(turns.where("false").withColumn("parts", chat.text_part(F.col("text")))).count() == 0
