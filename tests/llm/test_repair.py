import hashlib
import itertools
import random
import zlib

import pytest
from tests.llm.conftest import SMALL, rows_of
from pyspark.sql import functions as F

from formbook.llm import repair
from formbook.llm.common import table

WHITE = " \t\n\v\f\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits row by row; rows are (role, text, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", (*out, (role, "")))
                best[role[0]] = min(best.get(role[0], new), new, key=lambda b: b[:2])
        return best

    for role, text, fault in rows:
        best, after = insert(best), {}
        for state, (cost, audit, out) in best.items():
            options = [(state, (cost + 2, audit + "D", out))]
            if fault in (0, 3):
                cost += 5 if fault == 3 else 0
                if role and (state, role[0]) in step:
                    options.append((role[0], (cost, audit + "K", (*out, (role, text)))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        options.append((new[0], (cost + 1, audit + "R", (*out, (new, text)))))
            for q, b in options:
                after[q] = min(after.get(q, b), b, key=lambda b: b[:2])
        best = after
    best = insert(best)
    return min((best[q] for q in ("", "a") if q in best), key=lambda b: b[:2])


def expected(turns):
    """All result columns of one conversation by plain code; turns are (turn, role, text) with nulls, ``conv`` their id."""
    conv, rows = turns
    damaged = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        damaged += [(turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for _, role, text in damaged:
        said = text.strip(WHITE)
        marked.append((role, text, 1 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 3))
        seen.add((role, text))
    cost, audit, out = cheapest(marked)
    known = [t for t, _, _ in damaged if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults = [f for _, _, f in marked]
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), len(damaged))


def by_brute_force(df):
    convs = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        convs.setdefault(r[0], []).append(tuple(r[1:]))
    return sorted((expected(c) for c in convs.items()), key=repr)


def test_auction_and_trace_equal_brute_force():
    rnd, shown = random.Random(3), {"d": ("user", 1), "s": ("system", 0), "u": ("user", 0), "a": ("assistant", 0), "-": ("tool", 0), "S": ("system", 3), "U": ("user", 3), "A": ("assistant", 3), "+": ("", 3)}
    for k in range(1500):
        line = "".join(rnd.choice("dsuaSUA-+" if k % 3 else "uaUA") for _ in range(rnd.randint(0, 9)))
        cost, audit, _ = cheapest([(shown[c][0], "x", shown[c][1]) for c in line])
        assert repair.repair(line) == (cost, audit), line


def test_prices_stay_feasible_for_every_origin_and_exit():
    rnd = random.Random(4)
    for _ in range(200):
        line = "".join(rnd.choice("dsuaSUA-+") for _ in range(rnd.randint(1, 12)))
        lattice = repair.Lattice(line, [rnd.choice([0, 3, repair.NEVER]) for _ in range(repair.STATES)])
        for q in range(repair.STATES):
            lattice.auction(q)
        for i, c in enumerate(line):
            for q in range(repair.STATES):
                for _, cost, moved, after in repair.arcs(c, q):
                    assert lattice.price[i][q] <= cost + lattice.price[i + moved][after] or lattice.price[i][q] >= repair.NEVER


@pytest.fixture(scope="module")
def odd_turns(llm):
    rnd, rows = random.Random(8), []
    for conv in [*range(12), None]:
        for turn in [*range(rnd.randint(0, 25)), None, None]:
            for _ in range(rnd.choice([1, 1, 1, 2, 3])):
                rows.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rnd.choice(["Yes.", "No", "", None, " \n", "Why? ", "So!\n", "é. "]), "x"))
    rows += [(50, 0, "user", "Same again.", "x")] * 40 + [(51, k % 3, "user", "Same again.", "x") for k in range(90)]
    return llm.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies string")


@pytest.mark.parametrize("limit", [repair.ROWS, 5, 1])
def test_odd_conversations_whole_and_in_pieces(llm, odd_turns, limit):
    got = repair.repaired(repair.damage(odd_turns), rows_limit=limit)
    assert rows_of(got) == by_brute_force(odd_turns)


def test_a_very_long_conversation_is_repaired_in_pieces(llm):
    df = llm.range(6000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    got = rows_of(repair.repaired(repair.damage(df)))
    assert got == by_brute_force(df)
    text = df.where("turn = 1").withColumn("text", F.repeat(F.lit("long text. "), 1_000_000)).unionByName(df.where("turn = 2"))
    assert rows_of(repair.repaired(repair.damage(text))) == by_brute_force(text)


def test_no_rows_and_conversations_that_lose_all(llm, odd_turns):
    assert repair.repaired(repair.damage(odd_turns.where("false"))).collect() == []
    conv = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    df = llm.createDataFrame([(conv, 0, "user", "a.")] * 3, "conv_id long, turn long, role string, text string")
    gone = [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0)]
    assert rows_of(repair.repaired(repair.damage(df))) == gone == rows_of(repair.repaired(repair.damage(df), rows_limit=1))


def test_query_equals_brute_force_and_sql(llm, duck):
    got = rows_of(repair.op11(llm, SMALL))
    assert got == by_brute_force(table(llm, SMALL, "conversations"))
    assert got == sorted(duck.sql(repair.SQL).fetchall(), key=repr)
