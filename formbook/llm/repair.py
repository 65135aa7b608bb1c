"""Conversation structure repair as shortest paths by the auction algorithm.

The rows of a conversation are the columns of a lattice whose nodes are (row, state); the
states say which roles came last (none, system, user, assistant).  Arcs are edits with integer
costs: Keep, Rerole and Delete lead to the next row, Insert stays at its row.  A repair is a
path from the first node to one where the roles form ``(s?(ua)+)?``.

The auction keeps a price at every node and one path from the origin.  The path's last node
either extends along an arc whose cost it can pay (its price equals the arc's cost plus the
price behind it) or raises its price to the cheapest offer and contracts.  At the end prices
are dual feasible, so an arc is on some cheapest path just if it is tight and leads on to the
end by tight arcs; the audit is traced along those, least letter first.  Prices start at the
sum of what every later row costs at least.

A conversation of up to ``ROWS`` rows and ``BYTES`` of text is repaired in one piece.  A longer
one is cut into pieces of consecutive rows that are spread over tasks: each piece gives the
costs from every state to every state, the pieces' suffix costs are offers at their ends, and
each piece is traced from every state it might begin in.  The texts of a conversation are
hashed as a stream.  Only the audit itself, a letter a row, is ever in one place.

Edge cases: null roles, texts, ids and turns read as one space where text is asked for; rows
of one turn are ordered by role and text; repeated rows are damaged alike and all but the
first are duplicates; an empty or unknown role has no legal initial, it can be reroled or
deleted; a null conversation id is one conversation; other columns are not looked at, whatever
their names; texts of any length are read whole; a conversation that loses all rows gives
zeros; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import CRC_TABLE_SQL, SPACE, bucket, crc32_sql, query, stored, table

FAULTS = 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
USER, ASSISTANT = "user", "assistant"
# A conversation beyond these is repaired in pieces of about that size.
ROWS, BYTES = 500, 8 << 20
# Long conversations' ids are broadcast up to this many.
BROADCAST_IDS = 100_000

NONE, SYSTEM, SAID, DONE = range(4)  # states: nothing yet, s, ends in u, ends in a
STATES = 4
#: State after a role's initial, by state.
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): SAID, (SYSTEM, "u"): SAID, (SAID, "a"): DONE, (DONE, "u"): SAID}
#: The role that may be added in each state, and the state after it.
ADDED = {NONE: (USER, SAID), SYSTEM: (USER, SAID), SAID: (ASSISTANT, DONE), DONE: (USER, SAID)}
#: Cost and letters to the end once all rows are used.
FINAL = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
NEVER = 1 << 40
# Symbols of a row: d must be deleted; s u a - its role's initial, in capitals (and +) if its text is cut short.
_CUT = {"s": "S", "u": "U", "a": "A", "-": "+"}


# ---- the auction ------------------------------------------------------------


def arcs(symbol: str, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows moved, next state) of the edits at a row, letters in order."""
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, ADDED[state][1])]
    if symbol != "d":
        extra = TRUNCATED if symbol in "SUA+" else 0
        if (after := NEXT.get((state, symbol.lower()))) is not None:
            out.append(("K", KEEP + extra, 1, after))
        out.append(("R", REROLE + extra, 1, ADDED[state][1]))
    return out


_ARCS = {(c, q): arcs(c, q) for c in "dsuaSUA-+" for q in range(STATES)}
_LEAST = {c: min(a[1] for q in range(STATES) for a in _ARCS[c, q] if a[2]) for c in "dsuaSUA-+"}


class Lattice:
    """One run of rows with offers at its end: ``offers[q]`` is the cost of going on from state q, or ``NEVER``."""

    def __init__(self, symbols: str, offers: Sequence[int]):
        self.symbols, self.n = symbols, len(symbols)
        least = min(offers)
        self.price = [[0] * STATES for _ in range(self.n)] + [list(offers)]
        reach = [p < NEVER for p in offers]
        for i in range(self.n - 1, -1, -1):
            least += _LEAST[symbols[i]]
            # Nodes that cannot reach an offer would raise their prices for ever.
            behind, reach = reach, [False] * STATES
            for _ in range(STATES):
                reach = [any((behind if moved else reach)[after] for _, _, moved, after in _ARCS[symbols[i], q]) for q in range(STATES)]
            self.price[i] = [least if r else NEVER for r in reach]

    def auction(self, state: int) -> int:
        """The least cost from the first row in ``state``; prices stay feasible and only rise."""
        price, symbols, n = self.price, self.symbols, self.n
        if min(price[n]) >= NEVER:
            return NEVER
        path = [(0, state)]
        while True:
            i, q = path[-1]
            if i == n or price[i][q] >= NEVER:
                return price[0][state]
            offer, best = NEVER, None
            for _, cost, moved, after in _ARCS[symbols[i], q]:
                bid = cost + price[i + moved][after]
                if bid < offer:
                    offer, best = bid, (i + moved, after)
            if price[i][q] < offer:
                price[i][q] = offer
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)

    def trace(self, state: int) -> tuple[str, int]:
        """(letters, last state) of the ASCII-least cheapest path from ``state``, once it was auctioned."""
        price, symbols, n = self.price, self.symbols, self.n

        def tight(i: int, q: int) -> list[tuple[str, int, int]]:
            return [(letter, i + moved, after) for letter, cost, moved, after in _ARCS[symbols[i], q] if cost + price[i + moved][after] == price[i][q]]

        # Nodes that reach the end by tight arcs; at a row, insertions go from state to state.
        alive = [[False] * STATES for _ in range(n)] + [[p < NEVER for p in price[n]]]
        for i in range(n - 1, -1, -1):
            for _ in range(STATES):
                for q in range(STATES):
                    if not alive[i][q]:
                        alive[i][q] = any(alive[j][r] for _, j, r in tight(i, q))
        letters, i, q = [], 0, state
        while i < n:
            letter, i, q = next(a for a in tight(i, q) if alive[a[1]][a[2]])
            letters.append(letter)
        return "".join(letters), q


@lru_cache(maxsize=100_000)
def repair(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    lattice = Lattice(symbols, [c for c, _ in FINAL])
    cost = lattice.auction(NONE)
    letters, q = lattice.trace(NONE)
    return cost, letters + FINAL[q][1]


def replay(letters: str, roles: Iterator[tuple[str, str]], state: int = NONE) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows; the rows are taken from ``roles``."""
    for letter in letters:
        if letter == "I":
            role, state = ADDED[state]
            yield role, ""
            continue
        role, text = next(roles)
        if letter == "K":
            state = NEXT[state, role[:1]]
        elif letter == "R":
            role, state = ADDED[state]
        if letter != "D":
            yield role, text


# ---- rows -------------------------------------------------------------------

_WHITE = " \t\n\v\f\r"


def fault(role: str, text: str, duplicate: bool) -> int:
    """0 none, 1 blank, 2 duplicate, 3 truncated."""
    said = text.rstrip(_WHITE)
    if not said:
        return 1
    return 2 if duplicate else 0 if said[-1] in ".!?" else 3


def symbol(role: str, found: int) -> str:
    """The row's symbol, given its fault."""
    kind = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return (kind, "d", "d", _CUT[kind])[found]


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage; dropped rows have no copies."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    b = bucket(key, FAULTS)
    return rows.select(
        "conv_id", "turn", F.when(b == 4, USER).otherwise(F.col("role")).alias("role"),
        F.when(b == 1, "").when(b == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(b == 0, 0).when(b == 3, 2).otherwise(1).cast("long").alias("copies"))


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
_LEGAL = {"su", "ua", "au"}
_EMPTY = hashlib.sha256(b"").hexdigest()


def _illegal(roles: Sequence[str]) -> int:
    return sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:]))


def _gaps(turns: Sequence[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def _whole(rows: list[dict]) -> tuple:
    """The result of one conversation from its rows with copies, in any order."""
    rows = sorted((r for r in rows if r["copies"]), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["text"].encode()))
    said = [(r["role"], r["text"]) for r in rows for _ in range(r["copies"])]
    seen, symbols, faults = set(), [], [0, 0, 0, 0]
    for role, text in said:
        again = (role, text) in seen
        seen.add((role, text))
        found = fault(role, text, again)
        symbols.append(symbol(role, found))
        faults[found] += 1
    cost, audit = repair("".join(symbols))
    text = "\n".join(f"{r}:{t}" for r, t in replay(audit, iter(said)))
    return (_gaps([r["turn"] for r in rows if r["turn"] is not None]), *faults[1:], _illegal([r for r, _ in said]), cost, audit,
            hashlib.sha256(text.encode()).hexdigest(), len(said))


def _short(rows: DataFrame) -> DataFrame:
    """One task a group of whole conversations."""
    grouped = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text", "copies")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_whole(r) for r in b.column(1).to_pylist()]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.record_batch([b.column(0), *columns], names=_COLUMNS)

    return grouped.mapInArrow(run, RESULT)


# ---- long conversations -----------------------------------------------------

_PIECE = ("conv_id long, part int, seq long, symbols string, roles array<string>, texts array<string>, copies array<long>, costs array<long>, "
          "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, n_rows long, first string, last string")


def _piece(conv: int | None, part: int, seq: int, rows: list[dict]) -> dict:
    """A run of consecutive distinct rows: costs between all states, and what its neighbours need to know.

    A row's copies after the first are deletions that follow it at once: least letter, same cost.
    """
    faults = [fault(r["role"], r["text"], r["again"]) for r in rows]
    symbols = "".join(symbol(r["role"], f) for r, f in zip(rows, faults))
    more = sum(r["copies"] - 1 for r in rows)
    costs = []
    for q in range(STATES):
        lattice = Lattice(symbols, [0 if r == q else NEVER for r in range(STATES)])
        costs += [lattice.auction(p) for p in range(STATES)]
    # A blank row's copies are blank, any other's are duplicates.
    blank = sum(r["copies"] for r, f in zip(rows, faults) if f == 1)
    duplicate = sum(r["copies"] - (f != 2) for r, f in zip(rows, faults) if f != 1)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    roles = [r["role"] for r in rows]
    return {
        "conv_id": conv, "part": part, "seq": seq, "symbols": symbols, "roles": roles, "texts": [r["text"] for r in rows], "copies": [r["copies"] for r in rows],
        "costs": [min(c + DELETE * more, NEVER) for c in costs], "low": min(turns, default=None), "high": max(turns, default=None),
        "turns": len(set(turns)), "blank": blank, "duplicate": duplicate, "truncated": faults.count(3),
        "illegal": _illegal(roles) + more, "n_rows": more + len(rows), "first": roles[0], "last": roles[-1]}


def _pieces(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    """The long conversations in runs of rows that are next to each other in their order."""
    # Copies become numbers before anything meets, so no order key is hot.
    rows = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    shown = F.sha2("text", 256)
    rank = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv_id", "role", shown.alias("shown")).agg(F.min(rank).alias("first"))
    rows = stored(rows, "turns")
    marked = rows.withColumn("shown", shown).alias("r").join(first.alias("f"), F.expr("r.conv_id <=> f.conv_id AND r.role = f.role AND r.shown = f.shown"))
    marked = marked.select("r.conv_id", "r.turn", "r.role", "r.text", "r.copies", (F.struct(F.col("r.turn").isNotNull().alias("known"), F.col("r.turn").alias("turn")) != F.col("f.first")).alias("again"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    placed = stored(marked, "turns").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, seq, schema = [], 0, None, 0, pa.schema([
            (n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}[t])
            for n, t in (c.split() for c in _PIECE.split(", "))])
        for b in batches:
            for r in b.to_pylist():
                if held and (r["conv_id"] != now or len(held) >= piece_rows or size >= piece_bytes):
                    yield pa.RecordBatch.from_pylist([_piece(now, held[0]["part"], seq, held)], schema)
                    held, size, seq = [], 0, seq + 1
                now = r["conv_id"]
                held.append(r)
                size += len(r["text"])
        if held:
            yield pa.RecordBatch.from_pylist([_piece(now, held[0]["part"], seq, held)], schema)

    return stored(placed.mapInArrow(run, _PIECE), "pieces")


def _offers(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, seq, offers): least cost from each state at a piece's end; from numbers only, a few for hundreds of rows."""
    at = F.array_sort(F.collect_list(F.struct("part", "seq", "costs")))
    grouped = pieces.groupBy("conv_id").agg(at.alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, ps in zip(*(c.to_pylist() for c in b.columns)):
                offers, out = [c for c, _ in FINAL], []
                for p in reversed(ps):
                    out.append((p["part"], p["seq"], offers))
                    offers = [min(min(p["costs"][r * STATES + q] + offers[r], NEVER) for r in range(STATES)) for q in range(STATES)]
                parts, seqs, offered = zip(*out)
                yield pa.record_batch([pa.array([conv] * len(out), pa.int64()), pa.array(parts, pa.int32()), pa.array(seqs, pa.int64()), pa.array(offered, pa.list_(pa.int64()))],
                                      names=["conv_id", "part", "seq", "offers"])

    return grouped.mapInArrow(run, "conv_id long, part int, seq long, offers array<long>")


def _long(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    pieces = _pieces(rows, piece_rows, piece_bytes)
    offers = _offers(pieces)
    priced = pieces.alias("p").join(offers.alias("o"), F.expr("p.conv_id <=> o.conv_id AND p.part = o.part AND p.seq = o.seq")).select("p.*", "o.offers")
    order = ["part", "seq"]
    placed = priced.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict = {}

        def close() -> pa.RecordBatch:
            o = open_
            audit = "".join(o["audit"])
            q, letters = o["state"], FINAL[o["state"]][1]
            for role, text in replay(letters, iter(()), q):
                o["sha"](role, text)
            gaps = o["high"] - o["low"] + 1 - o["turns"] if o["low"] is not None else 0
            values = [o["conv"], gaps, o["blank"], o["duplicate"], o["truncated"], o["illegal"], o["cost"], audit + letters, o["digest"].hexdigest(), o["n_rows"]]
            return pa.record_batch([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names=_COLUMNS)

        for b in batches:
            for p in b.to_pylist():
                if open_ and open_["conv"] != p["conv_id"]:
                    yield close()
                    open_ = {}
                if not open_:
                    open_ = _opened(p["conv_id"])
                    open_["cost"] = min(min(p["costs"][r * STATES + NONE] + p["offers"][r], NEVER) for r in range(STATES))
                _take(open_, p)
        if open_:
            yield close()

    return placed.mapInArrow(run, RESULT)


def _opened(conv: int | None) -> dict:
    digest = hashlib.sha256()
    o = {"conv": conv, "digest": digest, "any": False, "state": NONE, "audit": [], "low": None, "high": None, "last": None, "last_turn": None}
    o |= dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "n_rows"), 0)

    def sha(role: str, text: str) -> None:
        digest.update(("\n" if o["any"] else "").encode() + f"{role}:{text}".encode())
        o["any"] = True

    return o | {"sha": sha}


def _take(o: dict, p: dict) -> None:
    """Go on with the conversation's next piece."""
    lattice = Lattice(p["symbols"], p["offers"])
    lattice.auction(o["state"])
    letters, after = lattice.trace(o["state"])
    for role, text in replay(letters, zip(p["roles"], p["texts"]), o["state"]):
        o["sha"](role, text)
    copies, out = iter(p["copies"]), []
    for letter in letters:
        out.append(letter if letter == "I" else letter + "D" * (next(copies) - 1))
    o["audit"].append("".join(out))
    o["state"] = after
    for c in ("blank", "duplicate", "truncated", "illegal", "n_rows"):
        o[c] += p[c]
    if o["last"] is not None:
        o["illegal"] += o["last"][:1] + p["first"][:1] not in _LEGAL
    o["last"] = p["last"]
    if p["low"] is not None:
        # Pieces come by turn, so one turn at most is in both.
        o["turns"] += p["turns"] - (o["high"] == p["low"])
        o["low"], o["high"] = p["low"] if o["low"] is None else o["low"], p["high"]


def repaired(turns: DataFrame, rows_limit: int = ROWS, bytes_limit: int = BYTES) -> DataFrame:
    """Structure faults and the cheapest repair of each conversation of (conv_id, turn, role, text, copies) rows."""
    size = turns.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.length("text")).alias("b"))
    long = stored(size.where((F.col("n") > rows_limit) | (F.col("b") > bytes_limit)).select("conv_id"), "long-conversations")
    n = long.count()
    if not n:
        return _short(turns)
    long = F.broadcast(long) if n <= BROADCAST_IDS else long
    same = turns["conv_id"].eqNullSafe(long["conv_id"])
    cut = turns.join(long, same, "left_semi")
    found = _long(cut, rows_limit, bytes_limit)
    # A long conversation that lost every row has no piece.
    lost = long.join(found.select("conv_id"), long["conv_id"].eqNullSafe(found["conv_id"]), "left_anti")
    gone = lost.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _COLUMNS[1:7]], F.lit("").alias("audit"), F.lit(_EMPTY).alias("repaired_sha256"), F.lit(0).cast("long").alias("n_rows"))
    return _short(turns.join(long, same, "left_anti")).unionByName(found).unionByName(gone)


_LETTERS = f"""
ins(q, k, q2) AS (VALUES {", ".join(f"({q}, {k}, {r})" for q, steps in {NONE: (0, 2, 3, 2), SYSTEM: (1, 2, 3, 2), SAID: (2, 3, 2, 3), DONE: (3, 2, 3, 2)}.items() for k, r in enumerate(steps))}),
keep(q, kind, q2) AS (VALUES {", ".join(f"({q}, '{c}', {r})" for (q, c), r in NEXT.items())}),
edits AS (
  SELECT q, 'D' AS letter, {DELETE} AS cost, NULL::VARCHAR AS kind, q AS q2 FROM range({STATES}) r(q)
  UNION ALL SELECT q, 'R', {REROLE}, NULL::VARCHAR, q2 FROM ins WHERE k = 1
  UNION ALL SELECT q, 'K', {KEEP}, kind, q2 FROM keep),
arcs AS (
  SELECT i.q, repeat('I', k) || letter AS letters, letter, {INSERT} * k + cost AS cost, kind, e.q2 FROM ins i JOIN edits e ON i.q2 = e.q)"""

SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
{_LETTERS.strip()},
read AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % {FAULTS} AS b FROM conversations, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN b = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN b = 1 THEN '' WHEN b = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN b = 0 THEN 0 WHEN b = 3 THEN 2 ELSE 1 END)) AS copy FROM read),
said AS MATERIALIZED (
  SELECT conv_id, turn, role, text, left(role, 1) AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    NOT regexp_matches(text, '[^{SPACE}]') AS blank, NOT regexp_matches(text, '[.!?][{SPACE}]*$') AS cut FROM hurt),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM said),
rows_ AS MATERIALIZED (
  SELECT *, blank OR again AS gone, NOT blank AND NOT again AND cut AS short, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM told),
sizes AS MATERIALIZED (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (short) AS truncated,
    count(*) FILTER (i > 1 AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY 1),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit FROM sizes
  UNION ALL
  SELECT conv_id, i, q, cost, audit FROM (
    SELECT b.conv_id, r.i, a.q2 AS q, b.cost + a.cost + CASE WHEN r.short AND a.letter <> 'D' THEN {TRUNCATED} ELSE 0 END AS cost, b.audit || a.letters AS audit
    FROM best b JOIN rows_ r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = b.i + 1
    JOIN arcs a ON a.q = b.q AND (a.letter = 'D' OR NOT r.gone) AND (a.kind IS NULL OR a.kind = r.kind))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ends AS (
  SELECT b.conv_id, b.cost + {INSERT} * k AS cost, audit || repeat('I', k) AS audit
  FROM best b JOIN sizes s ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.i = s.n JOIN ins ON ins.q = b.q WHERE ins.q2 IN ({NONE}, {DONE})
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + {INSERT} * k, audit || repeat('I', k)) = 1),
letters AS (
  SELECT conv_id, p, substr(audit, p::INT, 1) AS letter, row_number() OVER (PARTITION BY conv_id ORDER BY p) - count(*) FILTER (substr(audit, p::INT, 1) = 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i
  FROM ends, unnest(range(1, length(audit) + 1)) u(p)),
kept AS (
  SELECT l.conv_id, l.p, l.letter, r.role, r.text, CASE WHEN l.letter = 'K' THEN r.role END AS fixed,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS k, first_value(CASE WHEN l.letter = 'K' THEN r.kind END) OVER (PARTITION BY l.conv_id ORDER BY p) = 's' AS opened
  FROM letters l LEFT JOIN rows_ r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i AND l.letter <> 'I' WHERE l.letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(coalesce(fixed, CASE WHEN (k + CASE WHEN opened THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text
  FROM kept GROUP BY 1)
SELECT c.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(t.text, '')) AS repaired_sha256, coalesce(n, 0)::BIGINT AS n_rows
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sizes s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""


@query("op11_auction_repair", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damage(table(spark, sf_dir, "conversations")))
