"""Chat formatting over typed content parts.

A conversation is rows of turns; a turn holds an ordered list of typed parts (text, image,
audio, document).  A visitor with one case per part type flattens the list: text parts are
escaped, other parts become numbered placeholders, and each leaves an attachment record with
its reference and the tokens it expands to.  Everything is column expressions.

Template: ``<turn ROLE>BODY</turn>\\n`` for each turn.  In roles, texts and references ``&``
becomes ``&amp;``, ``<`` becomes ``&lt;``, and in roles also ``>`` becomes ``&gt;``, so a raw
``<`` only ever opens a control string and the escapes can be undone in a fixed order.

Edge cases: null text or an empty part list is an empty body; a null part or an unknown part
type is an empty text; a null role is the empty role; repeated (conversation, turn) rows are
all kept, ordered by role and then body; a conversation with a null id is one conversation;
an empty table gives no rows.  One conversation is one output string, so one conversation's
turns meet in one task; there is no bound on how many conversations there are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.llm.common import free_name, let, query, table

PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.LongType()),
])
PARTS = T.ArrayType(PART)

# Tokens a part expands to: an image per 28-pixel patch, audio per second, a document per page.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 1024
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    for entity, char in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit(">"), F.lit("&gt;"))


def _patches(size: Column) -> Column:
    return F.ceil(F.coalesce(size, F.lit(0)) / PATCH)


#: Tokens of an attachment by part type; the keys are the placeholder types.
EXPANSIONS: Mapping[str, Callable[[Column], Column]] = {
    "image": lambda p: _patches(p["width"]) * _patches(p["height"]),
    "audio": lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND),
    "document": lambda p: F.coalesce(p["pages"], F.lit(0)) * TOKENS_PER_PAGE,
}


def text_part(text: Column) -> Column:
    """A turn of plain text as a list of one part."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *nulls))


def _visit(part: Column, number: Column) -> Column:
    """One part as (body, attachment or null)."""
    kind = part["type"]
    body = escape(F.coalesce(part["text"], F.lit("")))
    tokens = F.lit(0).cast("long")
    held = F.lit(False)
    for name, expand in EXPANSIONS.items():
        body = F.when(kind == name, F.concat(F.lit(f"<{name} "), number.cast("string"), F.lit(">"))).otherwise(body)
        tokens = F.when(kind == name, expand(part).cast("long")).otherwise(tokens)
        held = F.when(kind == name, F.lit(True)).otherwise(held)
    return F.struct(body.alias("body"), F.when(F.coalesce(held, F.lit(False)), F.struct(
        number.cast("int").alias("number"), kind.alias("type"), part["ref"].alias("ref"), tokens.alias("n_tokens"))).alias("attachment"))


def flatten_parts(df: DataFrame, parts_col: str = "parts") -> DataFrame:
    """Replace a turn's parts by ``body`` and ``attachments``; placeholders count from 0 within the turn."""
    visited = let(F.transform(F.coalesce(F.col(parts_col), F.array().cast(PARTS)), _visit), lambda v: F.struct(
        F.array_join(F.transform(v, lambda x: x["body"]), "").alias("body"),
        F.filter(F.transform(v, lambda x: x["attachment"]), lambda a: a.isNotNull()).alias("attachments")))
    taken = df.columns
    tmp = free_name("visited", taken)
    kept = [F.col(f"`{c}`") for c in taken if c.lower() not in {parts_col.lower(), "body", "attachments"}]
    return df.withColumn(tmp, visited).select(*kept, F.col(tmp)["body"].alias("body"), F.col(tmp)["attachments"].alias("attachments"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, ``loss_spans`` (start from 1, length, in
    ``formatted``, of each assistant body), ``attachments`` with turn positions, ``n_attachment_tokens``."""
    flat = flatten_parts(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(parts_col).alias("parts")))
    turn = F.struct("turn", "role", "body", "attachments")
    convs = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rendered = convs.select("conv_id", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<turn "), _escape_role(t["role"]), F.lit(">")).alias("head"),
        t["body"].alias("body"), F.coalesce(t["role"] == TRAINED, F.lit(False)).alias("trained"), t["attachments"].alias("attachments"))).alias("t"))
    # A running length of everything before each body gives the spans.
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("t", start, lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len("</turn>\n")).alias("at"),
        F.when(t["trained"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    attachments = F.flatten(F.transform("t", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
        i.alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    out = rendered.select(
        "conv_id", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit("</turn>\n"))), "").alias("formatted"),
        spans.alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text); placeholders stay as they are.

    Escaped bodies hold no raw ``<`` but a placeholder's, so the end mark splits turns and the first ``>`` ends a head."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, ">", 1).substr(F.lit(len("<turn ") + 1), F.length(p))).alias("role"),
        unescape(p.substr(F.instr(p, ">") + 1, F.length(p))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")


EXTRA_TEXT = "\\### Assistant: </turn> ok"

SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS body FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(body) + 15)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""


@query("op10_chat_parts", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # literals over a one-row range: a local relation would be built from Python rows
    extra = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise(TRAINED), F.lit(EXTRA_TEXT))
    chats = format_chats(turns.union(extra).withColumn("parts", text_part(F.col("text"))))
    read = chats.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
