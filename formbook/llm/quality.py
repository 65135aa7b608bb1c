"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps the measurements and one
failure bit per rule.  Policies are versioned masks over those bits: a document is kept
if none of the policy's bits is set.  Changing a policy, or asking what one rule costs,
reads only the ledger.  Everything is column expressions; no row leaves the JVM.

Edge cases: a null text counts as empty (no words, base rule fails); documents are never
grouped, so repeated rows and repeated ids give one ledger row each; columns of the input
besides the id and the text are not looked at, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import SPACE, let, query, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurement columns, as Spark SQL that DuckDB reads too."""

    name: str
    fails: str


# Order fixes the bit: rule k owns bit k.  Append only; a ledger stays readable by later versions.
RULES: tuple[Rule, ...] = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_windows", f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words"),
    Rule("long_words", "word_chars > 30 * n_words"),
    Rule("symbol_heavy", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    Rule("shouting", "n_exclaims > n_words"),
)
BASE = ("few_words", "repeated_windows")

POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "standard-1": (*BASE, "long_words", "symbol_heavy", "duplicate_lines", "shouting"),
}
PRODUCTION = "standard-1"


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << k for k, r in enumerate(rules)}
    return sum(bits[n] for n in dict.fromkeys(names))


def _covered(words: Column, n: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more.

    Windows are compared by their 64-bit hash: sorted with their positions, equal ones are
    neighbours.  A repeated window at p adds the words up to the next repeated window, three at most.
    """
    hashed = F.transform(
        F.slice(words, 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(let(F.sort_array(hashed), repeated), total)


def measurements(text: Column) -> Column:
    """The measurements of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.alias("n"), F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).alias("chars"), _covered(words, n).alias("covered"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("d"))

    words = let(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]")), of_lines)
    return let(F.struct(words.alias("w"), lines.alias("l")), lambda m: F.struct(
        m["w"]["n"].cast("long").alias("n_words"),
        m["w"]["chars"].cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("n_exclaims"),
        m["l"]["n"].cast("long").alias("n_lines"),
        (m["l"]["n"] - m["l"]["d"]).cast("long").alias("n_dup_lines"),
        m["w"]["covered"].cast("long").alias("n_repeat_words"),
    ))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: id, measurements and ``failed``, a long with bit k set if rule k fails."""
    measured = df.select(F.col(id_col).alias("doc_id"), measurements(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: str = PRODUCTION, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``policy`` and ``kept``: no bit of the policy's mask is set."""
    mask = F.lit(mask_of(policies[policy], rules)).cast("long")
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("failed").bitwiseAND(mask) == 0)


def ablation(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of each policy costs, from the ledger alone.

    The ledger is first reduced to its distinct failure masks (at most two to the number of
    rules), so the rules fan out over a few rows.  Per policy and rule: documents that fail it,
    that only it rejects, and the bits that ever failed beside it (a bitwise or).
    An empty ledger gives no rows.
    """
    masks = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit"), F.lit(mask_of(names, rules)).cast("long").alias("mask"))
             for p, names in policies.items() for k, r in enumerate(rules) if r.name in names]
    hit = F.col("failed").bitwiseAND(F.col("c.bit")) != 0
    inside = F.col("failed").bitwiseAND(F.col("c.mask"))
    return (masks.withColumn("c", F.explode(F.array(*cases)))
            .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(inside == F.col("c.bit"), F.col("n")).otherwise(0)).alias("n_only"),
                 F.sum(F.when(inside != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
                 F.bit_or(F.when(hit, F.col("failed")).otherwise(F.lit(0).cast("long"))).alias("bits_beside")))


def _failed_sql() -> str:
    return " | ".join(f"(CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END)" for k, r in enumerate(RULES))


SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM base),
wins AS (
  SELECT k, p, [words[p], words[p + 1], words[p + 2]] AS w
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS p FROM split)),
dup AS (
  SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, w) AS c FROM wins) WHERE c > 1),
cov AS (
  SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY k),
m AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclaims,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN cov USING (k)),
l AS (SELECT *, ({_failed_sql()})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {mask_of(BASE)}) <> 0 AS base_failed, (failed & {mask_of(POLICIES[PRODUCTION])}) = 0 AS kept, failed
FROM l
"""


@query("op5_quality_ledger", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0).alias("base_failed"), "kept", "failed")
