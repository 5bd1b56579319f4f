"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit, policies are masks.

``ledger`` adds the measurements and ``failed`` (a bit per rule). A policy is a named, versioned set of rules;
applying one is a bitwise test, and its ablations (what each rule removes alone, what would stay without it)
come from counts per distinct bit pattern, of which there are at most 2**len(RULES) whatever the input.

Defined results: a null or empty text has no words, all counts are 0 and it fails ``few_words``. Texts of any
length are measured whole, in Arrow batches, one text at a time. Rows are independent: repeated rows, null or
repeated ids and other columns pass through; an empty table gives an empty table. Added columns carry a
prefix (``_q_``), so they clash with none of the input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import SLICE_ROWS, table, words_of

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words", "n_bangs", "n_stutters")
_TYPE = pa.struct([(m, pa.int64()) for m in MEASURES])
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_BLANKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Fails where ``failed`` (SQL over the measurements) holds. The bit is the rule's place in RULES, for good."""

    name: str
    failed: str


#: Append only: ledgers that were stored keep their meaning. Shares are whole-number tests, without division.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("shouting", "100 * n_caps_words > 60 * n_words"),
    Rule("exclamations", "100 * n_bangs > 30 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("stutter", "100 * n_stutters > 30 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Versioned policies: which rules reject a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": tuple(BIT),
}
DEFAULT = "full-1"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in some window of ``size`` words which occurs twice or more, each word counted once."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(size))))
    if len(set(windows)) == n:
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    covered = until = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + size - max(i, until)
            until = i + size
    return covered


def duplicate_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    if len(lines) == len(set(lines)):
        return 0
    seen: set = set()
    return sum(bool(words_of(x)) and (x in seen or bool(seen.add(x))) for x in lines)


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, _BLANKS))),
        len(raw.translate(None, _NOT_SYMBOLS)),
        len(lines),
        duplicate_lines(lines),
        repeated_words(words),
        sum(map(bytes.isupper, words)),
        raw.count(b"!"),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def _measure_all(texts: pa.Array) -> pa.Array:
    out: list = []
    for at in range(0, len(texts), SLICE_ROWS):
        out += [dict(zip(MEASURES, measure(t.as_py()))) for t in texts.slice(at, SLICE_ROWS)]
    return pa.array(out, _TYPE)


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q_<measure>`` (long) and ``_q_failed`` (long, a bit per rule)."""
    kind = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"
    # Marked as not deterministic so that a filter on the result doesn't evaluate it a second time.
    run = F.arrow_udf(_measure_all, kind).asNondeterministic()
    measured = docs.withColumn("_q_m", run(F.col("text")))
    columns = {f"_q_{m}": F.col(f"_q_m.{m}") for m in MEASURES}
    flat = measured.withColumns(columns).drop("_q_m")
    bits = None
    for name, bit in BIT.items():
        failed = F.expr(_prefixed(next(r.failed for r in RULES if r.name == name)))
        one = F.when(failed, F.lit(bit)).otherwise(F.lit(0)).cast("long")
        bits = one if bits is None else bits.bitwiseOR(one)
    return flat.withColumn("_q_failed", bits)


def _prefixed(sql: str) -> str:
    return re.sub(rf"\b({'|'.join(MEASURES)})\b", r"_q_\1", sql)


def mask_of(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def passes(policy: str = DEFAULT, failed="_q_failed") -> F.Column:
    return F.col(failed).bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(ledger_rows: DataFrame, policies=tuple(POLICIES)) -> DataFrame:
    """(policy, rule, n_docs, n_kept, n_kept_without, n_only) per rule of each policy, from bit patterns.

    ``n_only`` documents fail this rule and no other of the policy; without the rule they would stay.
    """
    patterns = ledger_rows.groupBy(F.col("_q_failed").alias("failed")).agg(F.count("*").alias("n"))
    rules = [(p, r, mask_of(p), BIT[r]) for p in policies for r in POLICIES[p]]
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("policy", "rule", "mask", "bit"), x)]) for x in rules])
    each = patterns.select("failed", "n", F.explode(listed).alias("r")).select("failed", "n", "r.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(hit == 0).alias("n_kept"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        total(hit == F.col("bit")).alias("n_only"),
    )


def keep_good(docs: DataFrame, policy: str = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    return ledger(docs).filter(passes(policy)).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        *[F.col(f"_q_{m}").alias(m) for m in MEASURES],
        (~passes("base-1")).alias("base_failed"),
        passes(DEFAULT).alias("kept"),
        F.col("_q_failed").alias("failed_bits"),
    )


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs and what it alone rejects, over all documents."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("text")))


_BITS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), windows AS (
  SELECT doc_id, pos, word, lead(word, 4) OVER o AS last, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS win,
    word = lead(word) OVER o AS stutters FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), again AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows WHERE last IS NOT NULL
), repeats AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM again, range(5) AS r(k) WHERE n > 1 GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]')) AS n_caps_words,
    count(*) FILTER (stutters) AS n_stutters FROM windows GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), marked AS (
  SELECT doc_id, regexp_matches(line, '[^\x20\x09-\x0D]') AND row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup FROM lines
), dups AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines FROM marked GROUP BY doc_id
), m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    CASE WHEN text = '' THEN 0 ELSE n_lines END AS n_lines, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_caps_words, 0) AS n_caps_words,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, coalesce(n_stutters, 0) AS n_stutters
  FROM d JOIN dups USING (doc_id) LEFT JOIN counted USING (doc_id) LEFT JOIN repeats USING (doc_id)
), bits AS (
  SELECT *, CAST(""" + " + ".join(f"CASE WHEN {r.failed} THEN {BIT[r.name]} ELSE 0 END" for r in RULES) + r""" AS BIGINT) AS failed_bits FROM m
)"""

OP2_SQL = f"""{_BITS_SQL}
SELECT doc_id, {", ".join(MEASURES)}, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM bits
"""

RULE_ABLATIONS_SQL = f"""{_BITS_SQL}, r(policy, rule, mask, bit) AS (
  VALUES {", ".join(f"('{p}', '{r}', {mask_of(p)}, {BIT[r]})" for p in POLICIES for r in POLICIES[p])}
)
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (failed_bits & mask = 0) AS n_kept,
  count(*) FILTER (failed_bits & mask & (mask - bit) = 0) AS n_kept_without, count(*) FILTER (failed_bits & mask = bit) AS n_only
FROM bits, r GROUP BY policy, rule
"""
