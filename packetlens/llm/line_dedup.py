"""Line de-duplication: lines that many documents share are dropped from every document.

Only DataFrame functions: lines are exploded, normalised and hashed; documents are counted per hash;
lines over the threshold are dropped and the rest reassembled by position.

Two hashes of 64 bits stand for a key, so no text is shuffled for the counts; partial counts combine before
the shuffle, so a line of a third of all documents is one row per task. The documents themselves are
shuffled once, to meet the positions they lose.

Defined results: every row is a document of its own, also when rows repeat a ``doc_id`` or it is null (rows
equal in ``doc_id`` and text lose the same lines). Null and empty texts are one empty line, whose key has no
code point and is never dropped. An empty table gives an empty table. Other columns are left alone; internal
columns carry a prefix (``_ld_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import BLANKS, ascii_lower, stored

MIN_DOCS = 10
MIN_CHARS = 1


def lines_of(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line) -> F.Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _pair(c) -> list[F.Column]:
    """128 bits for a text: two 64-bit hashes with different seeds."""
    return [F.xxhash64(c).alias("_ld_h1"), F.xxhash64(F.lit(20011), c).alias("_ld_h2")]


def frequent_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_ld_h1, _ld_h2, n_docs) of the keys found in at least ``min_docs`` documents.

    A key counts once per document: keys are made distinct inside each row before they are exploded.
    """
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    each = docs.select(F.explode(keys).alias("_ld_key")).filter(F.char_length("_ld_key") >= min_chars)
    counts = each.select(*_pair(F.col("_ld_key"))).groupBy("_ld_h1", "_ld_h2").agg(F.count("*").alias("n_docs"))
    return counts.filter(F.col("n_docs") >= min_docs)


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with ``text`` reassembled, plus ``_ld_n_lines`` and ``_ld_n_dropped`` (long)."""
    frequent = stored(frequent_keys(docs, min_docs, min_chars).select("_ld_h1", "_ld_h2"), "shared-lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    # The row's own hashes are taken before the explode, so its text doesn't travel with every line.
    rows = docs.select(
        F.col("doc_id").alias("_ld_doc"),
        F.xxhash64(text).alias("_ld_t1"),
        F.xxhash64(F.lit(20011), text).alias("_ld_t2"),
        lines_of(F.col("text")).alias("_ld_lines"),
    )
    each = rows.select("_ld_doc", "_ld_t1", "_ld_t2", F.posexplode("_ld_lines").alias("_ld_pos", "_ld_line"))
    stripped = each.withColumn("_ld_line", F.btrim("_ld_line", F.lit(BLANKS)))
    at = stripped.filter(F.char_length("_ld_line") >= min_chars).select(
        "_ld_doc", "_ld_t1", "_ld_t2", "_ld_pos", *_pair(ascii_lower(F.col("_ld_line")))
    )
    lost = at.join(frequent, ["_ld_h1", "_ld_h2"]).groupBy("_ld_doc", "_ld_t1", "_ld_t2")
    lost = lost.agg(F.collect_set("_ld_pos").alias("_ld_drop")).hint("shuffle_hash")
    joined = docs.join(
        lost,
        F.col("doc_id").eqNullSafe(F.col("_ld_doc"))
        & (F.xxhash64(text) == F.col("_ld_t1"))
        & (F.xxhash64(F.lit(20011), text) == F.col("_ld_t2")),
        "left",
    )
    lines = F.col("_ld_lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_drop"))
    new = F.when(F.col("_ld_drop").isNull(), F.array_join(lines, "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )
    split = joined.withColumn("_ld_lines", lines_of(F.col("text")))
    return split.select(
        *[new.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias("_ld_n_lines"),
        F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long").alias("_ld_n_dropped"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    from packetlens.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs).select(
        "doc_id",
        F.col("_ld_n_lines").alias("n_lines"),
        F.col("_ld_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
)
SELECT doc_id, count(*) AS n_lines, count(shared.key) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN shared.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN shared ON keyed.key = shared.key GROUP BY doc_id
"""
