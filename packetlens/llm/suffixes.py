"""Passages that repeat across documents, by hashes of sparse suffixes.

A passage is a run of ``LENGTH`` words or more; a word is repeated if it lies in a window of ``LENGTH`` words that
another document has too. The result is exactly the repeated words, as spans.

1. Of each document only suffixes at minimiser positions are kept: in every ``REACH`` neighbouring starts the one
   whose ``GRAM`` words hash lowest. The choice depends on the content only, so two documents that share a
   window keep the same suffix of it, with at least ``PREFIX = LENGTH - REACH + 1`` words of the window ahead.
2. Suffixes are grouped by their first ``PREFIX`` words (as a hash), in place of a sorted suffix array, and those with
   equal prefixes and different documents stay; Spark's aggregate and join do this, so a prefix that a third of all
   documents share is combined before the shuffle and split in the join. The rest of the corpus is done with.
3. Exact ends come from counting windows: a suffix that stays stands for a block, the windows whose
   minimiser it is. Blocks that another document has whole are repeated whole; of the others, the windows are
   compared one by one. No two documents are paired, so a group of copies costs no more than its rows.

Windows are compared as 64-bit hashes of the words; a block's hash covers all its windows.

Defined results: null and short texts have no span. Words are bytes between ASCII blanks, whole texts of any length.
Rows with a null id count as one document, and so do rows that repeat an id: what they share with each other
only is not repeated. Their texts have their spans each (``row`` is a hash of the text); rows equal in both have them once.
An empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlens.llm.common import slices, stored, table, words_of

LENGTH = 50
REACH = 35
GRAM = 8
PREFIX = LENGTH - REACH + 1

_BASE = 0x9E3779B97F4A7C15
_KNOWN_WORDS = 500_000
_known: dict[bytes, int] = {}
_powers: list[np.ndarray] = []


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > _KNOWN_WORDS:
        _known.clear()
    get, out = _known.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w, 7)
        out.append(h)
    return np.array(out, "u8")


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 4096)
        _powers[:] = [np.cumprod(np.full(size, np.uint64(b), "u8")) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of all runs of some length in a document, from one running sum."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.power, self.inverse = _power(self.n)
        self.sum = np.concatenate([np.zeros(1, "u8"), np.cumsum(word_hashes(words) * self.power)])

    def runs(self, length: int) -> np.ndarray:
        n = self.n - length + 1
        return _mixed((self.sum[length:] - self.sum[:n]) * self.inverse[:n])


def minimisers(rolling: Rolling) -> np.ndarray:
    """For every window of LENGTH words, the place of its minimiser."""
    windows = rolling.n - LENGTH + 1
    grams = rolling.runs(GRAM)[: windows + REACH - 1]
    return np.lib.stride_tricks.sliding_window_view(grams, REACH).argmin(1) + np.arange(windows)


def _suffixes(batches):
    """(key, doc_id, row, at) of the suffixes kept."""
    for part in slices(batches):
        keys, docs, rows, places = [], [], [], []
        for doc, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
            words = words_of(text.as_py())
            if len(words) < LENGTH:
                continue
            rolling = Rolling(words)
            at = np.unique(minimisers(rolling))
            keys.append(rolling.runs(PREFIX)[at])
            places.append(at.astype("i4"))
            docs += [doc] * len(at)
            rows += [row] * len(at)
        if docs:
            numbers = [pa.array(docs, pa.int64()), pa.array(rows, pa.int64())]
            arrays = [pa.array(np.concatenate(keys).view("i8")), *numbers, pa.array(np.concatenate(places))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "row", "at"])


BLOCK = "block long, doc_id long, row long, starts array<int>, windows array<long>"


def _blocks(batches):
    """Blocks of the kept suffixes (doc_id, row, text, at): the hashes of its windows and where the block starts."""
    for part in slices(batches):
        rows: list[tuple[int, int, int, list[int], np.ndarray]] = []
        for doc, row, text, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)):
            words = words_of(text.as_py())
            if len(words) < LENGTH:
                continue
            rolling = Rolling(words)
            chosen, windows = minimisers(rolling), rolling.runs(LENGTH)
            first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
            last = np.append(first[1:], len(chosen))
            mine: dict[bytes, list[int]] = {}
            for k in np.flatnonzero(np.isin(chosen[first], at.values.to_numpy())):
                mine.setdefault(windows[first[k] : last[k]].tobytes(), []).append(int(first[k]))
            for raw, starts in mine.items():
                own = np.frombuffer(raw, "i8")
                rows.append((xxhash.xxh64_intdigest(raw, len(own)) - (1 << 63), doc, row, starts, own))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(map(list, zip(*rows)), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "doc_id", "row", "starts", "windows"])


def _two_documents() -> list[F.Column]:
    return [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, end, n_words): maximal spans of repeated words of each document (doc_id, text), end excluded."""
    nobody = -(1 << 63)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nobody)).alias("doc_id"), F.xxhash64(text).alias("row"), "text")
    suffixes = stored(named.mapInArrow(_suffixes, "key long, doc_id long, row long, at int"), "suffixes")
    # Stored, so that both sides of the join are plain exchanges and a hot prefix is split there.
    shared = stored(suffixes.groupBy("key").agg(*_two_documents()).filter("low <> high").select("key"), "shared-keys")
    kept = suffixes.join(shared, "key", "left_semi").groupBy("doc_id", "row").agg(F.collect_set("at").alias("at"))

    found = named.join(kept.hint("shuffle_hash"), ["doc_id", "row"])
    blocks = stored(found.select("doc_id", "row", "text", "at").mapInArrow(_blocks, BLOCK), "blocks")
    once = stored(blocks.groupBy("block").agg(*_two_documents(), F.first("windows").alias("windows")), "block-groups")

    whole = once.filter("low <> high").select("block")
    starts = blocks.select("block", "doc_id", "row", F.explode("starts").alias("start"), F.size("windows").alias("n"))
    spans = starts.join(whole, "block").select("doc_id", "row", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("end"))

    each = once.select("low", "high", F.explode("windows").alias("window"))
    twice = each.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    twice = stored(twice.select("window"), "shared-windows")
    # A block that one document has alone may be in several of its rows.
    part = once.filter("low = high").select("block", F.posexplode("windows").alias("k", "window")).join(twice, "window")
    part = stored(part.select("block", "k"), "shared-parts")
    part = blocks.select("block", "doc_id", "row", "starts").join(part, "block")
    part = part.select("doc_id", "row", F.explode(F.transform("starts", lambda x: x + F.col("k"))).alias("start"))
    spans = spans.unionAll(part.select("doc_id", "row", "start", (F.col("start") + LENGTH).alias("end"))).distinct()
    return _merged(spans).withColumn("doc_id", F.when(F.col("doc_id") != nobody, F.col("doc_id")))


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a text as one. A text's spans are bounded by its own length."""
    order = Window.partitionBy("doc_id", "row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select("doc_id", "row", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))


def op10(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("row")


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, k AS start, md5(array_to_string(w[k + 1 : k + {LENGTH}], ' ')) AS win FROM d, unnest(range(len(w) - {LENGTH - 1})) AS r(k)
), shared AS (
  SELECT win FROM windows GROUP BY win HAVING min(doc_id) <> max(doc_id)
), marked AS (
  SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + {LENGTH} THEN 0 ELSE 1 END AS opens FROM windows SEMI JOIN shared USING (win)
), islands AS (
  SELECT doc_id, start, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM marked
)
SELECT doc_id, CAST(min(start) AS INT) AS start, CAST(max(start) + {LENGTH} AS INT) AS "end", CAST(max(start) + {LENGTH} - min(start) AS INT) AS n_words FROM islands GROUP BY doc_id, island
"""
