"""Exact de-duplication: two passes over a Bloom filter find the rows that may be repeated; only those shuffle.

Texts are equal when they are identical without the blanks ``[\\x20\\x09-\\x0D]``; SHA-256 of what is left stands for them.
The texts are read once, into a narrow table of keys (digest, code points, id, a number for the row).

* Pass one: every task adds its digests to a filter that tells slots hit by one digest from slots hit twice, and hands on
  the slots it touched. They are merged per shard of the filter, so no filter of the whole corpus is ever in one place. A
  digest that occurs twice has all its slots hit twice, so none is missed.
* Pass two: rows whose slots were not all hit twice are the only ones of their text and pass straight through. The rest
  are counted by digest (partial counts combine before the shuffle) and meet their group's result by a join.

The second pass broadcasts the filter in sweeps of at most ``max_filter_bytes`` (one sweep for ``8 * max_filter_bytes /
SLOTS_PER_ROW`` rows); a sweep reads its range of hashes, which the key files are sorted by. About one row in thirty
shuffles without being repeated.

Of equal texts the row with the most code points stays, then the one with the smallest id (null last); of rows equal in
both exactly one stays. Defined results: null texts are empty, and all texts of blanks alone are equal. A null ``doc_id``
can be a ``keep_id``. Very long texts are hashed whole. An empty table gives an empty table. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packetlens.llm.common import BLANKS, slices, stored, table

SLOTS_PER_ROW = 8
HASHES = 3
#: Slots of a shard of the filter: 2 ** 16, a bitmap of 8 KiB for 8,192 rows.
SHARD_BITS = 16
MAX_FILTER_BYTES = 128 << 20
#: Rows of a task whose slots are handed on together.
CHUNK_ROWS = 200_000

_BLANK_BYTES = BLANKS.encode()
_DIGEST, _H, _CHARS, _ROW, _MAYBE = "_xd_digest", "_xd_h", "_xd_chars", "_xd_row", "_xd_maybe"


def digest_of(text: bytes | None) -> bytes:
    return hashlib.sha256((text or b"").translate(None, _BLANK_BYTES)).digest()


def _with_digest(batches):
    for batch in batches:
        for part in slices([batch]):
            texts = part.column(part.num_columns - 1)
            digests = [digest_of(t.as_py()) for t in texts]
            heads = np.frombuffer(b"".join(d[:8] for d in digests), ">u8") >> 2
            columns = [*part.columns[:-1], pa.array(digests, pa.binary()), pa.array(heads.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], _DIGEST, _H])


def with_digests(docs: DataFrame) -> DataFrame:
    """``docs`` with the digest of the normalised text, its first 62 bits as a number, and the text's code points."""
    chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias(_CHARS)
    rows = docs.select("*", chars, F.col("text").cast("binary").alias(_DIGEST))
    return rows.mapInArrow(_with_digest, StructType([*rows.schema.fields]).add(_H, "long"))


def keys_of(docs: DataFrame) -> DataFrame:
    """The narrow table of keys, stored. Files are sorted by hash, so that a sweep can skip what it doesn't need."""
    keys = with_digests(docs.select("doc_id", "text")).drop("text").sortWithinPartitions(_H)
    return stored(keys.withColumn(_ROW, F.monotonically_increasing_id()), "dedup-keys")


def _digests(batch) -> np.ndarray:
    """Digests as rows of four big-endian 64-bit numbers."""
    column = batch.column(_DIGEST)
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)


def _slots(digests: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each digest (ascending with its first bits) and its slots there."""
    shard = ((digests[:, 0] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    at = [(digests[:, 1] >> np.uint64(SHARD_BITS * i)) & np.uint64((1 << SHARD_BITS) - 1) for i in range(HASHES)]
    return shard.astype(np.int64), np.stack(at, axis=1).astype(np.int64)


def _hits(digests: np.ndarray, shards: int):
    """(shard, slots hit, whether twice) of some digests, one entry per shard."""
    distinct, n = np.unique(digests[:, :2], axis=0, return_counts=True)
    shard, slots = _slots(distinct, shards)
    # A digest's own slots may coincide; that is one hit.
    own = np.sort(slots, axis=1)
    first = np.ones(own.shape, bool)
    first[:, 1:] = own[:, 1:] != own[:, :-1]
    places = ((shard[:, None] << SHARD_BITS) | own)[first]
    weight = np.broadcast_to(np.minimum(n, 2)[:, None], own.shape)[first]
    order = np.argsort(places, kind="stable")
    places, weight = places[order], weight[order]
    starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    twice, places = np.add.reduceat(weight, starts) >= 2, places[starts]
    ends = np.r_[np.flatnonzero(np.diff(places >> SHARD_BITS)) + 1, len(places)]
    begin = 0
    for end in ends:
        slot = (places[begin:end] & ((1 << SHARD_BITS) - 1)).astype("<u2")
        yield int(places[begin] >> SHARD_BITS), slot.tobytes(), twice[begin:end].tobytes()
        begin = end


def _partial_filter(shards: int):
    def run(batches):
        def flush(held):
            found = list(_hits(np.concatenate(held), shards))
            columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "slots", "twice"])

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_digests(batch))
                rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def _merge_shard(group: pa.Table) -> pa.Table:
    hits = np.zeros(1 << SHARD_BITS, np.uint8)
    for slots, twice in zip(group.column("slots"), group.column("twice")):
        at = np.frombuffer(slots.as_py(), "<u2")
        hits[at] = np.minimum(hits[at] + 1 + np.frombuffer(twice.as_py(), bool), 2)
    bits = np.packbits(hits >= 2).tobytes()
    return pa.table({"shard": group.column("shard")[:1].cast(pa.int64()), "bits": pa.array([bits], pa.binary())})


def repeated_filter(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, bits): the slots that were hit twice, of each shard that has rows."""
    hits = keys.select(_DIGEST).mapInArrow(_partial_filter(shards), "shard long, slots binary, twice binary")
    return stored(hits.groupBy("shard").applyInArrow(_merge_shard, "shard long, bits binary"), "dedup-filter")


def _mark(bits, first: int, shards: int):
    """Adds to each batch whether all slots of a row's digest were hit twice."""

    def run(batches):
        words = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            shard, slots = _slots(_digests(batch), shards)
            at = ((shard - first)[:, None] << SHARD_BITS) + slots
            hit = (words[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            columns = [*batch.columns, pa.array(hit.all(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, _MAYBE])

    return run


def _marked(rows: DataFrame, filters: DataFrame, first: int, count: int, shards: int) -> DataFrame:
    """``rows`` of the shards from ``first`` on, marked by a broadcast of those shards."""
    size = (1 << SHARD_BITS) >> 3
    words = np.zeros((count, size), np.uint8)
    for r in filters.filter((F.col("shard") >= first) & (F.col("shard") < first + count)).toLocalIterator():
        words[r["shard"] - first] = np.frombuffer(r["bits"], np.uint8)
    bits = rows.sparkSession.sparkContext.broadcast(words.tobytes())
    return rows.mapInArrow(_mark(bits, first, shards), StructType([*rows.schema.fields]).add(_MAYBE, "boolean"))


def _first_hash(shard: int, shards: int) -> int:
    """The smallest 62-bit head that belongs to ``shard``."""
    return -(-(shard << 32) // shards) << 30


class Repeats:
    """The keys of a table, the filter over them, and the groups of equal texts that it led to."""

    def __init__(self, docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES):
        self.keys = keys_of(docs)
        self.shards = max(1, -(-self.keys.count() * SLOTS_PER_ROW >> SHARD_BITS))
        self.filters = repeated_filter(self.keys, self.shards)
        step = max(1, (max_filter_bytes << 3) >> SHARD_BITS)
        sweeps = []
        for first in range(0, self.shards, step):
            count = min(step, self.shards - first)
            low, high = _first_hash(first, self.shards), _first_hash(first + count, self.shards)
            rows = self.keys.filter((F.col(_H) >= low) & (F.col(_H) < high))
            sweep = _marked(rows, self.filters, first, count, self.shards)
            # One sweep is marked as it is read; of several each is written, so that one filter is held at a time.
            sweeps.append(sweep if count == self.shards else stored(sweep, "dedup-sweep"))
        self.marked = reduce(DataFrame.unionAll, sweeps)
        self.one_sweep = len(sweeps) == 1
        best = F.min(F.struct(-F.col(_CHARS), F.col("doc_id").isNull(), F.col("doc_id"), F.col(_ROW)))
        groups = self.marked.filter(_MAYBE).groupBy(_DIGEST).agg(F.count("*").alias("n"), best.alias("best"))
        self.groups = stored(
            groups.filter("n > 1").select(
                F.col(_DIGEST).alias("_xd_group"),
                F.col("n").alias("_xd_n"),
                (-F.col("best.col1")).alias("_xd_best_chars"),
                F.col("best.doc_id").alias("_xd_keep_id"),
                F.col(f"best.{_ROW}").alias("_xd_keep_row"),
            ),
            "dedup-groups",
        )


def exact_duplicates(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    found = Repeats(docs, max_filter_bytes)
    sha = F.lower(F.hex(_DIGEST)).alias("text_sha256")
    alone = found.marked.filter(f"not {_MAYBE}").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    maybe = found.marked.filter(_MAYBE).join(found.groups, F.col(_DIGEST) == F.col("_xd_group"), "left")
    single = F.col("_xd_n").isNull()
    met = maybe.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("_xd_keep_id")).alias("keep_id"),
        F.coalesce("_xd_n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col(_ROW) == F.col("_xd_keep_row"))).alias("kept"),
        sha,
    )
    return alone.unionAll(met)


def drop_copies(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """All columns of the documents that stay. Rows that the filter passes don't move; the others are joined.

    Tables that take several sweeps have no filter to broadcast whole; all their rows are joined then.
    """
    found = Repeats(docs, max_filter_bytes)
    rows = with_digests(docs)
    if found.one_sweep:
        rows = _marked(rows, found.filters, 0, found.shards, found.shards)
    else:
        rows = rows.withColumn(_MAYBE, F.lit(True))
    rows = rows.drop(_H)
    alone = rows.filter(f"not {_MAYBE}").select(*docs.columns)
    maybe = rows.filter(_MAYBE).join(found.groups, F.col(_DIGEST) == F.col("_xd_group"), "left")
    single = F.col("_xd_n").isNull()
    best = (F.col(_CHARS) == F.col("_xd_best_chars")) & F.col("doc_id").eqNullSafe(F.col("_xd_keep_id"))
    # Rows equal to the one that stays in text size and id are told apart by nothing: one of them is taken.
    same = maybe.filter(~single & best).dropDuplicates([_DIGEST])
    return alone.unionAll(maybe.filter(single).select(*docs.columns)).unionAll(same.select(*docs.columns))


def op11(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""
