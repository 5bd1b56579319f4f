"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised and cut in parallel; only the histogram (at most ``capacity`` counts, whatever the
input) reaches the driver. There, best-fit decreasing runs over counts: all open sequences with equal room
are one entry, so thousands of equal documents are placed in one step. The plan says which ranks within a
length go to which slots; documents take their slot by joining on (length, rank).

Ranks within a length are numbered per chunk of documents and shifted by the chunks before, so a length
that most documents share is not sorted in one task.

Defined results: a null or empty text is the end token alone. Rows are packed one by one, also when they
repeat an id or it is null. An empty table gives an empty table. Texts of any length are tokenised whole; those with
runs of blanks too long for the fast encoder's pattern (about a million) are encoded by the tokenizers library.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlens.llm.common import slices, stored, table

CAPACITY = 2048
END = 0
#: The byte-level vocabulary as ranks, the pattern that splits text before its merges, and its special token.
#: Ids equal those of the same vocabulary in the tokenizers library, at a quarter of the CPU time.
RANKS = "byte_bpe_50k.tiktoken"
#: The same vocabulary for the tokenizers library.
VOCABULARY = "byte_bpe_50k.json"
SPECIAL = {"<|endoftext|>": 50256}

_encoders: dict = {}
_slow: list = []


def encoder(path: str | None = None):
    """The encoder of a rank file, loaded once per worker. ``path``: the file, by default the public one."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
    return _encoders[path]


def slow_ids(text: str) -> list[int]:
    """Ids of a text by the tokenizers library, loaded once per worker and only if a text needs it."""
    if not _slow:
        import public_tokenizers
        import tokenizers

        _slow.append(tokenizers.Tokenizer.from_file(public_tokenizers.path(VOCABULARY)))
    return _slow[0].encode(text, add_special_tokens=False).ids


def ids_of(text: str | None, path: str | None = None) -> np.ndarray:
    """Ids of a whole text (little-endian unsigned 32 bits) and the end id."""
    if not text:
        return np.array([END], "<u4")
    try:
        found = encoder(path).encode(text, allowed_special="all")
    except ValueError:
        # The pattern's backtracking ends at about a million blanks in a row. Another rank file has no such twin.
        if path is not None:
            raise
        found = slow_ids(text)
    found.append(END)
    return np.array(found, "<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def tokenise(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        for part in slices(batches):
            rows = defaultdict(list)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                ids = ids_of(text.as_py(), path)
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    values = (doc, k, start, length, zlib.crc32(own.tobytes())) + (own.astype("i4"),) * with_ids
                    for name, v in zip(schema.names, values):
                        rows[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, pieces in each, offset).

    A piece of rank r (first <= r < first + ranks) goes to sequence ``first sequence + (r - first) // each`` at
    ``offset + (r - first) % each * length``. Sequences with equal room are one entry of ``room``; each length
    takes the smallest room that holds it, so a step uses up an entry or ends the length.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                new = -(-left // (capacity // length))
                room[fit := capacity] = [(opened, new)]
                opened += new
            first, n = room[fit].pop()
            if not room[fit]:
                del room[fit]
            each = fit // length
            full = min(n, left // each)
            if not full:  # the last few share one sequence
                full, each = 1, left
            plan.append((length, rank, full * each, first, each, capacity - fit))
            rank += full * each
            left -= full * each
            if full < n:
                room[fit].append((first + full, n - full))
            if rest := fit - each * length:
                room[rest].append((first, full))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset`` (long)."""
    spark = pieces.sparkSession
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Stored once, for the histogram and the placing; ``length`` repeats within chunks only by chance.
    held = stored(pieces.withColumn("_pk_chunk", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(chunks))), "pieces")
    counts = held.groupBy("length", "_pk_chunk").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_slots(histogram, capacity)
    schema = "_pk_length int, _pk_rank long, _pk_ranks long, _pk_sequence long, _pk_each long, _pk_offset long"
    plan = spark.createDataFrame(rows, schema)
    # The plan is bounded by the capacity, not by the input; it is broadcast only while it is small indeed.
    plan = F.broadcast(plan) if len(rows) <= 200_000 else plan

    before = Window.partitionBy("length").orderBy("_pk_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "_pk_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pk_before"))
    own = Window.partitionBy("length", "_pk_chunk").orderBy("doc_id", "piece")
    ranked = held.withColumn("_pk_row", F.row_number().over(own) - 1).join(shift, ["length", "_pk_chunk"])
    ranked = ranked.withColumn("_pk_r", F.col("_pk_row") + F.col("_pk_before"))
    at = F.col("_pk_r") - F.col("_pk_rank")
    placed = ranked.join(plan, (F.col("length") == F.col("_pk_length")) & (at >= 0) & (at < F.col("_pk_ranks")))
    return placed.select(
        *pieces.columns,
        (F.col("_pk_sequence") + F.expr("(_pk_r - _pk_rank) div _pk_each")).alias("sequence_id"),
        (F.col("_pk_offset") + at % F.col("_pk_each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: a row per piece."""
    placed = pack(tokenise(docs, capacity, path, with_ids), capacity)
    return placed.withColumn("length", F.col("length").cast("long"))


def op1(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
