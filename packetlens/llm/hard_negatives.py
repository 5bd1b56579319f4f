"""Hard-negative mining by segment summaries.

Each vector is cut into segments, in 1, 2, 4, ... ``SEGMENTS`` parts, and of every segment mean and deviation are stored. With
means m, k and deviations s, t of a segment of d components of two vectors, the segment's part of their product lies in
``d * (m * k - s * t)`` to ``d * (m * k + s * t)``. The sums over the segments bound the score: from one segment to all,
each level is taken only for rows that the levels before left open, and the exact product only for rows that the last
left open. Nothing else is dropped, so the results are exact; a level costs 4 products a segment where a score costs one
a component.

Anchors are a stated query set. They are taken in blocks of at most ``anchors_per_block`` rows, each broadcast (a bounded
size) and held against all rows in batches. A task keeps, for an anchor, the few best rows it has seen, which raise the
bound to beat; these few rows a task are all that shuffles. Two passes: positives first, then the negatives between the limits
that each positive sets.

Scores are products of whole numbers: a component counts as ``floor(scale * x)``. Higher scores come first, ties by smaller id.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no part. Vectors of
different lengths have no score. A null id is no anchor and comes last among ties. Rows with the anchor's own id are not
its partners; rows that repeat another id are partners each, and equal anchor rows count once. Scores beyond 64 bits
are computed exactly and returned as the nearest 64-bit number. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import stored, table, to_batch
from packetlens.operators.ranking import top_per_key

SEGMENTS = 8
SCALE = 256
TOP = 5
ANCHORS_PER_BLOCK = 50_000
#: Anchors and rows that are compared at a time.
ANCHOR_TILE, ROW_TILE = 512, 2048
#: Of products below this, sums in doubles are exact.
EXACT = 2.0**53
NO_ID = 2**63 - 1
_SCHEMA = "vec_id long, label long, size int, vector binary, mean binary, deviation binary"


def levels_of(size: int) -> list[np.ndarray]:
    """Segment borders per level: 1, 2, 4, ... parts, at most one a component."""
    parts, out = 1, []
    while parts <= min(SEGMENTS, size):
        out.append(np.linspace(0, size, parts + 1).astype(int))
        parts *= 2
    return out


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of every level, side by side."""
    means, deviations = [], []
    for borders in levels_of(vectors.shape[1]):
        for a, b in zip(borders[:-1], borders[1:]):
            means.append(vectors[:, a:b].mean(axis=1))
            deviations.append(vectors[:, a:b].std(axis=1))
    if not means:
        return np.zeros((len(vectors), 0)), np.zeros((len(vectors), 0))
    return np.stack(means, axis=1), np.stack(deviations, axis=1)


def _prepare(scale: int):
    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.r_[0, np.cumsum(sizes)]
            whole = np.isfinite(flat)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                place = starts[at][:, None] + np.arange(size)
                at, place = at[whole[place].all(axis=1)], place[whole[place].all(axis=1)]
                if not len(at):
                    continue
                with np.errstate(over="ignore"):
                    vectors = np.floor(scale * flat[place])
                mean, deviation = summaries(vectors)
                yield to_batch(
                    {
                        "vec_id": ([ids[i] for i in at], pa.int64()),
                        "label": ([labels[i] for i in at], pa.int64()),
                        "size": ([size] * len(at), pa.int32()),
                        "vector": ([v.tobytes() for v in vectors], pa.binary()),
                        "mean": ([v.tobytes() for v in mean], pa.binary()),
                        "deviation": ([v.tobytes() for v in deviation], pa.binary()),
                    }
                )

    return run


def summarise(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, size, vector, mean, deviation) of the rows that take part, stored. Vectors are whole numbers in doubles."""
    usable = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    usable = usable.filter(~F.exists("vector", lambda x: x.isNull()))
    return stored(usable.mapInArrow(_prepare(scale), _SCHEMA), "vector-summaries")


class Vectors:
    """Some rows of one length: vectors and what their summaries bound."""

    def __init__(self, ids, labels, size: int, vectors, means, deviations):
        self.ids, self.labels, self.size = np.asarray(ids, np.int64), np.asarray(labels, np.int64), size
        n = len(self.ids)
        self.vectors = np.frombuffer(b"".join(vectors)).reshape(n, size)
        self.largest = np.abs(self.vectors).max(initial=0.0)
        mean = np.frombuffer(b"".join(means)).reshape(n, -1)
        deviation = np.frombuffer(b"".join(deviations)).reshape(n, -1)
        self.levels, at = [], 0
        for borders in levels_of(size):
            width = np.sqrt(np.diff(borders))
            self.levels.append((mean[:, at : at + len(width)] * width, deviation[:, at : at + len(width)] * width))
            at += len(width)

    def part(self, rows) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.labels, out.size, out.largest = self.ids[rows], self.labels[rows], self.size, self.largest
        out.vectors, out.levels = self.vectors[rows], [(m[rows], s[rows]) for m, s in self.levels]
        return out

    def bounds(self, level: int, rows: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores with ``rows``, with room for rounding."""
        (m, s), (k, t) = self.levels[level], rows.levels[level]
        middle, spread = m @ k.T, s @ t.T
        spread += 1e-9 * (np.abs(m) @ np.abs(k).T + spread) + 1e-6
        return middle - spread, middle + spread

    def scores(self, rows: Vectors) -> np.ndarray:
        """Exact products; whole numbers of any size where doubles would round."""
        if self.size * self.largest * rows.largest < EXACT:
            return self.vectors @ rows.vectors.T
        whole = [np.array([[int(x) for x in v] for v in y.vectors], object).reshape(-1, self.size) for y in (self, rows)]
        return whole[0] @ whole[1].T if self.size else np.zeros((len(self.ids), len(rows.ids)))


def _by_size(batch, step: int):
    """Rows of a batch as Vectors, in tiles of one length."""
    columns = batch.to_pydict()
    sizes = np.asarray(columns["size"])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        for i in range(0, len(at), step):
            rows = at[i : i + step].tolist()
            pick = lambda name: [columns[name][r] for r in rows]  # noqa: B023, E731
            ids = [NO_ID if x is None else x for x in pick("vec_id")]
            yield Vectors(ids, pick("label"), size, pick("vector"), pick("mean"), pick("deviation")), rows


class Best:
    """The ``top`` best (score, id) seen of each of some queries."""

    def __init__(self, top: int):
        self.top, self.of = top, {}

    def bound(self, query: int, least: float = -np.inf) -> float:
        held = self.of.get(query, ())
        return max(least, -held[-1][0]) if len(held) == self.top else least

    def add(self, query: int, scores, ids) -> None:
        if len(ids) > 4 * self.top:
            # Only rows that reach the best scores of this lot can stay; ties are all kept until sorted.
            cut = np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        found = [(-int(s), int(i)) for s, i in zip(scores, ids)]
        self.of[query] = sorted([*self.of.get(query, []), *found])[: self.top]


def survivors(anchors: Vectors, rows: Vectors, allowed, low, high):
    """(open pairs, columns they are in) after all levels: scores in ``low`` to ``high`` are possible there."""
    columns = np.flatnonzero(allowed.any(axis=0))
    mask = allowed[:, columns]
    for level in range(len(anchors.levels)):
        if not len(columns):
            break
        below, above = anchors.bounds(level, rows.part(columns))
        mask = mask & (above >= low[:, None]) & (below <= high[:, None])
        left = mask.any(axis=0)
        columns, mask = columns[left], mask[:, left]
    return mask, columns


def weight(score: int) -> bytes:
    """A score of any size in bytes that sort as the scores do: products of floats stay below 2 ** 319."""
    return (score + (1 << 319)).to_bytes(40, "big")


def unweighted(order: bytes) -> int:
    return int.from_bytes(order, "big") - (1 << 319)


def _search(tiles, limits, top: int, same_label: bool):
    """For each query (anchor row, positive) the best rows of a task. ``limits`` has (query, low, high) per anchor row."""

    def run(batches):
        best = Best(top)
        for batch in batches:
            for rows, _ in _by_size(batch, ROW_TILE):
                for anchors, numbers in tiles.value:
                    if anchors.size == rows.size:
                        _compare(anchors, numbers, rows, limits.value, best, same_label)
        queries = list(best.of)
        out = [(q, -s, i) for q in queries for s, i in best.of[q]]
        for at in range(0, len(out), 10_000):
            part = out[at : at + 10_000]
            yield to_batch(
                {
                    "query": ([q for q, _, _ in part], pa.int64()),
                    "weight": ([weight(s) for _, s, _ in part], pa.binary()),
                    "score": ([max(-(2**63), min(2**63 - 1, s)) for _, s, _ in part], pa.int64()),
                    "partner": ([i for _, _, i in part], pa.int64()),
                }
            )

    return run


def _compare(anchors: Vectors, numbers, rows: Vectors, limits, best: Best, same_label: bool) -> None:
    queries = [limits.get(n, ()) for n in numbers]
    lowest = np.array([min((best.bound(q, low) for q, low, _ in qs), default=np.inf) for qs in queries])
    highest = np.array([max((high for _, _, high in qs), default=-np.inf) for qs in queries])
    same = anchors.labels[:, None] == rows.labels[None, :]
    other = (anchors.ids[:, None] != rows.ids[None, :]) | (rows.ids == NO_ID)[None, :]
    mask, columns = survivors(anchors, rows, other & (same if same_label else ~same), lowest, highest)
    lines = np.flatnonzero(mask.any(axis=1))
    if not len(lines):
        return
    scores = anchors.part(lines).scores(rows.part(columns))
    ids = rows.ids[columns]
    for line, at in enumerate(lines.tolist()):
        found, of = scores[line][mask[at]], ids[mask[at]]
        for query, low, high in queries[at]:
            fits = (found >= best.bound(query, low)) & (found <= high)
            if fits.any():
                best.add(query, found[fits], of[fits])


_FOUND = "query long, weight binary, score long, partner long"


def _best_of_all(rows: DataFrame, tiles, limits: dict, top: int, same_label: bool) -> DataFrame:
    spark = rows.sparkSession
    found = rows.mapInArrow(_search(tiles, spark.sparkContext.broadcast(limits), top, same_label), _FOUND)
    return top_per_key(found, ["query"], [F.col("weight").desc(), F.col("partner").asc()], top)


def _block_of_anchors(rows: DataFrame, number: int) -> tuple[list, dict[int, int]]:
    """The anchors of a block as tiles of (Vectors, their numbers), and the id of each number."""
    held = rows.filter(F.col("_hn_block") == number).toArrow()
    tiles, ids = [], {}
    for batch in held.combine_chunks().to_batches():
        for vectors, at in _by_size(batch, ANCHOR_TILE):
            numbers = [len(ids) + i for i in range(len(at))]
            ids.update(zip(numbers, vectors.ids.tolist()))
            tiles.append((vectors, numbers))
    return tiles, ids


def mine(
    summary: DataFrame, anchor, top: int = TOP, low: int = 80, high: int = 100, anchors_per_block: int = ANCHORS_PER_BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``summary`` with ``anchor``.

    Positives are an anchor's ``top`` best rows of its label; a positive's negatives the ``top`` best rows of
    other labels with ``low * positive <= 100 * negative <= high * positive``.
    """
    spark = summary.sparkSession
    # Rows are distinct, so their hash deals them evenly to the blocks.
    distinct = stored(summary.filter(anchor & F.col("vec_id").isNotNull()).distinct(), "anchors")
    blocks = max(1, -(-distinct.count() // anchors_per_block))
    numbered = stored(
        distinct.withColumn("_hn_block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks))), "anchors"
    )
    out = None
    for number in range(blocks):
        tiles, ids = _block_of_anchors(numbered, number)
        sent = spark.sparkContext.broadcast(tiles)
        everything = {n: [(n, -np.inf, np.inf)] for n in ids}
        positives = _best_of_all(summary, sent, everything, top, True).collect()
        # A positive's query is its anchor's number and its rank; the limits are whole numbers, rounded inwards.
        limits, named = {}, []
        for r in positives:
            score, query = unweighted(r["weight"]), r["query"] * top + r["key_rank"] - 1
            limits.setdefault(r["query"], []).append((query, -(-low * score // 100), high * score // 100))
            named.append((query, ids[r["query"]], r["partner"], r["score"]))
        schema = "query long, anchor_id long, positive_id long, positive_score long"
        pairs = spark.createDataFrame(named, schema)
        found = _best_of_all(summary, sent, limits, top, False).join(F.broadcast(pairs), "query")
        mined = stored(
            found.select(
                "anchor_id",
                F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"),
                F.col("key_rank").cast("int").alias("rank"),
                F.nullif("partner", F.lit(NO_ID)).alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            ),
            "hard-negatives",
        )
        sent.unpersist()
        out = mined if out is None else out.unionAll(mined)
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    summary = summarise(raw.withColumn("label", moved))
    return mine(summary, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, t.vec_id AS other_id, a.label = t.label AS same, CAST(list_inner_product(a.v, t.v) AS BIGINT) AS score
  FROM t a JOIN t ON a.vec_id % 100 = 0 AND a.vec_id <> t.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""
