"""Exact selections by rank when the selection itself is large."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens.session import cut_lineage, shuffled_once, write_once


def with_row_rank(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``row_rank`` (0-based) in a total order, without a single-task sort.

    The rows are range-partitioned and sorted, then written to the checkpoint folder: the
    partition boundaries come from a sample, so they must not be drawn again when a lost
    task is repeated. Ranks are the position in the partition plus the sizes of the
    partitions before it (one row per partition). ``order`` must break all ties.
    """
    placed = cut_lineage(
        df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ).withColumns({"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition of the sort, so this window and the broadcast are small by construction.
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("row_rank", F.col("_before") + F.col("_pos"))
        .drop("_id", "_part", "_pos", "_before")
    )


#: Tied rows that are stored and ranked; of more, the next column's counts are taken first.
_FEW_TIES = 1_000_000


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows (``row_count``) of each value of a column, written once."""
    return write_once(df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count")), "counts")


def _rows_in(counts: DataFrame) -> int:
    return counts.agg(F.sum("row_count")).first()[0] or 0


def _last_value(counts: DataFrame, column: str, descending: bool, wanted: int) -> tuple[object, int, int]:
    """The value that holds the row number ``wanted`` (from 1) in order, the rows before that value, and its rows."""
    order = F.col(column).desc() if descending else F.col(column).asc()
    placed = cut_lineage(counts.orderBy(order).withColumn("_part", F.spark_partition_id()))
    before = 0
    # One row per partition of the sort.
    for part, size in sorted(placed.groupBy("_part").agg(F.sum("row_count")).collect()):
        if before + size >= wanted:
            break
        before += size
    upto = F.sum("row_count").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    here = placed.where(F.col("_part") == part).withColumn("_upto", upto)
    last = here.where(F.col("_upto") >= wanted - before).orderBy("_upto").first()
    return last[column], before + last["_upto"] - last["row_count"], last["row_count"]


def _stands_before(column: Column, value: Column, descending: bool) -> Column:
    """Whether a column comes before a value; null is the last of descending and the first of ascending values."""
    if descending:
        return F.coalesce(column > value, column.isNotNull() & value.isNull())
    return F.coalesce(column < value, column.isNull() & value.isNotNull())


def extreme_share(
    df: DataFrame,
    value: str,
    tie_break: Sequence[str],
    share: float,
    largest: bool = True,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The top (or bottom) share of rows by ``value``: ``max(1, floor(n * share))`` rows, exactly.

    No row moves for its rank. Rows are counted per value, and the counts (``counts``, if there already) tell in which
    value the share ends. That value's rows are counted per value of the first tie-break column, and so on until few
    rows are tied; only these are stored and ranked.
    """
    df = shuffled_once(df)
    counts = value_counts(df, value) if counts is None else counts
    total = _rows_in(counts)
    wanted = max(1, math.floor(total * share))
    if wanted >= total:
        return df
    inside, tied = F.lit(False), F.lit(True)
    for column, descending in [(value, largest), *[(c, False) for c in tie_break]]:
        counts = value_counts(df.where(tied), column) if counts is None else counts
        found, before, rows = _last_value(counts, column, descending, wanted)
        last, counts, wanted = F.lit(found).cast(df.schema[column].dataType), None, wanted - before
        inside = inside | (tied & _stands_before(F.col(column), last, descending))
        tied = tied & F.col(column).eqNullSafe(last)
        if rows == wanted:
            return df.where(inside | tied)
        if rows <= _FEW_TIES:
            break
    ranked = with_row_rank(write_once(df.where(tied), "tied"), [F.col(c).asc() for c in tie_break])
    return df.where(inside).unionByName(ranked.where(F.col("row_rank") < wanted).drop("row_rank"))


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """A small top-n report; Spark keeps n rows per task and merges them."""
    return df.orderBy(*order).limit(n)


#: Spark keeps at most this many rows a key in every task before a shuffle for a window's rank.
_PRUNED_RANKS = 1000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key. The rank bound is applied in every task before the shuffle.

    Spark does so up to 1,000 rows a key; above that a hot key would be sorted in one task, so :func:`ranked_per_key`
    takes over, for which ``order`` must break all ties that matter.
    """
    if n > _PRUNED_RANKS:
        return ranked_per_key(df, keys, order).where(F.col("key_rank") <= n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("key_rank", rank).where(F.col("key_rank") <= n)


def ranked_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds ``key_rank`` (from 1) of every row within its key; a key's rows may lie in many tasks.

    Rows are ranked over all keys, by key and then ``order``, in range partitions. A key's first rank, one row per
    key that combines before its shuffle, is taken off. Null keys are keys like others.
    """
    ranked = with_row_rank(df, [*map(F.col, keys), *order])
    first = ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("row_rank").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    placed = ranked.join(first, same)
    return placed.withColumn("key_rank", F.col("row_rank") - F.col("_first") + 1).select(*df.columns, "key_rank")
