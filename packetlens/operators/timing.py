"""Gaps between events and sliding counts, safe for hot keys and for bursts.

A plain ``lag`` window over one key would sort a whole hot key in one task, and one over a minute a whole burst. Here equal
times are combined first (map-side), and time is cut twice: into chunks of 1/64 s and into blocks of 4096 chunks. Each chunk is
reduced to a state that merges in time order (first, last, count, moments of gaps), chunks merge within their block and
blocks within their key. A chunk holds at most as many rows as there are distinct times in 1/64 s, a block 4096, a key
one for each 64 s that it was seen in, so no task depends on how many events a key or a minute has. Widths are powers of
two: cutting times by them is exact.

Few keys need this. Events are counted by a hash of their key first, in a fixed number of buckets; a key whose bucket has no
more events than a chunk may have instants is one chunk as a whole, and moves once. Only keys of crowded buckets are cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_SECONDS = 2.0**-6
BLOCK_CHUNKS = 4096
#: Events of a bucket up to which its keys are not cut, about as many as there are microseconds in a chunk; and buckets.
WHOLE_EVENTS = 1 << 14
BUCKETS = 1 << 17


def _merged(parts: DataFrame, group: Sequence[str], mean: Callable[[WindowSpec], Column], sums: Sequence[str]) -> DataFrame:
    """States of consecutive stretches of time merged per group, with ``_mean`` (gaps around it are what ``_m2`` sums up)."""
    within = Window.partitionBy(*group)
    placed = parts.withColumns(
        {"_bridge": F.col("_first") - F.lag("_last").over(within.orderBy("_first")), "_mean": mean(within)}
    )

    def squared(x):
        return (x - F.col("_mean")) * (x - F.col("_mean"))

    own_mean = F.try_divide(F.col("_last") - F.col("_first"), "_gaps")
    moment = (
        F.col("_m2")
        + F.coalesce(squared(own_mean) * F.col("_gaps"), F.lit(0.0))
        + F.coalesce(squared(F.col("_bridge")), F.lit(0.0))
    )
    return placed.groupBy(*group).agg(
        F.sum("_n").alias("_n"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.sum(F.col("_gaps") + F.col("_bridge").isNotNull().cast("int")).alias("_gaps"),
        F.sum(moment).alias("_m2"),
        F.max("_mean").alias("_mean"),
        *[F.sum(f"_x_{name}").alias(f"_x_{name}") for name in sums],
    )


def gap_statistics(
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    sums: dict[str, Column] | None = None,
    whole: int = WHOLE_EVENTS,
) -> DataFrame:
    """Per key: event count, first and last time, mean gap, gap deviations and extra sums.

    ``mean_gap`` is NULL below two events, ``stdev_samp`` below three. Deviations are merged
    from the chunks' moments around the overall mean, not from sums of squares, so nearly
    equal gaps do not cancel. Keys that surely have at most ``whole`` events are one chunk each and need no
    merging; with 0 nothing is counted first and all keys are cut.
    """
    keys = list(keys)
    sums = sums or {}
    extra = [F.sum(c).alias(f"_x_{name}") for name, c in sums.items()]
    if whole:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
        counts = events.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        crowded = counts.where(F.col("_n") > whole).select("_bucket", F.lit(True).alias("_cut"))
        events = events.withColumn("_bucket", bucket).join(F.broadcast(crowded), "_bucket", "left")
    else:
        events = events.withColumn("_cut", F.lit(True))
    chunk = F.when(F.col("_cut"), F.floor(F.col(time) / F.lit(CHUNK_SECONDS))).alias("_chunk")
    instants = events.groupBy(*keys, chunk).agg(
        F.count(F.lit(1)).alias("_n"), F.collect_set(time).alias("_times"), F.max("_cut").alias("_cut"), *extra
    )
    gaps = F.greatest(F.size("_times") - 1, F.lit(0)).cast("long")
    own_mean = (F.array_max("_times") - F.array_min("_times")) / gaps
    later, earlier = (F.slice(F.sort_array("_times"), i, F.size("_times") - 1) for i in (2, 1))
    moment = F.aggregate(
        F.zip_with(later, earlier, lambda t, u: (t - u).cast("double")),
        F.lit(0.0),
        lambda m2, gap: m2 + (gap - F.col("_own")) * (gap - F.col("_own")),
    )
    chunks = (
        instants.withColumn("_own", F.when(gaps > 0, own_mean))
        .withColumns(
            {
                "_first": F.array_min("_times"),
                "_last": F.array_max("_times"),
                "_gaps": gaps,
                "_m2": F.when(F.col("_own").isNotNull(), moment).otherwise(0.0),
                "_block": F.floor(F.col("_chunk") / BLOCK_CHUNKS),
            }
        )
        .drop("_times")
    )
    cut = F.coalesce("_cut", F.lit(False))

    def over_gaps(count: Callable[[WindowSpec], Column]) -> Callable[[WindowSpec], Column]:
        return lambda w: F.try_divide(F.max("_last").over(w) - F.min("_first").over(w), count(w))

    # Gaps between different times in a block, then all gaps of a key, those of length zero included.
    between = over_gaps(lambda w: F.sum("_gaps").over(w) + F.count(F.lit(1)).over(w) - 1)
    all_gaps = over_gaps(lambda w: F.sum("_n").over(w) - 1)
    blocks = _merged(chunks.where(cut), [*keys, "_block"], between, list(sums))
    found = _merged(blocks, keys, all_gaps, list(sums))
    if whole:
        mean = F.try_divide(F.col("_last") - F.col("_first"), F.col("_n") - 1)
        off = F.coalesce((F.col("_own") - F.col("_mean")) * (F.col("_own") - F.col("_mean")) * F.col("_gaps"), F.lit(0.0))
        single = chunks.where(~cut).withColumn("_mean", mean).withColumn("_m2", F.col("_m2") + off)
        found = found.unionByName(single.select(*found.columns))
    stats = found.select(
        *keys,
        F.col("_n").alias("event_count"),
        F.col("_first").alias("first_time"),
        F.col("_last").alias("last_time"),
        F.col("_mean").alias("mean_gap"),
        F.col("_gaps").alias("_nonzero"),
        "_m2",
        *[F.col(f"_x_{name}").alias(name) for name in sums],
    )
    n = F.col("event_count") - 1
    zero_gaps = n - F.col("_nonzero")
    m2 = F.col("_m2") + zero_gaps * F.col("mean_gap") * F.col("mean_gap")
    return stats.withColumns(
        {
            "stdev_samp": F.when(n > 1, F.sqrt(m2 / (n - 1))),
            "stdev_pop": F.when(n > 0, F.sqrt(m2 / n)),
        }
    ).drop("_nonzero", "_m2")


def first_busy_window(
    events: DataFrame, key: str, time: str, seconds: int, min_events: int
) -> DataFrame:
    """Per key, the earliest event with at least ``min_events`` events in the ``seconds`` after it.

    The frame includes both ends. Time is cut into some 4096 to 8192 chunks a window. A window that starts in a chunk covers
    whole chunks, which count by prefix sums within blocks of one window's length and the block after, and ends in
    a chunk whose instants are looked at one by one. Only chunks that can reach ``min_events`` are counted at all.
    """
    width = 2.0 ** math.floor(math.log2(seconds / BLOCK_CHUNKS))
    whole = math.floor(seconds / width)
    # The window's end falls in this chunk after its own, or in the next where chunks don't divide the window.
    ends = [whole] if whole * width == seconds else [whole, whole + 1]
    instants = (
        events.withColumn("_chunk", F.floor(F.col(time) / F.lit(width)))
        .groupBy(key, "_chunk", F.col(time).alias("_t"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = instants.groupBy(key, "_chunk").agg(F.sum("_n").alias("_n"))
    # Each chunk counts in its own block and, for windows that begin in the block before, there.
    block = F.floor(F.col("_chunk") / whole)
    placed = counts.withColumn("_block", F.explode(F.array(block, block - 1)))
    ahead = Window.partitionBy(key, "_block").orderBy("_chunk").rangeBetween(1, whole - 1)
    between = (
        placed.withColumn("_between", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .where(F.col("_block") == block)
        .select(key, "_chunk", F.lit(None).cast("double").alias("_t"), F.lit(0).cast("long").alias("_n"), F.lit(False).alias("_own"), "_between")
    )
    roles = [F.struct(F.col("_chunk").alias("c"), F.lit(True).alias("own"))]
    roles += [F.struct((F.col("_chunk") - e).alias("c"), F.lit(False).alias("own")) for e in ends]
    served = instants.select(key, F.col("_t").cast("double").alias("_t"), "_n", F.explode(F.array(*roles)).alias("_s")).select(
        key, F.col("_s.c").alias("_chunk"), "_t", "_n", F.col("_s.own").alias("_own"), F.lit(None).cast("long").alias("_between")
    )
    chunk = Window.partitionBy(key, "_chunk")
    frame = chunk.orderBy("_t").rangeBetween(0, seconds)
    return (
        served.unionByName(between)
        .withColumn("_whole", F.max("_between").over(chunk))
        .withColumn("_reach", F.col("_whole") + F.sum("_n").over(chunk))
        .where((F.col("_reach") >= min_events) & F.col("_t").isNotNull())
        .withColumn("_in_window", F.sum("_n").over(frame) + F.col("_whole"))
        .where(F.col("_own") & (F.col("_in_window") >= min_events))
        .groupBy(key)
        .agg(
            F.min("_t").alias("window_start"),
            F.min_by("_in_window", "_t").alias("events_in_window"),
        )
    )
