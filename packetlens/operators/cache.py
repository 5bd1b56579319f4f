"""Look-up results kept as a table with a lifetime per threat level. ``now`` is always a parameter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import as_col
from packetlens.functions.intel import cache_ttl
from packetlens.operators.intel import enrichment_stats, sort_enriched
from packetlens.operators.ranking import with_row_rank
from packetlens.session import write_once


def cache_key(indicator: Column | str = "indicator", indicator_type: Column | str = "indicator_type") -> Column:
    """``type:indicator`` with the indicator in lower case."""
    return F.concat(as_col(indicator_type), F.lit(":"), F.lower(as_col(indicator)))


def cache_entries(results: DataFrame, now: float) -> DataFrame:
    """Results as cache rows that expire by threat level."""
    return results.withColumns(
        {
            "cache_key": cache_key(),
            "created_at": F.lit(float(now)),
            "expires_at": F.lit(float(now)) + cache_ttl("overall_threat_level"),
        }
    )


def live_entries(cache: DataFrame, now: float) -> DataFrame:
    """Entries that have not expired, with the seconds they have left."""
    return cache.where(F.col("expires_at") >= now).withColumn("ttl_remaining", F.col("expires_at") - now)


def split_by_cache(indicators: DataFrame, cache: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(cached results, indicators to look up). ``indicators`` has ``value`` and ``indicator_type``."""
    keyed = indicators.withColumn("cache_key", cache_key("value"))
    live = live_entries(cache, now)
    hits = live.join(keyed.select("cache_key"), "cache_key", "left_semi").withColumn("cached", F.lit(True))
    misses = keyed.join(live.select("cache_key"), "cache_key", "left_anti").drop("cache_key")
    return hits, misses


def merge_cache(cache: DataFrame, results: DataFrame, now: float) -> DataFrame:
    """The cache with new results; the newest entry of a key wins."""
    added = cache_entries(results, now).withColumn("_source", F.lit(1))
    both = cache.withColumn("_source", F.lit(0)).unionByName(added, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("cache_key", "_source")]
    # Of entries as old as each other the one that was added wins.
    order = F.struct("created_at", "_source", "expires_at")
    newest = both.groupBy("cache_key").agg(F.max_by(F.struct(*rest), order).alias("_e"))
    return newest.select("cache_key", *[F.col(f"_e.{c}").alias(c) for c in rest])


def prune_cache(cache: DataFrame, now: float, max_size: int = K.CACHE_MAX_SIZE) -> DataFrame:
    """Live entries; if they still fill the cache, without the oldest tenth (ties by key).

    Entries are counted per second of their making. Live ones are at most as old as the longest life, which bounds
    these counts. They give the second in which the cut lies, and only the entries of that second are ranked.
    """
    # An entry without a time is the oldest.
    made = F.coalesce(F.floor("created_at"), F.lit(-(1 << 62)))
    live = cache.where(F.col("expires_at") >= now)
    counts = live.groupBy(made.alias("made")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("made").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = counts.select("made", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("size"))
    evicted = F.when(F.col("size") >= max_size, F.greatest(F.lit(1), F.floor(F.col("size") / 10))).otherwise(0)
    cut = seconds.select("made", (evicted - F.col("upto") + F.col("n")).alias("oldest")).where("oldest > 0")
    last = cut.orderBy(F.desc("made")).first()
    if last is None:
        return live
    ranked = with_row_rank(live.where(made == last["made"]), [F.col("created_at"), F.col("cache_key")])
    return live.where(made > last["made"]).unionByName(ranked.where(F.col("row_rank") >= last["oldest"]).drop("row_rank"))


@dataclass(frozen=True)
class CachedLookups:
    """Results of a batch (``cached``: from the cache), the cache after it, and one row of counts."""

    results: DataFrame
    cache: DataFrame
    stats: DataFrame


def enrich_with_cache(
    indicators: DataFrame, cache: DataFrame, now: float, look_up: Callable[[DataFrame], DataFrame]
) -> CachedLookups:
    """Look up only what has no live entry, keep the answers, and give both, most serious first.

    ``indicators`` has ``value`` and ``indicator_type``; one asked for twice (also in another case) is looked up once.
    ``look_up`` takes such rows and returns results as :func:`intel.enrich` does. Its answers are written once, as the
    results, the cache and the counts all read them. Threat levels are counted for what was looked up, as are errors: answers of a
    source that hold one. An empty batch looks nothing up and keeps the cache.
    """
    whole = F.struct(*indicators.columns)
    once = indicators.groupBy(cache_key("value")).agg(F.min_by(whole, "value").alias("_i")).select("_i.*")
    hits, misses = split_by_cache(once, cache, now)
    fresh = write_once(look_up(misses), "lookups")
    own = [c for c in hits.columns if c not in ("cache_key", "created_at", "expires_at", "ttl_remaining")]
    results = hits.select(*own).unionByName(fresh.withColumn("cached", F.lit(False)), allowMissingColumns=True)
    sources = [c for c in ("otx", "abuse", "vt") if c in fresh.columns]
    errors = sum((F.count_if(F.col(f"{c}.error").isNotNull()) for c in sources), F.lit(0))
    stats = enrichment_stats(fresh).withColumnRenamed("total_indicators", "api_lookups").withColumns(
        {
            "cached_hits": hits.select(F.count(F.lit(1)).alias("n")).scalar(),
            "errors": fresh.select(errors.alias("n")).scalar(),
        }
    )
    stats = stats.withColumn("total_indicators", F.col("cached_hits") + F.col("api_lookups"))
    return CachedLookups(sort_enriched(results), merge_cache(cache, fresh, now), stats)


def cache_stats(indicators: DataFrame, cache: DataFrame, now: float, max_size: int = K.CACHE_MAX_SIZE) -> DataFrame:
    """One row: size, hits, misses, hit rate and expired entries for a batch of look-ups."""
    keyed = indicators.select(cache_key("value").alias("cache_key"))
    asked = keyed.join(cache.select("cache_key", "expires_at"), "cache_key", "left")
    hit = F.coalesce(F.col("expires_at") >= now, F.lit(False))
    size = cache.select(F.count(F.lit(1)).alias("n")).scalar()
    return asked.agg(
        F.count_if(hit).alias("hits"),
        F.count_if(~hit).alias("misses"),
        F.count_if(F.col("expires_at") < now).alias("expirations"),
    ).select(
        size.alias("size"),
        F.lit(max_size).alias("max_size"),
        "hits",
        "misses",
        F.coalesce(F.bround(F.try_divide("hits", F.col("hits") + F.col("misses")), 3), F.lit(0.0)).alias("hit_rate"),
        "expirations",
    )
