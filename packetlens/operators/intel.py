"""Indicators joined to threat-intelligence tables, in stages or in two phases.

A source table that is ``None`` is "not configured". All joins use the same key
(indicator type, indicator), so consecutive stages keep one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens import constants as K
from packetlens import schemas
from packetlens.functions import intel as I
from packetlens.functions import rank_of
from packetlens.operators.ranking import top_rows

KEY = ["indicator_type", "indicator"]


def _packed(source: DataFrame, name: str) -> DataFrame:
    """One row per key with the whole record as a struct."""
    return source.select(*KEY, F.struct(*[c for c in source.columns if c not in KEY]).alias(name))


def _missing(ddl: str, name: str) -> Column:
    """A NULL of the struct :func:`_packed` would give."""
    fields = [f for f in T.DataType.fromDDL(ddl).fields if f.name not in KEY]
    return F.lit(None).cast(T.StructType(fields)).alias(name)


def _attach(rows: DataFrame, source: DataFrame | None, name: str, ddl: str, wanted: Column | None = None) -> DataFrame:
    """Adds the source struct, NULL where there is no record or the look-up is not wanted."""
    if source is None:
        return rows.select("*", _missing(ddl, name))
    joined = rows.join(_packed(source, name), KEY, "left")
    return joined if wanted is None else joined.withColumn(name, F.when(wanted, F.col(name)))


def with_assessment(rows: DataFrame) -> DataFrame:
    """Overall level, number of answering sources and summary line."""
    return rows.withColumns(
        {
            "overall_threat_level": I.overall_threat_level(),
            "source_count": I.source_count(),
            "summary": I.summary(),
        }
    )


def _attach_slow(rows: DataFrame, chosen: DataFrame, vt: DataFrame) -> DataFrame:
    """Adds ``vt`` for the chosen indicators. Their number is the caller's limit, so their size decides on a broadcast."""
    records = _packed(vt, "vt").join(chosen.select(*KEY), KEY, "left_semi")
    picked = chosen.select(*KEY).join(records, KEY, "left").withColumn("slow_selected", F.lit(True))
    joined = rows.join(picked, KEY, "left")
    return joined.withColumn("slow_selected", F.coalesce("slow_selected", F.lit(False)))


# ---- staged look-up ------------------------------------------------------------------------


def cascade_candidates(rows: DataFrame, limit: int) -> DataFrame:
    """Who is worth the slow source: flagged twice, then by abuse reports, then by pulses, then domains."""
    is_ip = F.col("indicator_type") == "ip"
    stage = (
        F.when(is_ip & F.col("otx_flagged") & F.col("abuse_flagged"), 0)
        .when(is_ip & F.col("abuse_flagged"), 1)
        .when(is_ip & F.col("otx_flagged"), 2)
        .when(~is_ip & F.col("otx_flagged"), 3)
    )
    ranked = rows.select(*KEY, stage.alias("stage")).where("stage IS NOT NULL")
    return top_rows(ranked, [F.col("stage"), F.col("indicator_type"), F.col("indicator")], limit)


def cascade(
    indicators: DataFrame,
    otx: DataFrame | None = None,
    abuse: DataFrame | None = None,
    vt: DataFrame | None = None,
    max_slow: int = K.MAX_SLOW_LOOKUPS_CASCADE,
) -> DataFrame:
    """Pulses for all, abuse reports for flagged addresses (all when pulses are not configured), engines for a few.

    ``indicators`` has ``value`` and ``indicator_type``.
    """
    is_ip = F.col("indicator_type") == "ip"
    base = indicators.select(F.col("value").alias("indicator"), "indicator_type").distinct()
    staged = _attach(base, otx, "otx", schemas.INTEL_OTX).withColumn("otx_flagged", I.otx_flagged("otx"))
    wanted = is_ip & (F.col("otx_flagged") if otx is not None else F.lit(True))
    staged = _attach(staged, abuse, "abuse", schemas.INTEL_ABUSE, wanted).withColumns(
        {
            "abuse_wanted": wanted & F.lit(abuse is not None),
            "abuse_flagged": I.abuse_flagged("abuse"),
        }
    )
    if vt is None:
        staged = staged.select("*", _missing(schemas.INTEL_VT, "vt"), F.lit(False).alias("slow_selected"))
    else:
        staged = _attach_slow(staged, cascade_candidates(staged, max_slow), vt)
    return with_assessment(staged)


def cascade_stats(enriched: DataFrame) -> DataFrame:
    """One row of counts per stage and overall, from the output of :func:`cascade`."""
    def seen(source):
        return F.col(source).isNotNull()

    def failed(source):
        return F.count_if(seen(source) & F.col(source)["error"].isNotNull())

    level = F.col("overall_threat_level")
    return enriched.agg(
        F.count(F.lit(1)).alias("total_indicators"),
        F.count_if(seen("otx")).alias("otx_checked"),
        F.count_if("otx_flagged").alias("otx_flagged"),
        failed("otx").alias("otx_errors"),
        F.count_if("abuse_wanted").alias("abuse_total"),
        F.count_if(seen("abuse")).alias("abuse_checked"),
        F.count_if("abuse_flagged").alias("abuse_flagged"),
        failed("abuse").alias("abuse_errors"),
        F.count_if("slow_selected").alias("vt_total"),
        F.count_if(seen("vt")).alias("vt_checked"),
        F.count_if(I.vt_malicious("vt")).alias("vt_malicious"),
        failed("vt").alias("vt_errors"),
        F.count_if(level == "malicious").alias("total_malicious"),
        F.count_if(level == "suspicious").alias("total_suspicious"),
    )


def flagged_indicators(enriched: DataFrame) -> DataFrame:
    """Malicious and suspicious indicators with source texts and families, most serious first."""
    flagged = enriched.where(F.col("overall_threat_level").isin("malicious", "suspicious"))
    return (
        flagged.select(
            "indicator",
            "indicator_type",
            F.col("overall_threat_level").alias("threat_level"),
            I.flagged_sources().alias("sources"),
            I.flagged_families().alias("malware_families"),
        )
        .withColumn("summary", F.array_join("sources", " | "))
        .orderBy(
            rank_of("threat_level", K.THREAT_RANK), F.size("sources").desc(), "indicator_type", "indicator"
        )
    )


# ---- two-phase look-up ---------------------------------------------------------------------


def prioritize_for_slow_source(
    rows: DataFrame, order: list[Column], limit: int = K.MAX_SLOW_LOOKUPS_TWO_PHASE
) -> DataFrame:
    """At most ``limit`` indicators for the slow source, with the reason.

    All of a small set; else suspicious ones first, filled up in input order.
    """
    suspicious = F.col("overall_threat_level").isin("malicious", "suspicious")
    total = rows.select(F.count(F.lit(1)).alias("n")).scalar()
    n_suspicious = rows.select(F.count_if(suspicious).alias("n")).scalar()
    # A small set keeps its order; the others put suspicious ones first.
    lead = F.when(total <= limit, 0).when(suspicious, 0).otherwise(1)
    chosen = rows.withColumn("_lead", lead).orderBy("_lead", *order).limit(limit)
    reason = (
        F.when(total <= limit, "auto-selected (small set)")
        .when(n_suspicious >= limit, "marked suspicious by preliminary scan")
        .otherwise("fallback selection")
    )
    return chosen.withColumn("selection_reason", reason).drop("_lead")


def enrich(
    indicators: DataFrame,
    otx: DataFrame | None = None,
    abuse: DataFrame | None = None,
    vt: DataFrame | None = None,
    order: list[Column] | None = None,
    max_slow: int = K.MAX_SLOW_LOOKUPS_TWO_PHASE,
) -> DataFrame:
    """Both fast sources for all indicators, then the slow source for the selected ones."""
    base = indicators.withColumnRenamed("value", "indicator")
    fast = _attach(base, otx, "otx", schemas.INTEL_OTX)
    fast = _attach(fast, abuse, "abuse", schemas.INTEL_ABUSE, F.col("indicator_type") == "ip")
    blank = fast.select("*", _missing(schemas.INTEL_VT, "vt"))
    if vt is None:
        done = blank.withColumn("slow_selected", F.lit(False))
    else:
        order = order or [F.col("indicator_type"), F.col("indicator")]
        first_view = blank.withColumn("overall_threat_level", I.overall_threat_level())
        chosen = prioritize_for_slow_source(first_view, order, max_slow)
        done = _attach_slow(fast, chosen, vt)
    return with_assessment(done)


def enrich_single(
    spark, value: str, indicator_type: str, otx=None, abuse=None, vt=None
) -> DataFrame:
    """One indicator against all sources; the key predicate reaches the source scans."""
    one = spark.createDataFrame([(value, indicator_type)], "value STRING, indicator_type STRING")

    def narrowed(source):
        if source is None:
            return None
        return source.where((F.col("indicator") == value) & (F.col("indicator_type") == indicator_type))

    return enrich(one, narrowed(otx), narrowed(abuse), narrowed(vt))


def sort_enriched(enriched: DataFrame) -> DataFrame:
    """Most serious first."""
    return enriched.orderBy(rank_of("overall_threat_level", K.THREAT_RANK), "indicator_type", "indicator")


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    """One row of counts from the output of :func:`enrich`."""
    level = F.col("overall_threat_level")
    return enriched.agg(
        F.count(F.lit(1)).alias("total_indicators"),
        F.count_if(F.col("otx").isNotNull()).alias("otx_queries"),
        F.count_if(F.col("abuse").isNotNull()).alias("abuse_queries"),
        F.count_if("slow_selected").alias("vt_queries"),
        F.count_if(~F.col("slow_selected")).alias("vt_skipped"),
        F.count_if(level == "malicious").alias("malicious_found"),
        F.count_if(level == "suspicious").alias("suspicious_found"),
    )
