"""Saved intelligence responses (one JSON document per line) shaped into typed source tables.

Each input row is ``indicator, indicator_type, response`` where ``response`` is the JSON text a
source returned; :func:`read_responses` reads such rows from JSON lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens import constants as K

_RESPONSES = "indicator STRING, indicator_type STRING, response STRING"

_OTX = (
    "error STRING, pulse_info STRUCT<count: INT, pulses: ARRAY<STRUCT<id: STRING, name: STRING, created: STRING, "
    "tags: ARRAY<STRING>>>>, country_code STRING, country_name STRING, city STRING, asn STRING"
)
_VT = (
    "error STRING, data STRUCT<attributes: STRUCT<last_analysis_stats: MAP<STRING, INT>, categories: MAP<STRING, STRING>, "
    "tags: ARRAY<STRING>, country: STRING, asn: INT, as_owner: STRING, registrar: STRING, creation_date: BIGINT, "
    "last_analysis_date: BIGINT>>"
)
_ABUSE = (
    "error STRING, data STRUCT<abuseConfidenceScore: INT, totalReports: INT, numDistinctUsers: INT, isWhitelisted: BOOLEAN, "
    "isTor: BOOLEAN, countryCode: STRING, isp: STRING, domain: STRING, usageType: STRING, lastReportedAt: STRING, "
    "reports: ARRAY<STRUCT<categories: ARRAY<INT>>>>"
)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses from JSON lines with a fixed schema."""
    return spark.read.schema(_RESPONSES).json(path)


def _parsed(responses: DataFrame, ddl: str) -> DataFrame:
    return responses.select("indicator", "indicator_type", F.from_json("response", ddl).alias("r"))


def _error(r: Column) -> Column:
    return F.when(r.isNull(), F.lit("no response")).otherwise(r["error"])


def _union_of(arrays: Column, kind: str) -> Column:
    """Sorted distinct elements of an array of arrays."""
    present = F.filter(F.coalesce(arrays, F.array().cast(f"array<array<{kind}>>")), lambda a: a.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(present)))


def shape_otx(responses: DataFrame, max_pulses: int | None = None) -> DataFrame:
    """Pulse count, the pulses (the first ``max_pulses``, if given), all tags, the tags that name malware, place."""
    r = F.col("r")
    pulses = r["pulse_info"]["pulses"]
    word = "|".join(K.MALWARE_KEYWORDS)
    shaped = _parsed(responses, _OTX).select(
        "indicator",
        "indicator_type",
        F.coalesce(r["pulse_info"]["count"], F.lit(0)).alias("pulse_count"),
        (pulses if max_pulses is None else F.slice(pulses, 1, max_pulses)).alias("pulses"),
        _union_of(F.transform(pulses, lambda p: p["tags"]), "string").alias("tags"),
        r["country_code"].alias("country_code"),
        r["country_name"].alias("country_name"),
        r["city"].alias("city"),
        r["asn"].alias("asn"),
        _error(r).alias("error"),
    )
    return shaped.withColumn("malware_families", F.filter("tags", lambda t: F.lower(t).rlike(word)))


def shape_vt(responses: DataFrame) -> DataFrame:
    """Engine verdict counts and their sum, categories, tags, registration data."""
    r = F.col("r")
    a = r["data"]["attributes"]
    stats = a["last_analysis_stats"]

    def verdicts(name):
        return F.coalesce(F.try_element_at(stats, F.lit(name)), F.lit(0)).alias(f"{name}_count")

    return _parsed(responses, _VT).select(
        "indicator",
        "indicator_type",
        *[verdicts(v) for v in ("malicious", "suspicious", "harmless", "undetected")],
        F.coalesce(F.aggregate(F.map_values(stats), F.lit(0), lambda acc, x: acc + x), F.lit(0)).alias("total_engines"),
        F.array_sort(F.array_distinct(F.map_values(a["categories"]))).alias("categories"),
        F.coalesce(a["tags"], F.array().cast("array<string>")).alias("tags"),
        *[a[c].alias(c) for c in ("country", "asn", "as_owner", "registrar", "creation_date", "last_analysis_date")],
        _error(r).alias("error"),
    )


def shape_abuse(responses: DataFrame) -> DataFrame:
    """Score, reports, flags and the union of the report categories. Addresses only."""
    r = F.col("r")
    d = r["data"]
    return _parsed(responses.where(F.col("indicator_type") == "ip"), _ABUSE).select(
        "indicator",
        "indicator_type",
        F.coalesce(d["abuseConfidenceScore"], F.lit(0)).alias("abuse_confidence_score"),
        F.coalesce(d["totalReports"], F.lit(0)).alias("total_reports"),
        F.coalesce(d["numDistinctUsers"], F.lit(0)).alias("distinct_users"),
        F.coalesce(d["isWhitelisted"], F.lit(False)).alias("is_whitelisted"),
        F.coalesce(d["isTor"], F.lit(False)).alias("is_tor_node"),
        d["countryCode"].alias("country_code"),
        d["isp"].alias("isp"),
        d["domain"].alias("domain"),
        d["usageType"].alias("usage_type"),
        _union_of(F.transform(d["reports"], lambda x: x["categories"]), "int").alias("categories"),
        d["lastReportedAt"].alias("last_reported_at"),
        _error(r).alias("error"),
    )
