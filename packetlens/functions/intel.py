"""Threat levels, flags and detail texts over intelligence structs.

Source columns are the structs of :mod:`packetlens.schemas` (``otx``, ``abuse``, ``vt``);
a NULL struct means the source was not asked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import as_col, literal_map


def _non_empty(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0


def vt_threat_level(vt: Column | str) -> Column:
    """Level from engine verdicts."""
    vt = as_col(vt)
    return (
        F.when(vt["error"].isNotNull(), "unknown")
        .when(vt["malicious_count"] >= 5, "malicious")
        .when((vt["malicious_count"] >= 1) | (vt["suspicious_count"] >= 3), "suspicious")
        .when((vt["total_engines"] > 0) & (vt["malicious_count"] == 0), "clean")
        .otherwise("unknown")
    )


def abuse_threat_level(abuse: Column | str) -> Column:
    """Level from the abuse confidence score."""
    abuse = as_col(abuse)
    return (
        F.when(abuse["error"].isNotNull(), "unknown")
        .when(abuse["is_whitelisted"], "clean")
        .when(abuse["abuse_confidence_score"] >= 75, "malicious")
        .when(abuse["abuse_confidence_score"] >= 25, "suspicious")
        .when(abuse["total_reports"] == 0, "clean")
        .otherwise("unknown")
    )


def otx_threat_level(otx: Column | str) -> Column:
    """Level from community pulses."""
    otx = as_col(otx)
    return (
        F.when(otx["error"].isNotNull(), "unknown")
        .when((otx["pulse_count"] >= 3) | _non_empty(otx["malware_families"]), "malicious")
        .when(otx["pulse_count"] >= 1, "suspicious")
        .otherwise("unknown")
    )


def overall_threat_level(vt="vt", abuse="abuse", otx="otx") -> Column:
    """Most severe level of the sources that were asked; clean outranks unknown."""
    levels = F.array(
        F.when(as_col(vt).isNotNull(), vt_threat_level(vt)),
        F.when(as_col(abuse).isNotNull(), abuse_threat_level(abuse)),
        F.when(as_col(otx).isNotNull(), otx_threat_level(otx)),
    )
    levels = F.array_compact(levels)
    return (
        F.when(F.array_contains(levels, "malicious"), "malicious")
        .when(F.array_contains(levels, "suspicious"), "suspicious")
        .when(F.array_contains(levels, "clean"), "clean")
        .otherwise("unknown")
    )


def otx_flagged(otx: Column | str) -> Column:
    """Any pulse or malware tag, without an error."""
    otx = as_col(otx)
    hit = (otx["pulse_count"] >= 1) | _non_empty(otx["malware_families"])
    return F.coalesce(otx["error"].isNull() & hit, F.lit(False))


def abuse_flagged(abuse: Column | str) -> Column:
    """Score of 25 or three reports, without an error."""
    abuse = as_col(abuse)
    hit = (abuse["abuse_confidence_score"] >= 25) | (abuse["total_reports"] >= 3)
    return F.coalesce(abuse["error"].isNull() & hit, F.lit(False))


def vt_malicious(vt: Column | str) -> Column:
    """At least one engine calls it malicious."""
    return F.coalesce(as_col(vt)["malicious_count"] >= 1, F.lit(False))


def detection_ratio(vt: Column | str) -> Column:
    """``malicious/total``; the total is the sum of verdicts, or the engine count when that is 0."""
    vt = as_col(vt)
    verdicts = vt["malicious_count"] + vt["suspicious_count"] + vt["harmless_count"] + vt["undetected_count"]
    total = F.when(verdicts == 0, vt["total_engines"]).otherwise(verdicts)
    return F.concat(vt["malicious_count"].cast("string"), F.lit("/"), total.cast("string"))


def source_count(vt="vt", abuse="abuse", otx="otx") -> Column:
    """How many sources answered without an error."""
    answered = [F.when(as_col(s).isNotNull() & as_col(s)["error"].isNull(), 1).otherwise(0) for s in (vt, abuse, otx)]
    return answered[0] + answered[1] + answered[2]


def _source_texts(vt, abuse, otx, vt_end, abuse_end) -> list[Column]:
    vt, abuse, otx = as_col(vt), as_col(abuse), as_col(otx)
    score, pulses = abuse["abuse_confidence_score"], otx["pulse_count"]
    return [
        F.when(vt["malicious_count"] > 0, F.concat(F.lit("VT: "), detection_ratio(vt), F.lit(vt_end))),
        F.when(score > 0, F.concat(F.lit("AbuseIPDB: "), score.cast("string"), F.lit("%" + abuse_end))),
        F.when(pulses > 0, F.concat(F.lit("OTX: "), pulses.cast("string"), F.lit(" pulses"))),
    ]


def summary(vt="vt", abuse="abuse", otx="otx") -> Column:
    """One line over all sources."""
    text = F.concat_ws(" | ", *_source_texts(vt, abuse, otx, " detections", " confidence"))
    return F.when(text == "", F.lit("No threat indicators found")).otherwise(text)


def flagged_sources(vt="vt", abuse="abuse", otx="otx") -> Column:
    """The short source texts of a flagged indicator, as an array."""
    return F.array_compact(F.array(*_source_texts(vt, abuse, otx, "", "")))


def flagged_families(vt="vt", otx="otx") -> Column:
    """Up to three malware families and two tags, distinct and sorted."""
    families = F.coalesce(F.slice(as_col(otx)["malware_families"], 1, 3), F.array().cast("array<string>"))
    tags = F.coalesce(F.slice(as_col(vt)["tags"], 1, 2), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(families, tags)))


def category_names(codes: Column | str) -> Column:
    """Names of abuse category codes; unknown codes print as ``Category-n``."""
    names = literal_map(K.ABUSE_CATEGORIES)
    return F.transform(
        as_col(codes),
        lambda c: F.coalesce(F.try_element_at(names, c), F.concat(F.lit("Category-"), c.cast("string"))),
    )


def pulse_names(pulses: Column | str) -> Column:
    """Names of the first five pulses."""
    return F.transform(F.slice(as_col(pulses), 1, 5), lambda p: F.coalesce(p["name"], F.lit("Unknown Pulse")))


def _joined(array: Column, n: int) -> Column:
    text = F.array_join(F.slice(array, 1, n), ", ")
    return F.nullif(text, F.lit(""))


def otx_details(otx: Column | str) -> Column:
    """``n pulses - family, family``."""
    otx = as_col(otx)
    pulses = F.when(otx["pulse_count"] > 0, F.concat(otx["pulse_count"].cast("string"), F.lit(" pulses")))
    return F.concat_ws(" - ", pulses, _joined(otx["malware_families"], 3))


def abuse_details(abuse: Column | str) -> Column:
    """``n% confidence - n reports - category, category``."""
    abuse = as_col(abuse)
    score, reports = abuse["abuse_confidence_score"], abuse["total_reports"]
    return F.concat_ws(
        " - ",
        F.when(score > 0, F.concat(score.cast("string"), F.lit("% confidence"))),
        F.when(reports > 0, F.concat(reports.cast("string"), F.lit(" reports"))),
        _joined(category_names(abuse["categories"]), 2),
    )


def vt_details(vt: Column | str) -> Column:
    """``malicious/total - tag, tag, tag``."""
    vt = as_col(vt)
    return F.concat_ws(" - ", detection_ratio(vt), _joined(vt["tags"], 3))


def detector_category(detector: Column | str) -> Column:
    """Display-filter category of a detector."""
    lower = F.lower(as_col(detector))
    return F.when(lower.isin(K.DETECTOR_CATEGORIES), lower).otherwise(F.lit("custom"))


def cache_ttl(level: Column | str) -> Column:
    """Cache lifetime in seconds of a threat level."""
    default = K.CACHE_TTL_SECONDS["unknown"]
    return F.coalesce(F.try_element_at(literal_map(K.CACHE_TTL_SECONDS), as_col(level)), F.lit(default))
