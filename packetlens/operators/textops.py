"""Addresses, threat level, summary and filter expressions read out of report texts, row by row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import as_col

# Word boundaries and digits in the Unicode sense.
_QUAD = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
_OCTETS = r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(?!$)|$)){4}$"
_LOCAL = r"^0*(10|127)\.|^0*192\.0*168\.|^0*172\.0*(1[6-9]|2[0-9]|3[01])\."
_FIELDS = r"(?i)(?:" + "|".join(f.replace(".", r"\.") for f in K.REPORT_FILTER_FIELDS) + r")[^`\n]*"
_TITLE = "EXECUTIVE SUMMARY"


def _first(items: Column, at_most: int | None) -> Column:
    return items if at_most is None else F.slice(items, 1, at_most)


def mentioned_ips(text: Column | str, at_most: int | None = None) -> Column:
    """Distinct public addresses in a text, in text order; all of them unless ``at_most`` is given."""
    found = F.array_distinct(F.regexp_extract_all(as_col(text), F.lit(_QUAD), F.lit(0)))
    public = F.filter(found, lambda ip: ip.rlike(_OCTETS) & ~ip.rlike(_LOCAL))
    return _first(F.array_sort(public), at_most)


def report_threat_level(text: Column | str) -> Column:
    """The first listed level that follows one of the usual phrases, else ``unknown``."""
    upper = F.upper(as_col(text))

    def stated(level):
        return reduce(or_, [upper.contains(prefix + level) for prefix in K.REPORT_THREAT_PREFIXES])

    return F.coalesce(*[F.when(stated(x), F.lit(x.lower())) for x in K.REPORT_THREAT_LEVELS], F.lit("unknown"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def executive_summary(text: Column | str, max_chars: int | None = None) -> Column:
    """Text between the summary heading and the next heading; NULL without a summary heading."""
    text = as_col(text)
    start = F.instr(F.upper(text), _TITLE)
    after = start + 20
    rest = F.substr(text, after)

    def next_heading(mark):
        at = F.instr(rest, mark)
        return F.when(at > 1, after + at - 1)

    end = F.coalesce(F.least(*[next_heading(m) for m in ("## ", "### ", "# ")]), F.length(text) + 1)
    section = _stripped(F.substr(text, start, end - start))
    body = _stripped(F.regexp_replace(section, r"^[^\n]*\n?", ""))
    return F.when((start > 0) & (end > start), body if max_chars is None else F.substring(body, 1, max_chars))


def quoted_filters(text: Column | str, at_most: int | None = None) -> Column:
    """Distinct filter expressions of a text that names the packet viewer; all unless ``at_most`` is given."""
    text = as_col(text)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(_FIELDS), F.lit(0))))
    return F.when(F.upper(text).contains("WIRESHARK"), _first(found, at_most)).otherwise(
        F.array().cast("array<string>")
    )


def report_ips(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per document and mentioned address."""
    return df.select(*key, F.explode(mentioned_ips(text)).alias("ip"))


def parse_reports(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """All extracted fields of each document, in one projection."""
    return df.select(
        *key,
        executive_summary(text).alias("executive_summary"),
        report_threat_level(text).alias("threat_level"),
        mentioned_ips(text).alias("ips"),
        quoted_filters(text).alias("recommended_filters"),
    )
