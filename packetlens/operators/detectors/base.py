"""Findings schema, detector protocol and registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import rank_of, text
from packetlens.operators.detectors.ledger import Ledger
from packetlens.operators.flows import Tables


@runtime_checkable
class Detector(Protocol):
    """What a detector provides. Settings are fields of the detector, given when it is built."""

    name: str

    def detect(self, tables: Tables) -> DataFrame:
        """Findings, in the schema of :func:`make_findings`."""

    def addresses(self, tables: Tables) -> DataFrame:
        """All addresses of each finding, one row each: ``finding_id, detector, ip``."""


_REGISTRY: dict[str, Callable[..., Detector]] = {}


def register(detector_class):
    """Class decorator that makes a detector available by its name."""
    _REGISTRY[detector_class.name] = detector_class
    return detector_class


def get_detector(name: str, **settings) -> Detector:
    """A registered detector, with settings overridden by keyword."""
    return _REGISTRY[name](**settings)


def detector_names() -> list[str]:
    """Names of all registered detectors."""
    return list(_REGISTRY)


def as_text(value: Column) -> Column:
    """An indicator value as text; arrays are comma-separated."""
    return value.cast("string")


def make_findings(
    rows: DataFrame,
    detector: str,
    rule: str,
    entity: Column,
    severity: Column,
    confidence: Column,
    title: Column,
    description: Column,
    affected_ips: Column | None = None,
    affected_flows: Column | None = None,
    indicators: dict[str, Column] | None = None,
    start: Column | None = None,
    end: Column | None = None,
    techniques: Column | list[str] = (),
    display_filter: Column | None = None,
) -> DataFrame:
    """Project rule output to the findings schema.

    The identifier is a hash of detector, rule and entity, so it is the same in every run.
    ``affected_ips`` holds a bounded list; the complete relation is ``Detector.addresses``.
    """
    no_text = F.array().cast("array<string>")
    pairs = [x for key, value in (indicators or {}).items() for x in (F.lit(key), as_text(value))]
    if not isinstance(techniques, Column):
        techniques = F.array(*[F.lit(t) for t in techniques]).cast("array<string>")
    return rows.select(
        F.md5(F.concat_ws("|", F.lit(detector), F.lit(rule), entity)).alias("finding_id"),
        F.lit(detector).alias("detector"),
        F.lit(rule).alias("rule"),
        severity.alias("severity"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence.cast("double"))).alias("confidence"),
        title.alias("title"),
        description.alias("description"),
        (no_text if affected_ips is None else affected_ips).alias("affected_ips"),
        (no_text if affected_flows is None else affected_flows).alias("affected_flows"),
        F.map_filter(F.create_map(*pairs).cast("map<string,string>"), lambda _, v: v.isNotNull()).alias("indicators"),
        (F.lit(None).cast("double") if start is None else start).alias("timestamp_start"),
        (F.lit(None).cast("double") if end is None else end).alias("timestamp_end"),
        techniques.alias("mitre_techniques"),
        (F.lit(None).cast("string") if display_filter is None else display_filter).alias("display_filter"),
    )


def listed_addresses(findings: DataFrame) -> DataFrame:
    """The bounded address lists of findings as rows."""
    return findings.select("finding_id", "detector", F.explode("affected_ips").alias("ip"))


def finding_key(detector: str, rule: str, entity: Column) -> Column:
    """The identifier :func:`make_findings` gives this entity."""
    return F.md5(F.concat_ws("|", F.lit(detector), F.lit(rule), entity))


def evaluate(
    tables: Tables, names: Iterable[str] | None = None, detectors: Iterable[Detector] | None = None
) -> Ledger:
    """The stored ledger of all (or the named) detectors' rules; findings and addresses both read it."""
    chosen = list(detectors) if detectors is not None else [get_detector(n) for n in (names or detector_names())]
    return Ledger(tables, chosen)


def run_detectors(
    tables: Tables, names: Iterable[str] | None = None, detectors: Iterable[Detector] | None = None
) -> DataFrame:
    """Findings of all (or the named) detectors, in one table. With addresses wanted too, use :func:`evaluate` once."""
    return evaluate(tables, names, detectors).findings()


def finding_addresses(
    tables: Tables, names: Iterable[str] | None = None, detectors: Iterable[Detector] | None = None
) -> DataFrame:
    """Every (finding, address) pair of all (or the named) detectors."""
    return evaluate(tables, names, detectors).addresses()


def sort_findings(findings: DataFrame) -> DataFrame:
    """Most severe first, then most confident."""
    return findings.orderBy(
        rank_of("severity", K.SEVERITY_RANK, 5), F.col("confidence").desc(), "detector", "rule", "finding_id"
    )


def finding_records(findings: DataFrame) -> DataFrame:
    """Findings as published: confidence to three decimals, ISO times added."""
    return findings.withColumns(
        {
            "confidence": F.bround("confidence", 3),
            "timestamp_start_iso": text.iso_time("timestamp_start"),
            "timestamp_end_iso": text.iso_time("timestamp_end"),
        }
    )


def count_by_severity(rows: DataFrame) -> DataFrame:
    """Findings or anomalies per severity, most severe first."""
    return (
        rows.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("finding_count"))
        .orderBy(rank_of("severity", K.SEVERITY_RANK, 5), "severity")
    )
