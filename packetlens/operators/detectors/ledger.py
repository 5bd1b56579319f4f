"""One evaluation of all rules.

Flows are aggregated once per edge (source, destination, port, protocol) with the measures that any rule of any detector
asks for, and queries once per name. From these two stored tables each detector makes one aggregate per grain (source,
destination, edge, parent domain, ...): a row per entity that some rule holds for, its measures, and ``rules`` with a bit
for each rule that holds. These tables are stored too. They are the ledger: findings and address relations are
projections of it, and no rule is evaluated twice.

Only rules about single instants read the flows again, and only flows of entities that their aggregates left open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions import names
from packetlens.operators.flows import Tables
from packetlens.session import write_once

EDGE = ["src_ip", "dst_ip", "dst_port", "protocol"]


@dataclass(frozen=True)
class Measure:
    """A column of one flow and how it adds up over flows."""

    value: Callable[[], Column]
    merge: Callable[[Column], Column] = F.sum


COMMON = {
    "connections": Measure(lambda: F.lit(1)),
    "packets": Measure(lambda: F.col("packet_count")),
    "bytes": Measure(lambda: F.col("byte_count")),
    "first_start": Measure(lambda: F.col("start_time"), F.min),
    "last_start": Measure(lambda: F.col("start_time"), F.max),
}


def single_flows(flows: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """Every flow as an edge of its own. Aggregates per grain read these or edges alike."""
    return flows.select(*EDGE, *[m.value().alias(name) for name, m in (COMMON | measures).items()])


def edges_of(flows: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """One row per edge. All measures have fixed size, so a hot edge is one row per task before the shuffle."""
    both = COMMON | measures
    return single_flows(flows, measures).groupBy(*EDGE).agg(*[m.merge(F.col(n)).alias(n) for n, m in both.items()])


def names_of(dns: DataFrame) -> DataFrame:
    """One row per name asked for, with its parent domain and counts."""
    size = F.col("response_size")
    return (
        dns.groupBy("query_name")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.count_if(F.col("query_type") == "TXT").alias("txt"),
            F.count_if(F.col("query_type") == "NULL").alias("null_type"),
            F.count_if(size > 0).alias("responses"),
            F.sum(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))).alias("response_bytes"),
            F.sum(F.length("query_name") + size).alias("payload_bytes"),
        )
        .withColumn("parent", names.registered_parent("query_name"))
    )


def _side_by_side(spark: SparkSession, jobs: list[Callable]) -> list:
    """Results of some driver calls that each run Spark jobs, submitted together."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


class Evidence:
    """The tables that rules read: the analysis's own, edges and names. ``keep`` is for what several rules read.

    Where edges are only added up further, every flow stands for an edge of its own: flows are stored with the columns that are
    ``added_up``, and none is shuffled for its edge.
    """

    def __init__(
        self, tables: Tables, measures: dict[str, Measure], store: Callable[[DataFrame], DataFrame] | None = None, added_up: tuple = ()
    ):
        self.tables, self.measures, self.store, self.added_up = tables, measures, store, added_up
        self.stored: list[DataFrame] = []

    def keep(self, rows: DataFrame) -> DataFrame:
        """``rows``, stored if this evidence stores and they aren't yet."""
        if self.store is None or any(rows is s for s in self.stored):
            return rows
        self.stored.append(self.store(rows))
        return self.stored[-1]

    @property
    def flows(self) -> DataFrame:
        return self.tables.flows

    @cached_property
    def edges(self) -> DataFrame:
        if self.added_up:
            return single_flows(self.keep(self.tables.flows.select(*EDGE, *self.added_up)), self.measures)
        return self.keep(edges_of(self.tables.flows, self.measures))

    @cached_property
    def names(self) -> DataFrame:
        return self.keep(names_of(self.tables.dns))


class LedgerDetector:
    """A detector whose rules are evaluated once, into tables per grain.

    ``measure(evidence)`` gives the tables, ``report(measured, evidence)`` the findings and ``affected(measured, evidence)``
    the addresses (``finding_id, detector, ip``). ``flow_measures`` are what it needs to know of flows per edge, ``reads``
    which of the shared tables it uses. ``adds_up`` names the columns of flows that it reads if it reads edges only to add them up,
    ``lists_once`` says that ``affected`` gives no pair twice.
    """

    reads = ("edges",)
    adds_up = ()
    lists_once = False

    def flow_measures(self) -> dict[str, Measure]:
        return {}

    def detect(self, tables: Tables) -> DataFrame:
        """Findings of this detector alone, planned without storing anything."""
        evidence = Evidence(tables, self.flow_measures(), added_up=self.adds_up)
        return self.report(self.measure(evidence), evidence)

    def addresses(self, tables: Tables) -> DataFrame:
        """Addresses of this detector's findings, planned without storing anything."""
        evidence = Evidence(tables, self.flow_measures(), added_up=self.adds_up)
        return self.affected(self.measure(evidence), evidence)


def rule_bits(**rules: Column) -> Column:
    """A number with bit i set where the i-th rule holds; a null condition does not hold."""
    bits = [F.when(holds, F.lit(1 << i)).otherwise(F.lit(0)) for i, holds in enumerate(rules.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def holding(rows: DataFrame, bit: int) -> DataFrame:
    """Rows of a ledger table for which a rule holds."""
    return rows.where(F.col("rules").bitwiseAND(F.lit(1 << bit)) > 0)


class Ledger:
    """All rules of some detectors, each evaluated once and stored in the checkpoint folder.

    Detectors don't wait for each other: their jobs are submitted side by side.
    """

    def __init__(self, tables: Tables, detectors: Iterable):
        self.detectors = list(detectors)
        measures: dict[str, Measure] = {}
        for d in self.detectors:
            measures |= d.flow_measures() if isinstance(d, LedgerDetector) else {}
        readers = [d for d in self.detectors if isinstance(d, LedgerDetector) and "edges" in d.reads]
        self.evidence = Evidence(tables, measures, write_once, added_up=readers[0].adds_up if len(readers) == 1 else ())
        used = {name for d in self.detectors if isinstance(d, LedgerDetector) for name in d.reads}
        present = [n for n, given in (("edges", tables.flows), ("names", tables.dns)) if n in used and given is not None]
        self.spark = (tables.flows if tables.flows is not None else tables.dns).sparkSession
        _side_by_side(self.spark, [lambda n=n: getattr(self.evidence, n) for n in present])
        self.measured = _side_by_side(self.spark, [lambda d=d: self._measure(d) for d in self.detectors])

    def _measure(self, detector) -> dict[str, DataFrame] | None:
        if not isinstance(detector, LedgerDetector):
            return None
        tables = detector.measure(self.evidence)
        stored = _side_by_side(self.spark, [lambda rows=rows: self.evidence.keep(rows) for rows in tables.values()])
        return dict(zip(tables, stored))

    def findings(self) -> DataFrame:
        """Findings of all detectors. Detectors without ledger tables are asked directly."""
        parts = [
            d.detect(self.evidence.tables) if m is None else d.report(m, self.evidence)
            for d, m in zip(self.detectors, self.measured)
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def addresses(self) -> DataFrame:
        """Every (finding, address) pair."""
        parts = [
            d.addresses(self.evidence.tables) if m is None else d.affected(m, self.evidence)
            for d, m in zip(self.detectors, self.measured)
        ]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        once = len({d.name for d in self.detectors}) == len(parts) and all(getattr(d, "lists_once", False) for d in self.detectors)
        return rows if once else rows.distinct()
