"""Regular call-backs: flow starts of one source, destination and port at near-equal gaps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import net
from packetlens.operators.detectors.base import listed_addresses, make_findings, register
from packetlens.operators.detectors.ledger import EDGE, Evidence, LedgerDetector
from packetlens.operators.timing import gap_statistics


@register
@dataclass(frozen=True)
class BeaconDetector(LedgerDetector):
    min_connections: int = 10
    max_jitter: float = 0.15
    known_intervals: tuple[int, ...] = (30, 60, 120, 180, 300, 600, 900, 1800, 3600)
    interval_tolerance: float = 0.1
    min_duration: float = 300.0
    min_regularity: float = 0.7

    name = "beacon"

    def candidates(self, flows: DataFrame) -> DataFrame:
        """Groups with enough flows over enough time, with their gap statistics."""
        outside = flows.where(~net.is_internal(mode="detector"))
        stats = gap_statistics(
            outside,
            EDGE,
            "start_time",
            sums={"packet_count": F.col("packet_count"), "byte_count": F.col("byte_count")},
            whole=0,  # Flows are costlier to read again than their few groups are to merge.
        )
        span = F.col("last_time") - F.col("first_time")
        return stats.where((F.col("event_count") >= self.min_connections) & (span >= self.min_duration)).withColumn(
            "duration_seconds", span
        )

    def known_interval(self, mean: Column) -> Column:
        """The first usual interval within tolerance of the mean."""
        low, high = 1 - self.interval_tolerance, 1 + self.interval_tolerance
        return F.coalesce(*[F.when(mean.between(k * low, k * high), F.lit(k)) for k in self.known_intervals])

    @staticmethod
    def confidence(regularity: Column, intervals: Column, seconds: Column, known: Column) -> Column:
        """Half the regularity, plus steps for evidence, time span and a usual interval."""
        evidence = F.when(intervals >= 100, 0.2).when(intervals >= 50, 0.15).when(intervals >= 20, 0.1).otherwise(0.05)
        span = F.when(seconds >= 3600, 0.15).when(seconds >= 1800, 0.1).when(seconds >= 600, 0.05).otherwise(0.0)
        usual = F.when(known.isNotNull(), 0.15).otherwise(0.0)
        return F.least(F.lit(1.0), regularity * 0.5 + evidence + span + usual)

    def beacons(self, flows: DataFrame) -> DataFrame:
        """Regular groups with typed measures."""
        groups = self.candidates(flows).where((F.col("event_count") >= 3) & (F.col("mean_gap") > 0))
        scored = groups.withColumn("cv", F.col("stdev_samp") / F.col("mean_gap")).where(
            F.col("cv") <= self.max_jitter
        )
        scored = scored.withColumn(
            "regularity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cv") / self.max_jitter))
        ).where(F.col("regularity") >= self.min_regularity)
        scored = scored.withColumn("known_interval", self.known_interval(F.col("mean_gap")))
        scored = scored.withColumn(
            "confidence",
            self.confidence(
                F.col("regularity"), F.col("event_count") - 1, F.col("duration_seconds"), F.col("known_interval")
            ),
        )
        return scored.withColumn(
            "severity",
            F.when((F.col("confidence") >= 0.9) & F.col("known_interval").isNotNull(), "high")
            .when(F.col("confidence") >= 0.7, "medium")
            .otherwise("low"),
        )

    def measure(self, evidence: Evidence) -> dict[str, DataFrame]:
        """Beacons per edge. Gaps are taken only on edges with enough connections over enough time."""
        edges = evidence.edges
        long_enough = F.col("last_start") - F.col("first_start") >= self.min_duration
        open_edges = edges.where(
            ~net.is_internal(mode="detector") & (F.col("connections") >= self.min_connections) & long_enough
        ).select(*EDGE)
        flows, wanted = evidence.flows.alias("f"), open_edges.alias("e")
        same = reduce(lambda a, b: a & b, [F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}")) for k in EDGE])
        return {"edge": self.beacons(flows.join(wanted, same, "left_semi"))}

    def report(self, measured: dict[str, DataFrame], evidence: Evidence) -> DataFrame:
        rows = measured["edge"]
        c = F.col
        port = F.coalesce(c("dst_port").cast("string"), F.lit("None"))
        proto = F.when(c("protocol") == "TCP", "tcp").otherwise("udp")
        known = F.when(c("known_interval").isNotNull(), F.concat(F.lit("; usual interval "), c("known_interval"), F.lit(" s")))
        return make_findings(
            rows,
            self.name,
            "beacon",
            F.concat_ws("|", c("src_ip"), c("dst_ip"), port, c("protocol")),
            c("severity"),
            c("confidence"),
            F.concat(F.lit("C2 Beacon Pattern: "), c("src_ip"), F.lit(" → "), c("dst_ip"), F.lit(":"), port),
            F.concat(
                c("event_count"), F.lit(" connections about every "), F.format_string("%.1f", c("mean_gap")),
                F.lit(" s (deviation "), F.format_string("%.1f", c("stdev_samp")), F.lit(" s, regularity "),
                F.format_string("%.1f%%", c("regularity") * 100), F.lit(")"), F.coalesce(known, F.lit("")),
                F.lit("; such even spacing points to an automated call-back."),
            ),
            affected_ips=F.array("src_ip", "dst_ip"),
            affected_flows=F.array(
                F.concat(c("src_ip"), F.lit("->"), c("dst_ip"), F.lit(":"), port, F.lit("/"), c("protocol"))
            ),
            indicators={
                "src_ip": c("src_ip"),
                "dst_ip": c("dst_ip"),
                "dst_port": c("dst_port"),
                "mean_interval": F.bround("mean_gap", 2),
                "stdev_interval": F.bround("stdev_samp", 2),
                "coefficient_of_variation": F.bround("cv", 4),
                "regularity_score": F.bround("regularity", 4),
                "connection_count": c("event_count"),
                "duration_seconds": F.bround("duration_seconds", 2),
                "matched_known_interval": c("known_interval"),
                "packet_count": c("packet_count"),
                "byte_count": c("byte_count"),
            },
            start=c("first_time"),
            end=c("last_time"),
            techniques=["T1071", "T1571"],
            display_filter=F.concat(
                F.lit("ip.src == "), c("src_ip"), F.lit(" && ip.dst == "), c("dst_ip"), F.lit(" && "), proto,
                F.lit(".dstport == "), port,
            ),
        )

    def affected(self, measured: dict[str, DataFrame], evidence: Evidence) -> DataFrame:
        return listed_addresses(self.report(measured, evidence))
