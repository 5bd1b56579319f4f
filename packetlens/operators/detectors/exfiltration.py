"""Data leaving the network: volume, direction ratio, unusual protocols, hosting services, off hours."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import names, net, text
from packetlens.operators.detectors.base import make_findings, register
from packetlens.operators.detectors.ledger import Evidence, LedgerDetector, Measure, holding, names_of, rule_bits, single_flows

MIB = 1024 * 1024


@register
@dataclass(frozen=True)
class ExfiltrationDetector(LedgerDetector):
    min_bytes: int = 10 * MIB
    large_bytes: int = 50 * MIB
    high_ratio: float = 10.0
    dns_bytes: int = MIB
    icmp_bytes: int = 100 * 1024
    off_hours_start: int = 22
    off_hours_end: int = 6

    name = "exfiltration"
    reads = ("edges", "names")
    adds_up = ("packet_count", "byte_count", "start_time")
    lists_once = True

    def flow_measures(self) -> dict[str, Measure]:
        late = lambda value, merge=F.sum: Measure(lambda: F.when(self.in_off_hours(F.col("start_time")), value()), merge)
        return {
            self._late("connections"): late(lambda: F.lit(1)),
            self._late("bytes"): late(lambda: F.col("byte_count")),
            self._late("packets"): late(lambda: F.col("packet_count")),
            self._late("first_start"): late(lambda: F.col("start_time"), F.min),
            self._late("last_start"): late(lambda: F.col("start_time"), F.max),
        }

    def _late(self, measure: str) -> str:
        """Name of a measure that counts off hours only; detectors with other hours have other names."""
        return f"{measure}_{self.off_hours_start}_{self.off_hours_end}"

    @staticmethod
    def _pairs(edges: DataFrame, *variants: Callable[[str], str]) -> DataFrame:
        """One row per external address and host that sent to it, with the number of flows. Their other measures add up without hosts."""
        flows = [F.sum(named("connections")).alias(named("flow_count")) for named in variants]
        return edges.where(net.is_outbound(mode="detector")).groupBy("dst_ip", "src_ip").agg(*flows)

    @staticmethod
    def _destinations(edges: DataFrame, pairs: DataFrame, *variants: Callable[[str], str]) -> DataFrame:
        """One row per external address, with what was sent and what came back. A pair is one source, so sources are counted without a distinct."""
        src_private = net.is_private("src_ip", "detector")
        dst_private = net.is_private("dst_ip", "detector")
        sent = edges.withColumn("_out", src_private & ~dst_private).where(F.col("_out") | (dst_private & ~src_private))
        out = F.col("_out")
        measures, sources = [], []
        for named in variants:
            when = lambda m: F.when(out, F.col(named(m)))  # noqa: B023, E731
            measures += [
                F.sum(when("connections")).alias(named("flow_count")),
                F.sum(when("packets")).alias(named("total_packets")),
                F.sum(when("bytes")).alias(named("bytes_out")),
                F.coalesce(F.sum(F.when(~out, F.col(named("bytes")))), F.lit(0)).alias(named("bytes_in")),
                F.min(when("first_start")).alias(named("first_start")),
                F.max(when("last_start")).alias(named("last_start")),
            ]
            sources.append(F.count(named("flow_count")).alias(named("source_count")))
        external = F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("dst_ip")
        return sent.groupBy(external).agg(*measures).join(pairs.groupBy("dst_ip").agg(*sources), "dst_ip")

    def _sets(self, edges: DataFrame, destinations: DataFrame, *variants: Callable[[str], str]) -> DataFrame:
        """``destinations`` with the ports and protocols used; sets are made for these destinations only, of each port and protocol once."""
        flows = [F.sum(named("connections")).alias(named("connections")) for named in variants]
        used = edges.where(net.is_outbound(mode="detector")).groupBy("dst_ip", "dst_port", "protocol").agg(*flows)
        sent = used.join(destinations.select("dst_ip"), "dst_ip", "left_semi")
        sets = [
            F.array_sort(F.collect_set(F.when(F.col(named("connections")).isNotNull(), F.col(c)))).alias(named(c + "s"))
            for named in variants
            for c in ("dst_port", "protocol")
        ]
        return destinations.join(sent.groupBy("dst_ip").agg(*sets), "dst_ip", "left")

    @staticmethod
    def _with_ratio(rows: DataFrame) -> DataFrame:
        return rows.withColumn("byte_ratio", net.byte_ratio("bytes_out", "bytes_in", both_zero=0.0))

    def destination_profiles(self, flows: DataFrame) -> DataFrame:
        """One row per external address that internal hosts sent to; both directions in one pass.

        Sources are counted as the one distinct aggregate; the port set is bounded by 65,535.
        """
        src_private = net.is_private("src_ip", "detector")
        dst_private = net.is_private("dst_ip", "detector")
        sent = flows.withColumn("_out", src_private & ~dst_private).where(
            F.col("_out") | (dst_private & ~src_private)
        )
        out = F.col("_out")
        found = (
            sent.groupBy(F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("dst_ip"))
            .agg(
                F.count(F.when(out, 1)).alias("flow_count"),
                F.count_distinct(F.when(out, F.col("src_ip"))).alias("source_count"),
                F.array_sort(F.collect_set(F.when(out, F.col("dst_port")))).alias("dst_ports"),
                F.array_sort(F.collect_set(F.when(out, F.col("protocol")))).alias("protocols"),
                F.sum(F.when(out, F.col("packet_count"))).alias("total_packets"),
                F.sum(F.when(out, F.col("byte_count"))).alias("bytes_out"),
                F.sum(F.when(out, 0).otherwise(F.col("byte_count"))).alias("bytes_in"),
                F.min(F.when(out, F.col("start_time"))).alias("first_start"),
                F.max(F.when(out, F.col("start_time"))).alias("last_start"),
            )
            .where(F.col("flow_count") > 0)
        )
        return self._with_ratio(found)

    def _sized(self, profiles: DataFrame) -> DataFrame:
        seconds = F.col("last_start") - F.col("first_start")
        rate = F.when(
            seconds > 0, F.try_divide(F.col("bytes_out") * F.lit(8.0), seconds * F.lit(1_000_000.0))
        ).otherwise(0.0)
        large = F.col("bytes_out") >= self.large_bytes
        return profiles.where(F.col("bytes_out") >= self.min_bytes).withColumns(
            {
                "duration_seconds": seconds,
                "rate_mbps": rate,
                "severity": F.when(large, "high").otherwise("medium"),
                "confidence": F.when(large, 0.7).otherwise(0.5),
            }
        )

    def large_transfers(self, flows: DataFrame) -> DataFrame:
        """Destinations that received 10 MiB or more."""
        return self._sized(self.destination_profiles(flows))

    def in_off_hours(self, time: Column) -> Column:
        """Between the evening and the morning hour, in UTC whatever the session time zone is."""
        hour = F.floor(F.pmod(time, F.lit(86400.0)) / 3600)
        return (hour >= self.off_hours_start) | (hour < self.off_hours_end)

    def off_hours_transfers(self, flows: DataFrame) -> DataFrame:
        """Large transfers counting only flows that started off hours."""
        return self._sized(self.destination_profiles(flows.where(self.in_off_hours(F.col("start_time")))))

    def _is_lopsided(self) -> Column:
        return (F.col("bytes_out") >= self.min_bytes) & (F.col("byte_ratio") >= self.high_ratio)

    def _ratio_measures(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "severity": F.when(F.col("byte_ratio") < 50, "medium").otherwise("high"),
                "confidence": F.least(F.lit(0.8), F.lit(0.4) + F.col("byte_ratio") / 100),
            }
        )

    def high_ratios(self, flows: DataFrame) -> DataFrame:
        """Destinations that got far more than they sent back."""
        return self._ratio_measures(self.destination_profiles(flows).where(self._is_lopsided()))

    def protocol_volumes(self, flows: DataFrame, dns: DataFrame) -> DataFrame:
        """DNS payload and ICMP bytes of the whole input, where above their thresholds."""
        return self._volumes(single_flows(flows, {}), names_of(dns))

    def _volumes(self, edges: DataFrame, per_name: DataFrame) -> DataFrame:
        dns_total = per_name.agg(
            F.lit("DNS").alias("protocol"),
            F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("total_bytes"),
            F.coalesce(F.sum("queries"), F.lit(0)).alias("item_count"),
        ).where(F.col("total_bytes") >= self.dns_bytes)
        icmp_total = (
            edges.where(F.col("protocol") == "ICMP")
            .agg(
                F.lit("ICMP").alias("protocol"),
                F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
                F.coalesce(F.sum("connections"), F.lit(0)).alias("item_count"),
            )
            .where(F.col("total_bytes") >= self.icmp_bytes)
        )
        return dns_total.unionByName(icmp_total).withColumn(
            "confidence", F.when(F.col("protocol") == "DNS", 0.75).otherwise(0.8)
        )

    def hosting_access(self, tls: DataFrame) -> DataFrame:
        """Connections per cloud or paste service. Names are counted before they are classified."""
        per_sni = tls.where(F.col("sni") != "").groupBy(F.lower("sni").alias("sni")).agg(F.count(F.lit(1)).alias("n"))
        return (
            per_sni.withColumn("domain", names.hosting_service("sni"))
            .where("domain IS NOT NULL")
            .groupBy("domain")
            .agg(F.sum("n").alias("connection_count"))
            .withColumn(
                "category", F.when(F.col("domain").isin(K.PASTE_DOMAINS), "paste_site").otherwise("cloud_storage")
            )
        )

    @staticmethod
    def _profile_indicators() -> dict[str, Column]:
        """Profile fields every destination rule reports. Equal fields let the rules share one aggregation."""
        c = F.col
        return {
            "destination_ip": c("dst_ip"),
            "total_bytes": c("bytes_out"),
            "outbound_inbound_ratio": F.bround("byte_ratio", 2),
            "ports": F.concat_ws(",", c("dst_ports").cast("array<string>")),
            "source_count": c("source_count"),
            "flow_count": c("flow_count"),
        }

    def _transfer_findings(self, rows: DataFrame, rule: str, title: str, note: str) -> DataFrame:
        c = F.col
        size = text.format_bytes("bytes_out", "binary_large")
        return make_findings(
            rows,
            self.name,
            rule,
            c("dst_ip"),
            c("severity"),
            c("confidence"),
            F.concat(F.lit(title + ": "), size, F.lit(" to "), c("dst_ip")),
            F.concat(
                size, F.lit(f" left for one external address{note} over "),
                F.format_string("%.0f", c("duration_seconds")), F.lit(" s ("),
                F.format_string("%.1f", c("rate_mbps")), F.lit(" Mbps) from "), c("source_count"), F.lit(" hosts."),
            ),
            affected_ips=F.array("dst_ip"),
            indicators=self._profile_indicators()
            | {"duration_seconds": F.bround("duration_seconds", 2), "rate_mbps": F.bround("rate_mbps", 2)},
            start=c("first_start"),
            end=c("last_start"),
            techniques=["T1048", "T1041"],
            display_filter=F.concat(F.lit("ip.dst == "), c("dst_ip")),
        )

    def _ratio_findings(self, rows: DataFrame) -> DataFrame:
        c = F.col
        ratio = F.when(c("byte_ratio") == float("inf"), "inf").otherwise(
            F.format_string("%.0f", F.bround("byte_ratio", 0))
        )
        return make_findings(
            self._ratio_measures(rows),
            self.name,
            "high_ratio",
            c("dst_ip"),
            c("severity"),
            c("confidence"),
            F.concat(F.lit("High Outbound Ratio: "), ratio, F.lit(":1 to "), c("dst_ip")),
            F.concat(F.lit("Hosts sent "), ratio, F.lit(" times what this address returned; downloads look the other way round.")),
            affected_ips=F.array("dst_ip"),
            indicators=self._profile_indicators(),
            start=c("first_start"),
            end=c("last_start"),
            techniques=["T1048", "T1041"],
            display_filter=F.concat(F.lit("ip.dst == "), c("dst_ip")),
        )

    def _protocol_findings(self, rows: DataFrame) -> DataFrame:
        c = F.col
        size = text.format_bytes("total_bytes", "binary_large")
        is_dns = c("protocol") == "DNS"
        return make_findings(
            rows,
            self.name,
            "protocol_volume",
            c("protocol"),
            F.lit("high"),
            c("confidence"),
            F.concat(F.lit("High "), c("protocol"), F.lit(" Data Volume: "), size),
            F.concat(size, F.lit(" moved over "), c("protocol"), F.lit(", which normally carries little data.")),
            indicators={
                "protocol": c("protocol"),
                "total_bytes": c("total_bytes"),
                "query_count": F.when(is_dns, c("item_count")),
                "flow_count": F.when(~is_dns, c("item_count")),
            },
            techniques=F.when(is_dns, F.array(F.lit("T1048.003"), F.lit("T1071.004"))).otherwise(
                F.array(F.lit("T1048.003"), F.lit("T1095"))
            ),
            display_filter=F.lower("protocol"),
        )

    def _hosting_findings(self, rows: DataFrame) -> DataFrame:
        c = F.col
        is_paste = c("category") == "paste_site"
        label = F.when(is_paste, "Paste Site").otherwise("Cloud Storage")
        return make_findings(
            rows,
            self.name,
            "hosting_access",
            c("domain"),
            F.lit("medium"),
            F.lit(0.6),
            F.concat(label, F.lit(" Access: "), c("domain")),
            F.concat(c("connection_count"), F.lit(" connections to "), c("domain"), F.lit(", a service data can be left at.")),
            indicators={
                "domain": c("domain"),
                "category": c("category"),
                "connection_count": c("connection_count"),
            },
            techniques=F.when(is_paste, F.array(F.lit("T1567"))).otherwise(F.array(F.lit("T1567.002"))),
            display_filter=F.concat(F.lit('tls.handshake.extensions_server_name contains "'), c("domain"), F.lit('"')),
        )

    def measure(self, evidence: Evidence) -> dict[str, DataFrame]:
        """Destinations by all their flows and by those off hours, volumes per protocol, and services."""
        pairs = evidence.keep(self._pairs(evidence.edges, str, self._late))
        judged = self._with_ratio(self._destinations(evidence.edges, pairs, str, self._late)).withColumn(
            "rules",
            rule_bits(
                large_transfer=F.col("bytes_out") >= self.min_bytes,
                off_hours_transfer=F.col(self._late("bytes_out")) >= self.min_bytes,
                high_ratio=self._is_lopsided(),
            ),
        )
        found = self._sets(evidence.edges, judged.where(F.col("rules") > 0), str, self._late)
        out = {"pair": pairs, "destination": found}
        if evidence.tables.dns is not None:
            out["protocol"] = self._volumes(evidence.edges, evidence.names)
        if evidence.tables.tls is not None:
            out["service"] = self.hosting_access(evidence.tables.tls)
        return out

    def _off_hours(self, destinations: DataFrame) -> DataFrame:
        """The destinations of the off-hours rule, with their off-hours measures under the common names."""
        shared = ["flow_count", "source_count", "dst_ports", "protocols", "total_packets", "bytes_out", "bytes_in", "first_start", "last_start"]
        rows = holding(destinations, 1).select("dst_ip", *[F.col(self._late(m)).alias(m) for m in shared])
        return self._with_ratio(rows)

    def report(self, measured: dict[str, DataFrame], evidence: Evidence) -> DataFrame:
        destinations = measured["destination"]
        parts = [
            self._transfer_findings(self._sized(holding(destinations, 0)), "large_transfer", "Large Transfer", ""),
            self._transfer_findings(
                self._sized(self._off_hours(destinations)), "off_hours_transfer", "Off-Hours Transfer", " outside working hours"
            ),
            self._ratio_findings(holding(destinations, 2)),
        ]
        if "protocol" in measured:
            parts.append(self._protocol_findings(measured["protocol"]))
        if "service" in measured:
            parts.append(self._hosting_findings(measured["service"]))
        return reduce(DataFrame.unionByName, parts)

    def affected(self, measured: dict[str, DataFrame], evidence: Evidence) -> DataFrame:
        """The destination of every rule and the hosts that sent to it; off hours, those that sent then."""
        late = F.col(self._late("flow_count")).isNotNull()

        def per_rule(rows: DataFrame, in_late: Column, ip: str) -> DataFrame:
            held = F.array_compact(
                F.array(
                    F.when(F.col("rules").bitwiseAND(F.lit(1)) > 0, F.lit("large_transfer")),
                    F.when((F.col("rules").bitwiseAND(F.lit(2)) > 0) & in_late, F.lit("off_hours_transfer")),
                    F.when(F.col("rules").bitwiseAND(F.lit(4)) > 0, F.lit("high_ratio")),
                )
            )
            return rows.select("dst_ip", F.col(ip).alias("ip"), F.explode(held).alias("rule"))

        destinations = measured["destination"]
        hosts = measured["pair"].select("dst_ip", "src_ip", late.alias("late")).join(destinations.select("dst_ip", "rules"), "dst_ip")
        # Hosts are internal and destinations external: no address is both.
        rows = per_rule(hosts, F.col("late"), "src_ip").unionAll(per_rule(destinations, F.lit(True), "dst_ip"))
        key = F.md5(F.concat_ws("|", F.lit(self.name), F.col("rule"), F.col("dst_ip"))).alias("finding_id")
        return rows.select(key, F.lit(self.name).alias("detector"), "ip")
