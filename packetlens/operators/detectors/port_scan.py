"""Scanning: many hosts, many ports, unanswered connections, or many connections in a minute."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.operators.detectors.base import make_findings, register
from packetlens.operators.detectors.ledger import Evidence, LedgerDetector, Measure, holding, rule_bits, single_flows
from packetlens.operators.ranking import top_per_key
from packetlens.operators.timing import first_busy_window


def sequential_runs(ports: Column) -> Column:
    """Number of maximal runs of consecutive ports, at least two long, in a sorted distinct array."""

    def starts_run(port, i):
        follows = F.get(ports, i + 1) == port + 1
        preceded = F.coalesce((i > 0) & (F.get(ports, F.greatest(i - 1, F.lit(0))) == port - 1), F.lit(False))
        return F.coalesce(follows, F.lit(False)) & ~preceded

    return F.size(F.filter(ports, starts_run))


@register
@dataclass(frozen=True)
class PortScanDetector(LedgerDetector):
    min_hosts: int = 10
    min_ports: int = 20
    unanswered_share: float = 0.8
    min_connections: int = 15
    rapid_window: int = 60
    rapid_connections: int = 50
    listed_hosts: int = 20

    name = "port_scan"

    def flow_measures(self) -> dict[str, Measure]:
        failed = lambda: ((F.col("packet_count") <= 3) & (F.col("byte_count") < 200)).cast("int")
        return {"failed": Measure(failed)}

    def profiles(self, flows: DataFrame) -> DataFrame:
        """One row per TCP source. Hosts are the one distinct count; the port set has at most 65,535 entries."""
        found = self._sources(single_flows(flows, self.flow_measures()))
        return found.where(F.col("total_connections") >= self.min_connections)

    @staticmethod
    def _sources(edges: DataFrame) -> DataFrame:
        return (
            edges.where(F.col("protocol") == "TCP")
            .groupBy("src_ip")
            .agg(
                F.count_distinct("dst_ip").alias("unique_hosts"),
                F.array_sort(F.collect_set("dst_port")).alias("ports"),
                F.sum("connections").alias("total_connections"),
                F.sum("failed").alias("failed_connections"),
                F.min("first_start").alias("first_start"),
                F.max("last_start").alias("last_start"),
            )
            .withColumns(
                {
                    "unique_ports": F.size("ports").cast("bigint"),
                    "failure_rate": F.col("failed_connections") / F.col("total_connections"),
                }
            )
        )

    def _is_horizontal(self) -> Column:
        hosts, ports = F.col("unique_hosts"), F.col("unique_ports")
        return (hosts >= self.min_hosts) & (ports <= 5) & (hosts / F.greatest(ports, F.lit(1)) >= 3)

    def _is_vertical(self) -> Column:
        return (F.col("unique_ports") >= self.min_ports) & (F.col("unique_hosts") <= 3)

    def _is_stealth(self) -> Column:
        return (F.col("failed_connections") > 0) & (F.col("failure_rate") >= self.unanswered_share)

    @staticmethod
    def _banded(rows: DataFrame, size: str) -> DataFrame:
        n = F.col(size)
        return rows.withColumns(
            {
                "severity": F.when(n >= 100, "high").when(n >= 50, "medium").otherwise("low"),
                "confidence": F.when(n >= 100, 0.85).when(n >= 50, 0.75).otherwise(0.6),
            }
        )

    def horizontal(self, flows: DataFrame) -> DataFrame:
        """Many hosts on few ports."""
        return self._banded(self.profiles(flows).where(self._is_horizontal()), "unique_hosts")

    def targeted_ports(self, flows: DataFrame, n: int = 5) -> DataFrame:
        """The n ports of each source that reach most hosts."""
        per_port = (
            flows.where(F.col("protocol") == "TCP")
            .groupBy("src_ip", "dst_port")
            .agg(F.count_distinct("dst_ip").alias("hosts"))
        )
        return top_per_key(per_port, ["src_ip"], [F.col("hosts").desc(), F.col("dst_port")], n)

    def _vertical_measures(self, rows: DataFrame) -> DataFrame:
        sensitive = F.array(*[F.lit(p) for p in K.SENSITIVE_PORTS])
        return self._banded(rows, "unique_ports").withColumns(
            {
                "sequential_runs": sequential_runs(F.col("ports")),
                "min_port": F.array_min("ports"),
                "max_port": F.array_max("ports"),
                "sensitive_ports_hit": F.array_intersect("ports", sensitive),
            }
        )

    def vertical(self, flows: DataFrame) -> DataFrame:
        """Many ports on few hosts."""
        return self._vertical_measures(self.profiles(flows).where(self._is_vertical()))

    def _stealth_measures(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("confidence", F.least(F.lit(0.9), F.lit(0.5) + F.col("failure_rate") * 0.4))

    def stealth(self, flows: DataFrame) -> DataFrame:
        """Mostly unanswered connections."""
        return self._stealth_measures(self.profiles(flows).where(self._is_stealth()))

    def _windows(self, flows: DataFrame) -> DataFrame:
        tcp = flows.where(F.col("protocol") == "TCP")
        return first_busy_window(tcp, "src_ip", "start_time", self.rapid_window, self.rapid_connections)

    def _rapid_measures(self, rows: DataFrame) -> DataFrame:
        n = F.col("events_in_window")
        return rows.withColumns(
            {
                "rate_per_second": n / self.rapid_window,
                "confidence": F.least(F.lit(0.85), F.lit(0.5) + n / 200),
            }
        )

    def rapid(self, flows: DataFrame) -> DataFrame:
        """The first minute in which a source opened 50 connections."""
        return self._rapid_measures(self._windows(flows))

    def measure(self, evidence: Evidence) -> dict[str, DataFrame]:
        """Scanning sources. Windows are counted only for sources with enough connections in all."""
        edges = evidence.edges.where(F.col("protocol") == "TCP")
        sources = evidence.keep(
            self._sources(edges).where(F.col("total_connections") >= min(self.min_connections, self.rapid_connections))
        )
        busy = sources.where(F.col("total_connections") >= self.rapid_connections).select("src_ip")
        windows = self._windows(evidence.flows.join(busy, "src_ip", "left_semi"))
        enough = F.col("total_connections") >= self.min_connections
        horizontal, vertical = enough & self._is_horizontal(), enough & self._is_vertical()
        # What reports list of the targets: the first hosts in text order, and the ports that reach most hosts.
        tried = edges.join(sources.where(horizontal | vertical).select("src_ip"), "src_ip", "left_semi")
        first = top_per_key(tried.select("src_ip", "dst_ip").distinct(), ["src_ip"], [F.col("dst_ip")], self.listed_hosts)
        hosts = first.groupBy("src_ip").agg(F.array_sort(F.collect_list("dst_ip")).alias("hosts"))
        # An edge is one host on one port, so counting edges counts hosts.
        per_port = tried.groupBy("src_ip", "dst_port").agg(F.count(F.lit(1)).alias("hosts"))
        ranked = top_per_key(per_port, ["src_ip"], [F.col("hosts").desc(), F.col("dst_port")], 5)
        listed = F.array_sort(F.collect_list(F.struct("key_rank", "dst_port", "hosts")))
        top = ranked.groupBy("src_ip").agg(
            F.array_join(
                F.transform(listed, lambda s: F.concat(s["dst_port"].cast("string"), F.lit(":"), s["hosts"].cast("string"))), ","
            ).alias("top_ports")
        )
        judged = sources.join(windows, "src_ip", "left").withColumn(
            "rules",
            rule_bits(
                horizontal=horizontal,
                vertical=vertical,
                stealth=enough & self._is_stealth(),
                rapid=F.col("events_in_window").isNotNull(),
            ),
        )
        found = judged.where(F.col("rules") > 0)
        return {"source": found.join(hosts, "src_ip", "left").join(top, "src_ip", "left")}

    def _horizontal_findings(self, sources: DataFrame) -> DataFrame:
        c = F.col
        rows = self._banded(holding(sources, 0), "unique_hosts")
        return make_findings(
            rows,
            self.name,
            "horizontal",
            c("src_ip"),
            c("severity"),
            c("confidence"),
            F.concat(F.lit("Horizontal Scan: "), c("src_ip"), F.lit(" → "), c("unique_hosts"), F.lit(" hosts")),
            F.concat(
                c("src_ip"), F.lit(" contacted "), c("unique_hosts"), F.lit(" hosts on ports "),
                F.array_join(c("ports").cast("array<string>"), ", "), F.lit(" in "), c("total_connections"),
                F.lit(" connections, a search for one service."),
            ),
            affected_ips=F.concat(F.array("src_ip"), F.coalesce("hosts", F.array().cast("array<string>"))),
            indicators={
                "scan_type": F.lit("horizontal"),
                "source_ip": c("src_ip"),
                "unique_hosts": c("unique_hosts"),
                "unique_ports": c("unique_ports"),
                "total_connections": c("total_connections"),
                "failure_rate": F.bround("failure_rate", 3),
                "top_ports": c("top_ports"),
            },
            start=c("first_start"),
            end=c("last_start"),
            techniques=["T1046", "T1018"],
            display_filter=F.concat(F.lit("ip.src == "), c("src_ip"), F.lit(" && tcp.flags.syn == 1")),
        )

    def _vertical_findings(self, sources: DataFrame) -> DataFrame:
        c = F.col
        rows = self._vertical_measures(holding(sources, 1)).withColumn("hosts", F.slice("hosts", 1, 5))
        return make_findings(
            rows,
            self.name,
            "vertical",
            c("src_ip"),
            c("severity"),
            c("confidence"),
            F.concat(F.lit("Vertical Scan: "), c("src_ip"), F.lit(" → "), c("unique_ports"), F.lit(" ports")),
            F.concat(
                c("src_ip"), F.lit(" tried "), c("unique_ports"), F.lit(" ports between "), c("min_port"),
                F.lit(" and "), c("max_port"), F.lit(" on "), F.array_join("hosts", ", "), F.lit(" ("),
                c("sequential_runs"), F.lit(" runs of consecutive ports)."),
            ),
            affected_ips=F.concat(F.array("src_ip"), c("hosts")),
            indicators={
                "scan_type": F.lit("vertical"),
                "source_ip": c("src_ip"),
                "target_hosts": F.array_join("hosts", ","),
                "unique_ports": c("unique_ports"),
                "port_range": F.concat(c("min_port"), F.lit("-"), c("max_port")),
                "sequential_runs": c("sequential_runs"),
                "sensitive_ports_hit": F.array_join(F.col("sensitive_ports_hit").cast("array<string>"), ","),
                "total_connections": c("total_connections"),
                "failure_rate": F.bround("failure_rate", 3),
            },
            start=c("first_start"),
            end=c("last_start"),
            techniques=["T1046"],
            display_filter=F.concat(
                F.lit("ip.src == "), c("src_ip"), F.lit(" && ip.dst == "), F.get("hosts", F.lit(0))
            ),
        )

    def _stealth_findings(self, sources: DataFrame) -> DataFrame:
        c = F.col
        return make_findings(
            self._stealth_measures(holding(sources, 2)),
            self.name,
            "stealth",
            c("src_ip"),
            F.lit("medium"),
            c("confidence"),
            F.concat(F.lit("Stealth Scan: "), c("src_ip"), F.lit(" ("), c("failed_connections"), F.lit(" SYN-only)")),
            F.concat(c("failed_connections"), F.lit(" of "), c("total_connections"),
                     F.lit(" connections carried almost nothing, as half-open probes do.")),
            affected_ips=F.array("src_ip"),
            indicators={
                "scan_type": F.lit("stealth_syn"),
                "source_ip": c("src_ip"),
                "syn_only_count": c("failed_connections"),
                "syn_ratio": F.bround("failure_rate", 3),
                "total_connections": c("total_connections"),
                "unique_hosts": c("unique_hosts"),
                "unique_ports": c("unique_ports"),
            },
            start=c("first_start"),
            end=c("last_start"),
            techniques=["T1046"],
            display_filter=F.concat(
                F.lit("ip.src == "), c("src_ip"), F.lit(" && tcp.flags.syn == 1 && tcp.flags.ack == 0")
            ),
        )

    def _rapid_findings(self, sources: DataFrame) -> DataFrame:
        c = F.col
        return make_findings(
            self._rapid_measures(holding(sources, 3)),
            self.name,
            "rapid",
            c("src_ip"),
            F.lit("medium"),
            c("confidence"),
            F.concat(F.lit("Rapid Scan: "), c("src_ip"), F.lit(" ("),
                     F.format_string("%.0f", F.bround("rate_per_second", 0)), F.lit("/sec)")),
            F.concat(c("events_in_window"), F.lit(f" connections opened within {self.rapid_window} s.")),
            affected_ips=F.array("src_ip"),
            indicators={
                "scan_type": F.lit("rapid"),
                "source_ip": c("src_ip"),
                "connections_in_window": c("events_in_window"),
                "window_seconds": F.lit(self.rapid_window),
                "rate_per_second": F.bround("rate_per_second", 2),
            },
            techniques=["T1046"],
            display_filter=F.concat(F.lit("ip.src == "), c("src_ip")),
        )

    def report(self, measured: dict[str, DataFrame], evidence: Evidence) -> DataFrame:
        sources = measured["source"]
        return reduce(
            DataFrame.unionByName,
            [
                self._horizontal_findings(sources),
                self._vertical_findings(sources),
                self._stealth_findings(sources),
                self._rapid_findings(sources),
            ],
        )

    def affected(self, measured: dict[str, DataFrame], evidence: Evidence) -> DataFrame:
        """The scanner of every rule, and every host that a horizontal or vertical scan tried."""
        rules = ("horizontal", "vertical", "stealth", "rapid")
        keyed = [F.when(F.col("rules").bitwiseAND(F.lit(1 << i)) > 0, F.lit(rule)) for i, rule in enumerate(rules)]
        held = measured["source"].select("src_ip", F.explode(F.array_compact(F.array(*keyed))).alias("rule"))
        tried = evidence.edges.where(F.col("protocol") == "TCP").select("src_ip", "dst_ip").distinct()
        hosts = held.where(F.col("rule").isin("horizontal", "vertical")).join(tried, "src_ip")
        both = held.withColumn("ip", F.col("src_ip")).unionAll(hosts.select("src_ip", "rule", "dst_ip"))
        key = F.md5(F.concat_ws("|", F.lit(self.name), F.col("rule"), F.col("src_ip"))).alias("finding_id")
        return both.select(key, F.lit(self.name).alias("detector"), "ip")
