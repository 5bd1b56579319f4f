"""Data carried in DNS names: random, long or numerous subdomains, unusual record types, known tools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.functions import in_place, names
from packetlens.operators.detectors.base import finding_key, listed_addresses, make_findings, register
from packetlens.operators.detectors.ledger import Evidence, LedgerDetector, names_of
from packetlens.operators.ranking import top_per_key


@register
@dataclass(frozen=True)
class DnsTunnelDetector(LedgerDetector):
    min_entropy: float = 3.5
    many_subdomains: int = 20
    long_subdomain: float = 30.0
    min_queries: int = 3
    txt_share: float = 0.3
    min_points: int = 35

    name = "dns_tunnel"
    reads = ("names",)
    lists_once = True

    def subdomains(self, per_name: DataFrame) -> DataFrame:
        """One row per parent and subdomain. Entropy is computed here, once per distinct subdomain."""
        named = per_name.where(in_place(F.col("parent").isNotNull()))
        named = named.withColumn("subdomain", names.subdomain_under("query_name", "parent"))
        sums = ["queries", "txt", "null_type", "responses", "response_bytes"]
        return (
            named.groupBy("parent", "subdomain")
            .agg(*[F.sum(s).alias(s) for s in sums])
            .withColumns(
                {
                    "entropy": F.when(F.col("subdomain").isNotNull(), names.entropy("subdomain")),
                    "sub_length": F.length("subdomain"),
                }
            )
        )

    def domain_profiles(self, dns: DataFrame) -> DataFrame:
        """One row per parent: volumes, mean entropy per query, mean length per distinct subdomain."""
        return self._profiles(self.subdomains(names_of(dns)))

    @staticmethod
    def _profiles(subdomains: DataFrame) -> DataFrame:
        with_sub = F.col("subdomain").isNotNull()
        return (
            subdomains.groupBy("parent")
            .agg(
                F.sum("queries").alias("query_count"),
                F.count("subdomain").alias("unique_subdomains"),
                F.sum(F.when(with_sub, F.col("entropy") * F.col("queries"))).alias("_entropy_sum"),
                F.sum(F.when(with_sub, F.col("queries"))).alias("_entropy_n"),
                F.avg("sub_length").alias("avg_subdomain_length"),
                F.coalesce(F.max("sub_length"), F.lit(0)).alias("max_subdomain_length"),
                F.sum("txt").alias("txt_query_count"),
                F.sum("null_type").alias("null_query_count"),
                F.sum("responses").alias("response_count"),
                F.sum("response_bytes").alias("response_bytes"),
            )
            .withColumns(
                {
                    "avg_entropy": F.coalesce(F.try_divide("_entropy_sum", "_entropy_n"), F.lit(0.0)),
                    "avg_subdomain_length": F.coalesce("avg_subdomain_length", F.lit(0.0)),
                    "txt_ratio": F.col("txt_query_count") / F.col("query_count"),
                }
            )
            .drop("_entropy_sum", "_entropy_n")
        )

    def scored(self, dns: DataFrame) -> DataFrame:
        """Profiles with points in whole hundredths, so thresholds are compared exactly."""
        return self._scored(self.domain_profiles(dns))

    def _scored(self, profiles: DataFrame) -> DataFrame:
        points = (
            F.when(F.col("avg_entropy") >= self.min_entropy, 30).otherwise(0)
            + F.when(F.col("unique_subdomains") >= self.many_subdomains, 25).otherwise(0)
            + F.when(F.col("avg_subdomain_length") >= self.long_subdomain, 20).otherwise(0)
            + F.when(F.col("txt_ratio") >= self.txt_share, 15).otherwise(0)
            + F.when(F.col("null_query_count") > 0, 10).otherwise(0)
        )
        kept = (F.col("query_count") >= self.min_queries) & ~names.has_benign_suffix("parent")
        return profiles.where(in_place(kept)).withColumn("points", points)

    def tunnels(self, dns: DataFrame) -> DataFrame:
        """Parents with enough points."""
        return self._tunnels(self.scored(dns))

    def _tunnels(self, scored: DataFrame) -> DataFrame:
        return (
            scored.where(F.col("points") >= self.min_points)
            .withColumns(
                {
                    "confidence": F.least(F.lit(100), F.col("points") + 20) / 100.0,
                    "severity": F.when(F.col("points") >= 70, "high")
                    .when(F.col("points") >= 50, "medium")
                    .otherwise("low"),
                }
            )
        )

    def highest_entropies(self, dns: DataFrame, parents: DataFrame) -> DataFrame:
        """The three highest query entropies of the given parents, one array per parent."""
        return self._highest(self.subdomains(names_of(dns)), parents)

    @staticmethod
    def _highest(subdomains: DataFrame, parents: DataFrame) -> DataFrame:
        subs = subdomains.where("subdomain IS NOT NULL").select("parent", "subdomain", "entropy", "queries")
        subs = subs.join(parents.select("parent"), "parent", "left_semi")
        best = top_per_key(subs, ["parent"], [F.col("entropy").desc(), F.col("subdomain")], 3)
        repeated = F.array_repeat(F.col("entropy"), F.least(F.col("queries"), F.lit(3)).cast("int"))
        values = F.sort_array(F.flatten(F.collect_list(repeated)), asc=False)
        return best.groupBy("parent").agg(F.slice(values, 1, 3).alias("highest_entropies"))

    def known_tools(self, dns: DataFrame) -> DataFrame:
        """Queries per tunnel tool, with the first five distinct names."""
        return self._tools(names_of(dns))

    @staticmethod
    def _tools(per_name: DataFrame) -> DataFrame:
        hits = per_name.withColumn("tool", F.explode(names.tunnel_tools("query_name")))
        counts = hits.groupBy("tool").agg(F.sum("queries").alias("match_count"))
        first = top_per_key(hits, ["tool"], [F.col("query_name")], 5)
        samples = first.groupBy("tool").agg(F.array_sort(F.collect_list("query_name")).alias("sample_queries"))
        return counts.join(samples, "tool")

    def _tunnel_findings(self, rows: DataFrame) -> DataFrame:
        c = F.col
        reasons = F.concat_ws(
            "; ",
            F.when(c("avg_entropy") >= self.min_entropy, F.format_string("mean subdomain entropy %.2f bits", c("avg_entropy"))),
            F.when(c("unique_subdomains") >= self.many_subdomains, F.format_string("%d distinct subdomains", c("unique_subdomains"))),
            F.when(c("avg_subdomain_length") >= self.long_subdomain, F.format_string("mean subdomain length %.0f", c("avg_subdomain_length"))),
            F.when(c("txt_ratio") >= self.txt_share, F.format_string("TXT share %.1f%%", c("txt_ratio") * 100)),
            F.when(c("null_query_count") > 0, F.format_string("%d NULL queries", c("null_query_count"))),
        )
        return make_findings(
            rows,
            self.name,
            "tunnel",
            c("parent"),
            c("severity"),
            c("confidence"),
            F.concat(F.lit("DNS Tunnel Suspected: "), c("parent")),
            F.concat(F.lit("Names under "), c("parent"), F.lit(" look like encoded data: "), reasons, F.lit(".")),
            indicators={
                "domain": c("parent"),
                "query_count": c("query_count"),
                "unique_subdomains": c("unique_subdomains"),
                "avg_entropy": F.when(c("avg_entropy") >= self.min_entropy, F.bround("avg_entropy", 3)),
                "avg_subdomain_length": F.when(
                    c("avg_subdomain_length") >= self.long_subdomain, F.bround("avg_subdomain_length", 1)
                ),
                "txt_query_ratio": F.when(c("txt_ratio") >= self.txt_share, F.bround("txt_ratio", 3)),
                "null_query_count": F.when(c("null_query_count") > 0, c("null_query_count")),
                "sample_high_entropy_values": c("highest_entropies"),
            },
            techniques=["T1071.004", "T1048.003"],
            display_filter=F.concat(F.lit('dns.qry.name contains "'), c("parent"), F.lit('"')),
        )

    def _tool_findings(self, rows: DataFrame) -> DataFrame:
        c = F.col
        return make_findings(
            rows,
            self.name,
            "tool",
            c("tool"),
            F.lit("critical"),
            F.lit(0.95),
            F.concat(F.lit("Known DNS Tunnel Tool Detected: "), c("tool")),
            F.concat(c("match_count"), F.lit(" queries carry the label of "), c("tool"), F.lit(", for example "),
                     F.array_join("sample_queries", ", "), F.lit(".")),
            indicators={
                "tool": c("tool"),
                "match_count": c("match_count"),
                "sample_queries": F.array_join("sample_queries", ","),
            },
            techniques=["T1071.004", "T1048.003", "T1572"],
            display_filter=F.concat(F.lit('dns.qry.name contains "'), c("tool"), F.lit('"')),
        )

    def measure(self, evidence: Evidence) -> dict[str, DataFrame]:
        """Tunnels per parent domain, with their highest entropies, and queries per tool."""
        subs = evidence.keep(self.subdomains(evidence.names))
        found = self._tunnels(self._scored(self._profiles(subs)))
        return {
            "parent": found.join(self._highest(subs, found), "parent", "left"),
            "tool": self._tools(evidence.names),
        }

    def report(self, measured: dict[str, DataFrame], evidence: Evidence) -> DataFrame:
        return self._tunnel_findings(measured["parent"]).unionByName(self._tool_findings(measured["tool"]))

    def affected(self, measured: dict[str, DataFrame], evidence: Evidence) -> DataFrame:
        """Who asked for names under a tunnel's parent. Parents are found per name, not per query."""
        under = evidence.names.select("query_name", "parent").join(measured["parent"].select("parent"), "parent", "left_semi")
        asked = evidence.tables.dns.where(F.coalesce(F.col("src_ip"), F.lit("")) != "").join(under, "query_name")
        long_form = asked.select("parent", F.col("src_ip").alias("ip")).distinct().select(
            finding_key(self.name, "tunnel", F.col("parent")).alias("finding_id"),
            F.lit(self.name).alias("detector"),
            "ip",
        )
        return long_form.unionByName(listed_addresses(self._tool_findings(measured["tool"])))
