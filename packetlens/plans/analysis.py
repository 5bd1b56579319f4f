"""Whole analyses over a set of tables: statistics, findings, indicators, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.operators import anomalies, filters, indicators, intel, stats
from packetlens.operators.cache import CachedLookups, enrich_with_cache
from packetlens.operators.detectors import evaluate
from packetlens.operators.flows import Tables, all_addresses, all_domains, build_conversations, build_flows
from packetlens.sources.decode import dns_of, packets_of, tls_of
from packetlens.session import cut_lineage
from packetlens.sources.lists import legit_domain_list


def tables_from_packets(packets: DataFrame, dns: DataFrame | None = None, tls: DataFrame | None = None) -> Tables:
    """Flows and conversations planned over a packet table."""
    return Tables(packets, build_flows(packets), build_conversations(packets), dns, tls)


def tables_from_decoded(decoded: DataFrame) -> Tables:
    """All tables planned over a written decode result."""
    return tables_from_packets(packets_of(decoded), dns_of(decoded), tls_of(decoded))


def load_tables(spark: SparkSession, path: str) -> Tables:
    """Tables previously written below ``path`` as parquet, each under its own name."""
    return Tables(*[spark.read.parquet(f"{path}/{n}") for n in ("packets", "flows", "conversations", "dns", "tls")])


def write_tables(spark: SparkSession, tables: Tables, path: str) -> Tables:
    """Write every table below ``path`` once and read it back: what is planned on the result reads files, not packets."""
    read = {}
    for name in ("packets", "flows", "conversations", "dns", "tls"):
        rows = getattr(tables, name)
        if rows is not None:
            rows.write.parquet(f"{path}/{name}")
            read[name] = spark.read.parquet(f"{path}/{name}")
    return Tables(**read)


def compute_statistics(tables: Tables, bucket_seconds: int = 60, top_n: int = 20) -> dict[str, DataFrame]:
    """Every statistics section as a table; each one is planned, none is run."""
    p, f, c = tables.packets, tables.flows, tables.conversations
    out = {
        "overview": stats.overview(p),
        "transport_protocols": stats.protocol_distribution(p, "protocol"),
        "app_protocols": stats.protocol_distribution(p, "app_protocol"),
        "top_src_ips": stats.top_talkers(p, "src_ip", top_n),
        "top_dst_ips": stats.top_talkers(p, "dst_ip", top_n),
        "top_dst_ports": stats.top_talkers(p, "dst_port", top_n),
        "top_conversations": stats.top_conversations(c, top_n),
        "timeline": stats.timeline(p, bucket_seconds),
        "flow_total": stats.flow_total(f),
        "long_flows": stats.long_flows(f),
        "high_volume_flows": stats.high_volume_flows(f),
        "syn_only_flows": stats.syn_only_flows(f),
        "anomalies": anomalies.detect_anomalies(tables, bucket_seconds),
    }
    if tables.dns is not None:
        out |= {
            "dns_overview": stats.dns_overview(tables.dns),
            "dns_query_types": stats.dns_query_types(tables.dns),
            "dns_top_domains": stats.dns_top_domains(tables.dns),
        }
    if tables.tls is not None:
        out |= {
            "tls_overview": stats.tls_overview(tables.tls),
            "tls_versions": stats.tls_versions(tables.tls),
            "top_snis": stats.top_snis(tables.tls),
        }
    return out


def first_produced() -> list[Column]:
    """The order in which display filters are made: findings by severity and confidence, then look-ups; ties by name."""
    levels = F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info")])
    rank = F.array_position(levels, F.lower("severity"))
    return [
        F.col("related_finding_id").isNull(),
        F.when(rank > 0, rank).otherwise(9),
        -F.coalesce(F.col("confidence"), F.lit(0.0)),
        F.col("category"),
        F.col("name"),
        F.col("related_finding_id"),
    ]


def analyze(
    spark: SparkSession,
    tables: Tables,
    otx: DataFrame | None = None,
    abuse: DataFrame | None = None,
    vt: DataFrame | None = None,
    share: float = 0.4,
    largest: bool = True,
    legit: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Statistics, findings, selected indicators, staged look-ups and display filters.

    Rules are evaluated once, into a stored ledger that findings and their addresses are read from. Look-up results
    are few and dear to compute, so they are written to the checkpoint folder too.
    """
    legit = legit_domain_list(spark) if legit is None else legit
    ledger = evaluate(tables)
    findings = ledger.findings()
    selected = indicators.select_indicators(tables.flows, tables.dns, tables.tls, legit, share, largest)
    enriched = cut_lineage(intel.cascade(selected.select("value", "indicator_type"), otx, abuse, vt))
    sections = compute_statistics(tables)
    made = filters.filters_from_findings(findings).unionByName(filters.filters_from_enrichment(enriched))
    made = made.unionByName(filters.filters_from_anomalies(sections["anomalies"]))
    return sections | {
        "findings": findings,
        "finding_ips": ledger.addresses(),
        "indicators": selected,
        "enriched": enriched,
        "flagged_indicators": intel.flagged_indicators(enriched),
        "filters": filters.deduplicate(made, first_produced()),
    }


def _prioritised(tables: Tables) -> DataFrame:
    """Every address and name, prioritised by findings and capped."""
    ledger = evaluate(tables)
    ranked = indicators.prioritize_indicators(
        all_addresses(tables.flows),
        all_domains(tables.dns, tables.tls),
        ledger.addresses(),
        indicators.finding_domains(ledger.findings()),
    )
    return indicators.cap_by_priority(ranked)


def enrich_all(
    tables: Tables, otx: DataFrame | None = None, abuse: DataFrame | None = None, vt: DataFrame | None = None
) -> DataFrame:
    """The second path: every address and name, prioritised by findings, capped, then looked up."""
    return _look_up(_prioritised(tables), otx, abuse, vt)


def enrich_all_cached(
    tables: Tables,
    cache: DataFrame,
    now: float,
    otx: DataFrame | None = None,
    abuse: DataFrame | None = None,
    vt: DataFrame | None = None,
) -> CachedLookups:
    """The second path with a cache: only what has no live entry is looked up. The returned cache replaces the given one."""
    return enrich_with_cache(_prioritised(tables), cache, now, lambda misses: _look_up(misses, otx, abuse, vt))


def _look_up(capped: DataFrame, otx: DataFrame | None, abuse: DataFrame | None, vt: DataFrame | None) -> DataFrame:
    # The value column is called indicator once it is looked up.
    order = [*indicators.indicator_order()[:-1], F.col("indicator")]
    return intel.enrich(capped, otx, abuse, vt, order=order)
