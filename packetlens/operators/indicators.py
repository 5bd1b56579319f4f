"""Which addresses and domains deserve a look-up: selection by traffic, and priorities by findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import in_place, names, net, rank_of
from packetlens.operators.flows import FLOW_KEYS
from packetlens.operators.ranking import extreme_share, top_per_key, value_counts
from packetlens.session import shuffled_once, write_once

# ---- names and addresses -------------------------------------------------------------------


def flow_ends(flows: DataFrame) -> DataFrame:
    """Flows (``flow_count``) by the end that may be public: the source, or the destination if the source is private.

    ``is_source``: some flow has it as its source, which then is public. One row per address arrives, not one per pair.
    """
    rows = flows.select("src_ip", "dst_ip", net.is_private("src_ip", "registry").alias("_behind"))
    end = F.when(F.col("_behind"), F.col("dst_ip")).otherwise(F.col("src_ip"))
    return (
        rows.select(end.alias("ip"), (~F.col("_behind")).alias("is_source"))
        .groupBy("ip")
        .agg(F.count(F.lit(1)).alias("flow_count"), F.max("is_source").alias("is_source"))
    )


def public_addresses(flows: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Distinct public ends of flows; of two public ends only the source. ``ends``: their :func:`flow_ends`, if there already.

    Destinations are tested once per address.
    """
    ends = flow_ends(flows) if ends is None else ends
    return ends.where(F.col("ip").isNotNull() & (F.col("is_source") | ~net.is_private("ip", "registry"))).select("ip")


def address_names(dns: DataFrame, tls: DataFrame) -> DataFrame:
    """Distinct (ip, domain) pairs from DNS answers and TLS server names."""
    answered = dns.where(in_place(F.col("query_name") != "")).select(
        F.explode("response_ips").alias("ip"), F.col("query_name").alias("domain")
    )
    contacted = tls.where(F.col("sni") != "").select(F.col("dst_ip").alias("ip"), F.col("sni").alias("domain"))
    return answered.union(contacted).where("ip <> ''").distinct()


def related_domains(addresses: DataFrame, dns: DataFrame, tls: DataFrame) -> DataFrame:
    """Cleaned domains that resolve to, or were contacted on, the given addresses. Local names are dropped."""
    pairs = address_names(dns, tls).join(addresses, "ip", "left_semi")
    return (
        pairs.select(names.clean_domain("domain").alias("domain"))
        .distinct()
        .where((F.col("domain") != "") & ~names.is_local_name("domain", K.LOCAL_SUFFIXES_SELECTION))
    )


def under_listed(domains: DataFrame, listed: DataFrame, column: str = "domain") -> DataFrame:
    """The domains that are in ``listed`` (column ``domain``) or below one of its entries.

    Each name is expanded to its suffixes, which makes this an equi-join: the list may be of
    any size, and Spark broadcasts it only when it is measured to be small.
    """
    labels = domains.select(column, names.clean_domain(column).alias("_name")).select(
        column, "_name", F.explode(names.suffix_sizes("_name")).alias("_labels")
    )
    suffixes = labels.select(column, names.last_labels(F.col("_name"), F.col("_labels")).alias("_suffix"))
    entries = listed.select(F.col("domain").alias("_suffix"))
    return suffixes.join(entries, "_suffix", "left_semi").select(column).distinct()


def classify_domains(domains: DataFrame, legit: DataFrame) -> DataFrame:
    """Adds ``spoofed_brand`` and ``is_legit`` to distinct domains; look-alikes are never legit."""
    branded = domains.withColumn("spoofed_brand", names.imitated_brand("domain"))
    known = under_listed(domains, legit).withColumn("_known", F.lit(True))
    return (
        branded.join(known, "domain", "left")
        .withColumns(
            {
                "is_typosquat": F.col("spoofed_brand").isNotNull(),
                "is_legit": F.coalesce("_known", F.lit(False)) & F.col("spoofed_brand").isNull(),
            }
        )
        .drop("_known")
    )


def _as_indicators(values: DataFrame, column: str, kind: str) -> DataFrame:
    typed = values.withColumns({"value": F.col(column), "indicator_type": F.lit(kind)})
    for name, default in (("is_typosquat", F.lit(False)), ("spoofed_brand", F.lit(None).cast("string"))):
        if name not in typed.columns:
            typed = typed.withColumn(name, default)
    return typed.select("value", "indicator_type", "is_typosquat", "spoofed_brand")


def select_flows(
    flows: DataFrame, share: float = 0.4, largest: bool = True, counts: DataFrame | None = None
) -> DataFrame:
    """Keys and bytes of the top (or bottom) share of flows by bytes; ties follow the key columns."""
    return extreme_share(flows.select(*FLOW_KEYS, "byte_count"), "byte_count", FLOW_KEYS, share, largest, counts)


def select_indicators(
    flows: DataFrame, dns: DataFrame, tls: DataFrame, legit: DataFrame, share: float = 0.4, largest: bool = True
) -> DataFrame:
    """Addresses of the busiest (or quietest) flows and the domains behind them.

    Well-known domains are left out; look-alikes of brands are kept and marked.
    """
    addresses = write_once(public_addresses(select_flows(flows, share, largest)), "addresses")
    related = write_once(related_domains(addresses, dns, tls), "domains")
    domains = classify_domains(related, legit).where(~F.col("is_legit"))
    return _as_indicators(addresses, "ip", "ip").unionByName(_as_indicators(domains, "domain", "domain"))


def selection_summary(
    flows: DataFrame, dns: DataFrame, tls: DataFrame, legit: DataFrame, share: float = 0.4, largest: bool = True
) -> DataFrame:
    """One row: flows seen and selected, addresses, domains, look-alikes and names left out as known.

    Flows are shuffled once. What is read more than once and is small beside them is written: flows per number of
    bytes, selected flows per address, and domains.
    """
    flows = shuffled_once(flows.select(*FLOW_KEYS, "byte_count"))
    counts = value_counts(flows, "byte_count")
    chosen = select_flows(flows, share, largest, counts)
    ends = write_once(flow_ends(chosen), "ends")
    addresses = public_addresses(chosen, ends)
    classified = classify_domains(write_once(related_domains(addresses, dns, tls), "domains"), legit)

    def one(df: DataFrame, c: Column = F.count(F.lit(1))):
        return df.select(c.alias("x")).scalar()

    def total(df: DataFrame, column: str) -> Column:
        return one(df, F.coalesce(F.sum(column), F.lit(0).cast("bigint")))

    return classified.agg(
        F.count_if(~F.col("is_legit")).alias("domains"),
        F.count_if(F.col("is_typosquat")).alias("typosquat_suspects"),
        F.count_if(F.col("is_legit")).alias("domains_filtered_by_legit"),
    ).select(
        total(counts, "row_count").alias("total_conversations"),
        total(ends, "flow_count").alias("selected_conversations"),
        one(addresses).alias("public_ips"),
        "domains",
        "typosquat_suspects",
        "domains_filtered_by_legit",
        (one(addresses) + F.col("domains")).alias("total_indicators"),
    )


# ---- priorities ----------------------------------------------------------------------------


def finding_domains(findings: DataFrame) -> DataFrame:
    """Domains named by findings: ``finding_id, detector, domain``."""
    named = findings.withColumn("domain", names.clean_domain(F.try_element_at("indicators", F.lit("domain"))))
    return named.where(F.col("domain") != "").select("finding_id", "detector", "domain")


def _flags(rows: DataFrame, column: str) -> DataFrame:
    """Findings per value. The detector set is bounded by the number of detectors."""
    return rows.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("detection_count"),
        F.array_sort(F.collect_set("detector")).alias("source_detectors"),
    )


def _flag_priority(count: Column, otherwise: str) -> Column:
    return F.when(count >= 2, "critical").when(count == 1, "high").otherwise(otherwise)


def _flag_reason(count: Column, detectors: Column, otherwise: str) -> Column:
    return (
        F.when(count >= 2, F.concat(F.lit("Flagged by "), count.cast("string"), F.lit(" detectors")))
        .when(count == 1, F.concat(F.lit("Flagged by "), F.get(detectors, F.lit(0))))
        .otherwise(F.lit(otherwise))
    )


def _with_flags(values: DataFrame, flags: DataFrame) -> DataFrame:
    return values.join(flags, "value", "left").withColumns(
        {
            "detection_count": F.coalesce("detection_count", F.lit(0).cast("bigint")),
            "source_detectors": F.coalesce("source_detectors", F.array().cast("array<string>")),
        }
    )


def _address_skip(skip_cdn: bool) -> Column:
    cdn = net.cdn_range("value") if skip_cdn else F.lit(None).cast("string")
    return (
        F.when(~net.is_valid_address("value"), "Invalid IP format")
        .when(net.is_private("value", "registry"), "Private IP range")
        .when(net.is_private("value", "non_global"), "Reserved/special address")
        .otherwise(F.concat(F.lit("Known CDN range ("), cdn, F.lit(")")))
    )


def _domain_skip(skip_safe: bool) -> Column:
    safe = names.listed_suffix("value", K.SAFE_DOMAINS_PRIORITY) if skip_safe else F.lit(None).cast("string")
    return F.coalesce(
        F.when(F.col("value") == "", "Empty domain"),
        F.concat(F.lit("Known safe domain ("), safe, F.lit(")")),
        F.when(names.is_local_name("value", K.REVERSE_SUFFIXES), "Reverse DNS lookup"),
        F.when(names.is_local_name("value", K.LOCAL_SUFFIXES_PRIORITY), "Local domain"),
    )


def _kept(values: DataFrame, flags: DataFrame, kind: str, quiet: str, quiet_reason: str) -> DataFrame:
    """Priority and reason of values that are not skipped."""
    rows = _with_flags(values, flags)
    count = F.col("detection_count")
    return rows.select(
        "value",
        F.lit(kind).alias("indicator_type"),
        _flag_priority(count, quiet).alias("priority"),
        _flag_reason(count, F.col("source_detectors"), quiet_reason).alias("reason"),
        "source_detectors",
        count.alias("detection_count"),
    )


def _skipped(values: DataFrame, reason: Column, kind: str) -> DataFrame:
    return values.where(in_place(reason.isNotNull())).select("value", reason.alias("reason")).select(
        "value",
        F.lit(kind).alias("indicator_type"),
        F.lit("skip").alias("priority"),
        "reason",
        F.array().cast("array<string>").alias("source_detectors"),
        F.lit(0).cast("bigint").alias("detection_count"),
    )


def classify_addresses(ips: DataFrame, flagged: DataFrame, skip_cdn: bool = True, with_skipped: bool = True) -> DataFrame:
    """Priority and reason of each address (column ``ip``); ``skip`` means no look-up.

    Skipped values are filtered before anything is joined to them.
    """
    values, reason = ips.select(F.col("ip").alias("value")).distinct(), _address_skip(skip_cdn)
    kept = _kept(values.where(in_place(reason.isNull())), _flags(flagged, "ip"), "ip", "medium", "External IP from traffic")
    return kept.unionByName(_skipped(values, reason, "ip")) if with_skipped else kept


def classify_domain_priority(
    domains: DataFrame, flagged: DataFrame, skip_safe: bool = True, with_skipped: bool = True
) -> DataFrame:
    """The same for domains (column ``domain``)."""
    values = domains.select(names.clean_domain("domain").alias("value")).distinct()
    reason = _domain_skip(skip_safe)
    kept = _kept(values.where(in_place(reason.isNull())), _flags(flagged, "domain"), "domain", "low", "Domain from traffic")
    return kept.unionByName(_skipped(values, reason, "domain")) if with_skipped else kept


def prioritize_indicators(
    ips: DataFrame,
    domains: DataFrame,
    flagged_ips: DataFrame,
    flagged_domains: DataFrame,
    skip_cdn: bool = True,
    skip_safe: bool = True,
) -> DataFrame:
    """All indicators worth a look-up, with priority and reason."""
    by_ip = classify_addresses(ips, flagged_ips, skip_cdn, with_skipped=False)
    return by_ip.unionByName(classify_domain_priority(domains, flagged_domains, skip_safe, with_skipped=False))


def cap_by_priority(indicators: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """All critical indicators and the first few of each other priority.

    The constant rank bound is applied in every task before the shuffle, so at most the
    largest cap of rows per task and priority arrives in a window. Critical indicators are
    ranked alone, one window each, so none is cut.
    """
    caps = K.PRIORITY_CAPS if caps is None else caps
    critical = F.col("priority") == "critical"
    order = [F.col("detection_count").desc(), F.col("indicator_type"), F.col("value")]
    alone = indicators.withColumn("_alone", F.when(critical, F.concat_ws(":", "indicator_type", "value")))
    first = top_per_key(alone, ["priority", "_alone"], order, max(1, *caps.values()))
    limit = F.coalesce(*[F.when(F.col("priority") == p, F.lit(n)) for p, n in caps.items()], F.lit(0))
    return first.where(critical | (F.col("key_rank") <= limit)).drop("key_rank", "_alone")


def indicator_order() -> list[Column]:
    """Most urgent first; ties by type and value."""
    return [
        rank_of("priority", K.PRIORITY_RANK),
        F.col("detection_count").desc(),
        F.col("indicator_type"),
        F.col("value"),
    ]


def sort_indicators(indicators: DataFrame) -> DataFrame:
    return indicators.orderBy(*indicator_order())
