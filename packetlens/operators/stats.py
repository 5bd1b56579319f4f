"""Traffic statistics: overview, distributions, rankings, timeline, DNS, TLS and flow lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import in_place, names, net
from packetlens.operators.flows import all_addresses, packet_counts, with_conversation_measures
from packetlens.operators.ranking import top_rows

MIB = 1024 * 1024


def _total(packets: DataFrame) -> Column:
    """Packet count as a scalar subquery (reads no columns)."""
    return packets.select(F.count(F.lit(1)).alias("n")).scalar()


def _percent(count: str, packets: DataFrame) -> Column:
    return F.col(count) * F.lit(100.0) / F.greatest(_total(packets), F.lit(1))


def overview(packets: DataFrame) -> DataFrame:
    """One row: totals, time span, rates and distinct addresses by class.

    Packets are reduced to one row per address first, so distinct counts need no expansion
    of the packets and the second step sees addresses only.
    """
    sides = packets.select(
        "ts",
        "length",
        F.explode(
            F.array(
                F.struct(F.col("src_ip").alias("ip"), F.lit(True).alias("is_src")),
                F.struct(F.col("dst_ip").alias("ip"), F.lit(False).alias("is_src")),
            )
        ).alias("side"),
    )
    is_src = F.col("side.is_src")
    per_ip = sides.groupBy(F.col("side.ip").alias("ip")).agg(
        F.count(F.when(is_src, 1)).alias("sent"),
        F.count(F.when(~is_src, 1)).alias("received"),
        F.sum(F.when(is_src, F.col("length"))).alias("bytes"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    private = net.is_private("ip", "core")
    totals = per_ip.agg(
        F.sum("sent").alias("total_packets"),
        F.sum("bytes").alias("total_bytes"),
        F.min("first").alias("start_time"),
        F.max("last").alias("end_time"),
        F.count_if(F.col("sent") > 0).alias("unique_src_ips"),
        F.count_if(F.col("received") > 0).alias("unique_dst_ips"),
        F.count_if(private).alias("unique_internal_ips"),
        F.count_if(~private).alias("unique_external_ips"),
    )
    seconds = net.duration()
    return totals.withColumns(
        {
            "duration_seconds": seconds,
            "packets_per_second": net.per_second("total_packets", seconds),
            "bytes_per_second": net.per_second("total_bytes", seconds),
        }
    )


def protocol_distribution(packets: DataFrame, column: str = "protocol") -> DataFrame:
    """Packets per transport (or ``app_protocol``) and their share of all packets."""
    counts = packets.groupBy(F.col(column).alias("protocol")).agg(F.count(F.lit(1)).alias("packet_count"))
    return counts.withColumn("percentage", _percent("packet_count", packets))


def top_talkers(packets: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n busiest values of an address or port column, with share and private flag."""
    counts = packet_counts(packets, column).withColumnRenamed(column, "identifier")
    top = top_rows(counts, [F.col("packet_count").desc(), F.col("identifier").asc()], n)
    top = top.withColumn("percentage", _percent("packet_count", packets))
    if column.endswith("_ip"):
        return top.withColumn("is_private", net.is_private("identifier", "core"))
    return top.withColumns(
        {
            "port_name": net.port_name("identifier"),
            "is_private": F.lit(False),
            "identifier": F.col("identifier").cast("string"),
        }
    )


def top_conversations(conversations: DataFrame, n: int = 20) -> DataFrame:
    """The n largest conversations by bytes."""
    measured = with_conversation_measures(conversations)
    top = top_rows(measured, [F.col("total_bytes").desc(), F.col("ip_a"), F.col("ip_b")], n)
    return top.select(
        "ip_a",
        "ip_b",
        F.col("total_packets").alias("packets"),
        F.col("total_bytes").alias("bytes"),
        F.bround("duration_seconds", 2).alias("duration"),
        F.bround("byte_ratio", 2).alias("byte_ratio"),
    )


def timeline(packets: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Packets, bytes, directed bytes and distinct addresses per time bucket.

    Buckets are aligned to the first packet. Rows are combined per (bucket, address) before the
    shuffle, so one busy bucket or address is reduced on the map side and spread by address.
    """
    start = packets.select(F.min("ts").alias("t")).scalar()
    end = packets.select(F.max("ts").alias("t")).scalar()
    bucket = F.floor((F.col("ts") - start) / bucket_seconds)
    classed = packets.where(end > start).withColumns(
        {"_src_private": net.is_private("src_ip"), "_dst_private": net.is_private("dst_ip")}
    )
    src_private, dst_private = F.col("_src_private"), F.col("_dst_private")
    directed = classed.select(
        bucket.alias("bucket"),
        "length",
        F.when(src_private & ~dst_private, F.col("length")).otherwise(0).alias("out_bytes"),
        F.when(~src_private & dst_private, F.col("length")).otherwise(0).alias("in_bytes"),
        F.explode(
            F.array(
                F.struct(F.col("src_ip").alias("ip"), F.lit(1).alias("one")),
                F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("one")),
            )
        ).alias("side"),
    )
    once = F.col("side.one")
    per_ip = directed.groupBy("bucket", F.col("side.ip").alias("ip")).agg(
        F.sum(once).alias("packet_count"),
        F.sum(F.col("length") * once).alias("byte_count"),
        F.sum(F.col("in_bytes") * once).alias("inbound_bytes"),
        F.sum(F.col("out_bytes") * once).alias("outbound_bytes"),
    )
    return (
        per_ip.groupBy("bucket")
        .agg(
            F.sum("packet_count").alias("packet_count"),
            F.sum("byte_count").alias("byte_count"),
            F.sum("inbound_bytes").alias("inbound_bytes"),
            F.sum("outbound_bytes").alias("outbound_bytes"),
            F.count("ip").alias("unique_ips"),
        )
        .withColumn("bucket_ts", start + F.col("bucket") * bucket_seconds)
    )


#: A sketch of 2**12 registers: its count errs by 1.6 % in the standard deviation.
SKETCH_LG_K = 12


def timeline_sketches(packets: DataFrame, bucket_seconds: int = 60, origin: float = 0.0, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Totals per time bucket with a sketch of its addresses (``ips``), to be stored and widened later.

    Buckets are counted from ``origin`` (the epoch, so that tables of several captures fit together). Sketches have a
    fixed size and combine before the shuffle, so a hot bucket costs no more than others. No packets: no rows; null
    addresses are not counted.
    """
    src_private, dst_private = net.is_private("src_ip"), net.is_private("dst_ip")
    return packets.groupBy(F.floor((F.col("ts") - F.lit(origin)) / bucket_seconds).alias("bucket")).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("length").alias("byte_count"),
        F.sum(F.when(~src_private & dst_private, F.col("length")).otherwise(0)).alias("inbound_bytes"),
        F.sum(F.when(src_private & ~dst_private, F.col("length")).otherwise(0)).alias("outbound_bytes"),
        F.hll_union(F.hll_sketch_agg("src_ip", lg_k), F.hll_sketch_agg("dst_ip", lg_k)).alias("ips"),
    )


def widen_timeline(sketches: DataFrame, factor: int = 1) -> DataFrame:
    """Buckets ``factor`` times as wide, from stored sketches alone, of one table or several united.

    ``unique_ips`` is an estimate (see ``SKETCH_LG_K``); the other columns are exact.
    """
    sums = [F.sum(c).alias(c) for c in ("packet_count", "byte_count", "inbound_bytes", "outbound_bytes")]
    wide = sketches.groupBy(F.floor(F.col("bucket") / factor).alias("bucket")).agg(*sums, F.hll_union_agg("ips").alias("ips"))
    return wide.withColumn("unique_ips", F.hll_sketch_estimate("ips"))


# ---- DNS -----------------------------------------------------------------------------------


def with_dns_names(dns: DataFrame) -> DataFrame:
    """Parent, subdomain and their lengths, as the statistics use them."""
    return dns.withColumns(
        {
            "parent": names.parent_domain("query_name"),
            "subdomain": names.subdomain("query_name"),
        }
    ).withColumn("subdomain_length", F.length("subdomain"))


def dns_overview(dns: DataFrame) -> DataFrame:
    """One row: queries, distinct names and the sizes of the suspicious sets.

    Names are counted once per distinct name; entropy is computed once per distinct name.
    """
    per_name = with_dns_names(dns.groupBy("query_name").agg(F.count(F.lit(1)).alias("n")))
    high = (F.col("subdomain_length") > 10) & (names.entropy("subdomain") > 3.5)
    return per_name.agg(
        F.sum("n").alias("total_queries"),
        F.count(F.lit(1)).alias("unique_domains"),
        F.sum(F.when(names.has_suspicious_tld("query_name", extended=True), F.col("n")).otherwise(0)).alias(
            "suspicious_tld_queries"
        ),
        F.sum(F.when(high, F.col("n")).otherwise(0)).alias("high_entropy_queries"),
        F.sum(F.when(F.col("subdomain_length") > 50, F.col("n")).otherwise(0)).alias("long_subdomain_queries"),
    )


def dns_query_types(dns: DataFrame) -> DataFrame:
    """Queries per record type."""
    return dns.groupBy("query_type").agg(F.count(F.lit(1)).alias("query_count"))


def dns_top_domains(dns: DataFrame, n: int = 50) -> DataFrame:
    """The n most queried parent domains."""
    counts = dns.groupBy(names.parent_domain("query_name").alias("domain")).agg(
        F.count(F.lit(1)).alias("query_count")
    )
    return top_rows(counts, [F.col("query_count").desc(), F.col("domain").asc()], n)


def suspicious_tld_queries(dns: DataFrame) -> DataFrame:
    """Queries under an often-abused top-level domain."""
    return dns.where(names.has_suspicious_tld("query_name", extended=True))


def long_subdomain_queries(dns: DataFrame, longer_than: int = 50) -> DataFrame:
    """Queries with an unusually long subdomain."""
    return with_dns_names(dns).where(F.col("subdomain_length") > longer_than)


def high_entropy_names(dns: DataFrame, longer_than: int = 10, bits: float = 3.5) -> DataFrame:
    """Distinct names with a random-looking subdomain: parent, entropy, number of queries."""
    per_name = with_dns_names(dns.groupBy("query_name").agg(F.count(F.lit(1)).alias("query_count")))
    return (
        per_name.where(F.col("subdomain_length") > longer_than)
        .withColumn("entropy", names.entropy("subdomain"))
        .where(in_place(F.col("entropy") > bits))
        .select("query_name", "parent", "subdomain", "entropy", "query_count")
    )


def high_entropy_queries(dns: DataFrame) -> DataFrame:
    """The queries behind :func:`high_entropy_names`."""
    return dns.join(high_entropy_names(dns).select("query_name"), "query_name", "left_semi")


# ---- TLS -----------------------------------------------------------------------------------


def tls_overview(tls: DataFrame) -> DataFrame:
    """One row: handshakes, distinct server names, certificate problems."""
    per_sni = tls.groupBy("sni").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col("is_self_signed"), F.lit(False))).alias("self_signed"),
        F.count_if(F.coalesce(F.col("is_expired"), F.lit(False))).alias("expired"),
    )
    return per_sni.agg(
        F.sum("n").alias("total_connections"),
        F.count_if(F.col("sni") != "").alias("unique_snis"),
        F.sum("self_signed").alias("self_signed_certs"),
        F.sum("expired").alias("expired_certs"),
    )


def tls_versions(tls: DataFrame) -> DataFrame:
    """Handshakes per protocol version."""
    return tls.where(F.col("version") != "").groupBy("version").agg(F.count(F.lit(1)).alias("connection_count"))


def top_snis(tls: DataFrame, n: int = 50) -> DataFrame:
    """The n most contacted server names."""
    counts = tls.where(F.col("sni") != "").groupBy("sni").agg(F.count(F.lit(1)).alias("connection_count"))
    return top_rows(counts, [F.col("connection_count").desc(), F.col("sni").asc()], n)


def certificate_problems(tls: DataFrame) -> DataFrame:
    """Handshakes with a self-signed or expired certificate."""
    return tls.where(
        F.coalesce(F.col("is_self_signed"), F.lit(False)) | F.coalesce(F.col("is_expired"), F.lit(False))
    )


# ---- flows ---------------------------------------------------------------------------------


def _endpoint(ip: str, port: str) -> Column:
    return F.concat(F.col(ip), F.lit(":"), F.coalesce(F.col(port).cast("string"), F.lit("None")))


def flow_total(flows: DataFrame) -> DataFrame:
    """Number of flows."""
    return flows.agg(F.count(F.lit(1)).alias("total_flows"))


def long_flows(flows: DataFrame, longer_than: float = 3600.0) -> DataFrame:
    """Flows that lasted more than an hour."""
    seconds = net.duration()
    return flows.where(seconds > longer_than).select(
        _endpoint("src_ip", "src_port").alias("src"),
        _endpoint("dst_ip", "dst_port").alias("dst"),
        "protocol",
        F.bround(seconds / 3600.0, 2).alias("duration_hours"),
        F.col("packet_count").alias("packets"),
        F.col("byte_count").alias("bytes"),
    )


def high_volume_flows(flows: DataFrame, more_than: int = 10 * MIB) -> DataFrame:
    """Flows that carried more than 10 MiB."""
    return flows.where(F.col("byte_count") > more_than).select(
        _endpoint("src_ip", "src_port").alias("src"),
        _endpoint("dst_ip", "dst_port").alias("dst"),
        "protocol",
        F.bround(F.col("byte_count") / float(MIB), 2).alias("bytes_mb"),
        F.col("packet_count").alias("packets"),
    )


def syn_only_flows(flows: DataFrame, fewer_than: int = 5) -> DataFrame:
    """Short flows whose handshake was never answered."""
    return flows.where(net.is_syn_only() & (F.col("packet_count") < fewer_than)).select(
        "src_ip", "dst_ip", "dst_port", "packet_count"
    )


def address_classes(packets: DataFrame) -> DataFrame:
    """Every distinct address under each private-address rule."""
    return all_addresses(packets).withColumns(
        {f"private_{mode}": net.is_private("ip", mode) for mode in ("core", "detector", "api", "registry", "non_global")}
    )
