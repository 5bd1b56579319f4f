"""Catalogue: keys, address classes, flows, conversations, rankings, timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import net, text
from packetlens.operators import flows as fl
from packetlens.operators import ranking, stats
from packetlens.operators.ranges import narrowest_ranges
from packetlens.plans import sqltext as S
from packetlens.plans.catalog import query
from packetlens.plans.views import view

FLOWS_CTE = f"""
flows AS (SELECT src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
  CAST(sum(payload_length) AS BIGINT) AS payload_bytes, min(ts) AS start_time, max(ts) AS end_time, bit_or(flag_bits) AS flag_bits,
  {S.app_protocol()} AS app_protocol
  FROM traffic_v GROUP BY ALL),
conv AS (SELECT least(src_ip, dst_ip) AS ip_a, greatest(src_ip, dst_ip) AS ip_b,
  count(*) FILTER (src_ip <= dst_ip) AS packets_a_to_b, count(*) FILTER (src_ip > dst_ip) AS packets_b_to_a,
  CAST(coalesce(sum(length) FILTER (src_ip <= dst_ip), 0) AS BIGINT) AS bytes_a_to_b,
  CAST(coalesce(sum(length) FILTER (src_ip > dst_ip), 0) AS BIGINT) AS bytes_b_to_a,
  min(ts) AS start_time, max(ts) AS end_time,
  array_to_string(list_sort(list_distinct(list(protocol))), ',') AS protocols,
  coalesce(array_to_string(list_sort(list_distinct(list(src_port) FILTER (src_port <> 0) || list(dst_port) FILTER (dst_port <> 0))), ','), '') AS ports_used
  FROM traffic_v GROUP BY 1, 2)
"""


def packets(spark: SparkSession, sf_dir: str, name: str = "traffic_v") -> DataFrame:
    """A packet view with the application protocol filled in."""
    return view(spark, sf_dir, name).withColumn("app_protocol", net.app_protocol())


def _joined(c):
    return F.concat_ws(",", F.col(c).cast("array<string>"))


@query("top_conversations", ["traffic_v"], """
SELECT ip_a, ip_b, packets_a_to_b + packets_b_to_a AS packets, bytes_a_to_b + bytes_b_to_a AS bytes,
  round_even(end_time - start_time, 2) AS duration,
  CASE WHEN bytes_b_to_a = 0 THEN CASE WHEN bytes_a_to_b > 0 THEN 'inf'::DOUBLE ELSE 1.0 END
    ELSE round_even(bytes_a_to_b / bytes_b_to_a, 2) END AS byte_ratio
FROM conv ORDER BY bytes DESC, ip_a, ip_b LIMIT 20""", FLOWS_CTE)
def top_conversations(spark, sf):
    return stats.top_conversations(fl.build_conversations(packets(spark, sf)), 20)


def _talkers_sql(column: str) -> str:
    ip = column.endswith("_ip")
    kind = f"{S.private_core(column)} AS is_private" if ip else (
        f"{S.case_of(column, K.PORT_NAMES, chr(39) + 'Unknown' + chr(39))} AS port_name, false AS is_private")
    return f"""
SELECT CAST({column} AS VARCHAR) AS identifier, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM traffic_v) AS percentage, {kind}
FROM traffic_v WHERE {column} IS NOT NULL {'' if ip else f'AND {column} <> 0'}
GROUP BY {column} ORDER BY packet_count DESC, {column} LIMIT 20"""


@query("top_src_ips", ["traffic_v"], _talkers_sql("src_ip"))
def top_src_ips(spark, sf):
    return stats.top_talkers(packets(spark, sf), "src_ip", 20)


@query("top_dst_ips", ["traffic_v"], _talkers_sql("dst_ip"))
def top_dst_ips(spark, sf):
    return stats.top_talkers(packets(spark, sf), "dst_ip", 20)


@query("top_dst_ports", ["traffic_v"], _talkers_sql("dst_port"))
def top_dst_ports(spark, sf):
    return stats.top_talkers(packets(spark, sf), "dst_port", 20)


@query("dst_port_counts", ["traffic_v"], """
SELECT dst_port, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count
FROM traffic_v WHERE dst_port <> 0 GROUP BY dst_port""")
def dst_port_counts(spark, sf):
    return fl.packet_counts(packets(spark, sf), "dst_port")


@query("flows", ["traffic_v"], """
SELECT concat(src_ip, ':', coalesce(CAST(src_port AS VARCHAR), 'None'), '->', dst_ip, ':', coalesce(CAST(dst_port AS VARCHAR), 'None'), '/', protocol) AS flow_key,
  packet_count, byte_count, payload_bytes, start_time, end_time, app_protocol, end_time - start_time AS duration_seconds,
  CASE WHEN end_time = start_time THEN 0.0 ELSE packet_count / (end_time - start_time) END AS packets_per_second,
  CASE WHEN end_time = start_time THEN 0.0 ELSE byte_count / (end_time - start_time) END AS bytes_per_second,
  array_to_string(list_sort(list_filter([CASE WHEN flag_bits & 1 > 0 THEN 'FIN' END, CASE WHEN flag_bits & 2 > 0 THEN 'SYN' END,
    CASE WHEN flag_bits & 4 > 0 THEN 'RST' END, CASE WHEN flag_bits & 8 > 0 THEN 'PSH' END, CASE WHEN flag_bits & 16 > 0 THEN 'ACK' END,
    CASE WHEN flag_bits & 32 > 0 THEN 'URG' END], lambda x: x IS NOT NULL)), ',') AS tcp_flags,
  flag_bits & 2 > 0 AND flag_bits & 16 > 0 AS is_complete_tcp, flag_bits & 2 > 0 AND flag_bits & 16 = 0 AS is_syn_only
FROM flows""", FLOWS_CTE)
def flows(spark, sf):
    return fl.with_flow_measures(fl.build_flows(packets(spark, sf))).select(
        "flow_key", "packet_count", "byte_count", "payload_bytes", "start_time", "end_time", "app_protocol",
        "duration_seconds", "packets_per_second", "bytes_per_second",
        _joined("tcp_flags_seen").alias("tcp_flags"), "is_complete_tcp", "is_syn_only",
    )


@query("conversations", ["traffic_v"], """
SELECT concat(ip_a, '<->', ip_b) AS conversation_key, packets_a_to_b, packets_b_to_a, bytes_a_to_b, bytes_b_to_a,
  packets_a_to_b + packets_b_to_a AS total_packets, bytes_a_to_b + bytes_b_to_a AS total_bytes,
  start_time, end_time, end_time - start_time AS duration_seconds,
  CASE WHEN bytes_b_to_a = 0 THEN CASE WHEN bytes_a_to_b > 0 THEN 'inf'::DOUBLE ELSE 1.0 END
    ELSE bytes_a_to_b / bytes_b_to_a END AS byte_ratio, protocols, ports_used
FROM conv""", FLOWS_CTE)
def conversations(spark, sf):
    return fl.with_conversation_measures(fl.build_conversations(packets(spark, sf))).select(
        "conversation_key", "packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a",
        "total_packets", "total_bytes", "start_time", "end_time", "duration_seconds", "byte_ratio",
        _joined("protocols").alias("protocols"), _joined("ports_used").alias("ports_used"),
    )


_ENDS = """concat(src_ip, ':', coalesce(CAST(src_port AS VARCHAR), 'None')) AS src,
  concat(dst_ip, ':', coalesce(CAST(dst_port AS VARCHAR), 'None')) AS dst, protocol"""


@query("long_flows", ["traffic_v"], f"""
SELECT {_ENDS}, round_even((end_time - start_time) / 3600.0, 2) AS duration_hours, packet_count AS packets, byte_count AS bytes
FROM flows WHERE end_time - start_time > 3600""", FLOWS_CTE)
def long_flows(spark, sf):
    return stats.long_flows(fl.build_flows(packets(spark, sf)))


@query("high_volume_flows", ["traffic_v"], f"""
SELECT {_ENDS}, round_even(byte_count / 1048576.0, 2) AS bytes_mb, packet_count AS packets
FROM flows WHERE byte_count > 150000""", FLOWS_CTE)
def high_volume_flows(spark, sf):
    # The views hold no 10 MiB flow; the threshold is a parameter of the operator.
    return stats.high_volume_flows(fl.build_flows(packets(spark, sf)), more_than=150_000)


@query("syn_only_flows", ["traffic_v"], """
SELECT src_ip, dst_ip, dst_port, packet_count FROM flows
WHERE flag_bits & 2 > 0 AND flag_bits & 16 = 0 AND packet_count < 5""", FLOWS_CTE)
def syn_only_flows(spark, sf):
    return stats.syn_only_flows(fl.build_flows(packets(spark, sf)))


@query("flow_total", ["traffic_v"], "SELECT count(*) AS total_flows FROM flows", FLOWS_CTE)
def flow_total(spark, sf):
    return stats.flow_total(fl.build_flows(packets(spark, sf)))


@query("overview", ["traffic_v"], f"""
SELECT count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes, min(ts) AS start_time, max(ts) AS end_time,
  max(ts) - min(ts) AS duration_seconds, count(*) / (max(ts) - min(ts)) AS packets_per_second,
  CAST(sum(length) AS BIGINT) / (max(ts) - min(ts)) AS bytes_per_second,
  count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
  (SELECT count(*) FROM ips WHERE {S.private_core('ip')}) AS unique_internal_ips,
  (SELECT count(*) FROM ips WHERE NOT {S.private_core('ip')}) AS unique_external_ips
FROM traffic_v""", "ips AS (SELECT src_ip AS ip FROM traffic_v UNION SELECT dst_ip FROM traffic_v)")
def overview(spark, sf):
    return stats.overview(packets(spark, sf))


@query("protocol_distribution", ["traffic_v"], """
SELECT protocol, count(*) AS packet_count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM traffic_v) AS percentage
FROM traffic_v GROUP BY protocol""")
def protocol_distribution(spark, sf):
    return stats.protocol_distribution(packets(spark, sf), "protocol")


@query("app_protocol_distribution", ["traffic_v"], f"""
SELECT {S.app_protocol()} AS protocol, count(*) AS packet_count,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM traffic_v) AS percentage
FROM traffic_v GROUP BY 1""")
def app_protocol_distribution(spark, sf):
    return stats.protocol_distribution(packets(spark, sf), "app_protocol")


@query("ip_classes", ["traffic_v"], f"""
SELECT ip, {S.private_core('ip')} AS private_core, {S.private_detector('ip')} AS private_detector,
  {S.private_api('ip')} AS private_api, {S.private_registry('ip')} AS private_registry,
  {S.private_registry('ip')} OR {S.in_network('ip', K.MULTICAST_V4)} AS private_non_global
FROM (SELECT src_ip AS ip FROM traffic_v UNION SELECT dst_ip FROM traffic_v) t""")
def ip_classes(spark, sf):
    return stats.address_classes(packets(spark, sf))


# Addresses spread over the whole number space, to reach every rule of every mode.
_SPREAD = """SELECT l_orderkey, l_linenumber, concat(
  CASE l_linenumber WHEN 1 THEN '172' WHEN 2 THEN '169' WHEN 3 THEN '192' WHEN 4 THEN '198' WHEN 5 THEN '203' ELSE CAST(l_partkey % 256 AS VARCHAR(5)) END, '.',
  CASE WHEN l_linenumber = 2 AND l_orderkey % 2 = 0 THEN '254' WHEN l_linenumber = 3 AND l_orderkey % 3 = 0 THEN '0' WHEN l_linenumber = 3 THEN '168'
    WHEN l_linenumber = 4 THEN CAST(16 + l_orderkey % 4 AS VARCHAR(5)) WHEN l_linenumber = 5 THEN '0' ELSE CAST(l_orderkey % 256 AS VARCHAR(5)) END, '.',
  CASE WHEN l_linenumber = 5 THEN CAST(112 + l_suppkey % 3 AS VARCHAR(5)) ELSE CAST(l_suppkey % 260 AS VARCHAR(5)) END, '.', CAST(l_partkey % 12 AS VARCHAR(5))) AS ip
FROM {lineitem}"""


@query("private_ip_modes", [], f"""
SELECT ip, {S.private_core('ip')} AS core, {S.private_detector('ip')} AS detector, {S.private_api('ip')} AS api,
  ok AND {S.private_registry('ip')} AS registry,
  NOT ok OR {S.private_registry('ip')} OR {S.in_network('ip', K.MULTICAST_V4)} AS non_global,
  ok AS valid_ip
FROM (SELECT DISTINCT ip, list_bool_and([CAST(x AS INT) <= 255 FOR x IN string_split(ip, '.')]) AS ok FROM ({_SPREAD.format(lineitem='lineitem')}) s) t""")
def private_ip_modes(spark, sf):
    spread = spark.sql(_SPREAD, lineitem=view(spark, sf, "lineitem")).select("ip").distinct()
    modes = ("core", "detector", "api", "registry", "non_global")
    return spread.select(
        "ip", *[net.is_private("ip", m).alias(m) for m in modes], net.is_dotted_quad("ip").alias("valid_ip")
    )


@query("packet_directions", ["traffic_v"], f"""
SELECT concat(least(src_ip, dst_ip), '<->', greatest(src_ip, dst_ip)) AS conversation_key,
  {S.private_core('src_ip')} AND {S.private_core('dst_ip')} AS is_internal,
  {S.private_core('src_ip')} AND NOT {S.private_core('dst_ip')} AS is_outbound,
  NOT {S.private_core('src_ip')} AND {S.private_core('dst_ip')} AS is_inbound,
  NOT {S.private_registry('src_ip')} OR NOT {S.private_registry('dst_ip')} AS has_public_endpoint,
  CASE WHEN NOT {S.private_registry('src_ip')} THEN src_ip WHEN NOT {S.private_registry('dst_ip')} THEN dst_ip END AS public_ip,
  n AS packet_count
FROM (SELECT src_ip, dst_ip, count(*) AS n FROM traffic_v GROUP BY ALL) t""")
def packet_directions(spark, sf):
    pairs = packets(spark, sf).groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("packet_count"))
    return pairs.select(
        net.conversation_key().alias("conversation_key"), net.is_internal().alias("is_internal"),
        net.is_outbound().alias("is_outbound"), net.is_inbound().alias("is_inbound"),
        net.has_public_endpoint().alias("has_public_endpoint"), net.public_ip().alias("public_ip"), "packet_count",
    )


@query("tcp_flag_sets", ["traffic_v"], """
SELECT flag_bits, array_to_string(list_filter([CASE WHEN flag_bits & 1 > 0 THEN 'FIN' END, CASE WHEN flag_bits & 2 > 0 THEN 'SYN' END,
  CASE WHEN flag_bits & 4 > 0 THEN 'RST' END, CASE WHEN flag_bits & 8 > 0 THEN 'PSH' END, CASE WHEN flag_bits & 16 > 0 THEN 'ACK' END,
  CASE WHEN flag_bits & 32 > 0 THEN 'URG' END], lambda x: x IS NOT NULL), ',') AS flags, packet_count
FROM (SELECT CAST((flag_bits + length) % 64 AS INT) AS flag_bits, count(*) AS packet_count FROM traffic_v GROUP BY 1) t""")
def tcp_flag_sets(spark, sf):
    bits = ((F.col("flag_bits") + F.col("length")) % 64).cast("int")
    counts = packets(spark, sf).groupBy(bits.alias("flag_bits")).agg(F.count(F.lit(1)).alias("packet_count"))
    return counts.select("flag_bits", F.concat_ws(",", net.tcp_flag_names()).alias("flags"), "packet_count")


@query("dns_code_names", [], f"""
SELECT code, coalesce({S.case_of('code', K.DNS_TYPES)}, concat('TYPE', code)) AS type_name,
  coalesce({S.case_of('code', K.DNS_RCODES)}, concat('RCODE', code)) AS rcode_name,
  {S.case_of('code', K.PORT_NAMES, chr(39) + 'Unknown' + chr(39))} AS port_name, count(*) AS n
FROM (SELECT CAST(l_partkey % 300 AS INT) AS code FROM lineitem) t GROUP BY ALL""")
def dns_code_names(spark, sf):
    codes = view(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 300).cast("int").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))
    return codes.select("code", net.dns_type_name("code").alias("type_name"),
                        net.dns_rcode_name("code").alias("rcode_name"), net.port_name("code").alias("port_name"), "n")


@query("sizes_and_durations", ["traffic_v"], f"""
SELECT ip_a, ip_b, {S.format_binary('total')} AS size_binary,
  CASE WHEN total < 1024 THEN total || ' B' WHEN total < 1048576 THEN printf('%.1f', total / 1024.0::DOUBLE) || ' KB'
    WHEN total < 1073741824 THEN printf('%.1f', total / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.2f', total / 1073741824.0::DOUBLE) || ' GB' END AS size_report,
  CASE WHEN total >= 1000000000 THEN CAST(round_even(CAST(total AS DECIMAL(20,2)) / 1000000000, 2) AS DECIMAL(20,2)) || ' GB'
    WHEN total >= 1000000 THEN CAST(round_even(total / 1000000, 2) AS DECIMAL(20,2)) || ' MB'
    WHEN total >= 1000 THEN printf('%.2f', (CASE WHEN total % 10 <> 5 THEN (total + 5) // 10 ELSE total // 10 + (total // 10) % 2 END) / 100.0::DOUBLE) || ' KB'
    ELSE total || ' bytes' END AS size_decimal,
  CASE WHEN seconds < 3600 THEN concat(CAST(floor(floor(seconds) / 60) AS BIGINT), 'm ', CAST(floor(seconds) AS BIGINT) % 60, 's')
    ELSE concat(CAST(floor(floor(seconds) / 3600) AS BIGINT), 'h ', CAST(floor((CAST(floor(seconds) AS BIGINT) % 3600) / 60) AS BIGINT), 'm') END AS duration
FROM (SELECT ip_a, ip_b, bytes_a_to_b + bytes_b_to_a AS total, end_time - start_time + 60 AS seconds FROM conv) t""", FLOWS_CTE)
def sizes_and_durations(spark, sf):
    conv = fl.with_conversation_measures(fl.build_conversations(packets(spark, sf)))
    return conv.select(
        "ip_a", "ip_b", text.format_bytes("total_bytes", "binary").alias("size_binary"),
        text.format_bytes("total_bytes", "report").alias("size_report"),
        text.format_bytes("total_bytes", "decimal").alias("size_decimal"),
        text.format_duration(F.col("duration_seconds") + 60).alias("duration"),
    )


_BUCKETS = """buckets AS (
  SELECT CAST(floor((ts - t0) / {w}) AS BIGINT) AS bucket, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
    CAST(coalesce(sum(length) FILTER (NOT {ps} AND {pd}), 0) AS BIGINT) AS inbound_bytes,
    CAST(coalesce(sum(length) FILTER ({ps} AND NOT {pd}), 0) AS BIGINT) AS outbound_bytes
  FROM traffic_v, (SELECT min(ts) AS t0 FROM traffic_v) s GROUP BY 1),
bucket_ips AS (SELECT CAST(floor((ts - t0) / {w}) AS BIGINT) AS bucket, count(DISTINCT ip) AS unique_ips
  FROM (SELECT ts, unnest([src_ip, dst_ip]) AS ip FROM traffic_v) u, (SELECT min(ts) AS t0 FROM traffic_v) s GROUP BY 1)
"""


def _buckets(width: int) -> str:
    return _BUCKETS.format(w=width, ps=S.private_core("src_ip"), pd=S.private_core("dst_ip"))


_BUCKET_SQL = """SELECT bucket, packet_count, byte_count, inbound_bytes, outbound_bytes, unique_ips,
  (SELECT min(ts) FROM traffic_v) + bucket * {w} AS bucket_ts FROM buckets JOIN bucket_ips USING (bucket)"""


@query("timeline_hourly", ["traffic_v"], _BUCKET_SQL.format(w=3600), _buckets(3600))
def timeline_hourly(spark, sf):
    return stats.timeline(packets(spark, sf), 3600)


@query("timeline_minutes", ["traffic_v"], _BUCKET_SQL.format(w=60), _buckets(60))
def timeline_minutes(spark, sf):
    return stats.timeline(packets(spark, sf))


@query("timeline_from_minutes", ["traffic_v"], f"""
SELECT CAST(floor(ts / 3600) AS BIGINT) AS bucket, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
  CAST(coalesce(sum(length) FILTER (NOT {S.private_core("src_ip")} AND {S.private_core("dst_ip")}), 0) AS BIGINT) AS inbound_bytes,
  CAST(coalesce(sum(length) FILTER ({S.private_core("src_ip")} AND NOT {S.private_core("dst_ip")}), 0) AS BIGINT) AS outbound_bytes, true AS ips_close
FROM traffic_v GROUP BY 1""")
def timeline_from_minutes(spark, sf):
    # Hours from the sketches of minutes alone. Their address counts are held against exact ones, within three deviations.
    rows = packets(spark, sf)
    hours = stats.widen_timeline(stats.timeline_sketches(rows), 60)
    ends = rows.select(F.floor(F.col("ts") / 3600).alias("bucket"), F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    exact = ends.distinct().groupBy("bucket").agg(F.count("ip").alias("exact"))
    close = F.abs(F.col("unique_ips") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.049 * F.col("exact"))
    return hours.join(exact, "bucket").select(
        "bucket", "packet_count", "byte_count", "inbound_bytes", "outbound_bytes", close.alias("ips_close"))


_PER_SOURCE = 2000


@query("largest_packets_per_source", ["traffic_v"], f"""
SELECT src_ip, key_rank, length, ts, seq, dst_ip FROM (
  SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY length DESC, ts, seq, dst_ip) AS key_rank FROM traffic_v) r WHERE key_rank <= {_PER_SOURCE}""")
def largest_packets_per_source(spark, sf):
    rows = packets(spark, sf).select("src_ip", "length", "ts", "seq", "dst_ip")
    return ranking.top_per_key(rows, ["src_ip"], [F.col("length").desc(), F.col("ts"), F.col("seq"), F.col("dst_ip")], _PER_SOURCE)


def _share_sql(direction: str, share: float) -> str:
    return f"""
SELECT src_ip, dst_ip, src_port, dst_port, protocol, byte_count FROM (
  SELECT *, row_number() OVER (ORDER BY byte_count {direction}, src_ip, dst_ip, src_port NULLS FIRST, dst_port NULLS FIRST, protocol) AS rn,
    count(*) OVER () AS n FROM flows) r WHERE rn <= greatest(1, CAST(floor(n * {share}::DOUBLE) AS BIGINT))"""


def _share(spark, sf, share, largest):
    flows = fl.build_flows(packets(spark, sf)).select(*fl.FLOW_KEYS, "byte_count")
    return ranking.extreme_share(flows, "byte_count", fl.FLOW_KEYS, share, largest)


@query("top_percent_flows", ["traffic_v"], _share_sql("DESC", 0.4), FLOWS_CTE)
def top_percent_flows(spark, sf):
    return _share(spark, sf, 0.4, True)


@query("bottom_percent_flows", ["traffic_v"], _share_sql("ASC", 0.1), FLOWS_CTE)
def bottom_percent_flows(spark, sf):
    return _share(spark, sf, 0.1, False)


@query("all_addresses", ["traffic_v"], "SELECT src_ip AS ip FROM traffic_v UNION SELECT dst_ip FROM traffic_v")
def all_addresses(spark, sf):
    return fl.all_addresses(packets(spark, sf))


@query("all_domains", ["dns_v", "tls_v"], """
SELECT query_name AS domain FROM dns_v WHERE query_name <> '' UNION SELECT sni FROM tls_v WHERE sni <> ''""")
def all_domains(spark, sf):
    return fl.all_domains(view(spark, sf, "dns_v"), view(spark, sf, "tls_v"))


# ---- address ranges ------------------------------------------------------------------------

#: Ranges of one to some hundred addresses that overlap and nest, one per supplier.
_RANGES = """SELECT concat('45.33.', CAST(floor(s_suppkey * 3 % 2048 / 256) AS INT), '.', CAST(s_suppkey * 3 % 256 AS INT)) AS low,
  concat('45.33.', CAST(floor((s_suppkey * 3 % 2048 + s_suppkey % 7 * 40) / 256) AS INT), '.', CAST((s_suppkey * 3 % 2048 + s_suppkey % 7 * 40) % 256 AS INT)) AS high,
  concat('net-', s_suppkey) AS value FROM {supplier}"""


@query("address_ranges", ["traffic_v"], f"""
SELECT ip, arg_min(value, (high_n - low_n, value)) AS value FROM (SELECT src_ip AS ip FROM traffic_v UNION SELECT dst_ip FROM traffic_v) a
JOIN (SELECT *, {S.ip_number('low')} AS low_n, {S.ip_number('high')} AS high_n FROM ({_RANGES.replace('{supplier}', 'supplier')}) r) r
  ON {S.ip_number('ip')} BETWEEN low_n AND high_n GROUP BY ip""")
def address_ranges(spark, sf):
    ranges = spark.sql(_RANGES, supplier=view(spark, sf, "supplier"))
    return narrowest_ranges(fl.all_addresses(packets(spark, sf)), ranges)
