"""Catalogue: detectors, anomalies, DNS and TLS statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import names
from packetlens.operators import anomalies, stats
from packetlens.operators import filters as D
from packetlens.operators import flows as fl
from packetlens.operators.detectors import finding_addresses, run_detectors
from packetlens.operators.detectors.base import count_by_severity, finding_records, sort_findings
from packetlens.operators.detectors.beacon import BeaconDetector
from packetlens.operators.detectors.dns_tunnel import DnsTunnelDetector
from packetlens.operators.detectors.exfiltration import ExfiltrationDetector
from packetlens.operators.detectors.port_scan import PortScanDetector, sequential_runs
from packetlens.operators.timing import first_busy_window, gap_statistics
from packetlens.plans import sqltext as S
from packetlens.plans.catalog import query
from packetlens.plans.traffic import FLOWS_CTE, _buckets, packets
from packetlens.plans.views import view

# ---- beacons -------------------------------------------------------------------------------

BEACON_CTE = """
gaps AS (SELECT src_ip, dst_ip, dst_port, protocol, start_time, packet_count, byte_count,
  start_time - lag(start_time) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY start_time) AS gap FROM beacon_flows_v),
cand AS (SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS event_count, min(start_time) AS first_time, max(start_time) AS last_time,
  avg(gap) AS mean_gap, stddev_samp(gap) AS stdev, CAST(sum(packet_count) AS BIGINT) AS packet_count, CAST(sum(byte_count) AS BIGINT) AS byte_count
  FROM gaps GROUP BY ALL HAVING count(*) >= 10 AND max(start_time) - min(start_time) >= 300),
scored AS (SELECT *, 1 - (stdev / mean_gap) / 0.15 AS reg,
  CASE WHEN mean_gap BETWEEN 27 AND 33 THEN 30 WHEN mean_gap BETWEEN 54 AND 66 THEN 60 WHEN mean_gap BETWEEN 108 AND 132 THEN 120
    WHEN mean_gap BETWEEN 162 AND 198 THEN 180 WHEN mean_gap BETWEEN 270 AND 330 THEN 300 WHEN mean_gap BETWEEN 540 AND 660 THEN 600
    WHEN mean_gap BETWEEN 810 AND 990 THEN 900 WHEN mean_gap BETWEEN 1620 AND 1980 THEN 1800 WHEN mean_gap BETWEEN 3240 AND 3960 THEN 3600 END AS known
  FROM cand),
conf AS (SELECT *, least(1.0, reg * 0.5 + CASE WHEN event_count > 100 THEN 0.2 WHEN event_count > 50 THEN 0.15 WHEN event_count > 20 THEN 0.1 ELSE 0.05 END
  + CASE WHEN last_time - first_time >= 3600 THEN 0.15 WHEN last_time - first_time >= 1800 THEN 0.1 WHEN last_time - first_time >= 600 THEN 0.05 ELSE 0 END
  + CASE WHEN known IS NULL THEN 0 ELSE 0.15 END) AS confidence FROM scored WHERE reg >= 0.7)
"""


@query("beacon_candidates", ["beacon_flows_v"], """
SELECT src_ip, dst_ip, dst_port, protocol, event_count, first_time, last_time, round(mean_gap, 6) AS mean_gap, round(stdev, 6) AS stdev_gap,
  packet_count, byte_count FROM cand""", BEACON_CTE)
def beacon_candidates(spark, sf):
    return BeaconDetector().candidates(view(spark, sf, "beacon_flows_v")).select(
        "src_ip", "dst_ip", "dst_port", "protocol", "event_count", "first_time", "last_time",
        F.round("mean_gap", 6).alias("mean_gap"), F.round("stdev_samp", 6).alias("stdev_gap"), "packet_count", "byte_count",
    )


@query("beacons", ["beacon_flows_v"], """
SELECT src_ip, dst_ip, dst_port, event_count, round(mean_gap, 6) AS mean_gap, round(reg, 6) AS regularity, known AS known_interval,
  round(CAST(confidence AS DOUBLE), 6) AS confidence,
  CASE WHEN confidence >= 0.9 AND known IS NOT NULL THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS severity
FROM conf""", BEACON_CTE)
def beacons(spark, sf):
    return BeaconDetector().beacons(view(spark, sf, "beacon_flows_v")).select(
        "src_ip", "dst_ip", "dst_port", "event_count", F.round("mean_gap", 6).alias("mean_gap"),
        F.round("regularity", 6).alias("regularity"), "known_interval", F.round("confidence", 6).alias("confidence"), "severity",
    )


@query("beacon_anomalies", ["beacon_flows_v"], """
SELECT src_ip, dst_ip, n AS event_count, round(m, 6) AS mean_gap, round(s / m * 100, 6) AS jitter_percent,
  CASE WHEN s / m * 100 < 5 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT src_ip, dst_ip, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s FROM gaps GROUP BY ALL) t
WHERE n >= 11 AND m >= 5 AND s / m * 100 < 15""", BEACON_CTE)
def beacon_anomalies(spark, sf):
    rows = view(spark, sf, "beacon_flows_v").withColumns({"src_port": F.lit(40000), "ts": F.col("start_time")})
    return anomalies.regular_flows(rows).select(
        "src_ip", "dst_ip", "event_count", F.round("mean_gap", 6).alias("mean_gap"),
        F.round("jitter_percent", 6).alias("jitter_percent"), "severity",
    )


@query("packet_gaps", ["traffic_v"], """
SELECT src_ip, dst_ip, count(*) AS event_count, min(ts) AS first_time, max(ts) AS last_time,
  round(avg(gap), 4) AS mean_gap, round(stddev_samp(gap), 4) AS stdev_samp, round(stddev_pop(gap), 4) AS stdev_pop, CAST(sum(length) AS BIGINT) AS bytes
FROM (SELECT src_ip, dst_ip, ts, length, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts) AS gap FROM traffic_v) t
GROUP BY ALL HAVING count(*) >= 3""")
def packet_gaps(spark, sf):
    rows = gap_statistics(packets(spark, sf), ["src_ip", "dst_ip"], "ts", sums={"bytes": F.col("length")})
    return rows.where("event_count >= 3").select(
        "src_ip", "dst_ip", "event_count", "first_time", "last_time", F.round("mean_gap", 4).alias("mean_gap"),
        F.round("stdev_samp", 4).alias("stdev_samp"), F.round("stdev_pop", 4).alias("stdev_pop"), "bytes",
    )


# ---- scans ---------------------------------------------------------------------------------

SCAN_CTE = """
prof AS (SELECT src_ip, count(DISTINCT dst_ip) AS unique_hosts, count(DISTINCT dst_port) AS unique_ports, count(*) AS total_connections,
  count(*) FILTER (packet_count <= 3 AND byte_count < 200) AS failed_connections, min(start_time) AS first_start, max(start_time) AS last_start
  FROM scan_flows_v WHERE protocol = 'TCP' GROUP BY src_ip HAVING count(*) >= 15),
runs AS (SELECT src_ip, count(*) FILTER (len > 1) AS sequential_runs FROM (
  SELECT src_ip, island, count(*) AS len FROM (
    SELECT src_ip, dst_port, dst_port - row_number() OVER (PARTITION BY src_ip ORDER BY dst_port) AS island
    FROM (SELECT DISTINCT src_ip, dst_port FROM scan_flows_v) d) i GROUP BY ALL) g GROUP BY src_ip)
"""


def _band(n: str) -> str:
    return (f"CASE WHEN {n} >= 100 THEN 'high' WHEN {n} >= 50 THEN 'medium' ELSE 'low' END AS severity, "
            f"CASE WHEN {n} >= 100 THEN 0.85::DOUBLE WHEN {n} >= 50 THEN 0.75 ELSE 0.6 END AS confidence")


@query("scan_profiles", ["scan_flows_v"], """
SELECT src_ip, unique_hosts, unique_ports, total_connections, failed_connections, failed_connections / total_connections AS failure_rate,
  first_start, last_start FROM prof""", SCAN_CTE)
def scan_profiles(spark, sf):
    return PortScanDetector().profiles(view(spark, sf, "scan_flows_v")).drop("ports")


@query("scan_horizontal", ["scan_flows_v"], f"""
SELECT src_ip, unique_hosts, unique_ports, total_connections, {_band('unique_hosts')}, hosts_on_first_port
FROM prof JOIN (SELECT src_ip, max(h) AS hosts_on_first_port FROM (
  SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS h FROM scan_flows_v GROUP BY ALL) p GROUP BY 1) q USING (src_ip)
WHERE unique_hosts >= 10 AND unique_ports <= 5 AND unique_hosts / greatest(unique_ports, 1) >= 3""", SCAN_CTE)
def scan_horizontal(spark, sf):
    flows = view(spark, sf, "scan_flows_v")
    det = PortScanDetector()
    found = det.horizontal(flows)
    first = det.targeted_ports(flows).where("key_rank = 1").select("src_ip", F.col("hosts").alias("hosts_on_first_port"))
    return found.join(first, "src_ip").select(
        "src_ip", "unique_hosts", "unique_ports", "total_connections", "severity", "confidence", "hosts_on_first_port")


@query("scan_vertical", ["scan_flows_v"], f"""
SELECT src_ip, unique_hosts, unique_ports, total_connections, {_band('unique_ports')}, sequential_runs, min_port, max_port, sensitive_hits
FROM prof JOIN runs USING (src_ip) JOIN (SELECT src_ip, min(dst_port) AS min_port, max(dst_port) AS max_port,
  count(DISTINCT dst_port) FILTER (dst_port IN {S.in_list(K.SENSITIVE_PORTS)}) AS sensitive_hits FROM scan_flows_v GROUP BY 1) m USING (src_ip)
WHERE unique_ports >= 20 AND unique_hosts <= 3""", SCAN_CTE)
def scan_vertical(spark, sf):
    return PortScanDetector().vertical(view(spark, sf, "scan_flows_v")).select(
        "src_ip", "unique_hosts", "unique_ports", "total_connections", "severity", "confidence",
        F.col("sequential_runs").cast("bigint").alias("sequential_runs"), "min_port", "max_port",
        F.size("sensitive_ports_hit").cast("bigint").alias("sensitive_hits"),
    )


@query("scan_stealth", ["scan_flows_v"], """
SELECT src_ip, failed_connections, total_connections, failed_connections / total_connections AS failure_rate,
  least(0.9::DOUBLE, 0.5::DOUBLE + failed_connections / total_connections * 0.4::DOUBLE) AS confidence
FROM prof WHERE failed_connections > 0 AND failed_connections / total_connections >= 0.8""", SCAN_CTE)
def scan_stealth(spark, sf):
    return PortScanDetector().stealth(view(spark, sf, "scan_flows_v")).select(
        "src_ip", "failed_connections", "total_connections", "failure_rate", "confidence")


@query("scan_rapid", ["scan_flows_v"], """
SELECT src_ip, min(start_time) AS window_start, arg_min(n, start_time) AS events_in_window, arg_min(n, start_time) / 60 AS rate_per_second,
  least(0.85::DOUBLE, 0.5::DOUBLE + arg_min(n, start_time) / 200) AS confidence
FROM (SELECT src_ip, start_time, count(*) OVER (PARTITION BY src_ip ORDER BY start_time RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS n
  FROM scan_flows_v WHERE protocol = 'TCP') w WHERE n >= 50 GROUP BY src_ip""")
def scan_rapid(spark, sf):
    return PortScanDetector().rapid(view(spark, sf, "scan_flows_v"))


@query("busy_windows_traffic", ["traffic_v"], """
SELECT src_ip, min(ts) AS window_start, arg_min(n, ts) AS events_in_window
FROM (SELECT src_ip, ts, count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN CURRENT ROW AND 604800 FOLLOWING) AS n
  FROM traffic_v) w WHERE n >= 5 GROUP BY src_ip""")
def busy_windows_traffic(spark, sf):
    return first_busy_window(packets(spark, sf), "src_ip", "ts", 604800, 5)


@query("scan_anomalies", ["scan_flows_v"], """
SELECT src_ip, target_count, unique_hosts, unique_ports,
  CASE WHEN unique_ports > 2 * unique_hosts THEN 'vertical (port scan)' WHEN unique_hosts > 2 * unique_ports THEN 'horizontal (host scan)' ELSE 'mixed' END AS scan_type
FROM (SELECT src_ip, count(DISTINCT (dst_ip, dst_port)) AS target_count, count(DISTINCT dst_ip) AS unique_hosts, count(DISTINCT dst_port) AS unique_ports
  FROM scan_flows_v WHERE flag_bits & 2 > 0 AND flag_bits & 16 = 0 AND packet_count < 5 GROUP BY 1) t WHERE target_count >= 10""")
def scan_anomalies(spark, sf):
    return anomalies.unanswered_targets(view(spark, sf, "scan_flows_v"))


@query("port_runs", ["traffic_v"], """
SELECT src_ip, count(*) FILTER (len > 1) AS sequential_runs FROM (
  SELECT src_ip, island, count(*) AS len FROM (
    SELECT src_ip, src_port, src_port - row_number() OVER (PARTITION BY src_ip ORDER BY src_port) AS island
    FROM (SELECT DISTINCT src_ip, src_port FROM traffic_v WHERE src_port IS NOT NULL) d) i GROUP BY ALL) g GROUP BY src_ip""")
def port_runs(spark, sf):
    ports = packets(spark, sf).groupBy("src_ip").agg(F.array_sort(F.collect_set("src_port")).alias("ports"))
    return ports.where(F.size("ports") > 0).select("src_ip", sequential_runs(F.col("ports")).cast("bigint").alias("sequential_runs"))


# ---- exfiltration --------------------------------------------------------------------------

EXFIL_CTE = FLOWS_CTE.rstrip() + f""",
outf AS (SELECT * FROM flows WHERE {S.private_detector('src_ip')} AND NOT {S.private_detector('dst_ip')}),
inf AS (SELECT src_ip AS dst_ip, CAST(sum(byte_count) AS BIGINT) AS bytes_in FROM flows
  WHERE {S.private_detector('dst_ip')} AND NOT {S.private_detector('src_ip')} GROUP BY 1),
dest AS (SELECT dst_ip, count(*) AS flow_count, count(DISTINCT src_ip) AS source_count, CAST(sum(packet_count) AS BIGINT) AS total_packets,
  CAST(sum(byte_count) AS BIGINT) AS bytes_out, coalesce(any_value(bytes_in), 0) AS bytes_in, min(start_time) AS first_start, max(start_time) AS last_start,
  array_to_string(list_sort(list_distinct(list(dst_port))), ',') AS dst_ports, array_to_string(list_sort(list_distinct(list(protocol))), ',') AS protocols
  FROM outf LEFT JOIN inf USING (dst_ip) GROUP BY dst_ip)
"""


@query("destination_profiles", ["traffic_v"], """
SELECT *, CASE WHEN bytes_in <> 0 THEN bytes_out / bytes_in WHEN bytes_out > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS byte_ratio FROM dest""", EXFIL_CTE)
def destination_profiles(spark, sf):
    rows = ExfiltrationDetector().destination_profiles(fl.build_flows(packets(spark, sf)))
    return rows.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("dst_ports", "protocols")})


_SIZED = """bytes_out AS total_bytes, flow_count, source_count, last_start - first_start AS duration_seconds,
  CASE WHEN last_start > first_start THEN bytes_out * 8.0::DOUBLE / ((last_start - first_start) * 1000000.0::DOUBLE) ELSE 0.0 END AS rate_mbps,
  CASE WHEN bytes_out >= 52428800 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN bytes_out >= 52428800 THEN 0.7::DOUBLE ELSE 0.5 END AS confidence"""


def _sized(rows):
    return rows.select("dst_ip", F.col("bytes_out").alias("total_bytes"), "flow_count", "source_count",
                       "duration_seconds", "rate_mbps", "severity", "confidence")


@query("large_transfers", ["traffic_v"], f"SELECT dst_ip, {_SIZED} FROM dest WHERE bytes_out >= 10485760", EXFIL_CTE)
def large_transfers(spark, sf):
    return _sized(ExfiltrationDetector().large_transfers(fl.build_flows(packets(spark, sf))))


@query("off_hours_transfers", ["traffic_v"], f"""
SELECT dst_ip, {_SIZED} FROM (SELECT dst_ip, count(*) AS flow_count, count(DISTINCT src_ip) AS source_count, CAST(sum(byte_count) AS BIGINT) AS bytes_out,
  min(start_time) AS first_start, max(start_time) AS last_start FROM outf
  WHERE hour(make_timestamp(CAST(floor(start_time) AS BIGINT) * 1000000)) >= 22 OR hour(make_timestamp(CAST(floor(start_time) AS BIGINT) * 1000000)) < 6
  GROUP BY 1) t WHERE bytes_out >= 3000000""", EXFIL_CTE)
def off_hours_transfers(spark, sf):
    return _sized(ExfiltrationDetector(min_bytes=3_000_000).off_hours_transfers(fl.build_flows(packets(spark, sf))))


@query("high_outbound_ratio", ["traffic_v"], """
SELECT dst_ip, bytes_out, bytes_in, bytes_out / bytes_in AS byte_ratio, CASE WHEN bytes_out / bytes_in < 50 THEN 'medium' ELSE 'high' END AS severity,
  least(0.8::DOUBLE, 0.4::DOUBLE + bytes_out / bytes_in / 100) AS confidence
FROM dest WHERE bytes_in > 0 AND bytes_out >= 10485760 AND bytes_out / bytes_in >= 10""", EXFIL_CTE)
def high_outbound_ratio(spark, sf):
    return ExfiltrationDetector().high_ratios(fl.build_flows(packets(spark, sf))).select(
        "dst_ip", "bytes_out", "bytes_in", "byte_ratio", "severity", "confidence")


@query("protocol_exfil", ["traffic_v", "dns_v"], """
SELECT 'DNS' AS protocol, CAST(sum(length(query_name) + response_size) AS BIGINT) AS total_bytes, count(*) AS item_count, 0.75::DOUBLE AS confidence
FROM dns_v HAVING sum(length(query_name) + response_size) >= 1048576
UNION ALL SELECT 'ICMP', CAST(sum(byte_count) AS BIGINT), count(*), 0.8::DOUBLE FROM flows WHERE protocol = 'ICMP' HAVING sum(byte_count) >= 102400""", FLOWS_CTE)
def protocol_exfil(spark, sf):
    return ExfiltrationDetector().protocol_volumes(fl.build_flows(packets(spark, sf)), view(spark, sf, "dns_v"))


@query("cloud_storage_access", ["tls_v"], f"""
SELECT domain, CASE WHEN domain IN {S.in_list(K.PASTE_DOMAINS)} THEN 'paste_site' ELSE 'cloud_storage' END AS category, count(*) AS connection_count
FROM (SELECT arg_max(d, length(d)) AS domain FROM (SELECT row_number() OVER () AS id, lower(sni) AS s FROM tls_v) t,
  (SELECT unnest({S.sql_list(K.CLOUD_STORAGE_DOMAINS + K.PASTE_DOMAINS)}) AS d) l WHERE ends_with('.' || s, '.' || d) GROUP BY id) m GROUP BY domain""")
def cloud_storage_access(spark, sf):
    return ExfiltrationDetector().hosting_access(view(spark, sf, "tls_v"))


@query("large_transfer_anomalies", ["traffic_v"], f"""
SELECT CASE WHEN NOT {S.private_core('ip_a')} THEN ip_a ELSE ip_b END AS external_ip, CASE WHEN NOT {S.private_core('ip_a')} THEN ip_b ELSE ip_a END AS internal_ip,
  CASE WHEN NOT {S.private_core('ip_a')} THEN bytes_b_to_a ELSE bytes_a_to_b END AS outbound_bytes,
  CASE WHEN bytes_b_to_a = 0 THEN 'inf'::DOUBLE ELSE bytes_a_to_b / bytes_b_to_a END AS byte_ratio, bytes_a_to_b + bytes_b_to_a AS total_bytes, 'medium' AS severity
FROM conv WHERE NOT ({S.private_core('ip_a')} AND {S.private_core('ip_b')}) AND (bytes_b_to_a = 0 OR bytes_a_to_b / bytes_b_to_a > 10)
  AND bytes_a_to_b + bytes_b_to_a > 200000""", FLOWS_CTE)
def large_transfer_anomalies(spark, sf):
    # No conversation of the views reaches 5 MiB; the threshold is a parameter of the operator.
    return anomalies.asymmetric_transfers(fl.build_conversations(packets(spark, sf)), min_bytes=200_000).select(
        "external_ip", "internal_ip", "outbound_bytes", "byte_ratio", "total_bytes", "severity")


@query("traffic_spikes", ["traffic_v"], """
SELECT (SELECT min(ts) FROM traffic_v) + bucket * 3600 AS bucket_ts, packet_count, byte_count,
  packet_count / (SELECT avg(packet_count) FROM buckets) AS multiplier
FROM buckets WHERE (SELECT count(*) FROM buckets) >= 10 AND packet_count > 3 * (SELECT avg(packet_count) FROM buckets) AND packet_count > 5""", _buckets(3600))
def traffic_spikes(spark, sf):
    # Hourly packet counts of the views are small; both limits are parameters of the operator.
    rows = anomalies.traffic_spikes(stats.timeline(packets(spark, sf), 3600), more_than=5)
    return rows.select("bucket_ts", "packet_count", "byte_count", "multiplier")


# ---- DNS -----------------------------------------------------------------------------------

DNS_CTE = f"""
named AS (SELECT query_name, query_type, src_ip, response_size, {S.registered_parent('query_name')} AS parent FROM dns_v),
subs AS (SELECT parent, sub, count(*) AS queries, count(*) FILTER (query_type = 'TXT') AS txt, count(*) FILTER (query_type = 'NULL') AS nulls,
  CAST(sum(response_size) AS BIGINT) AS response_bytes, {S.entropy('sub')} AS entropy
  FROM (SELECT *, {S.subdomain_under('query_name', 'parent')} AS sub FROM named WHERE parent IS NOT NULL) t GROUP BY parent, sub),
profile AS (SELECT parent, CAST(sum(queries) AS BIGINT) AS query_count, count(sub) AS unique_subdomains,
  coalesce(sum(entropy * queries) FILTER (sub IS NOT NULL) / sum(queries) FILTER (sub IS NOT NULL), 0.0) AS avg_entropy,
  coalesce(avg(length(sub)), 0.0) AS avg_subdomain_length, CAST(coalesce(max(length(sub)), 0) AS INTEGER) AS max_subdomain_length,
  CAST(sum(txt) AS BIGINT) AS txt_query_count, CAST(sum(nulls) AS BIGINT) AS null_query_count, CAST(sum(response_bytes) AS BIGINT) AS response_bytes
  FROM subs GROUP BY parent),
points AS (SELECT *, CAST(CASE WHEN avg_entropy >= 3.5 THEN 30 ELSE 0 END + CASE WHEN unique_subdomains >= 20 THEN 25 ELSE 0 END
  + CASE WHEN avg_subdomain_length >= 30 THEN 20 ELSE 0 END + CASE WHEN txt_query_count / query_count >= 0.3 THEN 15 ELSE 0 END
  + CASE WHEN null_query_count > 0 THEN 10 ELSE 0 END AS INTEGER) AS points
  FROM profile WHERE query_count >= 3 AND NOT regexp_matches(parent, '(^|[.])({'|'.join(d.lstrip('.').replace('.', '[.]') for d in K.BENIGN_HIGH_ENTROPY_SUFFIXES)})$'))
"""


@query("dns_profiles", ["dns_v"], """
SELECT parent, query_count, unique_subdomains, round(avg_entropy, 6) AS avg_entropy, round(avg_subdomain_length, 6) AS avg_subdomain_length,
  max_subdomain_length, txt_query_count, null_query_count, response_bytes FROM profile""", DNS_CTE)
def dns_profiles(spark, sf):
    return DnsTunnelDetector().domain_profiles(view(spark, sf, "dns_v")).select(
        "parent", "query_count", "unique_subdomains", F.round("avg_entropy", 6).alias("avg_entropy"),
        F.round("avg_subdomain_length", 6).alias("avg_subdomain_length"), "max_subdomain_length",
        "txt_query_count", "null_query_count", "response_bytes",
    )


@query("dns_scores", ["dns_v"], "SELECT parent, points FROM points", DNS_CTE)
def dns_scores(spark, sf):
    return DnsTunnelDetector().scored(view(spark, sf, "dns_v")).select("parent", "points")


@query("dns_tunnels", ["dns_v"], """
SELECT parent, query_count, unique_subdomains, points, least(100, points + 20) / 100.0::DOUBLE AS confidence,
  CASE WHEN points >= 70 THEN 'high' WHEN points >= 50 THEN 'medium' ELSE 'low' END AS severity,
  round(e[1], 6) AS entropy_1, round(e[2], 6) AS entropy_2, round(e[3], 6) AS entropy_3
FROM points LEFT JOIN (SELECT parent, list_reverse_sort(list(entropy))[1:3] AS e FROM (
  SELECT parent, entropy, unnest(range(queries)) FROM subs WHERE sub IS NOT NULL) x GROUP BY parent) h USING (parent)
WHERE points >= 35""", DNS_CTE)
def dns_tunnels(spark, sf):
    det, dns = DnsTunnelDetector(), view(spark, sf, "dns_v")
    found = det.tunnels(dns)
    best = F.col("highest_entropies")
    return found.join(det.highest_entropies(dns, found), "parent", "left").select(
        "parent", "query_count", "unique_subdomains", "points", "confidence", "severity",
        *[F.round(F.get(best, F.lit(i)), 6).alias(f"entropy_{i + 1}") for i in range(3)],
    )


@query("dns_tunnel_tools", ["dns_v"], """
SELECT tool, count(*) AS match_count, array_to_string(list_sort(list_distinct(list(query_name)))[1:5], ',') AS sample_queries
FROM dns_v, (SELECT unnest(['dnscat', 'dns2tcp', 'iodine']) AS tool) t
WHERE regexp_matches(query_name, '[.]' || tool || '[.]', 'i') GROUP BY tool""")
def dns_tunnel_tools(spark, sf):
    return DnsTunnelDetector().known_tools(view(spark, sf, "dns_v")).withColumn(
        "sample_queries", F.array_join("sample_queries", ","))


NAMES_CTE = f"""
names AS (SELECT query_name, n, {S.simple_parent('query_name')} AS parent, {S.simple_subdomain('query_name')} AS sub
  FROM (SELECT query_name, count(*) AS n FROM dns_v GROUP BY 1) t),
high AS (SELECT query_name, parent, sub AS subdomain, {S.entropy('sub')} AS entropy, n AS query_count FROM names
  WHERE length(sub) > 10 AND {S.entropy('sub')} > 3.5)
"""
_TLD10 = f"regexp_matches(lower(query_name), '[.]({'|'.join(K.SUSPICIOUS_TLDS_EXTENDED)})$')"


@query("dns_stats", ["dns_v"], f"""
SELECT CAST(sum(n) AS BIGINT) AS total_queries, count(*) AS unique_domains, CAST(coalesce(sum(n) FILTER ({_TLD10}), 0) AS BIGINT) AS suspicious_tld_queries,
  (SELECT CAST(coalesce(sum(query_count), 0) AS BIGINT) FROM high) AS high_entropy_queries,
  CAST(coalesce(sum(n) FILTER (length(sub) > 50), 0) AS BIGINT) AS long_subdomain_queries FROM names""", NAMES_CTE)
def dns_stats(spark, sf):
    return stats.dns_overview(view(spark, sf, "dns_v"))


@query("dns_query_types", ["dns_v"], "SELECT query_type, count(*) AS query_count FROM dns_v GROUP BY 1")
def dns_query_types(spark, sf):
    return stats.dns_query_types(view(spark, sf, "dns_v"))


@query("dns_top_domains", ["dns_v"], f"""
SELECT {S.simple_parent('query_name')} AS domain, count(*) AS query_count FROM dns_v GROUP BY 1 ORDER BY query_count DESC, domain LIMIT 50""")
def dns_top_domains(spark, sf):
    return stats.dns_top_domains(view(spark, sf, "dns_v"))


@query("dns_entropy", ["dns_v"], "SELECT query_name, parent, subdomain, round(entropy, 6) AS entropy, query_count FROM high", NAMES_CTE)
def dns_entropy(spark, sf):
    return stats.high_entropy_names(view(spark, sf, "dns_v")).withColumn("entropy", F.round("entropy", 6))


@query("dns_high_entropy_queries", ["dns_v"], """
SELECT ts, src_ip, query_name, query_type FROM dns_v WHERE query_name IN (SELECT query_name FROM high)""", NAMES_CTE)
def dns_high_entropy_queries(spark, sf):
    return stats.high_entropy_queries(view(spark, sf, "dns_v")).select("ts", "src_ip", "query_name", "query_type")


@query("dns_suspicious_tld_queries", ["dns_v"], f"SELECT ts, src_ip, query_name FROM dns_v WHERE {_TLD10}")
def dns_suspicious_tld_queries(spark, sf):
    return stats.suspicious_tld_queries(view(spark, sf, "dns_v")).select("ts", "src_ip", "query_name")


@query("dns_long_subdomains", ["dns_v"], f"""
SELECT ts, query_name, CAST(length({S.simple_subdomain('query_name')}) AS INTEGER) AS subdomain_length
FROM dns_v WHERE length({S.simple_subdomain('query_name')}) > 34""")
def dns_long_subdomains(spark, sf):
    # The longest subdomain of the views has 35 characters; the length is a parameter.
    return stats.long_subdomain_queries(view(spark, sf, "dns_v"), 34).select("ts", "query_name", "subdomain_length")


@query("dns_entropy_anomalies", ["dns_v"], """
SELECT parent, query_count, sample_queries FROM (SELECT parent, CAST(sum(query_count) AS BIGINT) AS query_count,
  array_to_string(list_sort(list(query_name))[1:5], ',') AS sample_queries FROM high GROUP BY 1) t
WHERE (SELECT sum(query_count) FROM high) > 5""", NAMES_CTE)
def dns_entropy_anomalies(spark, sf):
    return anomalies.random_name_parents(view(spark, sf, "dns_v")).withColumn(
        "sample_queries", F.array_join("sample_queries", ","))


@query("dns_entropy_sources", ["dns_v"], f"""
SELECT DISTINCT {S.simple_parent('query_name')} AS parent, src_ip AS ip FROM dns_v WHERE query_name IN (SELECT query_name FROM high)
AND {S.simple_parent('query_name')} IN (SELECT parent FROM high)""", NAMES_CTE)
def dns_entropy_sources(spark, sf):
    return anomalies.random_name_sources(view(spark, sf, "dns_v"))


@query("dns_tld_anomalies", ["dns_v"], f"""
SELECT * FROM (SELECT '.' || split_part(query_name, '.', -1) AS tld, count(*) AS query_count FROM dns_v WHERE {_TLD10}
GROUP BY 1) t WHERE query_count > 3""")
def dns_tld_anomalies(spark, sf):
    return anomalies.suspicious_tlds(view(spark, sf, "dns_v"))


@query("dns_tld_sources", ["dns_v"], f"""
SELECT DISTINCT '.' || split_part(query_name, '.', -1) AS tld, src_ip AS ip FROM dns_v WHERE {_TLD10}
  AND split_part(query_name, '.', -1) IN (SELECT split_part(query_name, '.', -1) FROM dns_v WHERE {_TLD10} GROUP BY 1 HAVING count(*) > 3)""")
def dns_tld_sources(spark, sf):
    return anomalies.suspicious_tld_sources(view(spark, sf, "dns_v"))


@query("domain_parts", ["dns_v"], f"""
SELECT query_name, {S.simple_parent('query_name')} AS parent_domain, {S.simple_subdomain('query_name')} AS subdomain,
  {S.registered_parent('query_name')} AS registered_parent, {S.subdomain_under('query_name', S.registered_parent('query_name'))} AS subdomain_under,
  round({S.entropy('query_name')}, 6) AS entropy, regexp_matches(lower(query_name), '[.]({'|'.join(K.SUSPICIOUS_TLDS)})$') AS is_suspicious_tld, n
FROM (SELECT query_name, count(*) AS n FROM dns_v GROUP BY 1) t""")
def domain_parts(spark, sf):
    per_name = view(spark, sf, "dns_v").groupBy("query_name").agg(F.count(F.lit(1)).alias("n"))
    return per_name.withColumn("registered_parent", names.registered_parent("query_name")).select(
        "query_name", names.parent_domain("query_name").alias("parent_domain"), names.subdomain("query_name").alias("subdomain"),
        "registered_parent", names.subdomain_under("query_name", "registered_parent").alias("subdomain_under"),
        F.round(names.entropy("query_name"), 6).alias("entropy"), names.has_suspicious_tld("query_name").alias("is_suspicious_tld"), "n",
    )


# ---- TLS -----------------------------------------------------------------------------------


@query("tls_stats", ["tls_v"], """
SELECT count(*) AS total_connections, count(DISTINCT sni) FILTER (sni <> '') AS unique_snis,
  count(*) FILTER (is_self_signed) AS self_signed_certs, count(*) FILTER (is_expired) AS expired_certs FROM tls_v""")
def tls_stats(spark, sf):
    return stats.tls_overview(view(spark, sf, "tls_v"))


@query("tls_versions", ["tls_v"], "SELECT version, count(*) AS connection_count FROM tls_v GROUP BY 1")
def tls_versions(spark, sf):
    return stats.tls_versions(view(spark, sf, "tls_v"))


@query("top_snis", ["tls_v"], "SELECT sni, count(*) AS connection_count FROM tls_v WHERE sni <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_snis(spark, sf):
    return stats.top_snis(view(spark, sf, "tls_v"))


@query("tls_certificate_problems", ["tls_v"], "SELECT ts, src_ip, dst_ip, sni, is_self_signed, is_expired FROM tls_v WHERE is_self_signed OR is_expired")
def tls_certificate_problems(spark, sf):
    return stats.certificate_problems(view(spark, sf, "tls_v")).select(
        "ts", "src_ip", "dst_ip", "sni", "is_self_signed", "is_expired")


# ---- unified findings ----------------------------------------------------------------------

_POINT = "CASE WHEN points >= 70 THEN 'high' WHEN points >= 50 THEN 'medium' ELSE 'low' END"


def _banded(n: str) -> str:
    return f"CASE WHEN {n} >= 100 THEN 'high' WHEN {n} >= 50 THEN 'medium' ELSE 'low' END, CASE WHEN {n} >= 100 THEN 0.85 WHEN {n} >= 50 THEN 0.75 ELSE 0.6 END"


FINDING_CTE = ", ".join(x.strip() for x in (BEACON_CTE, SCAN_CTE, DNS_CTE)) + f""",
vert AS (SELECT p.*, (SELECT min(dst_ip) FROM scan_flows_v s WHERE s.src_ip = p.src_ip) AS first_host FROM prof p WHERE unique_ports >= 20 AND unique_hosts <= 3),
rapid AS (SELECT src_ip, arg_min(n, start_time) AS k FROM (SELECT src_ip, start_time, count(*) OVER (PARTITION BY src_ip ORDER BY start_time RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS n FROM scan_flows_v) w WHERE n >= 50 GROUP BY 1),
tools AS (SELECT tool, count(*) AS n FROM dns_v, (SELECT unnest(['dnscat', 'dns2tcp', 'iodine']) AS tool) t WHERE contains(lower(query_name), '.' || tool || '.') GROUP BY 1),
vol AS (SELECT sum(length(query_name) + response_size) AS b FROM dns_v),
hosting AS (SELECT d AS domain, d IN {S.in_list(K.PASTE_DOMAINS)} AS paste, count(*) AS n FROM (SELECT arg_max(d, length(d)) AS d FROM (SELECT row_number() OVER () AS id, lower(sni) AS s FROM tls_v) t,
  (SELECT unnest({S.sql_list(K.CLOUD_STORAGE_DOMAINS + K.PASTE_DOMAINS)}) AS d) l WHERE ends_with('.' || s, '.' || d) GROUP BY id) m GROUP BY d),
found(detector, rule, severity, confidence, title, display_filter) AS (
  SELECT 'beacon', 'beacon', CASE WHEN confidence >= 0.9 AND known IS NOT NULL THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END, CAST(confidence AS DOUBLE),
    concat('C2 Beacon Pattern: ', src_ip, ' → ', dst_ip, ':', dst_port), concat('ip.src == ', src_ip, ' && ip.dst == ', dst_ip, ' && tcp.dstport == ', dst_port) FROM conf
  UNION ALL SELECT 'dns_tunnel', 'tunnel', {_POINT}, least(100, points + 20) / 100.0, 'DNS Tunnel Suspected: ' || parent, 'dns.qry.name contains "' || parent || '"' FROM points WHERE points >= 35
  UNION ALL SELECT 'dns_tunnel', 'tool', 'critical', 0.95, 'Known DNS Tunnel Tool Detected: ' || tool, 'dns.qry.name contains "' || tool || '"' FROM tools
  UNION ALL SELECT 'exfiltration', 'protocol_volume', 'high', 0.75, 'High DNS Data Volume: ' || ({S.format_binary('b')}), 'dns' FROM vol WHERE b >= 1048576
  UNION ALL SELECT 'exfiltration', 'hosting_access', 'medium', 0.6, CASE WHEN paste THEN 'Paste Site Access: ' ELSE 'Cloud Storage Access: ' END || domain, 'tls.handshake.extensions_server_name contains "' || domain || '"' FROM hosting
  UNION ALL SELECT 'port_scan', 'horizontal', {_banded('unique_hosts')}, concat('Horizontal Scan: ', src_ip, ' → ', unique_hosts, ' hosts'), concat('ip.src == ', src_ip, ' && tcp.flags.syn == 1')
    FROM prof WHERE unique_hosts >= 10 AND unique_ports <= 5 AND unique_hosts / greatest(unique_ports, 1) >= 3
  UNION ALL SELECT 'port_scan', 'vertical', {_banded('unique_ports')}, concat('Vertical Scan: ', src_ip, ' → ', unique_ports, ' ports'), concat('ip.src == ', src_ip, ' && ip.dst == ', first_host) FROM vert
  UNION ALL SELECT 'port_scan', 'stealth', 'medium', least(0.9, 0.5 + failed_connections / total_connections * 0.4), concat('Stealth Scan: ', src_ip, ' (', failed_connections, ' SYN-only)'),
    concat('ip.src == ', src_ip, ' && tcp.flags.syn == 1 && tcp.flags.ack == 0') FROM prof WHERE failed_connections > 0 AND failed_connections / total_connections >= 0.8
  UNION ALL SELECT 'port_scan', 'rapid', 'medium', least(0.85, 0.5 + k / 200), concat('Rapid Scan: ', src_ip, ' (', CAST(round_even(k / 60, 0) AS BIGINT), '/sec)'), 'ip.src == ' || src_ip FROM rapid)
"""
_FINDING_VIEWS = ["beacon_flows_v", "scan_flows_v", "dns_v", "tls_v"]


def _finding_tables(spark, sf):
    scans = view(spark, sf, "scan_flows_v").withColumn("src_port", F.lit(50000))
    both = view(spark, sf, "beacon_flows_v").withColumn("flag_bits", F.lit(18)).unionByName(scans)
    return fl.Tables(flows=both, dns=view(spark, sf, "dns_v"), tls=view(spark, sf, "tls_v"))


@query("findings", _FINDING_VIEWS, """
SELECT detector, rule, severity, round_even(round(CAST(confidence AS DOUBLE), 9), 3) AS confidence, title, display_filter FROM found""", FINDING_CTE)
def findings(spark, sf):
    found = finding_records(sort_findings(run_detectors(_finding_tables(spark, sf))))
    return found.select("detector", "rule", "severity", "confidence", "title", "display_filter")


@query("findings_by_severity", _FINDING_VIEWS, "SELECT severity, count(*) AS finding_count FROM found GROUP BY 1", FINDING_CTE)
def findings_by_severity(spark, sf):
    return count_by_severity(run_detectors(_finding_tables(spark, sf)))


@query("finding_addresses", _FINDING_VIEWS, f"""
SELECT DISTINCT detector, ip FROM (
  SELECT 'beacon' AS detector, unnest([src_ip, dst_ip]) AS ip FROM conf
  UNION ALL SELECT 'dns_tunnel', src_ip FROM named WHERE parent IN (SELECT parent FROM points WHERE points >= 35)
  UNION ALL SELECT 'port_scan', src_ip FROM prof WHERE (unique_hosts >= 10 AND unique_ports <= 5 AND unique_hosts / greatest(unique_ports, 1) >= 3) OR (unique_ports >= 20 AND unique_hosts <= 3) OR failed_connections / total_connections >= 0.8
  UNION ALL SELECT 'port_scan', src_ip FROM rapid
  UNION ALL SELECT 'port_scan', dst_ip FROM (SELECT DISTINCT src_ip, dst_ip FROM scan_flows_v) r
    JOIN prof USING (src_ip) WHERE (unique_hosts >= 10 AND unique_ports <= 5 AND unique_hosts / greatest(unique_ports, 1) >= 3) OR (unique_ports >= 20 AND unique_hosts <= 3)) u""", FINDING_CTE)
def finding_addresses_query(spark, sf):
    return finding_addresses(_finding_tables(spark, sf)).select("detector", "ip").distinct()


@query("display_filters_findings", _FINDING_VIEWS, """
SELECT title AS name, display_filter AS filter, detector AS category, severity, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM found""", FINDING_CTE)
def display_filters_findings(spark, sf):
    made = D.filters_from_findings(run_detectors(_finding_tables(spark, sf)))
    return made.select("name", "filter", "category", "severity", F.round("confidence", 6).alias("confidence"))


_ANOMALY_ROWS = f"""
SELECT 'DNS Tunnel: ' || parent AS name, 'dns.qry.name contains "' || parent || '"' AS filter, 'dns_tunnel' AS category, 'high' AS severity FROM (
  SELECT parent, sum(query_count) AS c FROM high WHERE (SELECT sum(query_count) FROM high) > 5 GROUP BY 1) a
UNION ALL SELECT 'Suspicious TLD: ' || tld, 'dns.qry.name contains "' || tld || '"', 'suspicious_dns', 'medium' FROM (
  SELECT '.' || split_part(query_name, '.', -1) AS tld, count(*) AS c FROM dns_v WHERE {_TLD10} GROUP BY 1) b WHERE c > 3
UNION ALL SELECT 'Port Scan from ' || src_ip, concat('ip.src == ', src_ip, ' && tcp.flags.syn == 1 && tcp.flags.ack == 0'), 'port_scan', 'medium' FROM (
  SELECT src_ip FROM scan_flows_v WHERE flag_bits & 2 > 0 AND flag_bits & 16 = 0 AND packet_count < 5 GROUP BY 1 HAVING count(DISTINCT (dst_ip, dst_port)) >= 10) c"""


@query("display_filters_anomalies", ["scan_flows_v", "dns_v"], _ANOMALY_ROWS, NAMES_CTE)
def display_filters_anomalies(spark, sf):
    return D.filters_from_anomalies(_anomaly_rows(spark, sf)).select("name", "filter", "category", "severity")


def _anomaly_rows(spark, sf):
    by_name = anomalies.dns_anomalies(view(spark, sf, "dns_v"))
    return by_name.unionByName(anomalies.scan_anomalies(view(spark, sf, "scan_flows_v")))


@query("anomalies_by_severity", ["scan_flows_v", "dns_v"], f"SELECT severity, count(*) AS finding_count FROM ({_ANOMALY_ROWS}) t GROUP BY 1", NAMES_CTE)
def anomalies_by_severity(spark, sf):
    return count_by_severity(_anomaly_rows(spark, sf))


# Anomalies of all kinds that give expressions, over the views that hold such traffic.
_ALL_ANOMALY_CTE = ", ".join(x.strip() for x in (NAMES_CTE, BEACON_CTE, FLOWS_CTE))
_ALL_ANOMALY_ROWS = _ANOMALY_ROWS + f"""
UNION ALL SELECT 'Beacon: ' || src_ip || ' → ' || dst_ip, 'ip.addr == ' || src_ip || ' && ip.addr == ' || dst_ip, 'beacon', CASE WHEN s / m * 100 < 5 THEN 'high' ELSE 'medium' END
FROM (SELECT src_ip, dst_ip, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s FROM gaps GROUP BY src_ip, dst_ip, dst_port, protocol) t
WHERE n >= 11 AND m >= 5 AND s / m * 100 < 15
UNION ALL SELECT 'Exfiltration to ' || ip, 'ip.dst == ' || ip, 'exfiltration', severity FROM (
  SELECT unnest([ip_a, ip_b]) AS ip, CASE WHEN CASE WHEN NOT {S.private_core('ip_a')} THEN bytes_b_to_a ELSE bytes_a_to_b END > 52428800 THEN 'high' ELSE 'medium' END AS severity
  FROM conv WHERE NOT ({S.private_core('ip_a')} AND {S.private_core('ip_b')}) AND (bytes_b_to_a = 0 OR bytes_a_to_b / bytes_b_to_a > 10)
    AND bytes_a_to_b + bytes_b_to_a > 200000) x WHERE NOT {S.private_api('ip')}"""


@query("display_filters_every_anomaly", ["scan_flows_v", "dns_v", "beacon_flows_v", "traffic_v"], _ALL_ANOMALY_ROWS, _ALL_ANOMALY_CTE)
def display_filters_every_anomaly(spark, sf):
    regular = view(spark, sf, "beacon_flows_v").withColumns({"src_port": F.lit(40000), "ts": F.col("start_time")})
    conversations = fl.build_conversations(packets(spark, sf))
    rows = (
        _anomaly_rows(spark, sf)
        .unionByName(anomalies.beacon_anomalies(regular))
        .unionByName(anomalies.transfer_anomalies(conversations, min_bytes=200_000))
    )
    return D.filters_from_anomalies(rows).select("name", "filter", "category", "severity")


# Findings on traffic with every column; the values of the indicators stand in columns of their own.
_MOVED = 3_000_000
_INDICATORS = {
    "destination_ip": "string", "total_bytes": "bigint", "outbound_inbound_ratio": "double", "ports": "string", "source_count": "bigint",
    "flow_count": "bigint", "duration_seconds": "double", "rate_mbps": "double", "protocol": "string", "query_count": "bigint",
    "domain": "string", "category": "string", "connection_count": "bigint",
}
_NIGHT = "hour(make_timestamp(CAST(floor(start_time) AS BIGINT) * 1000000))"


def _moved_sql(rule: str, rows: str, title: str, note: str) -> str:
    size = S.format_binary("bytes_out")
    return f"""
SELECT md5('exfiltration|{rule}|' || dst_ip) AS finding_id, 'exfiltration' AS detector, '{rule}' AS rule, severity, confidence, '{title}: ' || ({size}) || ' to ' || dst_ip AS title,
  concat({size}, ' left for one external address{note} over ', CAST(floor(duration + 0.5) AS BIGINT), ' s (', printf('%.1f', rate), ' Mbps) from ', source_count, ' hosts.') AS description,
  dst_ip AS affected_ips, '' AS affected_flows, first_start AS timestamp_start, last_start AS timestamp_end, 'T1048,T1041' AS mitre_techniques, 'ip.dst == ' || dst_ip AS display_filter,
  dst_ip AS destination_ip, bytes_out AS total_bytes, round_even(ratio, 2) AS outbound_inbound_ratio, dst_ports AS ports, source_count, flow_count,
  round_even(duration, 2) AS duration_seconds, round_even(rate, 2) AS rate_mbps, NULL::VARCHAR AS protocol, NULL::BIGINT AS query_count, NULL::VARCHAR AS domain, NULL::VARCHAR AS category, NULL::BIGINT AS connection_count
FROM {rows}"""


_MOVED_CTE = EXFIL_CTE.rstrip() + f""",
latedest AS (SELECT dst_ip, count(*) AS flow_count, count(DISTINCT src_ip) AS source_count, CAST(sum(byte_count) AS BIGINT) AS bytes_out, coalesce(any_value(bytes_in), 0) AS bytes_in,
  min(start_time) AS first_start, max(start_time) AS last_start, array_to_string(list_sort(list_distinct(list(dst_port))), ',') AS dst_ports
  FROM (SELECT * FROM outf WHERE {_NIGHT} >= 22 OR {_NIGHT} < 6) o
  LEFT JOIN (SELECT src_ip AS dst_ip, CAST(sum(byte_count) AS BIGINT) AS bytes_in FROM flows WHERE {S.private_detector('dst_ip')} AND NOT {S.private_detector('src_ip')}
    AND ({_NIGHT} >= 22 OR {_NIGHT} < 6) GROUP BY 1) i USING (dst_ip) GROUP BY dst_ip),
judged AS (SELECT *, last_start - first_start AS duration, CASE WHEN last_start > first_start THEN bytes_out * 8.0::DOUBLE / ((last_start - first_start) * 1000000.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
  CASE WHEN bytes_in <> 0 THEN bytes_out / bytes_in ELSE 'inf'::DOUBLE END AS ratio, CASE WHEN bytes_out >= 52428800 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN bytes_out >= 52428800 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence
  FROM (SELECT 'day' AS span, dst_ip, flow_count, source_count, bytes_out, bytes_in, first_start, last_start, dst_ports FROM dest
    UNION ALL SELECT 'night', dst_ip, flow_count, source_count, bytes_out, bytes_in, first_start, last_start, dst_ports FROM latedest) x WHERE bytes_out >= {_MOVED}),
lopsided AS (SELECT * REPLACE (CASE WHEN ratio < 50 THEN 'medium' ELSE 'high' END AS severity, least(0.8::DOUBLE, 0.4::DOUBLE + ratio / 100) AS confidence) FROM judged WHERE span = 'day' AND ratio >= 2),
times AS (SELECT *, CASE WHEN isinf(ratio) THEN 'inf' ELSE CAST(CAST(round_even(ratio, 0) AS BIGINT) AS VARCHAR) END AS fold FROM lopsided)
"""
_MOVED_SQL = (
    _moved_sql("large_transfer", "judged WHERE span = 'day'", "Large Transfer", "")
    + " UNION ALL " + _moved_sql("off_hours_transfer", "judged WHERE span = 'night'", "Off-Hours Transfer", " outside working hours")
    + """ UNION ALL
SELECT md5('exfiltration|high_ratio|' || dst_ip), 'exfiltration', 'high_ratio', severity, confidence, 'High Outbound Ratio: ' || fold || ':1 to ' || dst_ip,
  'Hosts sent ' || fold || ' times what this address returned; downloads look the other way round.', dst_ip, '', first_start, last_start, 'T1048,T1041', 'ip.dst == ' || dst_ip,
  dst_ip, bytes_out, round_even(ratio, 2), dst_ports, source_count, flow_count, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM times"""
)


@query("transfer_findings", ["traffic_v"], _MOVED_SQL, _MOVED_CTE)
def transfer_findings(spark, sf):
    # Both limits are parameters of the detector; few destinations of the views reach 10 MiB or ten times.
    detector = ExfiltrationDetector(min_bytes=_MOVED, high_ratio=2.0)
    found = run_detectors(fl.Tables(flows=fl.build_flows(packets(spark, sf))), detectors=[detector])
    lists = {c: F.concat_ws(",", c) for c in ("affected_ips", "affected_flows", "mitre_techniques")}
    values = [F.try_element_at("indicators", F.lit(k)).cast(t).alias(k) for k, t in _INDICATORS.items()]
    return found.withColumns(lists).select("*", *values).drop("indicators")
