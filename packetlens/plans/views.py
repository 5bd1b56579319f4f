"""Packet, DNS, TLS and intelligence tables derived from the star-schema test tables.

Each view is one SQL text that both engines run. ``EPOCH(c)`` is the only dialect difference;
``{name}`` marks a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = {"customer", "events", "lineitem", "orders", "pages", "part", "supplier", "documents", "conversations"}

VIEWS = {
    # Internal hosts to 45.33/16; one packet in five stays inside. flag_bits: 2 SYN, 16 ACK, 24 PSH+ACK.
    "packets_v": """
SELECT EPOCH(l_shipdate) + (l_orderkey * 37 + l_linenumber * 11) % 86400 AS ts,
  l_orderkey * 10 + l_linenumber AS seq,
  concat('10.0.', CAST(floor(o_custkey / 256) AS INT), '.', CAST(o_custkey % 256 AS INT)) AS src_ip,
  concat(CASE WHEN l_suppkey % 5 = 0 THEN '192.168.7.' ELSE concat('45.33.', CAST(floor(l_suppkey / 256) AS INT), '.') END, CAST(l_suppkey % 256 AS INT)) AS dst_ip,
  CASE WHEN l_linenumber <= 4 THEN 'TCP' WHEN l_linenumber <= 6 THEN 'UDP' ELSE 'ICMP' END AS protocol,
  CASE WHEN l_linenumber <= 6 THEN CAST(49152 + l_orderkey % 16384 AS INT) END AS src_port,
  CASE WHEN l_linenumber <= 6 THEN CAST(split_part('80,443,53,22,445,3389,8080,25,123,8443,4444,21', ',', CAST(1 + l_partkey % 12 AS INT)) AS INT) END AS dst_port,
  CAST(floor(l_extendedprice) AS BIGINT) AS length,
  CAST(floor(l_extendedprice) AS BIGINT) - 40 AS payload_length,
  CASE WHEN l_linenumber <= 4 THEN CAST(CASE WHEN l_orderkey % 9 = 0 THEN 2 ELSE 16 + 8 * (l_orderkey % 2) END AS INT) ELSE 0 END AS flag_bits
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # Answers to two packets in three; some destinations answer with 40 bytes only.
    "reply_v": """
SELECT ts + 1 AS ts, seq + 5 AS seq, dst_ip AS src_ip, src_ip AS dst_ip, protocol, dst_port AS src_port, src_port AS dst_port,
  CAST(CASE WHEN dst_ip LIKE '45.33.0.1%' THEN 40 ELSE floor(length / 2) END AS BIGINT) AS length,
  CAST(0 AS BIGINT) AS payload_length, flag_bits
FROM {packets_v} WHERE length % 3 <> 0""",
    "traffic_v": """
SELECT ts, seq, src_ip, dst_ip, protocol, src_port, dst_port, length, payload_length, flag_bits FROM {packets_v}
UNION ALL
SELECT ts, seq, src_ip, dst_ip, protocol, src_port, dst_port, length, payload_length, flag_bits FROM {reply_v}""",
    # 25 groups of flow starts: regular below nation 8, irregular above.
    "beacon_flows_v": """
SELECT concat('10.9.0.', c_nationkey) AS src_ip, concat('45.77.0.', c_nationkey) AS dst_ip, CAST(40000 + rn AS INT) AS src_port, 443 AS dst_port, 'TCP' AS protocol,
  CAST(10 AS BIGINT) AS packet_count, CAST(1500 AS BIGINT) AS byte_count,
  CAST(1700000000 + 60 * rn + CASE WHEN c_nationkey >= 8 THEN c_custkey * 7919 % 40 ELSE c_custkey % 3 END AS DOUBLE) AS start_time
FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM {customer}) t""",
    # Sources 0-4 scan hosts, 5-9 scan ports, 10-19 are normal.
    "scan_flows_v": """
SELECT concat('10.8.0.', g) AS src_ip,
  CASE WHEN g < 5 THEN concat('10.5.', CAST(floor(k / 256) AS INT), '.', CAST(k % 256 AS INT)) WHEN g < 10 THEN '10.6.0.1' ELSE concat('10.6.1.', CAST(k % 2 AS INT)) END AS dst_ip,
  CAST(CASE WHEN g < 5 THEN 445 WHEN g < 10 THEN k + 1 ELSE 443 END AS INT) AS dst_port, 'TCP' AS protocol,
  CAST(CASE WHEN g < 10 THEN 2 ELSE 100 END AS BIGINT) AS packet_count, CAST(CASE WHEN g < 10 THEN 100 ELSE 50000 END AS BIGINT) AS byte_count,
  CAST(CASE WHEN g < 10 THEN 2 ELSE 18 END AS INT) AS flag_bits,
  CAST(1700000000 + CASE WHEN g < 10 THEN k ELSE k * 120 END AS DOUBLE) AS start_time
FROM (SELECT CAST(p_partkey % 20 AS INT) AS g, CAST(floor(p_partkey / 20) AS INT) AS k FROM {part}) t""",
    # A tunnel with TXT and NULL queries, a tunnel tool, a CDN, look-alikes, local names and plain sites.
    "dns_v": """
SELECT EPOCH(ts) AS ts, event_id AS seq, concat('10.0.0.', CAST(user_id % 256 AS INT)) AS src_ip, '8.8.8.8' AS dst_ip,
  CASE event_type WHEN 'click' THEN concat(md5(CAST(event_id AS VARCHAR(20))), '.t', CAST(user_id % 3 AS INT), '.evil-tunnel.tk')
    WHEN 'view' THEN concat('www.site', CAST(user_id % 40 AS INT), '.com') WHEN 'purchase' THEN concat('cdn', CAST(event_id % 500 AS INT), '.cloudfront.net')
    WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN concat('x', event_id, '.dnscat.attacker.com') ELSE concat('host', CAST(user_id % 9 AS INT), '.example.co.uk') END
    ELSE split_part('g00gle.com,micr0soft.com,paypa1.com,arnazon.com,login.github.com,printer.local,netfl1x.xyz', ',', CAST(1 + user_id % 7 AS INT)) END AS query_name,
  CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'TXT' WHEN event_type = 'click' AND event_id % 31 = 0 THEN 'NULL' ELSE 'A' END AS query_type,
  concat('45.33.0.', CAST(user_id % 256 AS INT)) AS response_ip, CAST(60 + event_id % 400 AS INT) AS response_size FROM {events}""",
    # Paste and cloud server names plus page hosts.
    "tls_v": """
SELECT CAST(1700000000 + page_id AS DOUBLE) AS ts, concat('10.0.0.', CAST(page_id % 256 AS INT)) AS src_ip, concat('45.33.0.', CAST(page_id % 90 AS INT)) AS dst_ip, 443 AS dst_port,
  CASE WHEN page_id % 10 = 0 THEN 'pastebin.com' WHEN page_id % 10 = 1 THEN 'www.dropbox.com' WHEN page_id % 10 = 2 THEN 'GIST.github.com' ELSE split_part(split_part(url, '://', 2), '/', 1) END AS sni,
  CASE WHEN page_id % 4 = 0 THEN 'TLS 1.2' ELSE 'TLS 1.3' END AS version,
  page_id % 13 = 0 AS is_self_signed, page_id % 17 = 0 AS is_expired FROM {pages}""",
    # All three intelligence sources for 45.33/16.
    "intel_v": """
SELECT concat('45.33.', CAST(floor(s_suppkey / 256) AS INT), '.', CAST(s_suppkey % 256 AS INT)) AS indicator, 'ip' AS indicator_type, s_suppkey,
  CAST(s_suppkey % 5 AS INT) AS pulse_count, CAST(s_suppkey % 11 = 0 AS BOOLEAN) AS has_malware_tag, CAST(s_suppkey * 13 % 101 AS INT) AS abuse_score, CAST(s_suppkey % 6 AS INT) AS total_reports,
  CAST(s_suppkey % 17 = 0 AS BOOLEAN) AS is_whitelisted, CAST(s_suppkey % 7 AS INT) AS malicious_count, CAST(s_suppkey % 4 AS INT) AS suspicious_count, CAST(CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 90 END AS INT) AS total_engines
FROM {supplier}""",
}

#: Views that Spark reads in another form, with the same rows: packets and their answers come from one join, not from one each.
SPARK_VIEWS = {
    "traffic_v": """
SELECT IF(answer, ts + 1, ts) AS ts, IF(answer, seq + 5, seq) AS seq, IF(answer, dst_ip, src_ip) AS src_ip, IF(answer, src_ip, dst_ip) AS dst_ip, protocol,
  IF(answer, dst_port, src_port) AS src_port, IF(answer, src_port, dst_port) AS dst_port,
  IF(answer, CAST(CASE WHEN dst_ip LIKE '45.33.0.1%' THEN 40 ELSE floor(length / 2) END AS BIGINT), length) AS length,
  IF(answer, CAST(0 AS BIGINT), payload_length) AS payload_length, flag_bits
FROM {packets_v} LATERAL VIEW explode(CASE WHEN length % 3 <> 0 THEN array(false, true) ELSE array(false) END) sent AS answer""",
}

_NAME = re.compile(r"\{(\w+)\}")
_EPOCH = re.compile(r"EPOCH\((\w+)\)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or view as a DataFrame. The tables hold UTC times without a zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _EPOCH.sub(r"(unix_micros(CAST(\1 AS TIMESTAMP)) / 1000000D)", SPARK_VIEWS.get(name, VIEWS[name]))
    inputs = {used: view(spark, sf_dir, used) for used in set(_NAME.findall(text))}
    return spark.sql(text, **inputs)


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for item in [*_closure([n for n in _NAME.findall(VIEWS[name]) if n in VIEWS]), name]:
            if item not in ordered:
                ordered.append(item)
    return ordered


def with_views(names: list[str], body: str, ctes: str = "") -> str:
    """The comparison statement: the views as common table expressions, then ``body``."""
    parts = [f"{n} AS ({_NAME.sub(r'\1', _EPOCH.sub(r'epoch(\1)', VIEWS[n]))})" for n in _closure(names)]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
