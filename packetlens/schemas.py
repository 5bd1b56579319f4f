"""Table schemas, as DDL strings. Times are epoch seconds (DOUBLE) throughout."""

FRAMES = "capture STRING, seq BIGINT, ts DOUBLE, link_type INT, frame BINARY, problem STRING, place BIGINT"

PACKETS = (
    "capture STRING, seq BIGINT, ts DOUBLE, src_ip STRING, dst_ip STRING, protocol STRING, "
    "src_port INT, dst_port INT, length BIGINT, payload_length BIGINT, flag_bits INT, app_protocol STRING"
)

DNS = (
    "capture STRING, seq BIGINT, ts DOUBLE, query_name STRING, query_type STRING, src_ip STRING, dst_ip STRING, "
    "response_ips ARRAY<STRING>, response_code STRING, ttl INT, response_size INT"
)

TLS = (
    "capture STRING, seq BIGINT, ts DOUBLE, src_ip STRING, dst_ip STRING, dst_port INT, sni STRING, "
    "subject_cn STRING, issuer_cn STRING, not_before STRING, not_after STRING, serial_number STRING, "
    "is_self_signed BOOLEAN, is_expired BOOLEAN, version STRING, cipher_suite STRING, ja3_hash STRING, ja3s_hash STRING"
)

FINDINGS = (
    "finding_id STRING, detector STRING, rule STRING, severity STRING, confidence DOUBLE, title STRING, "
    "description STRING, affected_ips ARRAY<STRING>, affected_flows ARRAY<STRING>, indicators MAP<STRING,STRING>, "
    "timestamp_start DOUBLE, timestamp_end DOUBLE, mitre_techniques ARRAY<STRING>, display_filter STRING"
)

FINDING_IPS = "finding_id STRING, detector STRING, ip STRING"

ANOMALIES = (
    "category STRING, severity STRING, description STRING, affected_ips ARRAY<STRING>, "
    "indicators MAP<STRING,STRING>"
)

INTEL_OTX = (
    "indicator STRING, indicator_type STRING, pulse_count INT, "
    "pulses ARRAY<STRUCT<id: STRING, name: STRING, created: STRING, tags: ARRAY<STRING>>>, "
    "tags ARRAY<STRING>, malware_families ARRAY<STRING>, country_code STRING, country_name STRING, "
    "city STRING, asn STRING, error STRING"
)

INTEL_ABUSE = (
    "indicator STRING, indicator_type STRING, abuse_confidence_score INT, total_reports INT, distinct_users INT, "
    "is_whitelisted BOOLEAN, is_tor_node BOOLEAN, country_code STRING, isp STRING, domain STRING, "
    "usage_type STRING, categories ARRAY<INT>, last_reported_at STRING, error STRING"
)

INTEL_VT = (
    "indicator STRING, indicator_type STRING, malicious_count INT, suspicious_count INT, harmless_count INT, "
    "undetected_count INT, total_engines INT, categories ARRAY<STRING>, tags ARRAY<STRING>, country STRING, "
    "asn INT, as_owner STRING, registrar STRING, creation_date BIGINT, last_analysis_date BIGINT, error STRING"
)

FILTERS = (
    "name STRING, filter STRING, description STRING, category STRING, severity STRING, "
    "confidence DOUBLE, related_finding_id STRING"
)
