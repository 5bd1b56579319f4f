"""Detectors and anomalies: planted signals must be found, quiet traffic must stay quiet."""

import statistics

import pytest
from pyspark.sql import functions as F

from packetlens.operators import anomalies, stats
from packetlens.operators.detectors import (
    detector_names,
    finding_addresses,
    finding_records,
    get_detector,
    run_detectors,
    sort_findings,
)
from packetlens.operators.detectors.base import count_by_severity
from packetlens.operators.detectors.port_scan import PortScanDetector, sequential_runs
from packetlens.operators.flows import Tables, build_conversations, build_flows, with_conversation_measures, with_flow_measures
from packetlens.operators.ranking import extreme_share, with_row_rank
from packetlens.operators.timing import first_busy_window, gap_statistics
from tests.conftest import rows_of

T0 = 1700000000.0
FLOW = ("src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, packet_count BIGINT, byte_count BIGINT, "
        "payload_bytes BIGINT, start_time DOUBLE, end_time DOUBLE, flag_bits INT, app_protocol STRING")
PACKET = ("seq BIGINT, ts DOUBLE, src_ip STRING, dst_ip STRING, protocol STRING, src_port INT, dst_port INT, length BIGINT, "
          "payload_length BIGINT, flag_bits INT, app_protocol STRING")
DNS = "ts DOUBLE, src_ip STRING, dst_ip STRING, query_name STRING, query_type STRING, response_ips ARRAY<STRING>, response_size INT"
TLS = "ts DOUBLE, src_ip STRING, dst_ip STRING, dst_port INT, sni STRING, version STRING, is_self_signed BOOLEAN, is_expired BOOLEAN"


def flow(src, dst, sport, dport, packets, size, start, end=None, proto="TCP", flags=18):
    return (src, dst, sport, dport, proto, packets, size, 0, float(start), float(end or start + 1), flags, "UNKNOWN")


def flows(spark, rows):
    return spark.createDataFrame(rows, FLOW)


def findings(spark, name, flow_rows=(), dns_rows=(), tls_rows=(), **settings):
    t = Tables(flows=flows(spark, list(flow_rows)), dns=spark.createDataFrame(list(dns_rows), DNS),
               tls=spark.createDataFrame(list(tls_rows), TLS))
    return rows_of(get_detector(name, **settings).detect(t))


# ---- flows ---------------------------------------------------------------------------------


def test_flow_of_two_packets(spark):
    key = ("192.168.1.100", "8.8.8.8", "TCP", 54321, 443)
    p = spark.createDataFrame([(0, 1000.0, *key, 100, 50, 2, "UNKNOWN"), (1, 1001.0, *key, 200, 150, 16, "HTTPS"), (2, 1000.5, *key, 0, 0, 0, "UNKNOWN")], PACKET)
    row = rows_of(with_flow_measures(build_flows(p)))[0]
    assert (row["packet_count"], row["byte_count"], row["payload_bytes"]) == (3, 300, 200)
    assert (row["start_time"], row["end_time"], row["duration_seconds"]) == (1000.0, 1001.0, 1.0)
    assert row["tcp_flags_seen"] == ["ACK", "SYN"] and row["is_complete_tcp"] and row["app_protocol"] == "HTTPS"


def test_last_known_app_protocol_wins(spark):
    key = ("10.0.0.1", "8.8.8.8", "TCP", 5000, 6000)
    p = spark.createDataFrame([(0, 3.0, *key, 1, 1, 0, "UNKNOWN"), (1, 2.0, *key, 1, 1, 0, "TLS"), (2, 1.0, *key, 1, 1, 0, "HTTP")], PACKET)
    assert rows_of(build_flows(p))[0]["app_protocol"] == "TLS"


def test_conversation_directions(spark):
    p = spark.createDataFrame([
        (0, 1.0, "192.168.1.100", "8.8.8.8", "TCP", 5000, 443, 10000, 0, 0, "HTTPS"),
        (1, 2.0, "8.8.8.8", "192.168.1.100", "UDP", 443, 5000, 1000, 0, 0, "HTTPS"),
        (2, 2.0, "8.8.8.8", "192.168.1.100", "ICMP", None, None, 0, 0, 0, "UNKNOWN")], PACKET)
    row = rows_of(with_conversation_measures(build_conversations(p)))[0]
    assert (row["ip_a"], row["ip_b"], row["byte_ratio"], row["total_packets"]) == ("192.168.1.100", "8.8.8.8", 10.0, 3)
    assert row["protocols"] == ["ICMP", "TCP", "UDP"] and row["ports_used"] == [443, 5000]


# ---- timing --------------------------------------------------------------------------------


def test_gap_statistics_match_plain_python(spark):
    times = {"a": [0.0, 0.0, 30.0, 59.9, 60.0, 300.0, 300.0, 1000.5], "b": [5.0, 65.0, 125.0], "c": [7.0], "d": [1.0, 1.0]}
    df = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k STRING, t DOUBLE")
    for shift in (0.0, 0.004, T0):
        got = {r["k"]: r for r in rows_of(gap_statistics(df.withColumn("t", F.col("t") + shift), ["k"], "t", {"n": F.lit(1)}))}
        for k, ts in times.items():
            gaps = [b - a for a, b in zip(sorted(ts), sorted(ts)[1:])]
            assert got[k]["event_count"] == got[k]["n"] == len(ts)
            assert got[k]["mean_gap"] == (pytest.approx(statistics.mean(gaps), abs=1e-6) if gaps else None)
            if len(gaps) > 1:
                assert got[k]["stdev_samp"] == pytest.approx(statistics.stdev(gaps), abs=1e-6)
                assert got[k]["stdev_pop"] == pytest.approx(statistics.pstdev(gaps), abs=1e-6)
            else:
                assert got[k]["stdev_samp"] is None


def test_first_busy_window_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    times = {k: [rng.randrange(0, 900) / 2 for _ in range(rng.randrange(5, 80))] for k in "abcdefgh"}
    times["edge"] = [0.0] * 3 + [60.0] * 2
    df = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k STRING, t DOUBLE")
    for need in (2, 5, 12):
        expected = {}
        for k, ts in times.items():
            hits = [(t, sum(t <= u <= t + 60 for u in ts)) for t in sorted(ts)]
            first = next(((t, n) for t, n in hits if n >= need), None)
            if first:
                expected[k] = first
        got = {r["k"]: (r["window_start"], r["events_in_window"]) for r in rows_of(first_busy_window(df, "k", "t", 60, need))}
        assert got == expected


def test_rank_and_share(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("v"), F.col("id").cast("string").alias("k"))
    ranked = rows_of(with_row_rank(df, [F.col("v").desc(), F.col("k")]))
    expected = sorted(ranked, key=lambda r: (-r["v"], r["k"]))
    assert [r["row_rank"] for r in expected] == list(range(1000))
    top = extreme_share(df, "v", ["k"], 0.4)
    assert sorted((r["v"], r["k"]) for r in rows_of(top)) == sorted((r["v"], r["k"]) for r in expected[:400])
    assert extreme_share(df.limit(1), "v", ["k"], 0.4).count() == 1
    bottom = extreme_share(df, "v", ["k"], 0.1, largest=False)
    assert {r["v"] for r in rows_of(bottom)} == {0}


# ---- beacons -------------------------------------------------------------------------------


def beacon_rows(dst="185.234.5.6", port=443, starts=None):
    starts = starts or [T0 + 60 * i for i in range(20)]
    return [flow("192.168.1.100", dst, 49152 + i, port, 10, 1500, t) for i, t in enumerate(starts)]


def test_regular_beacon(spark):
    got = findings(spark, "beacon", beacon_rows())
    assert len(got) == 1
    f = got[0]
    assert f["severity"] == "medium" and f["confidence"] == pytest.approx(0.75)
    assert f["indicators"]["matched_known_interval"] == "60" and f["indicators"]["connection_count"] == "20"
    assert f["title"] == "C2 Beacon Pattern: 192.168.1.100 → 185.234.5.6:443"
    assert f["display_filter"] == "ip.src == 192.168.1.100 && ip.dst == 185.234.5.6 && tcp.dstport == 443"
    assert f["mitre_techniques"] == ["T1071", "T1571"] and f["timestamp_start"] == T0


def test_irregular_and_internal_traffic_is_no_beacon(spark):
    gaps = [5, 120, 33, 290, 17, 64, 250, 8, 91, 44, 180, 12, 300, 71, 29, 150, 9, 222, 60]
    starts = [T0 + sum(gaps[:i]) for i in range(20)]
    assert findings(spark, "beacon", beacon_rows("8.8.8.8", starts=starts)) == []
    assert findings(spark, "beacon", beacon_rows("192.168.1.200", 445)) == []
    assert findings(spark, "beacon", beacon_rows(starts=[T0 + i for i in range(20)])) == []
    assert findings(spark, "beacon", beacon_rows()[:9]) == []
    assert len(findings(spark, "beacon", beacon_rows()[:9], min_connections=9)) == 1


# ---- DNS -----------------------------------------------------------------------------------


def query(name, kind="A", src="192.168.1.100", size=100):
    return (T0, src, "8.8.8.8", name, kind, [], size)


def encoded(i):
    import base64

    return base64.b32encode(f"chunk-{i:04d}-{i * 7919 % 10007:05d}".encode()).decode().strip("=").lower()


def test_tunnel(spark):
    rows = [query(f"{encoded(i)}.i.malicious-tunnel.tk", src=f"10.0.0.{i % 3}") for i in range(25)]
    got = findings(spark, "dns_tunnel", dns_rows=rows)
    assert len(got) == 1 and got[0]["severity"] in ("medium", "high")
    assert got[0]["indicators"]["domain"] == "malicious-tunnel.tk" and got[0]["indicators"]["unique_subdomains"] == "25"
    t = Tables(flows=flows(spark, []), dns=spark.createDataFrame(rows, DNS), tls=spark.createDataFrame([], TLS))
    ips = rows_of(get_detector("dns_tunnel").addresses(t))
    assert {(r["finding_id"], r["ip"]) for r in ips} == {(got[0]["finding_id"], f"10.0.0.{i}") for i in range(3)}


def test_tunnel_tool(spark):
    got = findings(spark, "dns_tunnel", dns_rows=[query("command.DNSCAT.attacker.com", "TXT")])
    assert [(f["severity"], f["confidence"]) for f in got if f["rule"] == "tool"] == [("critical", 0.95)]
    assert any("dnscat" in f["title"] for f in got)


def test_ordinary_names_are_quiet(spark):
    rows = [query(f"www.{d}.com") for d in ("google", "microsoft", "github", "amazon", "apple")]
    assert findings(spark, "dns_tunnel", dns_rows=rows) == []
    cdn = [query(f"{encoded(i)}{encoded(i + 1)}.cloudfront.net", "TXT") for i in range(40)]
    assert findings(spark, "dns_tunnel", dns_rows=cdn) == []


# ---- exfiltration --------------------------------------------------------------------------


def test_large_transfer(spark):
    got = findings(spark, "exfiltration", [flow("192.168.1.100", "45.33.32.156", 50000, 443, 70000, 100 * 1024**2, T0 + 43200, T0 + 43800)])
    large = [f for f in got if f["rule"] == "large_transfer"]
    assert len(large) == 1 and large[0]["severity"] == "high" and large[0]["title"] == "Large Transfer: 100.0 MB to 45.33.32.156"
    assert [f["title"] for f in got if f["rule"] == "high_ratio"] == ["High Outbound Ratio: inf:1 to 45.33.32.156"]


def test_ratio_needs_the_reverse_direction(spark):
    out = flow("192.168.1.100", "45.33.32.156", 50000, 443, 100, 20 * 1024**2, T0)
    back = flow("45.33.32.156", "192.168.1.100", 443, 50000, 100, 1024**2, T0)
    full = flow("45.33.32.156", "192.168.1.100", 443, 50000, 100, 10 * 1024**2, T0)
    got = [f for f in findings(spark, "exfiltration", [out, back]) if f["rule"] == "high_ratio"]
    assert len(got) == 1 and got[0]["severity"] == "medium" and got[0]["confidence"] == pytest.approx(0.6)
    assert [f for f in findings(spark, "exfiltration", [out, full]) if f["rule"] == "high_ratio"] == []


def test_off_hours(spark):
    night = 1700006400.0 + 23 * 3600 - 1700006400 % 86400
    day = night - 11 * 3600
    rows = [flow("10.0.0.1", "8.8.8.8", 1, 443, 1, 11 * 1024**2, t) for t in (night,)]
    assert [f["rule"] for f in findings(spark, "exfiltration", rows) if "off" in f["rule"]] == ["off_hours_transfer"]
    rows = [flow("10.0.0.1", "8.8.8.8", 1, 443, 1, 11 * 1024**2, day)]
    assert [f["rule"] for f in findings(spark, "exfiltration", rows) if "off" in f["rule"]] == []


def test_protocols_and_hosting(spark):
    icmp = [flow("10.0.0.1", "8.8.8.8", None, None, 10, 200 * 1024, T0, proto="ICMP")]
    dns = [query("a.example.com", size=2 * 1024**2)]
    tls = [(T0, "10.0.0.1", "104.20.1.1", 443, "PasteBin.com", "TLS 1.3", None, None), (T0, "10.0.0.1", "1.1.1.1", 443, "www.dropbox.com", "TLS 1.3", None, None),
           (T0, "10.0.0.1", "1.1.1.1", 443, "example.org", "TLS 1.3", None, None)]
    got = {f["title"]: f for f in findings(spark, "exfiltration", icmp, dns, tls)}
    assert set(got) == {"High DNS Data Volume: 2.0 MB", "High ICMP Data Volume: 200.0 KB", "Paste Site Access: pastebin.com", "Cloud Storage Access: dropbox.com"}
    assert got["Paste Site Access: pastebin.com"]["mitre_techniques"] == ["T1567"]


# ---- scans ---------------------------------------------------------------------------------


def test_horizontal_scan(spark):
    rows = [flow("192.168.1.100", f"10.0.0.{i}", 50000 + i, 445, 2, 100, T0 + i) for i in range(1, 51)]
    got = {f["rule"]: f for f in findings(spark, "port_scan", rows)}
    assert set(got) == {"horizontal", "stealth", "rapid"}
    assert got["horizontal"]["severity"] == "medium" and len(got["horizontal"]["affected_ips"]) == 21
    assert got["horizontal"]["indicators"]["top_ports"] == "445:50"
    assert got["stealth"]["confidence"] == pytest.approx(0.9) and got["rapid"]["indicators"]["connections_in_window"] == "50"


def test_vertical_scan(spark):
    rows = [flow("192.168.1.100", "10.0.0.50", 50000 + i, i, 2, 100, T0 + 10 * i) for i in range(1, 101)]
    got = {f["rule"]: f for f in findings(spark, "port_scan", rows)}
    assert set(got) == {"vertical", "stealth"}
    v = got["vertical"]
    assert v["severity"] == "high" and v["indicators"]["sequential_runs"] == "1" and v["indicators"]["port_range"] == "1-100"
    assert v["indicators"]["sensitive_ports_hit"] == "21,22,23,25,53,80" and v["affected_ips"] == ["192.168.1.100", "10.0.0.50"]


def test_normal_traffic_is_no_scan(spark):
    rows = [flow("192.168.1.100", "142.250.80.46", 50000 + i, 443, 100, 50000, T0 + 60 * i) for i in range(10)]
    assert findings(spark, "port_scan", rows) == []


def test_sequential_runs(spark):
    cases = [[], [5], [1, 2], [1, 3, 5], [1, 2, 3, 7, 8, 10, 12, 13]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, p ARRAY<INT>")
    assert [r.n for r in df.orderBy("i").select(sequential_runs(F.col("p")).alias("n")).collect()] == [0, 0, 1, 0, 3]


# ---- all together --------------------------------------------------------------------------


def test_registry_union_and_records(spark):
    assert set(detector_names()) == {"beacon", "dns_tunnel", "exfiltration", "port_scan"}
    rows = beacon_rows() + [flow("192.168.1.7", f"10.0.0.{i}", 50000 + i, 445, 2, 100, T0 + i) for i in range(1, 51)]
    t = Tables(flows=flows(spark, rows), dns=spark.createDataFrame([query("x.iodine.y.com")], DNS), tls=spark.createDataFrame([], TLS))
    found = run_detectors(t)
    got = rows_of(sort_findings(found))
    assert [f["severity"] for f in got] == sorted([f["severity"] for f in got], key=["critical", "high", "medium", "low"].index)
    assert len({f["finding_id"] for f in got}) == len(got)
    assert rows_of(count_by_severity(found))[0] == {"severity": "critical", "finding_count": 1}
    record = [r for r in rows_of(finding_records(found)) if r["rule"] == "beacon"][0]
    assert record["timestamp_start_iso"] == "2023-11-14T22:13:20" and record["confidence"] == 0.75
    pairs = rows_of(finding_addresses(t))
    beacon = [f for f in got if f["rule"] == "beacon"][0]
    assert {p["ip"] for p in pairs if p["finding_id"] == beacon["finding_id"]} == {"192.168.1.100", "185.234.5.6"}
    assert [f["rule"] for f in rows_of(run_detectors(t, names=["beacon"]))] == ["beacon"]
    strict = PortScanDetector(min_hosts=60, rapid_connections=60, min_connections=60)
    assert rows_of(run_detectors(t, detectors=[strict])) == []


# ---- anomalies -----------------------------------------------------------------------------


def packet(i, ts, src, dst, size=100, flags=16):
    return (i, float(ts), src, dst, "TCP", 40000, 443, size, 0, flags, "HTTPS")


def test_beacon_and_transfer_anomalies(spark):
    p = spark.createDataFrame([packet(i, T0 + 60 * i, "10.0.0.5", "45.33.32.156", 600_000) for i in range(12)], PACKET)
    got = rows_of(anomalies.beacon_anomalies(p))
    assert len(got) == 1 and got[0]["severity"] == "high" and got[0]["indicators"]["connection_count"] == "12"
    assert anomalies.beacon_anomalies(p.limit(10)).count() == 0
    moved = rows_of(anomalies.transfer_anomalies(build_conversations(p)))
    assert len(moved) == 1 and moved[0]["affected_ips"] == ["10.0.0.5", "45.33.32.156"] and moved[0]["severity"] == "medium"
    assert anomalies.transfer_anomalies(build_conversations(p), min_bytes=8_000_000).count() == 0


def test_dns_anomalies(spark):
    rows = [query(f"{encoded(i)}.bad.xyz") for i in range(6)] + [query("www.ok.com")] * 9
    got = {r["category"]: r for r in rows_of(anomalies.dns_anomalies(spark.createDataFrame(rows, DNS)))}
    assert got["dns_tunnel"]["indicators"]["domain"] == "bad.xyz" and got["suspicious_dns"]["indicators"] == {"tld": ".xyz", "count": "6"}
    assert rows_of(anomalies.dns_anomalies(spark.createDataFrame(rows[3:], DNS))) == []


def test_scan_and_spike_anomalies(spark):
    rows = [flow("10.0.0.9", f"10.1.0.{i}", 50000, 22, 1, 60, T0, flags=2) for i in range(12)]
    got = rows_of(anomalies.scan_anomalies(flows(spark, rows)))
    assert got[0]["indicators"]["scan_type"] == "horizontal (host scan)" and got[0]["description"].startswith("Horizontal")
    assert anomalies.scan_anomalies(flows(spark, rows[:9])).count() == 0
    steady = [packet(i, T0 + 60 * (i % 20), "10.0.0.1", "8.8.8.8") for i in range(400)]
    burst = [packet(1000 + i, T0 + 605, f"10.0.0.{i % 30}", "8.8.8.8") for i in range(300)]
    spikes = rows_of(anomalies.spike_anomalies(spark.createDataFrame(steady + burst, PACKET)))
    assert len(spikes) == 1 and spikes[0]["indicators"]["packets"] == "320" and len(spikes[0]["affected_ips"]) == 10
    assert anomalies.spike_anomalies(spark.createDataFrame(steady, PACKET)).count() == 0


def test_flow_lists(spark):
    f = flows(spark, [flow("10.0.0.1", "8.8.8.8", 1, 443, 9, 11 * 1024**2, T0, T0 + 7300), flow("10.0.0.1", "8.8.8.8", 2, 443, 1, 60, T0, flags=2)])
    assert rows_of(stats.long_flows(f))[0]["duration_hours"] == 2.03
    assert rows_of(stats.high_volume_flows(f))[0]["bytes_mb"] == 11.0
    assert [r["dst_port"] for r in rows_of(stats.syn_only_flows(f))] == [443]
