"""Whole labels, UTC, order of display filters, ties, and complete relations."""

import pytest

from packetlens.functions import names, text
from packetlens.operators import anomalies, cache, filters, textops
from packetlens.operators.detectors.port_scan import PortScanDetector
from packetlens.operators.flows import Tables, build_flows
from packetlens.plans.analysis import first_produced
from pyspark.sql import functions as F
from tests.conftest import rows_of


@pytest.fixture
def far_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def test_names_match_whole_labels(spark):
    df = spark.createDataFrame([("www.xbox.com",), ("notpastebin.com",), ("a.box.com",), ("pastebin.com",)], "x string")
    assert [r[0] for r in df.select(names.hosting_service("x")).collect()] == [None, None, "box.com", "pastebin.com"]
    df = spark.createDataFrame([("evilfastly.net",), ("fastly.net",), ("a.fastly.net",)], "x string")
    assert [r[0] for r in df.select(names.has_benign_suffix("x")).collect()] == [False, True, True]


def test_times_are_utc(spark, far_zone):
    # 2024-03-10 02:30 doesn't exist in New York.
    df = spark.createDataFrame([(0.0,), (1710037800.75,), (None,), (-0.5,)], "t double")
    got = [r[0] for r in df.select(text.iso_time("t")).collect()]
    assert got == ["1970-01-01T00:00:00", "2024-03-10T02:30:00", None, "1969-12-31T23:59:59"]
    df = spark.createDataFrame([("2024-03-10T02:30:00", "2024-03-10 04:00:00+02:00"), ("x", "2024-01-01")], "start string, end string")
    got = rows_of(filters.time_range_filter(df))
    assert [r["filter"] for r in got] == ['frame.time >= "2024-03-10 02:30:00" && frame.time <= "2024-03-10 02:00:00"']
    stamps = df.select(F.timestamp_seconds(F.lit(0)).alias("start"), F.timestamp_seconds(F.lit(60)).alias("end")).limit(1)
    assert rows_of(filters.time_range_filter(stamps))[0]["filter"] == 'frame.time >= "1970-01-01 00:00:00" && frame.time <= "1970-01-01 00:01:00"'


def test_the_filter_made_first_stays(spark):
    schema = "name string, filter string, description string, category string, severity string, confidence double, related_finding_id string"
    made = spark.createDataFrame(
        [("a look-up", "same", "", "a", "high", 0.9, None), ("weak", "same", "", "b", "low", 0.9, "f1"), ("strong", "same", "", "z", "high", 0.2, "f2")], schema
    )
    assert [r["name"] for r in rows_of(filters.deduplicate(made, first_produced()))] == ["strong"]


def test_last_protocol_follows_the_file_within_a_microsecond(spark):
    columns = "ts double, seq long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, app_protocol string, length long, payload_length long, flag_bits int"
    packet = lambda seq, app: (5.0, seq, "10.0.0.1", "1.2.3.4", 1, 2, "TCP", app, 60, 0, 16)
    for order in (("HTTP", "DNS"), ("DNS", "HTTP"), ("SSH", "TLS"), ("TLS", "SSH")):
        flows = build_flows(spark.createDataFrame([packet(7, order[1]), packet(3, order[0])], columns))
        assert rows_of(flows)[0]["app_protocol"] == order[1]


def test_every_scanned_host_is_listed(spark):
    rows = [("10.0.0.1", f"10.1.0.{i}", 1000 + i, 445, "TCP", 2, 100, 1700000000.0 + i, 1700000000.5 + i, 2) for i in range(50)]
    flows = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_count long, byte_count long, start_time double, end_time double, flag_bits int")
    flows = flows.withColumns({"payload_bytes": F.lit(0).cast("long"), "app_protocol": F.lit("UNKNOWN"), "tcp_flags_seen": F.array(F.lit("SYN"))})
    found = {r["ip"] for r in rows_of(PortScanDetector().addresses(Tables(flows=flows)))}
    assert found == {"10.0.0.1"} | {f"10.1.0.{i}" for i in range(50)}


def test_sources_behind_a_suspicious_tld(spark):
    rows = [(f"h{i}.bad.tk", f"10.0.0.{i}") for i in range(6)] + [("one.xyz", "10.0.0.9")]
    dns = spark.createDataFrame(rows, "query_name string, src_ip string")
    got = rows_of(anomalies.suspicious_tld_sources(dns))
    assert {(r["tld"], r["ip"]) for r in got} == {(".tk", f"10.0.0.{i}") for i in range(6)}


def test_reports_are_read_whole(spark):
    many = " ".join(f"45.33.0.{i}" for i in range(1, 41))
    df = spark.createDataFrame([(f"{many}\nWireshark\n" + "\n".join(f"tcp.port == {i}" for i in range(15)),)], "text string")
    row = df.select(textops.mentioned_ips("text").alias("ips"), textops.quoted_filters("text").alias("f"), textops.mentioned_ips("text", 3).alias("few")).first()
    assert len(row["ips"]) == 40 and len(row["f"]) == 15 and len(row["few"]) == 3


def test_the_entry_added_wins_a_tie(spark):
    results = spark.createDataFrame([("1.2.3.4", "ip", "clean"), ("1.2.3.4", "ip", "malicious")], "indicator string, indicator_type string, overall_threat_level string")
    old = cache.cache_entries(results.where("overall_threat_level = 'clean'"), 100.0)
    merged = rows_of(cache.merge_cache(old, results.where("overall_threat_level = 'malicious'"), 100.0))
    assert [r["overall_threat_level"] for r in merged] == ["malicious"]
