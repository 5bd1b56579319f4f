"""Scalar functions on hand-made values."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import intel, names, net, rank_of, text
from packetlens.sources.lists import bundled_legit_domains
from tests.conftest import rows_of


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r["y"] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_private_core(spark):
    private = ["10.0.0.1", "10.255.255.255", "172.16.0.1", "172.31.255.1", "192.168.1.1", "127.0.0.1", "169.254.3.4", "::1"]
    public = ["8.8.8.8", "172.15.0.1", "172.32.0.1", "192.169.1.1", "11.0.0.1", "169.253.1.1", "", "10.0.0", "fe80::1", "abc"]
    assert all(column(spark, private, net.is_private("x")))
    assert not any(column(spark, public + [None], net.is_private("x")))


def test_private_detector_and_api(spark):
    values = ["10.1", "172.16.1.1", "172.40.1.1", "172.x.1.1", "192.168.", "127.0.0.1", "169.254.1.1", "::1", "1.10.0.1"]
    assert column(spark, values, net.is_private("x", "detector")) == [True, True, False, False, True, True, False, False, False]
    assert column(spark, values, net.is_private("x", "api")) == [False, True, False, False, False, True, False, False, False]


def test_registry_modes_against_the_standard_library(spark):
    values = [f"{a}.{b}.{c}.{d}" for a in (0, 1, 9, 10, 100, 127, 128, 169, 172, 192, 198, 203, 223, 224, 239, 240, 255)
              for b in (0, 15, 16, 17, 18, 19, 20, 31, 32, 51, 88, 168, 254) for c in (0, 2, 99, 100, 113) for d in (0, 9, 10, 255)]
    values += ["::", "::1", "::2", "2001:db8::1", "2001::1", "2001:1ff::1", "2001:200::1", "2001:20::1", "2001:4860::8888",
               "fe80::1", "febf::1", "fec0::1", "fc00::1", "fdff::1", "fe00::1", "ff02::1", "100::1", "100:0:0:1::", "64:ff9b:1::1",
               "64:ff9b::1", "2002::1", "3fff::1", "3fff:fff::1", "4000::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8"]
    got = column(spark, values, net.is_private("x", "registry"))
    blocked = column(spark, values, net.is_private("x", "non_global"))
    for v, g, b in zip(values, got, blocked):
        a = ipaddress.ip_address(v)
        assert g == a.is_private, v
        assert b == (a.is_private or a.is_loopback or a.is_reserved or a.is_multicast or a.is_link_local), v
    assert column(spark, ["x", "1.2.3", "256.1.1.1", "01.2.3.4"], net.is_private("x", "registry")) == [False] * 4
    assert column(spark, ["x", "1.2.3", "256.1.1.1", "01.2.3.4"], net.is_private("x", "non_global")) == [True] * 4


def test_public_end(spark):
    df = spark.createDataFrame(
        [("8.8.8.8", "1.1.1.1"), ("10.0.0.1", "1.1.1.1"), ("8.8.8.8", "10.0.0.1"), ("10.0.0.1", "10.0.0.2")], "src_ip STRING, dst_ip STRING")
    got = df.select(net.public_ip().alias("p"), net.has_public_endpoint().alias("h")).collect()
    assert [(r.p, r.h) for r in got] == [("8.8.8.8", True), ("1.1.1.1", True), ("8.8.8.8", True), (None, False)]


def test_cdn_ranges(spark):
    values = ["104.16.0.1", "104.31.255.255", "104.32.0.0", "172.64.1.1", "34.1.2.3", "13.107.4.4", "8.8.8.8", "x"]
    assert column(spark, values, net.cdn_range("x")) == [
        "104.16.0.0/12", "104.16.0.0/12", None, "172.64.0.0/13", "34.0.0.0/8", "13.107.0.0/16", None, None]
    hits = [next((c for c in K.CDN_RANGES if ipaddress.ip_address(v) in ipaddress.ip_network(c)), None) for v in values[:-1]]
    assert column(spark, values[:-1], net.cdn_range("x")) == hits


def test_keys(spark):
    df = spark.createDataFrame([("192.168.1.100", "8.8.8.8", 54321, 443, "TCP"), ("8.8.8.8", "192.168.1.100", None, None, "ICMP")],
                               "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING")
    got = df.select(net.flow_key().alias("f"), net.conversation_key().alias("c")).collect()
    assert got[0].f == "192.168.1.100:54321->8.8.8.8:443/TCP"
    assert got[1].f == "8.8.8.8:None->192.168.1.100:None/ICMP"
    assert got[0].c == got[1].c == "192.168.1.100<->8.8.8.8"


def test_app_protocol_order(spark):
    df = spark.createDataFrame(
        [(5000, 443, b""), (80, 5000, b""), (80, 23, b""), (5000, 6000, b"GET /x"), (5000, 6000, b"HTTP/1"), (5000, 6000, b"\x16\x03\x01\x00\x05\x01"),
         (5000, 6000, b"\x16\x03"), (None, None, None)], "src_port INT, dst_port INT, h BINARY")
    got = [r.a for r in df.select(net.app_protocol(payload_head=F.col("h")).alias("a")).collect()]
    assert got == ["HTTPS", "HTTP", "UNKNOWN", "HTTP", "HTTP", "TLS", "UNKNOWN", "UNKNOWN"]


def test_flags_and_rates(spark):
    assert column(spark, [0, 2, 18, 63], net.tcp_flag_names("x"), "int") == [
        [], ["SYN"], ["SYN", "ACK"], ["FIN", "SYN", "RST", "PSH", "ACK", "URG"]]
    assert column(spark, [2, 18, 16], net.is_syn_only("x"), "int") == [True, False, False]
    assert column(spark, [2, 18, 16], net.is_complete_tcp("x"), "int") == [False, True, False]
    df = spark.createDataFrame([(10000, 1000), (5, 0), (0, 0)], "a BIGINT, b BIGINT")
    assert [r.r for r in df.select(net.byte_ratio("a", "b").alias("r")).collect()] == [10.0, float("inf"), 1.0]


def test_domains(spark):
    values = ["a.b.example.com", "example.co.uk.", "host.example.co.uk", "localhost", "Example.COM", ""]
    assert column(spark, values, names.parent_domain("x")) == ["example.com", "co.uk", "co.uk", "localhost", "Example.COM", ""]
    assert column(spark, values, names.subdomain("x")) == ["a.b", "example", "host.example", "", "", ""]
    assert column(spark, values, names.registered_parent("x")) == ["example.com", "example.co.uk", "example.co.uk", None, "example.com", None]
    assert column(spark, values, names.subdomain_under("x", names.registered_parent("x"))) == ["a.b", None, "host", None, None, None]


def test_entropy(spark):
    values = ["", "aaaa", "abcd", "aGVsbG8", "AaBb"]
    assert column(spark, values, F.round(names.entropy("x"), 4)) == [0.0, 0.0, 2.0, 2.5216, 1.0]


def test_typosquats(spark):
    values = ["g00gle.com", "micr0soft.com", "google.com", "paypa1.com", "arnazon.com", "github.com", "gitlab.com", "example.org",
              "secure-g00gle-login.tk", "localhost", "Login.G00GLE.com."]
    assert column(spark, values, names.imitated_brand("x")) == [
        "google", "microsoft", None, "paypal", "amazon", None, None, None, "google", None, "google"]
    assert column(spark, ["g00gle", "arnaz0n", "vv1ndovvs", "p@yp@|"], names.normalize_lookalike("x")) == ["google", "amazon", "windows", "paypal"]


def test_lists(spark):
    assert len(bundled_legit_domains()) == len(set(bundled_legit_domains())) == 106
    values = ["mail.google.com", "google.com", "notgoogle.com", "com", "ocsp.digicert.com."]
    assert column(spark, values, names.listed_suffix("x", bundled_legit_domains())) == ["google.com", "google.com", None, None, "ocsp.digicert.com"]
    assert column(spark, ["", "a.local", "b.in-addr.arpa", "x.bing.com", "evil.tk"], names.is_safe_domain("x")) == [True, True, True, True, False]
    assert column(spark, ["www.dropbox.com", "box.com", "gist.GitHub.com", "github.com"], names.hosting_service("x")) == [
        "dropbox.com", "box.com", "gist.github.com", None]
    assert column(spark, ["x.dnscat.y", "x.IODINE.y.z", "dnscat.y"], names.tunnel_tools("x")) == [["dnscat"], ["iodine"], []]


def test_validity(spark):
    assert column(spark, ["192.168.1.1", "256.1.1.1", "1.2.3", "", "a.b.c.d", None], net.is_dotted_quad("x")) == [True] + [False] * 5
    values = ["example.com", "sub.example.co.uk", "with space.com", "-bad.com", "", "a" * 254, "ok-1.org"]
    assert column(spark, values, names.is_valid_domain("x")) == [True, True, False, False, False, False, True]


def python_binary(n, units):
    for u in units[:-1]:
        if n < 1024:
            return f"{n:.1f} {u}"
        n /= 1024
    return f"{n:.1f} {units[-1]}"


def test_sizes(spark):
    values = [0, 1, 1023, 1024, 1280, 1536, 10 * 1024**2, 5 * 1024**3 + 7, 3 * 1024**4, 2000 * 1024**4, 11 * 1024**5]
    assert column(spark, values, text.format_bytes("x"), "bigint") == [python_binary(v, ["B", "KB", "MB", "GB", "TB"]) for v in values]
    assert column(spark, values, text.format_bytes("x", "binary_large"), "bigint") == [
        python_binary(v, ["B", "KB", "MB", "GB", "TB", "PB"]) for v in values]
    assert column(spark, [5, 2048, 3 * 1024**2, 2 * 1024**3], text.format_bytes("x", "report"), "bigint") == ["5 B", "2.0 KB", "3.0 MB", "2.00 GB"]
    assert column(spark, [5, 2048, 3_500_000, 2_000_000_000], text.format_bytes("x", "decimal"), "bigint") == [
        "5 bytes", "2.05 KB", "3.50 MB", "2.00 GB"]
    assert column(spark, [1.5, 123.0, 3725.0], text.format_duration("x"), "double") == ["1.5s", "2m 3s", "1h 2m"]
    with pytest.raises(ValueError):
        text.format_bytes("x", "other")


VT = "struct<malicious_count: int, suspicious_count: int, harmless_count: int, undetected_count: int, total_engines: int, tags: array<string>, error: string>"
ABUSE = "struct<abuse_confidence_score: int, total_reports: int, is_whitelisted: boolean, categories: array<int>, error: string>"
OTX = "struct<pulse_count: int, malware_families: array<string>, error: string>"


def test_threat_levels(spark):
    vt = [(12, 0, 0, 78, 90, ["a"], None), (0, 0, 0, 90, 90, [], None), (1, 0, 0, 0, 90, [], None), (0, 3, 0, 0, 90, [], None), (9, 0, 0, 0, 9, [], "x"), (0, 0, 0, 0, 0, [], None)]
    assert column(spark, vt, intel.vt_threat_level("x"), VT) == ["malicious", "clean", "suspicious", "suspicious", "unknown", "unknown"]
    assert column(spark, vt[:1], intel.vt_details("x"), VT) == ["12/90 - a"]
    abuse = [(90, 5, False, [14, 99], None), (50, 5, False, [], None), (0, 0, False, [], None), (10, 2, False, [], None), (99, 9, True, [], None)]
    assert column(spark, abuse, intel.abuse_threat_level("x"), ABUSE) == ["malicious", "suspicious", "clean", "unknown", "clean"]
    assert column(spark, abuse[:1], intel.abuse_details("x"), ABUSE) == ["90% confidence - 5 reports - Port Scan, Category-99"]
    otx = [(3, [], None), (1, [], None), (0, ["rat"], None), (0, [], None), (9, [], "down")]
    assert column(spark, otx, intel.otx_threat_level("x"), OTX) == ["malicious", "suspicious", "malicious", "unknown", "unknown"]
    assert column(spark, otx, intel.otx_flagged("x"), OTX) == [True, True, True, False, False]
    df = spark.createDataFrame([((2, 0, 0, 0, 90, [], None), (0, 0, False, [], None), None), (None, None, None), (None, (0, 0, False, [], None), (0, [], None))],
                               f"vt {VT}, abuse {ABUSE}, otx {OTX}")
    got = rows_of(df.select(intel.overall_threat_level().alias("l"), intel.source_count().alias("n"), intel.summary().alias("s")))
    assert [(g["l"], g["n"]) for g in got] == [("suspicious", 2), ("unknown", 0), ("clean", 2)]
    assert got[0]["s"] == "VT: 2/2 detections" and got[1]["s"] == "No threat indicators found"


def test_pulse_names_and_ranks(spark):
    pulses = [[(f"p{i}",) for i in range(7)], [(None,)]]
    got = column(spark, pulses, intel.pulse_names("x"), "array<struct<name: string>>")
    assert got == [["p0", "p1", "p2", "p3", "p4"], ["Unknown Pulse"]]
    assert column(spark, ["critical", "info", "x"], rank_of("x", K.SEVERITY_RANK, 5)) == [0, 4, 5]
    assert column(spark, ["Beacon", "port_scan", "other"], intel.detector_category("x")) == ["beacon", "port_scan", "custom"]
    assert column(spark, ["malicious", "clean", "odd"], intel.cache_ttl("x")) == [21600, 86400, 14400]
