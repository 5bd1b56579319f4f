"""Frames assembled byte by byte: capture formats, header decoding, DNS and TLS payloads."""

import socket
import struct

import pytest

from packetlens.sources import captures, decode
from tests.conftest import rows_of

MAC = b"\x02\x00\x00\x00\x00\x01\x02\x00\x00\x00\x00\x02"


def eth(payload, kind=0x0800, vlan=False):
    tag = struct.pack("!HH", 0x8100, 5) if vlan else b""
    return MAC + tag + struct.pack("!H", kind) + payload


def ip4(src, dst, proto, body, frag=0, total=None):
    size = 20 + len(body) if total is None else total
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, size, 1, frag, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst)) + body


def ip6(src, dst, nxt, body):
    return struct.pack("!IHBB", 0x60000000, len(body), nxt, 64) + socket.inet_pton(socket.AF_INET6, src) + socket.inet_pton(socket.AF_INET6, dst) + body


def tcp(sport, dport, flags, data=b""):
    return struct.pack("!HHIIBBHHH", sport, dport, 1, 1, 5 << 4, flags, 1024, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data


def qname(name):
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\x00"


def dns_query(name, kind=1):
    return struct.pack("!6H", 7, 0x0100, 1, 0, 0, 0) + qname(name) + struct.pack("!HH", kind, 1)


def dns_answer(name, answers, rcode=0):
    out = struct.pack("!6H", 7, 0x8180 | rcode, 1, len(answers), 0, 0) + qname(name) + struct.pack("!HH", 1, 1)
    for kind, ttl, data in answers:
        out += b"\xc0\x0c" + struct.pack("!HHIH", kind, 1, ttl, len(data)) + data
    return out


def client_hello(host, versions=(0x0304, 0x0303)):
    name = host.encode()
    sni = struct.pack("!HBH", len(name) + 3, 0, len(name)) + name
    offered = b"".join(struct.pack("!H", v) for v in versions)
    exts = struct.pack("!HH", 0x0A0A, 0) + struct.pack("!HH", 0, len(sni)) + sni
    exts += struct.pack("!HHB", 43, len(offered) + 1, len(offered)) + offered
    body = struct.pack("!H", 0x0303) + bytes(32) + b"\x20" + bytes(32) + struct.pack("!HH", 2, 0x1301) + b"\x01\x00"
    body += struct.pack("!H", len(exts)) + exts
    return b"\x16\x03\x01" + struct.pack("!H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


def server_hello():
    body = struct.pack("!H", 0x0303) + bytes(32) + b"\x00" + struct.pack("!H", 0x1301) + b"\x00"
    body += struct.pack("!H", 0)
    return b"\x16\x03\x03" + struct.pack("!H", len(body) + 4) + b"\x02" + len(body).to_bytes(3, "big") + body


A, B = "192.168.1.100", "45.33.32.156"
FRAMES = [
    eth(ip4(A, B, 6, tcp(50000, 80, 0x02))),
    eth(ip4(B, A, 6, tcp(80, 50000, 0x12))),
    eth(ip4(A, B, 6, tcp(50000, 9999, 0x18, b"GET / HTTP/1.1\r\n"))),
    eth(ip4(A, B, 6, tcp(50001, 443, 0x18, client_hello("www.dropbox.com")))),
    eth(ip4(B, A, 6, tcp(443, 50001, 0x18, server_hello()))),
    eth(ip4(A, "8.8.8.8", 17, udp(5353, 53, dns_query("command.dnscat.attacker.com", 16)))),
    eth(ip4("8.8.8.8", A, 17, udp(53, 5353, dns_answer(
        "example.com", [(5, 60, qname("x.example.com")), (1, 300, socket.inet_aton(B)),
                        (28, 300, socket.inet_pton(socket.AF_INET6, "2001:db8::1"))])))),
    eth(ip4(A, B, 1, b"\x08\x00\x00\x00\x00\x01\x00\x01" + bytes(56))),
    eth(ip4(A, "224.0.0.1", 2, bytes(8))),
    eth(ip6("fe80::1", "2001:db8::2", 6, tcp(1000, 22, 0x10)), 0x86DD),
    eth(ip6("fe80::1", "2001:db8::2", 0, bytes([17, 0, 0, 0, 0, 0, 0, 0]) + udp(1000, 123, b"abc")), 0x86DD),
    eth(ip6("::1", "fe80::9", 58, bytes(8)), 0x86DD),
    eth(bytes(28), 0x0806),
    eth(ip4(A, B, 6, tcp(50002, 22, 0x02)))[:40],
    eth(ip4(A, B, 6, tcp(50003, 22, 0x02), frag=5)),
    eth(ip4(A, B, 17, udp(1, 2, b"x" * 10), total=28 + 4) + b"pad"),
    eth(ip4(A, B, 6, tcp(50004, 23, 0x29)), vlan=True),
    b"short",
]


def classic(frames, order="<", nano=False, link=1):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4",
             ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nano]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1700000000 + i, 500_000_000 if nano else 500_000, len(f), len(f)) + f
    return out


def block(order, kind, body):
    body += bytes(-len(body) % 4)
    size = len(body) + 12
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def nextgen(frames, order="<"):
    out = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(order, 1, struct.pack(order + "HHI", 1, 0, 65535) + struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0))
    for i, f in enumerate(frames):
        t = (1700000000 + i) * 10**9 + 500_000_000
        out += block(order, 6, struct.pack(order + "IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


FORMATS = {
    "a.pcap": classic(FRAMES), "b.pcap": classic(FRAMES, ">"), "c.cap": classic(FRAMES, "<", True),
    "d.pcap": classic(FRAMES, ">", True), "e.pcapng": nextgen(FRAMES), "f.pcapng": nextgen(FRAMES, ">"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("captures")
    for name, data in FORMATS.items():
        (d / name).write_bytes(data)
    (d / "notes.txt").write_text("not a capture")
    return str(d)


@pytest.mark.parametrize("split", [captures.SPLIT_BYTES, 700])
def test_every_format_gives_the_same_frames(spark, folder, split):
    got = rows_of(captures.read_captures(spark, folder, split_bytes=split))
    by_file = {}
    for r in got:
        by_file.setdefault(r["capture"].rsplit("/", 1)[1], {})[r["seq"]] = r
    assert set(by_file) == set(FORMATS)
    for rows in by_file.values():
        assert [bytes(rows[i]["frame"]) for i in range(len(FRAMES))] == FRAMES
        assert [rows[i]["ts"] for i in range(len(FRAMES))] == [1700000000.5 + i for i in range(len(FRAMES))]
        assert len(rows) == len(FRAMES)


def test_listing_and_broken_files(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"garbage")
    (tmp_path / "y.pcap").write_bytes(classic(FRAMES[:2]) + b"\x01\x02")
    names = [r["path"].rsplit("/", 1)[1] for r in rows_of(captures.list_captures(spark, str(tmp_path)))]
    assert sorted(names) == ["x.pcap", "y.pcap"]
    decoded = decode.decode_frames(captures.read_captures(spark, str(tmp_path)))
    errors = rows_of(decode.decode_errors(decoded))
    assert sorted((e["status"], e["frame_count"]) for e in errors) == [("truncated", 1), ("unreadable", 1)]
    assert decode.packets_of(decoded).count() == 2


@pytest.fixture(scope="module")
def decoded(spark, folder):
    frames = captures.read_captures(spark, folder).where("capture LIKE '%a.pcap'")
    return decode.decode_frames(frames).persist()


def test_packets(decoded):
    rows = {r["seq"]: r for r in rows_of(decode.packets_of(decoded))}

    def got(i, *cols):
        return tuple(rows[i][c] for c in cols)

    tuple5 = ("src_ip", "dst_ip", "protocol", "src_port", "dst_port")
    assert got(0, *tuple5, "flag_bits", "payload_length", "app_protocol") == (A, B, "TCP", 50000, 80, 0x02, 0, "HTTP")
    assert got(1, "flag_bits", "app_protocol") == (0x12, "HTTP")
    assert got(2, "payload_length", "app_protocol") == (16, "HTTP")
    assert got(3, "app_protocol") == ("HTTPS",)
    assert got(5, "protocol", "app_protocol") == ("UDP", "DNS")
    assert got(7, *tuple5, "payload_length") == (A, B, "ICMP", None, None, 60)
    assert got(8, "protocol", "src_port") == ("IGMP", None)
    assert got(9, *tuple5, "app_protocol") == ("fe80::1", "2001:db8::2", "TCP", 1000, 22, "SSH")
    assert got(10, "protocol", "dst_port", "payload_length") == ("UDP", 123, 3)
    assert got(11, "src_ip", "protocol", "payload_length") == ("::1", "ICMP", 0)
    assert got(13, "protocol", "src_port") == ("OTHER", None)
    assert got(14, "protocol", "src_port") == ("OTHER", None)
    assert got(15, "payload_length", "length") == (4, len(FRAMES[15]))
    assert got(16, "dst_port", "flag_bits", "app_protocol") == (23, 0x29, "UNKNOWN")
    assert 12 not in rows and 17 not in rows
    errors = rows_of(decode.decode_errors(decoded))
    assert [(e["status"], e["frame_count"]) for e in errors] == [("not_ip", 2)]


def test_dns(decoded):
    rows = {r["seq"]: r for r in rows_of(decode.dns_of(decoded))}
    assert set(rows) == {5, 6}
    assert rows[5]["query_name"] == "command.dnscat.attacker.com" and rows[5]["query_type"] == "TXT"
    assert rows[5]["response_ips"] == [] and rows[5]["ttl"] is None
    assert rows[6]["response_ips"] == [B, "2001:db8::1"] and rows[6]["ttl"] == 60
    assert rows[6]["response_code"] == "NOERROR" and rows[6]["response_size"] > 50


def test_tls(decoded):
    rows = {r["seq"]: r for r in rows_of(decode.tls_of(decoded))}
    assert set(rows) == {3, 4}
    assert (rows[3]["sni"], rows[3]["version"], rows[3]["dst_port"]) == ("www.dropbox.com", "TLS 1.3", 443)
    assert (rows[4]["sni"], rows[4]["version"]) == ("", "TLS 1.2")


def test_malformed_payloads():
    assert decode.parse_dns(b"\x00" * 5) is None
    assert decode.parse_dns(struct.pack("!6H", 7, 0, 1, 0, 0, 0) + b"\xc0\x0c\x00\x01\x00\x01") is None
    assert decode.parse_dns(struct.pack("!6H", 7, 0, 0, 0, 0, 0)) is None
    assert decode.parse_tls(b"\x16\x03\x01\x00\x05\x01") == {"sni": "", "version": "TLS 1.0"}
    assert decode.parse_tls(b"\x17\x03\x01\x00\x05\x01") is None
    hello = client_hello("a.example")
    for cut in range(6, len(hello)):
        assert decode.parse_tls(hello[:cut]) is not None
