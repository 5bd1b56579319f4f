"""Raw frames decoded to packet, DNS and TLS tables.

Header fields are read with numpy over whole Arrow batches; only DNS and TLS payloads, on
rows already filtered by port, are walked one by one.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens import schemas
from packetlens.functions import net

_DECODED = (
    "capture STRING, seq BIGINT, ts DOUBLE, src_ip STRING, dst_ip STRING, protocol STRING, src_port INT, dst_port INT, "
    "length BIGINT, payload_length BIGINT, flag_bits INT, payload_head BINARY, payload BINARY, status STRING"
)
_DECODED_ARROW = pa.schema(
    [
        ("capture", pa.string()), ("seq", pa.int64()), ("ts", pa.float64()), ("src_ip", pa.string()),
        ("dst_ip", pa.string()), ("protocol", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()),
        ("length", pa.int64()), ("payload_length", pa.int64()), ("flag_bits", pa.int32()),
        ("payload_head", pa.binary()), ("payload", pa.binary()), ("status", pa.string()),
    ]
)

# Ethernet types, IP protocol numbers and IPv6 extension headers.
_IPV4, _IPV6, _VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8, 0x9100)
_ICMP, _IGMP, _TCP, _UDP, _ICMPV6 = 1, 2, 6, 17, 58
_HOP, _ROUTING, _FRAGMENT, _AUTH, _DESTINATION = 0, 43, 44, 51, 60
_MAX_EXTENSIONS = 8


class _Frames:
    """Byte access to all frames of a batch at once; reads past a frame's end give 0."""

    def __init__(self, frames: pa.Array):
        frames = frames.cast(pa.binary()).fill_null(b"")
        self.bounds = np.frombuffer(frames.buffers()[1], dtype=np.int32)[frames.offset : frames.offset + len(frames) + 1].astype(np.int64)
        buffer = frames.buffers()[2]
        self.raw = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(1, np.uint8)
        self.start, self.size = self.bounds[:-1], np.diff(self.bounds)

    def u8(self, at):
        inside = (at >= 0) & (at < self.size)
        return np.where(inside, self.raw[np.where(inside, self.start + at, 0)], 0).astype(np.int64)

    def u16(self, at):
        return (self.u8(at) << 8) | self.u8(at + 1)

    def u32(self, at):
        return (self.u16(at) << 16) | self.u16(at + 2)

    def slices(self, at: np.ndarray, size: np.ndarray, where: np.ndarray) -> pa.Array:
        """``size`` bytes at ``at`` of the rows ``where``, null elsewhere, without a loop over rows."""
        size = np.where(where, size, 0)
        offsets = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.start + at - offsets[:-1], size) + np.arange(offsets[-1])
        valid = np.packbits(where, bitorder="little")
        buffers = [pa.py_buffer(valid.tobytes()), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(self.raw[place].tobytes())]
        return pa.Array.from_buffers(pa.binary(), len(where), buffers)


def _v4_text(numbers: np.ndarray) -> np.ndarray:
    values, where = np.unique(numbers, return_inverse=True)
    text = np.array([socket.inet_ntoa(struct.pack("!I", int(v))) for v in values], dtype=object)
    return text[where] if len(text) else np.array([], dtype=object)


def _v6_text(f: _Frames, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(f.raw[(f.start[rows] + at)[:, None] + np.arange(16)]).view("V16").ravel()
    values, where = np.unique(raw, return_inverse=True)
    return np.array([socket.inet_ntop(socket.AF_INET6, v.tobytes()) for v in values], dtype=object)[where]


#: Link types (fixed values): BSD loopback, Ethernet, raw IP, Linux cooked captures.
_LOOPBACK, _ETHERNET, _RAW, _COOKED, _COOKED2 = 0, 1, 101, 113, 276


def _network_layer(f: _Frames, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of the network layer and its Ethernet type, by link type; up to two VLAN tags are skipped.

    Loopback and raw frames have no such type: the IP version says it.
    """
    zero = np.zeros(len(f.size), np.int64)
    l3 = np.select([link == x for x in (_LOOPBACK, _RAW, _COOKED, _COOKED2)], [4, 0, 16, 20], 14) + zero
    kind = np.select([link == _ETHERNET, link == _COOKED, link == _COOKED2], [f.u16(zero + 12), f.u16(zero + 14), f.u16(zero)], 0)
    for _ in range(2):
        tagged = np.isin(kind, _VLAN)
        kind = np.where(tagged, f.u16(l3 + 2), kind)
        l3 = np.where(tagged, l3 + 4, l3)
    version = f.u8(l3) >> 4
    bare = (link == _LOOPBACK) | (link == _RAW)
    return l3, np.where(bare, np.select([version == 4, version == 6], [_IPV4, _IPV6], 0), kind)


def _decode_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    f = _Frames(batch["frame"])
    n = len(f.size)

    link = batch["link_type"].fill_null(-1).to_numpy(zero_copy_only=False)
    l3, kind = _network_layer(f, link)

    header = (f.u8(l3) & 15) * 4
    v4 = (kind == _IPV4) & (f.size >= l3 + 20) & (header >= 20)
    v6 = (kind == _IPV6) & (f.size >= l3 + 40)

    # Network layer: start and end of the transport part, protocol number, first fragment or not.
    total = f.u16(l3 + 2)
    plen = f.u16(l3 + 4)
    l4 = np.where(v4, l3 + header, l3 + 40)
    stated = np.where(v4, np.where(total > 0, l3 + total, f.size), np.where(plen > 0, l3 + 40 + plen, f.size))
    end = np.minimum(stated, f.size)
    proto = np.where(v4, f.u8(l3 + 9), f.u8(l3 + 6))
    first = np.where(v4, (f.u16(l3 + 6) & 0x1FFF) == 0, True)
    for _ in range(_MAX_EXTENSIONS):
        extended = v6 & np.isin(proto, (_HOP, _ROUTING, _FRAGMENT, _AUTH, _DESTINATION)) & (l4 + 8 <= end)
        if not extended.any():
            break
        size = np.where(proto == _FRAGMENT, 8, np.where(proto == _AUTH, (f.u8(l4 + 1) + 2) * 4, (f.u8(l4 + 1) + 1) * 8))
        first &= ~(extended & (proto == _FRAGMENT) & ((f.u16(l4 + 2) >> 3) > 0))
        proto = np.where(extended, f.u8(l4), proto)
        l4 = np.where(extended, l4 + size, l4)
    part = np.maximum(end - l4, 0)
    ip = v4 | v6

    # Transport layer.
    offset = (f.u8(l4 + 12) >> 4) * 4
    tcp = ip & first & (proto == _TCP) & (part >= 20) & (offset >= 20)
    udp = ip & first & (proto == _UDP) & (part >= 8)
    icmp4 = v4 & first & (proto == _ICMP) & (part >= 4)
    icmp6 = v6 & first & (proto == _ICMPV6) & (part >= 4)
    igmp = v4 & (proto == _IGMP)
    ports = tcp | udp
    payload_at = np.where(tcp, l4 + offset, l4 + 8)
    payload = np.where(ports, np.maximum(end - payload_at, 0), np.where(icmp4, part - 4, 0))
    names = np.select([tcp, udp, icmp4 | icmp6, igmp], ["TCP", "UDP", "ICMP", "IGMP"], "OTHER").astype(object)
    sport, dport = f.u16(l4), f.u16(l4 + 2)

    src, dst = np.full(n, None, object), np.full(n, None, object)
    src[v4], dst[v4] = _v4_text(f.u32(l3 + 12)[v4]), _v4_text(f.u32(l3 + 16)[v4])
    rows6 = np.flatnonzero(v6)
    if len(rows6):
        src[rows6], dst[rows6] = _v6_text(f, rows6, (l3 + 8)[rows6]), _v6_text(f, rows6, (l3 + 24)[rows6])

    # The first payload bytes decide HTTP and TLS; whole payloads are kept for DNS and TLS only.
    heads = f.slices(payload_at, np.minimum(payload, 6), ports & (payload > 0))
    is_dns = udp & ((sport == 53) | (dport == 53))
    is_tls = tcp & ((sport == 443) | (dport == 443)) & (payload >= 6) & (f.u8(payload_at) == 0x16)
    kept = f.slices(payload_at, payload, is_dns | is_tls)

    known = np.isin(link, (_LOOPBACK, _ETHERNET, _RAW, _COOKED, _COOKED2))
    status = np.where(ip & known, "ok", np.where(known, "not_ip", "unsupported_link")).astype(object)
    problem = batch["problem"].to_numpy(zero_copy_only=False)
    status = np.where(batch["problem"].is_valid().to_numpy(zero_copy_only=False), problem, status)
    names[~ip] = None
    columns = [
        batch["capture"], batch["seq"], batch["ts"],
        pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(names, pa.string()),
        pa.array(sport.astype(np.int32), pa.int32(), mask=~ports),
        pa.array(dport.astype(np.int32), pa.int32(), mask=~ports),
        pa.array(f.size, pa.int64()), pa.array(payload, pa.int64()),
        pa.array(np.where(tcp, f.u8(l4 + 13) & 0x3F, 0).astype(np.int32), pa.int32()),
        heads, kept, pa.array(status, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_DECODED_ARROW)


def _decode_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _decode_batch(batch)


def decode_frames(frames: DataFrame) -> DataFrame:
    """Every frame with its decoded fields and a ``status``.

    ``ok``, ``not_ip``, ``unsupported_link``, or what the reader met: ``damaged``, ``truncated``, ``unreadable``.

    Write this table once and derive the packet, DNS and TLS tables from it.
    """
    # Tables of frames that were not read from files may lack the link type (Ethernet) and the problem.
    link = F.col("link_type") if "link_type" in frames.columns else F.lit(_ETHERNET)
    problem = F.col("problem") if "problem" in frames.columns else F.when(F.col("frame").isNull(), "unreadable")
    given = frames.select("capture", "seq", "ts", "frame", link.cast("int").alias("link_type"), problem.cast("string").alias("problem"))
    decoded = given.mapInArrow(_decode_job, _DECODED)
    return decoded.withColumn("app_protocol", net.app_protocol(payload_head=F.col("payload_head"))).drop("payload_head")


def packets_of(decoded: DataFrame) -> DataFrame:
    """The packet table."""
    columns = [f.name for f in T.DataType.fromDDL(schemas.PACKETS).fields]
    return decoded.where(F.col("status") == "ok").select(*columns)


def decode_packets(frames: DataFrame) -> DataFrame:
    """Frames straight to the packet table."""
    return packets_of(decode_frames(frames))


def decode_errors(decoded: DataFrame) -> DataFrame:
    """Frames that gave no packet, per capture and reason."""
    return (
        decoded.where(F.col("status") != "ok")
        .groupBy("capture", "status")
        .agg(F.count(F.lit(1)).alias("frame_count"))
    )


# ---- DNS -----------------------------------------------------------------------------------


def _dns_name(data: bytes, at: int) -> tuple[str, int]:
    """A possibly compressed name and the position after it."""
    labels, after, jumps = [], None, 0
    while True:
        size = data[at]
        if size >= 0xC0:
            after = at + 2 if after is None else after
            at = ((size & 0x3F) << 8) | data[at + 1]
            jumps += 1
            if jumps > 64:
                raise ValueError("name loop")
        elif size == 0:
            return ".".join(labels), (at + 1 if after is None else after)
        else:
            label = data[at + 1 : at + 1 + size]
            if len(label) < size:
                raise ValueError("short name")
            labels.append(label.decode("latin-1"))
            at += 1 + size


def parse_dns(data: bytes) -> dict | None:
    """First question, A and AAAA answers, response code and the first answer's lifetime."""
    try:
        _, flags, questions, answers, _, _ = struct.unpack_from("!6H", data)
        if not questions:
            return None
        name, at = _dns_name(data, 12)
        (code,) = struct.unpack_from("!H", data, at)
        at += 4
        for _ in range(questions - 1):
            at = _dns_name(data, at)[1] + 4
        ips, ttl = [], None
        for i in range(answers):
            at = _dns_name(data, at)[1]
            kind, _, lifetime, size = struct.unpack_from("!HHIH", data, at)
            value = data[at + 10 : at + 10 + size]
            if i == 0:
                ttl = lifetime & 0x7FFFFFFF
            if kind == 1:
                ips.append(socket.inet_ntoa(value))
            elif kind == 28:
                ips.append(socket.inet_ntop(socket.AF_INET6, value))
            at += 10 + size
        return {"query_name": name, "type_code": code, "response_ips": ips, "rcode": flags & 15, "ttl": ttl}
    except (IndexError, ValueError, OSError, struct.error):
        return None


_DNS_KEYS = ["capture", "seq", "ts", "src_ip", "dst_ip"]
_DNS_OUT = (
    "capture STRING, seq BIGINT, ts DOUBLE, src_ip STRING, dst_ip STRING, query_name STRING, type_code INT, "
    "response_ips ARRAY<STRING>, rcode INT, ttl INT, response_size INT"
)
_DNS_ARROW = pa.schema(
    [
        ("capture", pa.string()), ("seq", pa.int64()), ("ts", pa.float64()), ("src_ip", pa.string()), ("dst_ip", pa.string()),
        ("query_name", pa.string()), ("type_code", pa.int32()), ("response_ips", pa.list_(pa.string())),
        ("rcode", pa.int32()), ("ttl", pa.int32()), ("response_size", pa.int32()),
    ]
)


def _payload_job(parse, schema: pa.Schema, keys: list[str]):
    """Arrow job that parses payload rows and drops those that do not parse."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch["payload"].to_pylist()
            parsed = [parse(p) for p in payloads]
            good = [i for i, x in enumerate(parsed) if x is not None]
            rows = [{**parsed[i], "response_size": len(payloads[i])} for i in good]
            kept = batch.select(keys).take(pa.array(good, pa.int64()))
            fields = [f for f in schema if f.name not in keys]
            columns = kept.columns + [pa.array([r.get(f.name) for r in rows], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return job


def _dns_payloads(decoded: DataFrame) -> DataFrame:
    return decoded.where(
        (F.col("protocol") == "UDP") & (F.col("app_protocol") == "DNS") & F.col("payload").isNotNull()
    ).select(*_DNS_KEYS, "payload")


def _parsed_dns(decoded: DataFrame) -> DataFrame:
    return _dns_payloads(decoded).mapInArrow(_payload_job(parse_dns, _DNS_ARROW, _DNS_KEYS), _DNS_OUT)


def dns_of(decoded: DataFrame) -> DataFrame:
    """The DNS table: UDP packets of the DNS application protocol that parse; :func:`parse_errors` counts the others."""
    named = _parsed_dns(decoded).withColumns(
        {"query_type": net.dns_type_name("type_code"), "response_code": net.dns_rcode_name("rcode")}
    )
    return named.select(*[f.name for f in T.DataType.fromDDL(schemas.DNS).fields])


def decode_dns(frames: DataFrame) -> DataFrame:
    """Frames straight to the DNS table."""
    return dns_of(decode_frames(frames))


# ---- TLS -----------------------------------------------------------------------------------

# Protocol version numbers.
_TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


def _hello_extensions(body: bytes, client: bool) -> Iterator[tuple[int, bytes]]:
    """Extensions of a ClientHello or ServerHello body."""
    at = 34
    at += 1 + body[at]
    if client:
        at += 2 + struct.unpack_from("!H", body, at)[0]
        at += 1 + body[at]
    else:
        at += 3
    at += 2
    while at + 4 <= len(body):
        kind, size = struct.unpack_from("!HH", body, at)
        yield kind, body[at + 4 : at + 4 + size]
        at += 4 + size


def parse_tls(data: bytes) -> dict | None:
    """Version and server name of a handshake record."""
    if len(data) < 6 or data[0] != 0x16:
        return None
    (version,) = struct.unpack_from("!H", data, 1)
    sni = ""
    try:
        client = data[5] == 1
        if data[5] in (1, 2):
            body = data[9 : 9 + int.from_bytes(data[6:9], "big")]
            (version,) = struct.unpack_from("!H", body)
            for kind, value in _hello_extensions(body, client):
                if kind == 0 and client and len(value) > 5:
                    size = struct.unpack_from("!H", value, 3)[0]
                    if len(value) >= 5 + size:
                        sni = value[5 : 5 + size].decode("ascii", errors="ignore")
                elif kind == 43:
                    listed = value[1:] if client else value
                    offered = [v for (v,) in struct.iter_unpack("!H", listed[: len(listed) // 2 * 2])]
                    version = max([v for v in offered if v in _TLS_VERSIONS], default=version)
    except (IndexError, struct.error):
        pass
    return {"sni": sni, "version": _TLS_VERSIONS.get(version, f"0x{version:04x}")}


_TLS_KEYS = ["capture", "seq", "ts", "src_ip", "dst_ip", "dst_port"]
_TLS_OUT = (
    "capture STRING, seq BIGINT, ts DOUBLE, src_ip STRING, dst_ip STRING, dst_port INT, sni STRING, version STRING"
)
_TLS_ARROW = pa.schema(
    [
        ("capture", pa.string()), ("seq", pa.int64()), ("ts", pa.float64()), ("src_ip", pa.string()), ("dst_ip", pa.string()),
        ("dst_port", pa.int32()), ("sni", pa.string()), ("version", pa.string()),
    ]
)


def _tls_payloads(decoded: DataFrame) -> DataFrame:
    return decoded.where(
        (F.col("protocol") == "TCP")
        & ((F.col("dst_port") == 443) | (F.col("src_port") == 443))
        & F.col("payload").isNotNull()
    ).select(*_TLS_KEYS, "payload")


def _parsed_tls(decoded: DataFrame) -> DataFrame:
    return _tls_payloads(decoded).mapInArrow(_payload_job(parse_tls, _TLS_ARROW, _TLS_KEYS), _TLS_OUT)


def parse_errors(decoded: DataFrame) -> DataFrame:
    """DNS and TLS payloads that didn't parse, per capture: payloads less parsed rows, with the columns of :func:`decode_errors`."""
    found = None
    for status, payloads, parsed in (
        ("unparsed_dns", _dns_payloads(decoded), _parsed_dns(decoded)),
        ("unparsed_tls", _tls_payloads(decoded), _parsed_tls(decoded)),
    ):
        rows = payloads.select("capture", F.lit(1).alias("n")).unionAll(parsed.select("capture", F.lit(-1).alias("n")))
        lost = rows.groupBy("capture").agg(F.sum("n").alias("frame_count")).where("frame_count > 0")
        lost = lost.select("capture", F.lit(status).alias("status"), "frame_count")
        found = lost if found is None else found.unionAll(lost)
    return found


def tls_of(decoded: DataFrame) -> DataFrame:
    """The TLS table: handshake records on port 443. Certificate columns stay NULL; other sources may fill them."""
    raw = _parsed_tls(decoded)
    have = set(raw.columns)
    return raw.select(*[
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in T.DataType.fromDDL(schemas.TLS).fields
    ])


def decode_tls(frames: DataFrame) -> DataFrame:
    """Frames straight to the TLS table."""
    return tls_of(decode_frames(frames))
