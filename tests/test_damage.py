"""Damaged captures and link types: every loss is a counted row, nothing raises."""

import io
import random
import struct

import pyarrow as pa
import pytest

from packetlens.sources import captures, decode
from tests.conftest import rows_of
from tests.test_captures import A, B, block, classic, dns_query, eth, ip4, ip6, tcp, udp

ONE = eth(ip4(A, B, 6, tcp(50000, 80, 0x02)))


def section(order):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def face(order, link=1, snap=65535):
    return block(order, 1, struct.pack(order + "HHI", link, 0, snap))


def packet(order, frame, number=0, captured=None):
    size = len(frame) if captured is None else captured
    return block(order, 6, struct.pack(order + "IIIII", number, 0, 5_000_000, size, size) + frame)


def damaged_files():
    """name -> (bytes, expected statuses)."""
    good = classic([ONE] * 20)
    record = 16 + len(ONE)
    broken = bytearray(good)
    broken[24 + 5 * record + 8 : 24 + 5 * record + 12] = struct.pack("<I", 0x7FFFFFFF)
    shifted = bytearray(good)
    shifted[24 + 5 * record + 8 : 24 + 5 * record + 12] = struct.pack("<I", len(ONE) - 3)
    ng = section("<") + face("<")
    cut = bytearray(ng + packet("<", ONE) * 3)
    cut[len(ng) + len(packet("<", ONE)) + 4] ^= 0x04
    return {
        "length.pcap": (bytes(broken), ["ok"] * 5 + ["damaged"] + ["ok"] * 14),
        "shift.pcap": (bytes(shifted), ["ok"] * 6 + ["damaged"] + ["ok"] * 14),
        "tail.pcap": (good[:-7], ["ok"] * 19 + ["truncated"]),
        "head.pcap": (good + b"\x01\x02", ["ok"] * 20 + ["truncated"]),
        "unknown.pcapng": (ng + packet("<", ONE) + packet("<", ONE, number=3) + packet("<", ONE), ["ok", "damaged", "ok"]),
        "short.pcapng": (section("<") + block("<", 1, b"\x01\x00\x00\x00") + face("<") + packet("<", ONE) + packet("<", ONE, 1), ["damaged", "damaged", "ok"]),
        "captured.pcapng": (ng + packet("<", ONE, captured=len(ONE) + 99) + packet("<", ONE), ["damaged", "ok"]),
        "sizes.pcapng": (bytes(cut), ["ok", "damaged", "ok"]),
        "end.pcapng": (ng + packet("<", ONE) + packet("<", ONE)[:-9], ["ok", "truncated"]),
        "old.pcapng": (section(">") + face(">") + face(">") + block(">", 2, struct.pack(">HHIIII", 1, 7, 0, 9, len(ONE), len(ONE)) + ONE), ["ok"]),
        "simple.pcapng": (section("<") + face("<", snap=0) + block("<", 3, struct.pack("<I", len(ONE)) + ONE), ["ok"]),
        "text.pcap": (b"no capture at all", ["unreadable"]),
    }


@pytest.mark.parametrize("split", [200, 1 << 30])
def test_damage_is_counted_and_never_raises(spark, tmp_path, split):
    files = damaged_files()
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    frames = captures.read_captures(spark, str(tmp_path), split)
    rows = rows_of(decode.decode_frames(frames))
    for name, (_, want) in files.items():
        mine = sorted((r for r in rows if r["capture"].endswith(f"/{name}")), key=lambda r: r["seq"])
        assert [r["status"] for r in mine] == want, name
        assert [r["seq"] for r in mine] == list(range(len(want))), name
    by_file = {(r["capture"].rsplit("/", 1)[1], r["problem"]): r for r in rows_of(frames) if r["problem"]}
    assert by_file["length.pcap", "damaged"]["place"] == 24 + 5 * (16 + len(ONE))
    simple = [r for r in rows_of(frames) if r["capture"].endswith("simple.pcapng")]
    assert bytes(simple[0]["frame"]) == ONE
    counted = {(r["capture"].rsplit("/", 1)[1], r["status"]): r["frame_count"] for r in rows_of(decode.decode_errors(decode.decode_frames(frames)))}
    assert counted["short.pcapng", "damaged"] == 2 and counted["tail.pcap", "truncated"] == 1


def test_link_types(spark, tmp_path):
    v4, v6 = ip4(A, B, 6, tcp(1, 80, 0x02)), ip6("fe80::1", "2001:db8::2", 6, tcp(2, 22, 0x10))
    cooked = lambda kind, body: bytes(14) + struct.pack("!H", kind) + body
    cooked2 = lambda kind, body: struct.pack("!H", kind) + bytes(18) + body
    links = {
        0: [b"\x02\x00\x00\x00" + v4, b"\x1e\x00\x00\x00" + v6],
        1: [eth(v4), eth(v6, 0x86DD)],
        101: [v4, v6],
        113: [cooked(0x0800, v4), cooked(0x86DD, v6)],
        276: [cooked2(0x0800, v4), cooked2(0x86DD, v6)],
        105: [v4, v6],
    }
    for link, frames in links.items():
        (tmp_path / f"{link}.pcap").write_bytes(classic(frames, link=link))
    rows = rows_of(decode.decode_frames(captures.read_captures(spark, str(tmp_path))))
    for link in links:
        mine = sorted((r for r in rows if r["capture"].endswith(f"/{link}.pcap")), key=lambda r: r["seq"])
        if link == 105:
            assert [r["status"] for r in mine] == ["unsupported_link"] * 2
        else:
            assert [(r["status"], r["src_ip"], r["dst_port"]) for r in mine] == [("ok", A, 80), ("ok", "fe80::1", 22)], link


def test_payloads_that_do_not_parse_are_counted(spark, tmp_path):
    frames = [
        eth(ip4(A, "8.8.8.8", 17, udp(5353, 53, dns_query("a.example.com")))),
        eth(ip4(A, "8.8.8.8", 17, udp(5353, 53, b"\x00\x01"))),
        eth(ip4(A, "8.8.8.8", 17, udp(5353, 53, dns_query("a.example.com")[:-8]))),
    ]
    (tmp_path / "a.pcap").write_bytes(classic(frames))
    decoded = decode.decode_frames(captures.read_captures(spark, str(tmp_path)))
    parsed = decode.dns_of(decoded).count()
    got = [(r["status"], r["frame_count"]) for r in rows_of(decode.parse_errors(decoded))]
    assert parsed < 3 and got == [("unparsed_dns", 3 - parsed)]


def records_at(data, window_block=64):
    """Sequential records (place, next place, problem) of the bytes of a classic capture."""
    window = captures._Window(io.BytesIO(data), 0, window_block)
    state, start = captures._start_state(window)
    return [(r[0], r[1], r[5]) for r in captures._records(window, start, len(data), state, True)]


class Sized(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("order", ["<", ">"])
def test_damage_costs_one_record(order, monkeypatch):
    """Every kind of damage at every record of a file of mixed sizes: all other records are read."""
    monkeypatch.setattr(io, "BytesIO", Sized)
    rng = random.Random(4)
    frames = [rng.randbytes(rng.choice([1, 40, 60, 300, 1500, 9000])) for _ in range(40)]
    good = classic(frames, order)
    clean = records_at(good)
    assert len(clean) == 40 and all(p is None for _, _, p in clean)
    for i in range(0, 40, 3):
        at, following, _ = clean[i]
        for change in ((at + 8, b"\xff\xff\xff\x7f"), (at + 4, b"\xff\xff\xff\xff"), (at, b"\xff" * 16)):
            broken = bytearray(good)
            broken[change[0] : change[0] + len(change[1])] = change[1]
            got = records_at(bytes(broken))
            assert got == clean[:i] + [(at, following, got[i][2])] + clean[i + 1 :] and got[i][2] in ("damaged", "truncated")
        lost = good[: at + 7] + good[following:]  # bytes missing, so that all later borders move
        got = records_at(lost)
        assert [g[2] for g in got].count(None) >= 38 and got[-1][1] == len(lost)
    garbage = good + rng.randbytes(5000) + bytes(5000)
    assert records_at(garbage)[:40] == clean and records_at(garbage)[40][2] and len(records_at(garbage)) == 41


def test_blocks_are_found_again(monkeypatch):
    monkeypatch.setattr(io, "BytesIO", Sized)
    rng = random.Random(5)
    blocks = [packet("<", rng.randbytes(rng.randrange(1, 900))) for _ in range(20)]
    head = section("<") + face("<")
    good = head + b"".join(blocks)
    for i in range(20):
        at = len(head) + sum(map(len, blocks[:i]))
        for change in (4, len(blocks[i]) - 4):
            broken = bytearray(good)
            broken[at + change] ^= 0x44
            got = records_at(bytes(broken))
            assert [p for *_, p in got].count(None) == 19 and len(got) == 20 and got[i][2] in ("damaged", "truncated")
    joined = good + b"lost bytes!" + section(">") + face(">") + packet(">", ONE)
    assert [p for *_, p in records_at(joined)] == [None] * 20 + ["damaged", None]


def test_parts_read_like_one_reader(spark, tmp_path, monkeypatch):
    """Parts of several sizes against one range: damage, an inner capture in a frame, and no walk where borders agree."""
    rng = random.Random(6)
    plain = [rng.randbytes(rng.choice([20, 60, 700, 1400])) for _ in range(300)]
    inner = classic([bytes([i]) * 90 for i in range(12)])[24:]  # whole records within one frame
    files = {"plain.pcap": classic(plain), "inner.pcap": classic(plain[:50] + [inner] + plain[50:90] + [inner]), "big.pcap": classic([rng.randbytes(60_000)] * 3, ">")}
    broken = bytearray(files["plain.pcap"])
    for place in (20_000, 70_000, 70_100, 120_000):
        broken[place : place + 64] = bytes(64)
    files["broken.pcap"] = bytes(broken)
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    columns = ["capture", "seq", "ts", "link_type", "frame", "problem", "place"]
    read = lambda split: sorted(map(str, captures.read_captures(spark, str(tmp_path), split).select(*columns).collect()))
    want = read(1 << 30)
    for split in (900, 5000, 50_000):
        assert read(split) == want, split
    path = str(tmp_path / "plain.pcap")
    length = len(files["plain.pcap"])
    probed = [captures._probe(path, length, n, 5000) for n in range(-(-length // 5000))]
    monkeypatch.setattr(captures, "_walk", None)  # the parts alone give the ranges
    ranges = captures._join_parts(5000)(pa.Table.from_batches([captures._batch(probed, captures._PART_ARROW)])).to_pylist()
    assert len(ranges) == len(probed) and ranges[0]["start"] == 24 and ranges[-1]["end"] == length
    assert all(a["end"] == b["start"] and a["first_seq"] < b["first_seq"] for a, b in zip(ranges, ranges[1:]))
