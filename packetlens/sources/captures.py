"""Packet captures (classic pcap and pcapng) as a table of raw frames.

Captures are cut into byte ranges so that one large file is read by many tasks. Small files
are one range. Of large classic files every part is walked by a task of its own, from the first
record border that it finds (``borders``) to the first border of the part after it; where these agree along the
whole file, the ranges are those of a reader from the start. Other large files (pcapng, whose packets
need the interfaces stated before, or borders that disagree) are walked by one task each, by headers only. Paths must
be readable by the executors: a shared mount, or any URI that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens import schemas
from packetlens.sources.borders import SECTION, SECTION_ORDERS, next_block, next_record

EXTENSIONS = "*.{pcap,pcapng,cap}"
SPLIT_BYTES = 128 * 1024 * 1024
BATCH_FRAMES = 10_000
BATCH_BYTES = 16 * 1024 * 1024

_RANGES = "path STRING, start BIGINT, end BIGINT, first_seq BIGINT, state STRING"
_FRAME_ARROW = pa.schema(
    [("capture", pa.string()), ("seq", pa.int64()), ("ts", pa.float64()), ("link_type", pa.int32()), ("frame", pa.binary()),
     ("problem", pa.string()), ("place", pa.int64())]
)
_PARTS = "path STRING, part BIGINT, start BIGINT, following BIGINT, records BIGINT, state STRING"
_PART_ARROW = pa.schema(
    [("path", pa.string()), ("part", pa.int64()), ("start", pa.int64()), ("following", pa.int64()), ("records", pa.int64()),
     ("state", pa.string())]
)
_RANGE_ARROW = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first_seq", pa.int64()), ("state", pa.string())]
)

# Classic file magic -> (byte order, fractions of a second).
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e6),
    b"\xa1\xb2\xc3\xd4": (">", 1e6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e9),
    b"\xa1\xb2\x3c\x4d": (">", 1e9),
}


# ---- files ---------------------------------------------------------------------------------


def list_captures(spark: SparkSession, directory: str) -> DataFrame:
    """Captures below a directory with size and time, newest first. File contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", EXTENSIONS)
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", "length", "modificationTime")
        .orderBy(F.col("modificationTime").desc(), "path")
    )


def _open(path: str):
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(unquote(parsed.path) if parsed.scheme else path)
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


class _Window:
    """Reads forward through a file in large blocks."""

    def __init__(self, source, start: int, block: int = 4 * 1024 * 1024):
        self.source, self.block, self.length = source, block, source.size()
        self.base, self.data = start, b""

    def take(self, at: int, size: int) -> bytes:
        """``size`` bytes at an absolute position, fewer at the end of the file."""
        if at < self.base or at + size > self.base + len(self.data):
            self.source.seek(at)
            self.base, self.data = at, self.source.read(max(self.block, size))
        return self.data[at - self.base : at - self.base + size]


# ---- records -------------------------------------------------------------------------------


# A record that can't be read is yielded too, with a problem instead of a frame: ``damaged`` (impossible lengths or
# references) or ``truncated`` (the file ends inside it). Reading goes on at the next chain of plausible records, so such
# a row stands for the bytes up to there. Nothing is dropped without such a row, nothing raises.
_MAX_FRAME = 256 * 1024


def _classic_state(head: bytes) -> dict | None:
    if len(head) < 24 or head[:4] not in _MAGIC:
        return None
    order, fraction = _MAGIC[head[:4]]
    snap, link = struct.unpack(order + "II", head[16:24])
    return {"kind": "pcap", "order": order, "fraction": fraction, "link": link, "most": max(snap, _MAX_FRAME)}


def _classic_records(window: _Window, at: int, end: int, state: dict, want_data: bool):
    """(position, next position, time, link type, frame, problem) of each record that starts before ``end``."""
    header, link, size_of_file = struct.Struct(state["order"] + "IIII"), state["link"], window.length
    while at < end:
        head = window.take(at, 16)
        if len(head) < 16:
            yield at, size_of_file, 0.0, link, None, "truncated"
            return
        sec, frac, size, _ = header.unpack(head)
        following = at + 16 + size
        problem = "damaged" if size > state["most"] or frac >= state["fraction"] else "truncated" if following > size_of_file else None
        if problem:
            found = next_record(window, at + 1, size_of_file, state)
            yield at, found or size_of_file, 0.0, link, None, "damaged" if found else problem
            at = found or size_of_file
            continue
        data = window.take(at + 16, size) if want_data else b""
        yield at, following, sec + frac / state["fraction"], link, data, None
        at = following


def _options(body: bytes, at: int, order: str) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def _interface(body: bytes, order: str) -> dict:
    link, _, snap = struct.unpack_from(order + "HHI", body, 0)
    units, offset = 1e6, 0
    for code, value in _options(body, 8, order):
        if code == 9 and value:
            units = float(2 ** (value[0] & 0x7F)) if value[0] & 0x80 else 10.0 ** value[0]
        elif code == 14 and len(value) == 8:
            offset = struct.unpack(order + "q", value)[0]
    return {"link": link, "units": units, "offset": offset, "snap": snap}


def _ng_records(window: _Window, at: int, end: int, state: dict, want_data: bool):
    """The same for pcapng. ``state`` follows sections and interfaces as blocks go by.

    A block whose own lengths agree is skipped when its content is damaged, and reading goes on after it; else at the
    next chain of blocks.
    """
    size_of_file = window.length
    while at < end:
        head = window.take(at, 12)
        problem = "truncated" if len(head) < 12 else None
        if not problem and struct.unpack_from("<I", head)[0] == SECTION:
            order = SECTION_ORDERS.get(head[8:12])
            if order is None:
                problem = "damaged"
            else:
                state["order"], state["interfaces"] = order, []
        order = state["order"]
        kind, size = struct.unpack_from(order + "II", head) if len(head) >= 8 else (0, 0)
        if not problem and (size < 12 or size % 4):
            problem = "damaged"
        if not problem and at + size > size_of_file:
            problem = "truncated"
        if not problem and window.take(at + size - 4, 4) != head[4:8]:
            problem = "damaged"
        if problem:
            found = next_block(window, at + 1, size_of_file, order)
            yield at, found or size_of_file, 0.0, -1, None, "damaged" if found else problem
            at = found or size_of_file
            continue
        if kind == 1:
            face = _interface(window.take(at + 8, size - 12), order) if size >= 20 else None
            state["interfaces"].append(face)
            if face is None:
                yield at, at + size, 0.0, -1, None, "damaged"
        elif kind in (2, 3, 6):
            yield _ng_packet(window, at, size, kind, state, want_data)
        at += size


def _ng_packet(window: _Window, at: int, size: int, kind: int, state: dict, want_data: bool):
    """One packet block: enhanced (6), obsolete (2, a 16-bit interface number first) or simple (3)."""
    faces, order = state["interfaces"], state["order"]
    bad = (at, at + size, 0.0, -1, None, "damaged")
    if size < (16 if kind == 3 else 32):
        return bad
    if kind == 3:
        (captured,) = struct.unpack(order + "I", window.take(at + 8, 4))
        number, begin, stamp = 0, at + 12, None
        most = size - 16
        snap = faces[0]["snap"] if faces and faces[0] else 0
        captured = min(captured, most, snap or most)
    else:
        number, _, high, low, captured, _ = struct.unpack(order + "HHIIII", window.take(at + 8, 20))
        if kind == 6:
            (number,) = struct.unpack(order + "I", window.take(at + 8, 4))
        begin, stamp = at + 28, (high << 32) | low
        if captured > size - 32:
            return bad
    if number >= len(faces) or faces[number] is None:
        return bad
    face = faces[number]
    time = 0.0 if stamp is None else face["offset"] + stamp / face["units"]
    return at, at + size, time, face["link"], window.take(begin, captured) if want_data else b"", None


def _start_state(window: _Window) -> tuple[dict, int] | None:
    """Reader state and first record position of a file, or None when it is no capture."""
    head = window.take(0, 24)
    classic = _classic_state(head)
    if classic:
        return classic, 24
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        return {"kind": "pcapng", "order": "<", "interfaces": []}, 0
    return None


def _records(window: _Window, at: int, end: int, state: dict, want_data: bool):
    walk = _classic_records if state["kind"] == "pcap" else _ng_records
    return walk(window, at, end, state, want_data)


# ---- jobs ----------------------------------------------------------------------------------


def _walk(path: str, length: int, split_bytes: int) -> list[tuple]:
    """The ranges of a file by a walk along its headers from the start."""
    with _open(path) as source:
        window = _Window(source, 0)
        begun = _start_state(window)
        if begun is None:
            return [(path, 0, length, 0, None)]
        state, start = begun
        found, first_seq, seq, mark = [], 0, 0, json.dumps(state)
        for _, following, *_ in _records(window, start, length, state, want_data=False):
            seq += 1
            if following - start >= split_bytes:
                found.append((path, start, following, first_seq, mark))
                start, first_seq, mark = following, seq, json.dumps(state)
        if start < length:
            found.append((path, start, length, first_seq, mark))
        return found


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _index_files(split_bytes: int):
    """Arrow job: file rows -> range rows, by walks."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
                if length <= split_bytes:
                    yield _batch([(path, 0, length, 0, None)], _RANGE_ARROW)
                elif rows := _walk(path, length, split_bytes):
                    yield _batch(rows, _RANGE_ARROW)

    return job


def _probe(path: str, length: int, part: int, split_bytes: int) -> tuple | None:
    """One part of a file: its first record border, the first border after it and the records between.

    None if no record begins in the part. Without a border (part 0 of files that need a walk), the walk is asked for.
    """
    with _open(path) as source:
        begun = _start_state(_Window(source, 0, block=24))
        if begun is None or begun[0]["kind"] != "pcap":
            return (path, 0, None, None, None, None) if part == 0 else None
        state, first = begun
        window, end = _Window(source, part * split_bytes), min((part + 1) * split_bytes, length)
        start = first if part == 0 else next_record(window, max(part * split_bytes, first), end, state)
        if start is None:
            return None
        following, count = start, 0
        for _, following, *_ in _records(window, start, end, state, want_data=False):
            count += 1
        return path, part, start, following, count, json.dumps(state)


def _probe_parts(split_bytes: int):
    """Arrow job: (path, length, part) -> part rows."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_probe(r["path"], r["length"], r["part"], split_bytes) for r in batch.to_pylist()]
            if rows := [r for r in rows if r]:
                yield _batch(rows, _PART_ARROW)

    return job


def _join_parts(split_bytes: int):
    """Arrow job for the parts of one file: ranges if every part ends where the next begins, else those of a walk."""

    def job(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda r: r["part"])
        path = rows[0]["path"]
        with _open(path) as source:
            length = source.size()
        starts = [r["start"] for r in rows] + [length]
        if rows[0]["part"] == 0 and [r["following"] for r in rows] == starts[1:]:
            ranges, seq = [], 0
            for r in rows:
                ranges.append((path, r["start"], r["following"], seq, r["state"]))
                seq += r["records"]
        else:
            ranges = _walk(path, length, split_bytes)
        return pa.Table.from_batches([_batch(ranges, _RANGE_ARROW)] if ranges else [], _RANGE_ARROW)

    return job


def _large_ranges(files: DataFrame, count: int, parts: int, split_bytes: int) -> DataFrame:
    """Range rows of ``count`` large files with ``parts`` parts in all: a row per part meets the others of its file."""
    each = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / split_bytes))))
    probed = each.repartition(parts).mapInArrow(_probe_parts(split_bytes), _PARTS)
    return probed.repartition(count, "path").groupBy("path").applyInArrow(_join_parts(split_bytes), _RANGES)


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow job: range rows -> frame rows. A file that is no capture gives one row without a frame."""
    for batch in batches:
        for row in batch.to_pylist():
            yield from _read_range(**row)


def _read_range(path: str, start: int, end: int, first_seq: int, state: str | None) -> Iterator[pa.RecordBatch]:
    def packed(seqs, times, links, frames, problems, places):
        columns = [pa.array([path] * len(seqs), pa.string()), seqs, times, links, frames, problems, places]
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _FRAME_ARROW.types)],
            schema=_FRAME_ARROW,
        )

    with _open(path) as source:
        window = _Window(source, start)
        if state is None:
            begun = _start_state(window)
            if begun is None:
                yield packed([0], [0.0], [-1], [None], ["unreadable"], [0])
                return
            reader, start = begun
        else:
            reader = json.loads(state)
        rows, size, seq = [], 0, first_seq
        for place, _, ts, link, data, problem in _records(window, start, end, reader, want_data=True):
            rows.append((seq, ts, link, data, problem, place))
            seq += 1
            size += len(data or b"")
            if len(rows) >= BATCH_FRAMES or size >= BATCH_BYTES:
                yield packed(*map(list, zip(*rows)))
                rows, size = [], 0
        if rows:
            yield packed(*map(list, zip(*rows)))


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All frames of the captures below ``path``: ``capture, seq, ts, link_type, frame, problem, place``.

    A record that can't be read is a row with a null frame, its ``problem`` and its byte offset in ``place``.

    The driver sees three totals only: bytes, for the number of reading tasks, and the numbers of
    large files and of their parts, for the numbers of indexing tasks.
    """
    files = list_captures(spark, path).select("path", "length")
    is_large = F.col("length") > split_bytes
    totals = files.agg(
        F.sum("length").alias("bytes"),
        F.count_if(is_large).alias("large"),
        F.sum(F.when(is_large, F.ceil(F.col("length") / split_bytes))).alias("parts"),
    ).first()
    whole = files.where(~is_large).select(
        "path",
        F.lit(0).cast("bigint").alias("start"),
        F.col("length").alias("end"),
        F.lit(0).cast("bigint").alias("first_seq"),
        F.lit(None).cast("string").alias("state"),
    )
    ranges = whole
    if totals["large"]:
        large = _large_ranges(files.where(is_large), totals["large"], totals["parts"], split_bytes)
        ranges = whole.unionByName(large)
    tasks = max(1, -(-(totals["bytes"] or 0) // split_bytes))
    return ranges.repartition(tasks).mapInArrow(_read_ranges, schemas.FRAMES)


def read_capture_rows(files: DataFrame, split_bytes: int = SPLIT_BYTES, tasks: int | None = None) -> DataFrame:
    """Frames of the files in a (batch or streaming) table with ``path`` and ``length``.

    One task walks the headers of a large file, then its ranges go round all ``tasks`` (by default as many as cores
    are known), a number that adaptive execution leaves alone: ranges are small rows that stand for much work. A stream
    can't compare borders found by several tasks without state, and a walk is exact.
    """
    tasks = tasks or max(1, files.sparkSession.sparkContext.defaultParallelism)
    ranges = files.select("path", "length").mapInArrow(_index_files(split_bytes), _RANGES)
    return ranges.repartition(tasks).mapInArrow(_read_ranges, schemas.FRAMES)
