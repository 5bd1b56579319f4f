"""Record borders of a capture, found from any byte by a chain of plausible headers.

Headers are tested for all bytes of a block at once; a place that passes must begin ``CHAIN`` records in a row, or
fewer that end exactly where the file does. A damaged record so costs itself alone, and tasks can begin anywhere
in a file. Frames may hold such chains themselves (a capture sent over a network), so whoever splits a file by
them must compare each border with the place that reading from the border before arrives at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

CHAIN = 5
BLOCK_CHAIN = 3
#: Longest record, in bytes, that a search takes for one, and most seconds between neighbours.
LONGEST = 1 << 20
LONGEST_GAP = 86_400
#: Bytes tested at a time: few at first, since the next record is mostly near.
FIRST_STEP, LAST_STEP = 4096, 1 << 20

# Pcapng block types (section, interface, packets, names, statistics, secrets, custom).
SECTION = 0x0A0D0D0A
BLOCK_TYPES = (1, 2, 3, 4, 5, 6, 10, 0x00000BAD, 0x40000BAD, SECTION)
SECTION_ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}


def _steps(window, at: int, end: int, width: int) -> Iterator[tuple[int, bytes]]:
    """Places from ``at`` to ``end`` in steps, each with the bytes of all headers of ``width`` that begin in it."""
    step = FIRST_STEP
    while at < end:
        size = min(step, end - at)
        yield at, window.take(at, size + width - 1)
        at, step = at + size, min(2 * step, LAST_STEP)


def _places(data: bytes, order: str, words: int, plausible) -> list[int]:
    """Offsets at which ``plausible`` holds for that many 32-bit words in a row, ascending."""
    found = []
    for phase in range(4):
        count = (len(data) - phase) // 4
        if count >= words:
            row = np.frombuffer(data, order + "u4", count, phase)
            columns = [row[i : count - words + 1 + i] for i in range(words)]
            found.append(np.flatnonzero(plausible(*columns)) * 4 + phase)
    return np.sort(np.concatenate(found)).tolist() if found else []


def next_record(window, at: int, end: int, state: dict) -> int | None:
    """The first place in [at, end) where a chain of classic records begins."""
    most, fraction = min(state["most"], LONGEST), state["fraction"]

    def plausible(_, frac, size, whole):
        return (frac < fraction) & (size > 0) & (size <= whole) & (whole <= most)

    for base, data in _steps(window, at, end, 16):
        for place in _places(data, state["order"], 4, plausible):
            if _records_follow(window, base + place, state["order"], plausible):
                return base + place
    return None


def _records_follow(window, at: int, order: str, plausible) -> bool:
    before = None
    for n in range(CHAIN):
        if at == window.length:
            return n > 0
        head = window.take(at, 16)
        if len(head) < 16:
            return n > 1
        seconds, frac, size, whole = struct.unpack(order + "IIII", head)
        if not plausible(seconds, frac, size, whole) or before is not None and abs(seconds - before) > LONGEST_GAP:
            return False
        before, at = seconds, at + 16 + size
        if at > window.length:
            return n > 1
    return True


def next_block(window, at: int, end: int, order: str) -> int | None:
    """The first place in [at, end) where a chain of pcapng blocks begins, whose two lengths agree."""

    def plausible(kind, size):
        return np.isin(kind, BLOCK_TYPES) & ((kind == SECTION) | (size >= 12) & (size % 4 == 0) & (size <= LONGEST))

    for base, data in _steps(window, at, end, 8):
        for place in _places(data, order, 2, plausible):
            if _blocks_follow(window, base + place, order):
                return base + place
    return None


def _blocks_follow(window, at: int, order: str) -> bool:
    for n in range(BLOCK_CHAIN):
        if at == window.length:
            return n > 0
        head = window.take(at, 12)
        if len(head) < 12:
            return n > 1
        if struct.unpack_from("<I", head)[0] == SECTION:
            order = SECTION_ORDERS.get(head[8:12])
            if order is None:
                return False
        kind, size = struct.unpack_from(order + "II", head)
        if kind not in BLOCK_TYPES or size < 12 or size % 4 or size > LONGEST:
            return False
        if at + size > window.length:
            return n > 1
        if window.take(at + size - 4, 4) != head[4:8]:
            return False
        at += size
    return True
