"""Large tables of address ranges: longest-prefix matching by equi-joins.

A range is a union of at most two aligned blocks per prefix length, so it becomes that many prefixes. An address has one
prefix of each length that the table uses; addresses and ranges meet where these are equal. No pair of an address and
a range that doesn't contain it is ever made, and the join splits a prefix that many addresses share like any skewed key.
IPv4 and IPv6 are kept apart by a family byte.
"""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = {4: 32, 6: 128}


def parse(text: str | None) -> tuple[int, int] | None:
    """(family, number) of an address, or None for what is none."""
    for family, kind in ((4, socket.AF_INET), (6, socket.AF_INET6)):
        try:
            return family, int.from_bytes(socket.inet_pton(kind, text or ""), "big")
        except (OSError, ValueError):
            continue
    return None


def prefix_key(family: int, bits: int, number: int) -> bytes:
    """Family, length and the leading bits: equal for an address and a block that contains it."""
    return bytes((family, bits)) + (number >> (BITS[family] - bits)).to_bytes(16, "big")


def blocks_of(low: int, high: int, width: int) -> Iterator[tuple[int, int]]:
    """(bits, first address) of the fewest aligned blocks that make up low to high."""
    first, end = low, high + 1
    for level in range(width + 1):
        if first >= end:
            return
        if first & 1:
            yield width - level, first << level
            first += 1
        if end & 1:
            end -= 1
            if first <= end:
                yield width - level, end << level
        first, end = first >> 1, end >> 1


def _range(row: dict) -> tuple[int, int, int] | None:
    """(family, low, high) of a row with ``cidr`` or with ``low`` and ``high``; None if it is no range."""
    if row.get("cidr"):
        try:
            net = ipaddress.ip_network(row["cidr"].strip(), strict=False)
        except ValueError:
            return None
        return net.version, int(net.network_address), int(net.broadcast_address)
    low, high = parse(row.get("low")), parse(row.get("high"))
    if low is None or high is None or low[0] != high[0] or low[1] > high[1]:
        return None
    return low[0], low[1], high[1]


def _prefixes(batches):
    for batch in batches:
        keys, bits, families, sizes, values = [], [], [], [], []
        for row in batch.to_pylist():
            if (found := _range(row)) is None:
                continue
            family, low, high = found
            for length, first in blocks_of(low, high, BITS[family]):
                keys.append(prefix_key(family, length, first))
                families.append(family)
                bits.append(length)
                # Sizes sort as numbers do, whatever the family.
                sizes.append((high - low).to_bytes(16, "big"))
                values.append(row["value"])
        arrays = [pa.array(keys, pa.binary()), pa.array(families, pa.int32()), pa.array(bits, pa.int32()), pa.array(sizes, pa.binary()), pa.array(values, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["prefix", "family", "bits", "size", "value"])


def range_prefixes(ranges: DataFrame) -> DataFrame:
    """(prefix, family, bits, size, value): per block the narrowest range that has it, ties by value.

    ``ranges`` has ``value`` and ``cidr``, or ``low`` and ``high`` (both included), of either family. What is no range
    is left out.
    """
    used = [c for c in ("cidr", "low", "high") if c in ranges.columns]
    rows = ranges.select(*[F.col(c).cast("string").alias(c) for c in (*used, "value")])
    each = rows.mapInArrow(_prefixes, "prefix binary, family int, bits int, size binary, value string")
    best = F.min(F.struct("size", "value")).alias("best")
    return each.groupBy("prefix", "family", "bits").agg(best).select("prefix", "family", "bits", "best.size", "best.value")


def _address_prefixes(lengths: dict[int, list[int]]):
    def run(batches):
        for batch in batches:
            ips, keys = [], []
            for ip in batch.column(0).to_pylist():
                if (found := parse(ip)) is not None:
                    family, number = found
                    ips += [ip] * len(lengths[family])
                    keys += [prefix_key(family, bits, number) for bits in lengths[family]]
            yield pa.RecordBatch.from_arrays([pa.array(ips, pa.string()), pa.array(keys, pa.binary())], names=["ip", "prefix"])

    return run


def narrowest_ranges(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, value): for each distinct address the narrowest range that contains it, ties by value; others are left out.

    ``prefixes`` of the ranges are computed twice, once for the lengths in use (162 at most reach the driver).
    """
    prefixes = range_prefixes(ranges)
    lengths: dict[int, list[int]] = {4: [], 6: []}
    for r in prefixes.select("family", "bits").distinct().collect():
        lengths[r["family"]].append(r["bits"])
    distinct = addresses.select("ip").where("ip IS NOT NULL").distinct()
    each = distinct.mapInArrow(_address_prefixes(lengths), "ip string, prefix binary")
    met = each.join(prefixes.select("prefix", "size", "value"), "prefix")
    return met.groupBy("ip").agg(F.min(F.struct("size", "value")).alias("best")).select("ip", "best.value")
