"""Packets folded into flows, conversations and counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import net
from packetlens.session import shuffled_once

FLOW_KEYS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


@dataclass(frozen=True)
class Tables:
    """The tables one analysis reads. Any of them may be missing."""

    packets: DataFrame | None = None
    flows: DataFrame | None = None
    conversations: DataFrame | None = None
    dns: DataFrame | None = None
    tls: DataFrame | None = None


def last_app_protocol(seq: Column | None, which: Column | None = None) -> Column:
    """Last application protocol that is not UNKNOWN, as one number: time in microseconds, place in the file, protocol.

    A number keeps the aggregate in the hash table; text or struct state would make Spark sort instead. Without
    ``seq``, of packets in one microsecond the highest protocol number counts. ``which`` limits it to some packets.
    """
    number = F.array_position(F.array(*[F.lit(p) for p in K.APP_PROTOCOLS]), F.col("app_protocol"))
    micros = F.round(F.col("ts") * 1_000_000).cast("bigint")
    if seq is not None:
        place = F.pmod(F.coalesce(seq.cast("bigint"), F.lit(0)), F.lit(1 << 44)).cast("decimal(14,0)")
        micros = (micros.cast("decimal(19,0)") * F.lit(1 << 44).cast("decimal(15,0)") + place).cast("decimal(36,0)")
    return F.max(F.when(number > 0 if which is None else which & (number > 0), micros * 16 + number))


def app_protocol_name(packed: Column) -> Column:
    names = F.array(*[F.lit(p) for p in K.APP_PROTOCOLS])
    return F.coalesce(F.get(names, (F.pmod(packed, F.lit(16)) - 1).cast("int")), F.lit(K.UNKNOWN))


def _flow_sums(packets: DataFrame, which: Column | None = None) -> dict[str, Column]:
    """The aggregates of flows by name; with ``which``, those of the packets it is true for."""

    def of(c: str) -> Column:
        return F.col(c) if which is None else F.when(which, F.col(c))

    return {
        "packet_count": F.count(F.lit(1)) if which is None else F.count_if(which),
        "byte_count": F.sum(of("length")),
        "payload_bytes": F.sum(of("payload_length")),
        "start_time": F.min(of("ts")),
        "end_time": F.max(of("ts")),
        "flag_bits": F.bit_or(of("flag_bits")),
        "app_protocol": last_app_protocol(F.col("seq") if "seq" in packets.columns else None, which),
    }


def build_flows(packets: DataFrame) -> DataFrame:
    """One row per directed 5-tuple.

    Every aggregate keeps fixed-size state (flags are OR-ed as bits), so the map-side
    combine reduces even a 5-tuple that carries a third of all packets to one row per task.
    """
    flows = packets.groupBy(*FLOW_KEYS).agg(*[c.alias(name) for name, c in _flow_sums(packets).items()])
    return flows.withColumn("app_protocol", app_protocol_name(F.col("app_protocol")))


def shuffled_flows(packets: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Flows with some of their measures, for plans that read them several times: packets are shuffled now, and once.

    A flow and its answers move as one row, with the sums of each direction. Its ends move as few bytes.
    """
    src_ip, dst_ip, src_port, dst_port = (F.col(c) for c in FLOW_KEYS[:4])
    # Null ends come first, so that a flow and its answers agree about the order.
    ports = F.coalesce(src_port <= dst_port, src_port.isNull())
    ahead = F.when(src_ip.eqNullSafe(dst_ip), ports).otherwise(F.coalesce(src_ip < dst_ip, src_ip.isNull()))
    way = F.col("_ahead")

    def ends(mark: str) -> dict[str, Column]:
        swapped = {"src_ip": "dst_ip", "dst_ip": "src_ip", "src_port": "dst_port", "dst_port": "src_port"}
        return {c: F.when(way, F.col(mark + c)).otherwise(F.col(mark + other)) for c, other in swapped.items()}

    rows = packets.withColumn("_ahead", ahead).withColumns({f"_{c}": end for c, end in ends("").items()})
    there, back = _flow_sums(packets, way), _flow_sums(packets, ~way)
    pairs = shuffled_once(
        rows.withColumns(net.packed_ends(*[f"_{c}" for c in FLOW_KEYS[:4]]))
        .groupBy("packed", "first_text", "second_text", "protocol")
        .agg(
            F.bit_or(F.when(way, 1).otherwise(2)).alias("_ways"),
            *[there[m].alias(m) for m in measures],
            *[back[m].alias(f"{m}_back") for m in measures],
        )
    )
    types = [packets.schema[c].dataType for c in ("src_port", "dst_port")]
    seen = F.when(F.col("_ways") == 3, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("_ways") == 1))
    rows = pairs.withColumn("_ahead", F.explode(seen)).withColumn("packed", F.hex("packed"))
    rows = rows.withColumns({f"_{c}": end for c, end in zip(FLOW_KEYS, net.unpacked_ends(types))})
    found = {**ends("_"), "protocol": F.col("protocol")}
    found |= {m: F.when(way, F.col(m)).otherwise(F.col(f"{m}_back")) for m in measures}
    if "app_protocol" in found:
        found["app_protocol"] = app_protocol_name(found["app_protocol"])
    return rows.select(*[c.alias(name) for name, c in found.items()])


def with_flow_measures(flows: DataFrame) -> DataFrame:
    """Key text, duration, rates, flag names and handshake state of each flow."""
    seconds = net.duration()
    return flows.withColumns(
        {
            "flow_key": net.flow_key(),
            "duration_seconds": seconds,
            "packets_per_second": net.per_second("packet_count", seconds),
            "bytes_per_second": net.per_second("byte_count", seconds),
            "tcp_flags_seen": F.array_sort(net.tcp_flag_names()),
            "is_complete_tcp": net.is_complete_tcp(),
            "is_syn_only": net.is_syn_only(),
        }
    )


def _directed(value: Column, forward: bool) -> Column:
    from_a = F.col("src_ip") == F.col("ip_a")
    return F.sum(F.when(from_a if forward else ~from_a, value).otherwise(0))


def _protocol_bit(protocol: Column) -> Column:
    arms = [F.when(protocol == p, F.lit(1 << i)) for i, p in enumerate(K.PROTOCOLS)]
    return F.coalesce(*arms, F.lit(1 << K.PROTOCOLS.index("OTHER")))


def _protocol_names(bits: Column) -> Column:
    arms = [F.when(bits.bitwiseAND(F.lit(1 << i)) > 0, F.lit(p)) for i, p in enumerate(K.PROTOCOLS)]
    return F.array_sort(F.array_compact(F.array(*arms)))


def build_conversations(packets: DataFrame) -> DataFrame:
    """One row per pair of addresses, with the two directions kept apart.

    The port set is bounded by the 65,535 possible ports; a plan that does not read it
    drops it from the aggregate.
    """
    pairs = packets.select(
        F.least("src_ip", "dst_ip").alias("ip_a"),
        F.greatest("src_ip", "dst_ip").alias("ip_b"),
        "src_ip",
        "protocol",
        "src_port",
        "dst_port",
        "length",
        "ts",
    )
    one = F.lit(1)
    return (
        pairs.groupBy("ip_a", "ip_b")
        .agg(
            _directed(one, True).alias("packets_a_to_b"),
            _directed(one, False).alias("packets_b_to_a"),
            _directed(F.col("length"), True).alias("bytes_a_to_b"),
            _directed(F.col("length"), False).alias("bytes_b_to_a"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.bit_or(_protocol_bit(F.col("protocol"))).alias("_protocols"),
            F.collect_set(F.when(F.col("src_port") != 0, F.col("src_port"))).alias("_src_ports"),
            F.collect_set(F.when(F.col("dst_port") != 0, F.col("dst_port"))).alias("_dst_ports"),
        )
        .withColumn("protocols", _protocol_names(F.col("_protocols")))
        .withColumn("ports_used", F.array_sort(F.array_union("_src_ports", "_dst_ports")))
        .drop("_src_ports", "_dst_ports", "_protocols")
    )


def with_conversation_measures(conversations: DataFrame) -> DataFrame:
    """Key text, totals, duration and byte ratio of each conversation."""
    return conversations.withColumns(
        {
            "conversation_key": net.conversation_key("ip_a", "ip_b"),
            "total_packets": F.col("packets_a_to_b") + F.col("packets_b_to_a"),
            "total_bytes": F.col("bytes_a_to_b") + F.col("bytes_b_to_a"),
            "duration_seconds": net.duration(),
            "byte_ratio": net.byte_ratio(),
        }
    )


def packet_counts(packets: DataFrame, column: str) -> DataFrame:
    """Packets and bytes per value of one column; missing and zero ports are left out."""
    if column in ("src_port", "dst_port"):
        packets = packets.where(F.col(column).isNotNull() & (F.col(column) != 0))
    return packets.groupBy(column).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("length").alias("byte_count")
    )


def all_addresses(rows: DataFrame) -> DataFrame:
    """Distinct addresses on either side of packets or flows (one scan)."""
    return rows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()


def all_domains(dns: DataFrame, tls: DataFrame) -> DataFrame:
    """Distinct query names and server names."""
    queried = dns.where(F.col("query_name") != "").select(F.col("query_name").alias("domain"))
    contacted = tls.where(F.col("sni") != "").select(F.col("sni").alias("domain"))
    return queried.union(contacted).distinct()
