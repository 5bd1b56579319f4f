"""Landed captures or packet files as streams, with timeline, flow and scan aggregates.

Event time is the packet time. A watermark bounds the state, so packets later than it are
dropped; the batch operators have no such rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens import schemas
from packetlens.functions import net
from packetlens.operators.flows import FLOW_KEYS, app_protocol_name, last_app_protocol
from packetlens.sources.captures import EXTENSIONS, SPLIT_BYTES, read_capture_rows
from packetlens.sources.decode import decode_packets

_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_packets(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """A growing folder of packet parquet files."""
    return (
        spark.readStream.schema(schemas.PACKETS).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    )


def stream_captures(
    spark: SparkSession, path: str, max_files_per_trigger: int = 100, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """A folder capture files are dropped into whole, as packets. A large file is cut into ranges that many tasks decode.

    The source's log of files in the query's checkpoint says what was read: a restart neither loses nor repeats a file.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("pathGlobFilter", EXTENSIONS)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
        .select("path", "length")
    )
    return decode_packets(read_capture_rows(files, split_bytes))


def _with_event_time(rows: DataFrame, time: str, watermark: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_seconds(time)).withWatermark("event_time", watermark)


def stream_timeline(packets: DataFrame, width: str = "1 minute", watermark: str = "2 minutes") -> DataFrame:
    """Packets, bytes, directed bytes and distinct addresses per window, exactly.

    Two chained aggregates as in the batch timeline: per (window, address), then per window.
    """
    src_private, dst_private = F.col("_src_private"), F.col("_dst_private")
    classed = _with_event_time(packets, "ts", watermark).withColumns(
        {"_src_private": net.is_private("src_ip"), "_dst_private": net.is_private("dst_ip")}
    )
    sides = classed.select(
        "event_time",
        "length",
        F.when(src_private & ~dst_private, F.col("length")).otherwise(0).alias("out_bytes"),
        F.when(~src_private & dst_private, F.col("length")).otherwise(0).alias("in_bytes"),
        F.explode(
            F.array(
                F.struct(F.col("src_ip").alias("ip"), F.lit(1).alias("one")),
                F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("one")),
            )
        ).alias("side"),
    )
    once = F.col("side.one")
    per_ip = sides.groupBy(F.window("event_time", width), F.col("side.ip").alias("ip")).agg(
        F.sum(once).alias("packet_count"),
        F.sum(F.col("length") * once).alias("byte_count"),
        F.sum(F.col("in_bytes") * once).alias("inbound_bytes"),
        F.sum(F.col("out_bytes") * once).alias("outbound_bytes"),
    )
    return (
        per_ip.groupBy(F.window(F.window_time("window"), width))
        .agg(
            F.sum("packet_count").alias("packet_count"),
            F.sum("byte_count").alias("byte_count"),
            F.sum("inbound_bytes").alias("inbound_bytes"),
            F.sum("outbound_bytes").alias("outbound_bytes"),
            F.count("ip").alias("unique_ips"),
        )
        .select(_epoch("window.start").alias("bucket_ts"), "packet_count", "byte_count", "inbound_bytes", "outbound_bytes", "unique_ips")
    )


def _epoch(time: str) -> Column:
    return F.unix_micros(time) / F.lit(1_000_000.0)


def stream_flows(packets: DataFrame, gap: str = "5 minutes", watermark: str = "2 minutes") -> DataFrame:
    """Flows that end after a silent gap: one row per 5-tuple and session, with the columns of the batch flows."""
    seq = F.col("seq") if "seq" in packets.columns else None
    return (
        _with_event_time(packets, "ts", watermark)
        .groupBy(*FLOW_KEYS, F.session_window("event_time", gap).alias("session"))
        .agg(
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("length").alias("byte_count"),
            F.sum("payload_length").alias("payload_bytes"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.bit_or("flag_bits").alias("flag_bits"),
            last_app_protocol(seq).alias("_app"),
        )
        .withColumn("app_protocol", app_protocol_name(F.col("_app")))
        .drop("session", "_app")
    )


def stream_rapid_scans(
    flows: DataFrame,
    time: str = "start_time",
    window: str = "60 seconds",
    slide: str = "10 seconds",
    min_connections: int = 50,
    watermark: str = "2 minutes",
) -> DataFrame:
    """Sources with many TCP connections in a sliding minute.

    Windows start on multiples of the slide, so this approximates the exact frame of the batch rule.
    """
    return (
        _with_event_time(flows.where(F.col("protocol") == "TCP"), time, watermark)
        .groupBy("src_ip", F.window("event_time", window, slide).alias("span"))
        .agg(F.count(F.lit(1)).alias("connections"))
        .where(F.col("connections") >= min_connections)
        .select("src_ip", _epoch("span.start").alias("window_start"), _epoch("span.end").alias("window_end"), "connections")
    )
