"""Streams run to the end of their input and are compared with the batch operators."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from packetlens.operators import stats
from packetlens.operators.flows import build_flows
from packetlens.sources import captures, decode
from packetlens.operators.timing import first_busy_window
from packetlens.streaming import live
from packetlens.streaming.rapid import first_window, stream_rapid_scan_alerts
from tests.conftest import rows_of
from tests.test_captures import FRAMES, classic

BASE = 1700000040.0  # a whole minute
LAST = BASE + 3600


def packet_files(spark, path):
    rows = spark.range(600).select(
        F.lit("c").alias("capture"), F.col("id").alias("seq"), (F.lit(BASE) + F.col("id") * 0.5).alias("ts"),
        F.concat(F.lit("10.0.0."), F.col("id") % 5).alias("src_ip"), F.concat(F.lit("45.33.0."), F.col("id") % 7).alias("dst_ip"),
        F.lit("TCP").alias("protocol"), F.lit(5000).alias("src_port"), F.lit(443).alias("dst_port"), (F.col("id") + 60).alias("length"),
        F.lit(0).cast("bigint").alias("payload_length"), F.lit(16).alias("flag_bits"), F.lit("HTTPS").alias("app_protocol"))
    for i in range(3):
        rows.where(f"seq >= {i * 200} AND seq < {i * 200 + 200}").coalesce(1).write.mode("append").parquet(path)
    return rows


def run(spark, stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def closing(spark, path, rows):
    """One late-time packet, which moves the watermark past everything before it."""
    rows.limit(1).withColumns({"ts": F.lit(LAST), "src_ip": F.lit("10.9.9.9")}).coalesce(1).write.mode("append").parquet(path)


def test_timeline_and_flows_equal_batch(spark, tmp_path):
    path = str(tmp_path / "packets")
    rows = packet_files(spark, path)
    closing(spark, path, rows)
    packets = live.stream_packets(spark, path, max_files_per_trigger=2)
    got = run(spark, live.stream_timeline(packets), "timeline_out", str(tmp_path / "cp1"))
    cols = ["bucket_ts", "packet_count", "byte_count", "inbound_bytes", "outbound_bytes", "unique_ips"]
    expected = stats.timeline(rows, 60).select(*cols)
    assert sorted(map(tuple, got.where(f"bucket_ts < {LAST - 600}").collect())) == sorted(map(tuple, expected.collect()))
    flows = run(spark, live.stream_flows(live.stream_packets(spark, path, 2)), "flows_out", str(tmp_path / "cp2"))
    keys = ["src_ip", "dst_ip", "packet_count", "byte_count", "start_time", "end_time", "flag_bits", "app_protocol"]
    assert sorted(map(tuple, flows.select(*keys).collect())) == sorted(map(tuple, build_flows(rows).select(*keys).collect()))


def test_rapid_scan_stream(spark, tmp_path):
    path = str(tmp_path / "packets")
    closing(spark, path, packet_files(spark, path))
    packets = live.stream_packets(spark, path)
    # Two connections a second, spread over five sources: 24 a minute each.
    got = rows_of(run(spark, live.stream_rapid_scans(packets, time="ts", min_connections=24), "scan_out", str(tmp_path / "cp")))
    assert {r["src_ip"] for r in got} == {f"10.0.0.{i}" for i in range(5)} and all(r["connections"] == 24 for r in got)
    assert rows_of(run(spark, live.stream_rapid_scans(packets, time="ts", min_connections=25), "scan_none", str(tmp_path / "cp2"))) == []


def test_first_window_of_sorted_times():
    assert first_window([0.0, 1.0, 60.0, 61.0], 60, 3, 1e9) == ((0.0, 3), 1)
    assert first_window([0.0, 1.0, 60.5], 60, 3, 1e9) == (None, 3)
    assert first_window([0.0, 1.0, 2.0], 60, 2, 60.0) == (None, 0) and first_window([0.0, 0.0], 60, 2, 61.0) == ((0.0, 2), 1)


def test_exact_rapid_alert_on_shuffled_and_late_input(spark, tmp_path):
    """Files hold slices of 40 s, but a third of each slice comes one or two files late; equals the batch rule."""
    rng, path = random.Random(2), str(tmp_path / "flows")
    events = [(f"10.0.0.{i % 4}", BASE + rng.random() * 600 / (1 + i % 4)) for i in range(1200)]
    events += [("10.0.0.8", BASE + 300 + k / 8) for k in range(60)] * 2 + [("10.0.0.9", BASE + 100.0)] * 49
    files = defaultdict(list)
    for source, t in events:
        files[int((t - BASE) // 40) + rng.choice([0, 0, 0, 0, 1, 2])].append((source, "TCP", t))
    schema = "src_ip string, protocol string, start_time double"
    for n in sorted(files):
        rng.shuffle(files[n])
        spark.createDataFrame(files[n] + [(None, "TCP", BASE), ("10.0.0.9", "UDP", BASE + 100), ("10.0.0.9", "TCP", None)], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("10.9.9.9", "TCP", LAST)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(path)
    rows = spark.createDataFrame(events, "src_ip string, start_time double")
    for need in (50,):
        alerts = stream_rapid_scan_alerts(stream, min_connections=need)
        got = run(spark, alerts, f"alerts_{need}", str(tmp_path / f"cp{need}")).select("src_ip", "window_start", "events_in_window").collect()
        want = first_busy_window(rows, "src_ip", "start_time", 60, need).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and 2 <= len(got) < 6


def test_capture_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.pcap").write_bytes(classic(FRAMES))
    got = run(spark, live.stream_captures(spark, str(folder), 2), "capture_out", str(tmp_path / "cp"))
    expected = decode.decode_packets(captures.read_captures(spark, str(folder)))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(*got.columns).collect())) and got.count() == 48


def test_one_large_capture_is_read_by_many_tasks_and_a_restart_repeats_nothing(spark, tmp_path):
    folder, checkpoint, sink = tmp_path / "in", str(tmp_path / "cp"), str(tmp_path / "out")
    folder.mkdir()

    def drain():
        packets = live.stream_captures(spark, str(folder), split_bytes=2000).withColumn("task", F.spark_partition_id())
        q = packets.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
        q.awaitTermination(180)
        return spark.read.parquet(sink)

    (folder / "large.pcap").write_bytes(classic(FRAMES * 20))
    first = drain()
    assert first.select("task").distinct().count() > 1
    (folder / "more.pcap").write_bytes(classic(FRAMES * 3))
    got = drain()
    expected = decode.decode_packets(captures.read_captures(spark, str(folder)))
    assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert drain().count() == got.count() > first.count()
