"""Timelines from stored sketches, and exact ranks of many rows a key."""

import random

from pyspark.sql import functions as F

from packetlens.operators import ranking, stats
from tests.conftest import rows_of
from tests.test_detectors import PACKET, packet

COUNTS = ["packet_count", "byte_count", "inbound_bytes", "outbound_bytes"]


def test_stored_minutes_give_hours(spark, tmp_path):
    draw = random.Random(3)
    # Two captures, a third of all packets in one minute.
    parts = [
        [packet(i, 90.0 if i % 3 == 0 else draw.uniform(0, 9000), f"10.0.{draw.randrange(9)}.{draw.randrange(250)}", f"45.33.0.{draw.randrange(99)}", draw.randrange(60, 1500))
         for i in range(k, 3000, 2)]
        for k in (0, 1)
    ]
    for k, rows in enumerate(parts):
        stats.timeline_sketches(spark.createDataFrame(rows, PACKET)).write.parquet(str(tmp_path / f"part={k}"))
    got = {r["bucket"]: r for r in rows_of(stats.widen_timeline(spark.read.parquet(str(tmp_path)).drop("part"), 60))}
    # A packet at the origin makes the exact timeline start there too.
    exact = spark.createDataFrame([packet(-1, 0.0, "10.0.0.1", "45.33.0.1", 0), *parts[0], *parts[1]], PACKET)
    want = {r["bucket"]: r for r in rows_of(stats.timeline(exact, 3600))}
    assert set(got) == set(want) == {0, 1, 2}
    for b, row in got.items():
        assert [row[c] for c in COUNTS] == [want[b]["packet_count"] - (b == 0), *(want[b][c] for c in COUNTS[1:])]
        assert abs(row["unique_ips"] - want[b]["unique_ips"]) <= 0.049 * want[b]["unique_ips"]


def test_no_packets_no_buckets(spark):
    assert rows_of(stats.widen_timeline(stats.timeline_sketches(spark.createDataFrame([], PACKET)), 5)) == []


def test_many_rows_of_one_key(spark):
    n = 200_000
    # Nine rows in ten are one key's; another key is null.
    key = F.when(F.col("id") % 10 != 0, "hot").when(F.col("id") % 20 == 0, F.concat(F.lit("k"), F.col("id") % 7))
    rows = spark.range(0, n, 1, 8).select(key.alias("k"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("v"), "id")
    got = ranking.top_per_key(rows, ["k"], [F.col("v").desc()], 5000)
    by_key = {}
    for i in range(n):
        k = "hot" if i % 10 else f"k{i % 7}" if i % 20 == 0 else None
        by_key.setdefault(k, []).append(i * 7919 % n)
    want = {(k, rank, v) for k, vs in by_key.items() for rank, v in enumerate(sorted(vs, reverse=True)[:5000], 1)}
    found = [(r["k"], r["key_rank"], r["v"]) for r in rows_of(got)]
    assert len(found) == len(want) and set(found) == want


def test_hot_key_lies_in_many_tasks(spark):
    rows = spark.range(0, 100_000, 1, 8).select(F.lit("hot").alias("k"), "id")
    placed = ranking.ranked_per_key(rows, ["k"], [F.col("id")])
    assert rows_of(placed.agg(F.max("key_rank").alias("m"), F.count_distinct("key_rank").alias("n")))[0] == {"m": 100_000, "n": 100_000}
    # The ranks come from a sort over several range partitions, none of which holds most of the key.
    sizes = [r["count"] for r in rows.orderBy("k", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 50_000
