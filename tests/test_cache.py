"""The cache on the two-phase path, and eviction by counts per second."""

import random

from pyspark.sql import functions as F

from packetlens.operators import cache, intel
from packetlens.plans.analysis import enrich_all, enrich_all_cached, tables_from_packets
from tests.conftest import rows_of
from tests.test_detectors import DNS, PACKET, T0, TLS, packet
from tests.test_indicators import otx

ENTRY = "indicator STRING, indicator_type STRING, overall_threat_level STRING"
ASKED = "value STRING, indicator_type STRING"


def looked_up(source, seen):
    """A look-up that notes what it is asked for."""

    def run(misses):
        seen.append({r["value"] for r in rows_of(misses)})
        return intel.enrich(misses, source)

    return run


def test_only_misses_are_looked_up(spark):
    source = otx(spark, [dict(indicator=i, indicator_type="ip", pulse_count=n) for i, n in (("1.1.1.1", 9), ("2.2.2.2", 0), ("3.3.3.3", 1))])
    old = cache.cache_entries(spark.createDataFrame([("2.2.2.2", "ip", "suspicious"), ("3.3.3.3", "ip", "malicious")], ENTRY), 0.0)
    asked = spark.createDataFrame([("1.1.1.1", "ip"), ("2.2.2.2", "ip"), ("3.3.3.3", "ip"), ("1.1.1.1", "ip"), ("Bad.com", "domain"), ("bad.com", "domain")], ASKED)
    seen = []
    # After seven hours the malicious entry has expired, the suspicious one has not.
    now = 7 * 3600.0
    done = cache.enrich_with_cache(asked, old, now, looked_up(source, seen))
    assert seen == [{"1.1.1.1", "3.3.3.3", "Bad.com"}]
    got = [(r["indicator"], r["cached"], r["overall_threat_level"]) for r in done.results.collect()]
    plain = {r["indicator"]: r["overall_threat_level"] for r in rows_of(intel.enrich(asked, source))}
    assert {(i, level) for i, cached, level in got if not cached} == {(i, plain[i]) for i in seen[0]}
    assert [(i, level) for i, cached, level in got if cached] == [("2.2.2.2", "suspicious")]
    rank = ["malicious", "suspicious", "unknown", "clean"]
    assert [rank.index(level) for *_, level in got] == sorted(rank.index(level) for *_, level in got)
    stats = rows_of(done.stats)[0]
    assert (stats["total_indicators"], stats["cached_hits"], stats["api_lookups"], stats["errors"]) == (4, 1, 3, 0)
    assert stats["malicious_found"] == sum(level == "malicious" for _, cached, level in got if not cached)
    kept = {r["cache_key"]: r["created_at"] for r in rows_of(done.cache)}
    assert kept == {"ip:2.2.2.2": 0.0, "ip:3.3.3.3": now, "ip:1.1.1.1": now, "domain:bad.com": now}
    # The same batch again finds all of it.
    again = cache.enrich_with_cache(asked, done.cache, now + 1, looked_up(source, seen))
    assert seen[1] == set() and rows_of(again.stats)[0]["cached_hits"] == 4
    assert all(r["cached"] for r in rows_of(again.results))


def test_errors_and_empty_batches(spark):
    source = otx(spark, [dict(indicator="1.1.1.1", indicator_type="ip", pulse_count=0, error="timeout")])
    none = cache.cache_entries(spark.createDataFrame([], ENTRY), 0.0)
    done = cache.enrich_with_cache(spark.createDataFrame([("1.1.1.1", "ip")], ASKED), none, 5.0, looked_up(source, []))
    assert rows_of(done.stats)[0]["errors"] == 1
    empty = cache.enrich_with_cache(spark.createDataFrame([], ASKED), none, 5.0, looked_up(source, []))
    assert rows_of(empty.results) == [] and rows_of(empty.stats)[0]["total_indicators"] == 0


def test_second_path_reads_the_cache(spark):
    packets = spark.createDataFrame([packet(i, T0 + 60 * i, "10.0.0.5", "45.33.32.156", 900_000) for i in range(30)], PACKET)
    dns = spark.createDataFrame([(T0, "10.0.0.5", "8.8.8.8", "x.dnscat.evil.tk", "TXT", ["45.33.32.156"], 99)], DNS)
    t = tables_from_packets(packets, dns, spark.createDataFrame([], TLS))
    o = otx(spark, [dict(indicator="45.33.32.156", indicator_type="ip", pulse_count=7)])
    none = cache.cache_entries(spark.createDataFrame([], ENTRY), 0.0)
    first = enrich_all_cached(t, none, 0.0, o)
    plain = {(r["indicator"], r["overall_threat_level"], r["priority"]) for r in rows_of(enrich_all(t, o))}
    assert {(r["indicator"], r["overall_threat_level"], r["priority"]) for r in rows_of(first.results)} == plain
    second = enrich_all_cached(t, first.cache, 60.0, o)
    assert all(r["cached"] for r in rows_of(second.results))
    assert {(r["indicator"], r["overall_threat_level"], r["priority"]) for r in rows_of(second.results)} == plain


def test_eviction_equals_a_full_sort(spark):
    draw = random.Random(4)
    # Most entries share one second, some one instant; one has no time.
    made = [draw.choice([100.25, 100.5, 100.5, 100.5, 7.0, 200.0, 300.75]) for _ in range(300)] + [None]
    rows = [(f"ip:{i:03d}", at, 1e6 if i % 9 else 50.0) for i, at in enumerate(made)]
    table = spark.createDataFrame(rows, "cache_key STRING, created_at DOUBLE, expires_at DOUBLE").repartition(4)
    live = sorted((r for r in rows if r[2] >= 60.0), key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    for max_size in (1, len(live), len(live) + 1):
        gone = max(1, len(live) // 10) if len(live) >= max_size else 0
        got = {r["cache_key"] for r in rows_of(cache.prune_cache(table, 60.0, max_size))}
        assert got == {r[0] for r in live[gone:]}
    ranked = cache.prune_cache(table.where("cache_key < 'ip:005'"), 60.0, 1)
    assert {r["cache_key"] for r in rows_of(ranked)} == {r[0] for r in sorted((r for r in live if r[0] < "ip:005"), key=lambda r: (r[1], r[0]))[1:]}
    assert rows_of(cache.prune_cache(table.where(F.lit(False)), 60.0, 1)) == []
