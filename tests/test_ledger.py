"""Rules are evaluated once, and bursts of one key are spread."""

import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetlens.operators.detectors import evaluate, get_detector, ledger
from packetlens.operators.flows import Tables
from packetlens.operators.timing import BLOCK_CHUNKS, CHUNK_SECONDS, first_busy_window, gap_statistics
from tests.conftest import rows_of
from tests.test_detectors import DNS, T0, TLS, flow, flows

MIB = 1024 * 1024
NAMES = ["beacon", "dns_tunnel", "exfiltration", "port_scan"]


def traffic(spark):
    rows = [flow("10.0.0.1", "45.0.0.1", 5000 + i, 443, 4, 900, T0 + 60 * i) for i in range(30)]
    rows += [flow("10.0.0.2", f"10.5.0.{i}", 6000, 445, 2, 100, T0 + i / 2) for i in range(80)]
    rows += [flow("10.0.0.3", "10.6.0.1", 6000, p, 2, 100, T0 + 90 * p) for p in range(1, 60)]
    rows += [flow(f"10.0.1.{i}", "45.0.0.2", 7000, 443, 50, 30 * MIB, T0 + 3600 * i) for i in range(24)]
    rows += [flow("45.0.0.2", "10.0.1.1", 443, 7000, 50, MIB, T0), flow("10.0.0.9", "45.0.0.3", None, None, 9, 300_000, T0, proto="ICMP")]
    dns = [(T0 + i, f"10.0.2.{i % 5}", "8.8.8.8", f"{random.Random(i).getrandbits(160):040x}.x.evil.tk", "TXT", None, 300 * 100) for i in range(60)]
    dns += [(T0, "10.0.2.9", "8.8.8.8", "a1.iodine.host.com", "A", None, None)]
    tls = [(T0, "10.0.0.1", "45.0.0.1", 443, "files.pastebin.com", "TLS 1.3", False, False)]
    return Tables(flows=flows(spark, rows), dns=spark.createDataFrame(dns, DNS), tls=spark.createDataFrame(tls, TLS))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_grain_is_aggregated_once(spark, monkeypatch):
    written = []
    store = ledger.write_once
    monkeypatch.setattr(ledger, "write_once", lambda df, *name: written.append(df) or store(df, *name))
    t = traffic(spark)
    found = evaluate(t, NAMES)
    texts = [df._jdf.queryExecution().optimizedPlan().toString() for df in written]
    keys = Counter(re.sub(r"#\d+L?", "", k) for text in texts for k in re.findall(r"Aggregate \[([^\]]*)\], \[", text))
    assert keys["query_name"] == keys["parent, subdomain"] == 1
    # Edges once for their measures, and once more where the gaps of open edges are merged.
    assert keys["src_ip, dst_ip, dst_port, protocol"] == 2
    # Flows are read for edges, for gaps and for windows (twice, through one exchange), queries for names only.
    assert sum(text.count("LogicalRDD [src_ip#") + text.count("Scan ExistingRDD[src_ip#") for text in texts) <= 4
    rules = plan_of(found.findings())
    assert "Exchange" not in rules and "Aggregate" not in rules and "Join" not in rules
    before = len(written)
    assert {r["rule"] for r in rows_of(found.findings())} == {
        "beacon", "tunnel", "tool", "large_transfer", "off_hours_transfer", "high_ratio", "protocol_volume", "hosting_access",
        "horizontal", "vertical", "stealth", "rapid",
    }
    assert found.addresses().count() and len(written) == before


def test_ledger_equals_detectors_alone(spark):
    t = traffic(spark)
    found = evaluate(t, NAMES)
    alone = [r for n in NAMES for r in rows_of(get_detector(n).detect(t))]
    key = lambda r: r["finding_id"]
    assert sorted(rows_of(found.findings()), key=key) == sorted(alone, key=key)
    ips = {tuple(r) for n in NAMES for r in get_detector(n).addresses(t).collect()}
    got = found.addresses().collect()
    assert {tuple(r) for r in got} == ips and len(got) == len(ips)
    assert {r.finding_id for r in got} <= {r["finding_id"] for r in alone}


def test_detectors_with_other_settings_share_edges(spark):
    t = traffic(spark)
    night, noon = get_detector("exfiltration"), get_detector("exfiltration", off_hours_start=11, off_hours_end=0)
    rows = rows_of(evaluate(t, detectors=[night, noon]).findings())
    late = {r["indicators"]["flow_count"] for r in rows if r["rule"] == "off_hours_transfer"}
    starts = [(T0 + 3600 * i) % 86400 / 3600 for i in range(24)]
    assert late == {str(sum(h >= 22 or h < 6 for h in starts)), str(sum(h >= 11 for h in starts))}


def test_rules_of_an_empty_analysis(spark):
    none = Tables(flows=flows(spark, []), dns=spark.createDataFrame([], DNS), tls=spark.createDataFrame([], TLS))
    found = evaluate(none, NAMES)
    assert rows_of(found.findings()) == [] and rows_of(found.addresses()) == []


def burst(n=6_000):
    """Nine events in ten belong to one key and one minute; most of those to a tenth of a second."""
    rng = random.Random(5)
    rows = [("hot", T0 + 20 + (rng.random() / 10 if i % 3 else rng.random() * 39)) for i in range(n * 9 // 10)]
    rows += [(rng.choice("abc"), T0 + rng.randrange(4000) / 4) for _ in range(n // 10)]
    return rows + [("hot", rows[0][1])] * 5


def test_bursts_of_one_minute(spark):
    rows = burst()
    df = spark.createDataFrame(rows, "k STRING, t DOUBLE").repartition(3)
    chunk, block = F.floor(F.col("t") / CHUNK_SECONDS), F.floor(F.col("t") / (CHUNK_SECONDS * BLOCK_CHUNKS))
    largest = lambda *by: df.distinct().groupBy("k", *by).count().agg(F.max("count")).scalar().alias("n")
    assert spark.range(1).select(largest(block)).first().n > 0.8 * len(rows)
    assert spark.range(1).select(largest(chunk)).first().n < 0.15 * len(rows)
    got = {r["k"]: r for r in rows_of(gap_statistics(df, ["k"], "t", {"n": F.lit(1)}))}
    for k in "abc", "hot":
        for key in k if len(k) == 3 and k == "abc" else [k]:
            times = sorted(t for name, t in rows if name == key)
            gaps = [b - a for a, b in zip(times, times[1:])]
            assert got[key]["event_count"] == got[key]["n"] == len(times)
            assert got[key]["mean_gap"] == pytest.approx(statistics.mean(gaps), rel=1e-6)
            assert got[key]["stdev_samp"] == pytest.approx(statistics.stdev(gaps), rel=1e-6)


@pytest.mark.parametrize("seconds", [1, 7, 60, 100])
def test_busy_windows_in_bursts(spark, seconds):
    rows = burst(3_000)
    df = spark.createDataFrame(rows, "k STRING, t DOUBLE").repartition(3)
    for need in (3, 50, 2_000):
        expected = {}
        for k in ("a", "b", "c", "hot"):
            times = sorted(t for name, t in rows if name == k)
            hits = ((t, sum(t <= u <= t + seconds for u in times)) for t in times)
            first = next(((t, n) for t, n in hits if n >= need), None)
            if first:
                expected[k] = first
        got = {r["k"]: (r["window_start"], r["events_in_window"]) for r in rows_of(first_busy_window(df, "k", "t", seconds, need))}
        assert got == expected
