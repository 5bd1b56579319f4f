"""Moved bytes and memory that must not grow faster than the input: joins, shuffles and scans are counted in plans."""

import os
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from packetlens.functions import names
from packetlens.operators import anomalies
from packetlens.operators.detectors import evaluate, get_detector, ledger
from packetlens.operators.lookalikes import hidden_brands
from packetlens.operators.timing import gap_statistics
from packetlens.plans import views
from packetlens.plans.all_queries import CATALOG
from tests.conftest import rows_of
from tests.test_detectors import T0
from tests.test_ledger import plan_of, traffic

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_packets_and_answers_come_from_one_join(spark):
    got = views.view(spark, SF, "traffic_v")
    inputs = {name: views.view(spark, SF, name) for name in ("packets_v", "reply_v")}
    expected = spark.sql(views.VIEWS["traffic_v"], **inputs)
    assert got.dtypes == expected.dtypes and optimized(got).count("Join Inner") == 1 < optimized(expected).count("Join Inner")
    assert got.count() == expected.count() and got.exceptAll(expected).isEmpty()


@needs_tables
@pytest.mark.parametrize("name", ["filter_port", "filter_protocol"])
def test_filters_read_the_traffic_once(spark, name):
    assert optimized(CATALOG[name].plan(spark, SF)).count("Join Inner") == 1


def test_flows_are_not_shuffled_for_edges_that_are_added_up(spark, monkeypatch):
    written = []
    store = ledger.write_once
    monkeypatch.setattr(ledger, "write_once", lambda df, *name: written.append(df) or store(df, *name))
    t = traffic(spark)
    found = evaluate(t, ["dns_tunnel", "exfiltration"])
    keys = [re.sub(r"#\d+L?", "", k) for df in written for k in re.findall(r"Aggregate \[([^\]]*)\], \[", optimized(df))]
    assert "src_ip, dst_ip, dst_port, protocol" not in keys
    # What adds up without hosts does not travel with every pair of hosts.
    pairs = next(df for df in written if df.columns[:2] == ["dst_ip", "src_ip"])
    assert len(pairs.columns) == 4
    whole = evaluate(t, ["dns_tunnel", "exfiltration", "port_scan"])
    ours = "detector IN ('dns_tunnel', 'exfiltration')"
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(rows_of(found.findings()), key=key) == sorted(rows_of(whole.findings().where(ours)), key=key)


def test_addresses_are_listed_once_without_a_distinct(spark):
    t = traffic(spark)
    got = [tuple(r) for r in evaluate(t, ["exfiltration"]).addresses().collect()]
    assert len(got) == len(set(got)) and {ip for *_, ip in got} >= {"45.0.0.2", "10.0.1.1"}
    assert "HashAggregate" not in plan_of(evaluate(t, ["exfiltration"]).addresses())
    # Two detectors of one name may report the same finding; then pairs are made distinct.
    twice = [get_detector("exfiltration"), get_detector("exfiltration")]
    assert sorted(tuple(r) for r in evaluate(t, detectors=twice).addresses().collect()) == sorted(got)


def test_spikes_read_the_buckets_once(spark, monkeypatch):
    written = []
    store = anomalies.write_once
    monkeypatch.setattr(anomalies, "write_once", lambda df, *name: written.append(df) or store(df, *name))
    buckets = spark.createDataFrame([(float(i), 200 if i == 7 else 10, 5) for i in range(20)], "bucket_ts DOUBLE, packet_count BIGINT, byte_count BIGINT")
    out = anomalies.traffic_spikes(buckets)
    assert len(written) == 1 and "RDD" not in optimized(out)
    assert [(r["bucket_ts"], r["multiplier"]) for r in rows_of(out)] == [(7.0, 200 / 19.5)]


def test_parts_of_names_are_not_shuffled_before_they_meet_a_brand(spark):
    """Names of look-alike characters that hide nothing: none of their parts goes beyond the heads of the brands."""
    brands = spark.createDataFrame([("google",), ("qy",), ("windows",)], "brand string")
    made = [(f"{i}0123456789.{'g00gle' if i == 3 else 'x'}.net", "") for i in range(50)]
    changed = spark.createDataFrame(made, "domain string, x string").withColumn("full_normal", names.normalize_lookalike("domain"))
    out = hidden_brands(changed, brands)
    assert {tuple(r) for r in out.collect()} == {("30123456789.g00gle.net", "google")}
    assert "Aggregate [domain" not in optimized(out)


@pytest.mark.parametrize("whole", [0, 40, 1 << 14])
def test_gaps_of_whole_and_cut_keys(spark, whole):
    rng = random.Random(3)
    times = {k: sorted(T0 + rng.random() * 90 // 0.25 / 4 for _ in range(n)) for k, n in (("a", 1), ("b", 2), ("c", 9), ("hot", 400))}
    times["same"] = [T0] * 5
    rows = [(k, t) for k, ts in times.items() for t in ts]
    got = {r["k"]: r for r in rows_of(gap_statistics(spark.createDataFrame(rows, "k STRING, t DOUBLE"), ["k"], "t", {"n": F.lit(1)}, whole=whole))}
    assert set(got) == set(times)
    for k, ts in times.items():
        r, gaps = got[k], [b - a for a, b in zip(ts, ts[1:])]
        assert (r["event_count"], r["n"], r["first_time"], r["last_time"]) == (len(ts), len(ts), ts[0], ts[-1])
        assert r["mean_gap"] == (pytest.approx(statistics.mean(gaps)) if gaps else None)
        assert r["stdev_samp"] == (pytest.approx(statistics.stdev(gaps)) if len(gaps) > 1 else None)
        assert r["stdev_pop"] == (pytest.approx(statistics.pstdev(gaps)) if gaps else None)


@needs_tables
def test_gaps_of_packets_move_once(spark):
    """Only the keys of crowded buckets go on to blocks and keys: the others come from the first exchange."""
    plan = plan_of(CATALOG["packet_gaps"].plan(spark, SF))
    assert "collect_set" in plan and "_cut" in plan
