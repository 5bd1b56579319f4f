"""Flows that move once for a selection: nothing that has a row per flow is sorted, stored or shuffled a second time."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from packetlens.functions import names, net
from packetlens.operators import flows as fl
from packetlens.operators import indicators, ranking
from packetlens.session import shuffled_once
from packetlens.sources.lists import legit_domain_list
from tests.conftest import rows_of
from tests.test_detectors import T0
from tests.test_indicators import DNS, TLS
from tests.test_ledger import plan_of

PACKET = (
    "ts DOUBLE, seq BIGINT, src_ip STRING, dst_ip STRING, protocol STRING, src_port INT, dst_port INT, length BIGINT,"
    " payload_length BIGINT, flag_bits INT, app_protocol STRING"
)


def made_packets(spark, n=400):
    rng = random.Random(5)
    ends = [("10.0.0.1", 1000), ("10.0.0.1", 443), ("10.0.0.2", None), ("45.33.0.9", 443), ("45.33.0.10", 53), ("fe80::1", 1), (None, 7), ("", 0)]
    rows = []
    for i in range(n):
        (a, p), (b, q) = rng.choice(ends), rng.choice(ends)
        size = rng.choice([None, 0, 40, 1500])
        rows.append((T0 + rng.randrange(90), i, a, b, rng.choice(["TCP", "UDP", None]), p, q, size, 1, rng.choice([2, 16, 24]), rng.choice(["DNS", "TLS", "UNKNOWN", None])))
    return spark.createDataFrame(rows, PACKET)


def test_a_flow_and_its_answers_are_one_row_of_a_shuffle(spark):
    packets = made_packets(spark)
    flows = fl.build_flows(packets)
    found = fl.shuffled_flows(packets, [c for c in flows.columns if c not in fl.FLOW_KEYS])
    assert found.dtypes == flows.dtypes and found.count() == flows.count() > 50
    assert found.exceptAll(flows).isEmpty()
    few = fl.shuffled_flows(packets, ["byte_count"])
    assert few.columns == [*fl.FLOW_KEYS, "byte_count"] and "Exchange" not in plan_of(few)
    assert few.count() == flows.count() and few.exceptAll(flows.select(few.columns)).isEmpty()


def test_ends_in_few_bytes_and_back(spark):
    """Dots, zeros and lengths stay apart; so do null, the empty text and texts that look like the marks."""
    values = ["10.0.0.1", "0.0.0.0", "00.0.0.0", "1", "01", "001", ".", "..", "1.", ".1", "10.0.300.1", "e", "E", "f", "fe80::1", "1f2", "", " 1", "1\n", None]
    ports = [0, 1, 65535, -1, 2147483647, None]
    rows = [(a, b, ports[i % 6], ports[(i + j) % 6]) for i, a in enumerate(values) for j, b in enumerate(values)]
    df = spark.createDataFrame(rows, "a STRING, b STRING, p INT, q INT")
    packed = df.withColumns(net.packed_ends("a", "b", "p", "q"))
    assert packed.select("packed", "first_text", "second_text").distinct().count() == len(set(rows)) == len(rows)
    back = packed.withColumn("packed", F.hex("packed")).select(*net.unpacked_ends([df.schema["p"].dataType, df.schema["q"].dataType]))
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))


def test_shuffled_once_reads_the_same_files_again(spark):
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("v"))
    kept = shuffled_once(df)
    assert "Exchange" in plan_of(df) and "Exchange" not in plan_of(kept)
    assert kept.dtypes == df.dtypes and sorted(map(tuple, kept.collect())) == sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    plain = spark.range(3)
    assert shuffled_once(plain) is plain


def in_order(rows, largest):
    """Nulls are last of descending bytes and first of all ascending values."""
    def up(x):
        return (x is not None, x if x is not None else 0)

    def key(r):
        v, a, b = r
        lead = (v is None, -(v or 0)) if largest else up(v)
        return (lead, (a is not None, a or ""), up(b))

    return sorted(rows, key=key)


@pytest.mark.parametrize("few", [0, 3, 1_000_000])
@pytest.mark.parametrize("largest", [True, False])
def test_share_by_counts(spark, monkeypatch, few, largest):
    monkeypatch.setattr(ranking, "_FEW_TIES", few)
    rng = random.Random(9)
    rows = list({(rng.choice([None, 1, 1, 1, 2, 9]), rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(30)])) for _ in range(300)})
    df = spark.createDataFrame(rows, "v BIGINT, a STRING, b INT").repartition(3)
    expected = in_order(rows, largest)
    for share in (0.0, 0.03, 0.1, 0.4, 0.77, 1.0):
        got = [tuple(r) for r in ranking.extreme_share(df, "v", ["a", "b"], share, largest).collect()]
        assert sorted(got, key=str) == sorted(expected[: max(1, int(len(rows) * share))], key=str)
    # Rows that nothing tells apart: as many as fit.
    same = spark.createDataFrame([(1, "a", 1)] * 10, df.schema)
    assert ranking.extreme_share(same, "v", ["a", "b"], 0.4, largest).count() == 4
    assert ranking.extreme_share(same.limit(0), "v", ["a", "b"], 0.4, largest).count() == 0


def test_a_share_ranks_tied_rows_only(spark, monkeypatch):
    ranked = []
    rank = ranking.with_row_rank
    monkeypatch.setattr(ranking, "with_row_rank", lambda df, order: ranked.append(df.count()) or rank(df, order))
    df = spark.range(1000).select((F.col("id") % 100).alias("v"), F.col("id").cast("string").alias("k"))
    assert ranking.extreme_share(df, "v", ["k"], 0.405).count() == 405
    assert ranked == [10]
    assert ranking.extreme_share(df, "v", ["k"], 0.4).count() == 400
    assert ranked == [10]


def test_selection_summary_reads_flows_from_one_shuffle(spark, monkeypatch):
    stored = []
    for module, name in ((indicators, "write_once"), (ranking, "write_once"), (ranking, "cut_lineage")):
        keep = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, keep=keep: stored.append(df) or keep(df, *a))
    flows = fl.build_flows(spark.range(300).selectExpr(
        f"{T0} + id AS ts", "id AS seq", "concat('10.0.0.', id % 200) AS src_ip", "concat('45.33.0.', id % 100) AS dst_ip", "'TCP' AS protocol",
        "CAST(id AS INT) AS src_port", "443 AS dst_port", "id % 50 AS length", "id AS payload_length", "16 AS flag_bits", "'TLS' AS app_protocol"))
    dns = spark.createDataFrame([(T0, "10.0.0.1", "8.8.8.8", "evil.tk", "A", ["45.33.0.49"], 50)], DNS)
    out = indicators.selection_summary(flows, dns, spark.createDataFrame([], TLS), legit_domain_list(spark), 0.41)
    # Neither the result nor anything stored joins, aggregates or sorts all flows again.
    assert "src_port" not in plan_of(out)
    assert max(df.count() for df in stored) <= 50
    assert rows_of(out) == [{
        "total_conversations": 300, "selected_conversations": 122, "public_ips": 42, "domains": 1, "typosquat_suspects": 0,
        "domains_filtered_by_legit": 0, "total_indicators": 43}]


def test_addresses_of_flows_come_from_single_addresses(spark):
    values = ["10.0.0.1", "10.0.300.1", "10.1.2", "45.33.0.1", "8.8.8.8", "192.168.1.1", "127.0.0.1", "100.64.0.1", "fe80::1", "2001:4860::8", "text", "", None]
    rng = random.Random(2)
    pairs = [(rng.choice(values), rng.choice(values)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "src_ip STRING, dst_ip STRING")
    expected = {r["ip"] for r in rows_of(df.select(net.public_ip().alias("ip")).where("ip IS NOT NULL"))}
    got = [r["ip"] for r in rows_of(indicators.public_addresses(df))]
    assert set(got) == expected and len(got) == len(expected)
    assert sum(r["flow_count"] for r in rows_of(indicators.flow_ends(df))) == 60


def test_registry_addresses_in_one_pattern(spark):
    values = ["10.0.0.1", "10.0.0.256", "10.0.0", "010.0.0.1", "10.0.0.1.", "192.0.0.9", "192.0.0.10", "192.0.0.8", "240.0.0.1", "255.255.255.255", "11.0.0.1", "198.18.0.1", None]
    df = spark.createDataFrame([(v,) for v in values], "ip STRING")

    def private(v):
        try:
            return v is not None and ipaddress.IPv4Address(v).is_private
        except ValueError:
            return False

    got = [r["p"] for r in rows_of(df.select(net.is_private("ip", "registry").alias("p")))]
    assert got == [private(v) for v in values]


def test_suffixes_of_names(spark):
    values = ["a.b.c.com", "COM", "b.com", ".x.Org.", "a..b", "", None]
    df = spark.createDataFrame([(v,) for v in values], "domain STRING")
    got = [r["s"] for r in rows_of(df.select(names.domain_suffixes("domain").alias("s")))]
    assert got == [["a.b.c.com", "b.c.com", "c.com"], [], ["b.com"], ["x.org"], ["a..b", ".b"], [], []]
    listed = spark.createDataFrame([("c.com",), ("x.org",), ("com",)], "domain STRING")
    assert {r["domain"] for r in rows_of(indicators.under_listed(df, listed))} == {"a.b.c.com", ".x.Org."}
    assert legit_domain_list(spark).count() > 90
