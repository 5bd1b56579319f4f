"""Range matching against brute force."""

import ipaddress
import random

from packetlens.operators.ranges import blocks_of, narrowest_ranges, parse


def test_blocks_are_the_fewest():
    rng = random.Random(1)
    for _ in range(500):
        a, b = sorted(rng.randrange(1 << rng.choice([4, 8, 32])) for _ in range(2))
        want = {(n.prefixlen, int(n.network_address)) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(a), ipaddress.IPv4Address(b))}
        got = list(blocks_of(a, b, 32))
        assert set(got) == want and len(got) == len(want)
    assert list(blocks_of(0, 2**128 - 1, 128)) == [(0, 0)] and list(blocks_of(7, 7, 32)) == [(32, 7)]


def test_narrowest_range_equals_brute_force(spark):
    rng = random.Random(2)
    v4 = lambda n: str(ipaddress.IPv4Address(n))
    v6 = lambda n: str(ipaddress.IPv6Address(n))
    base4, base6 = int(ipaddress.IPv4Address("45.33.0.0")), int(ipaddress.IPv6Address("2001:db8::"))
    ranges = []
    for i in range(300):
        low, size = rng.randrange(5000), rng.choice([0, 1, 5, 100, 1000])
        make, base = (v4, base4) if i % 3 else (v6, base6)
        ranges.append((None, make(base + low), make(base + low + size), f"r{i:03d}"))
    ranges += [("0.0.0.0/0", None, None, "all"), ("45.33.1.0/24", None, None, "b"), ("45.33.1.0/24", None, None, "a"), ("2001:db8::/32", None, None, "six")]
    ranges += [("nonsense", None, None, "x"), (None, "45.33.0.9", "45.33.0.1", "y"), (None, "1.2.3.4", "::1", "z"), (None, None, "1.1.1.1", "w")]
    ips = [v4(base4 + rng.randrange(6500)) for _ in range(400)] + [v6(base6 + rng.randrange(6500)) for _ in range(400)] + ["::1", "10.0.0.1", "", None, "no address"]
    known = []
    for cidr, low, high, value in ranges:
        if cidr and cidr != "nonsense":
            n = ipaddress.ip_network(cidr)
            known.append((n.version, int(n.network_address), int(n.broadcast_address), value))
        elif low and high and parse(low)[0] == parse(high)[0] and parse(low)[1] <= parse(high)[1]:
            known.append((parse(low)[0], parse(low)[1], parse(high)[1], value))
    want = {}
    for ip in ips:
        if (found := parse(ip)) and (hits := [(h - a, v) for f, a, h, v in known if f == found[0] and a <= found[1] <= h]):
            want[ip] = min(hits)[1]
    table = spark.createDataFrame(ranges, "cidr string, low string, high string, value string")
    out = narrowest_ranges(spark.createDataFrame([(i,) for i in ips], "ip string"), table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.ip: r.value for r in out.collect()}
    assert got == want and len(got) > 500
    assert narrowest_ranges(spark.createDataFrame([("1.2.3.4",)], "ip string"), table.limit(0)).count() == 0


def test_many_ranges(spark):
    """100,000 ranges that nest and overlap."""
    table = spark.range(100_000).selectExpr(
        "concat_ws('.', '20', cast((id * 40) div 65536 as string), cast((id * 40) div 256 % 256 as string), cast((id * 40) % 256 as string)) as low",
        "concat_ws('.', '20', cast((id * 40 + 59) div 65536 as string), cast((id * 40 + 59) div 256 % 256 as string), cast((id * 40 + 59) % 256 as string)) as high",
        "lpad(id, 6, '0') as value",
    )
    numbers = [random.Random(3).randrange(4_000_000) for _ in range(2_000)]
    ips = spark.createDataFrame([(str(ipaddress.IPv4Address((20 << 24) + n)),) for n in set(numbers)], "ip string")
    got = {r.ip: r.value for r in narrowest_ranges(ips, table).collect()}
    want = {}
    for n in set(numbers):
        hits = [i for i in (n // 40 - 1, n // 40) if 0 <= i < 100_000 and i * 40 <= n <= i * 40 + 59]
        if hits:
            want[str(ipaddress.IPv4Address((20 << 24) + n))] = f"{min(hits):06d}"
    assert got == want
