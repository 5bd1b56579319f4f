"""Selection, priorities, staged look-ups, cache and intelligence shaping."""

import json

from pyspark.sql import functions as F

from packetlens import schemas
from packetlens.operators import cache, indicators, intel
from packetlens.operators.flows import Tables
from packetlens.plans.analysis import analyze, compute_statistics, enrich_all, tables_from_packets
from packetlens.sources import intel as shaping
from packetlens.sources.lists import legit_domain_list, read_domain_list
from packetlens.sources.sinks import write_filter_file, write_filter_list, write_results
from tests.conftest import rows_of
from tests.test_detectors import DNS, FLOW, PACKET, TLS, T0, flow, packet


def values(spark, kind, items):
    return spark.createDataFrame([(v,) for v in items], f"{kind} STRING")


def flagged(spark, kind, pairs):
    return spark.createDataFrame([(f"f{i}", d, v) for i, (d, v) in enumerate(pairs)], f"finding_id STRING, detector STRING, {kind} STRING")


def test_private_safe_and_cdn_values_are_skipped(spark):
    ips = values(spark, "ip", ["192.168.1.1", "10.0.0.1", "172.16.0.1", "127.0.0.1", "8.8.8.8", "1.1.1.1", "224.0.0.5", "104.16.1.1", "nonsense"])
    domains = values(spark, "domain", ["www.google.com", "malicious-site.tk", "printer.local", "1.0.0.10.in-addr.arpa", "."])
    none = flagged(spark, "ip", []), flagged(spark, "domain", [])
    got = {r["value"]: r for r in rows_of(indicators.prioritize_indicators(ips, domains, *none))}
    assert {v: r["priority"] for v, r in got.items()} == {"8.8.8.8": "medium", "1.1.1.1": "medium", "malicious-site.tk": "low"}
    reasons = {r["value"]: r["reason"] for r in rows_of(indicators.classify_addresses(ips, none[0]))}
    assert reasons["10.0.0.1"] == "Private IP range" and reasons["224.0.0.5"] == "Reserved/special address"
    assert reasons["104.16.1.1"] == "Known CDN range (104.16.0.0/12)" and reasons["nonsense"] == "Invalid IP format"
    reasons = {r["value"]: r["reason"] for r in rows_of(indicators.classify_domain_priority(domains, none[1]))}
    assert reasons["www.google.com"] == "Known safe domain (google.com)" and reasons[""] == "Empty domain"
    assert reasons["1.0.0.10.in-addr.arpa"] == "Reverse DNS lookup" and reasons["printer.local"] == "Local domain"


def test_flagged_values_come_first(spark):
    ips = values(spark, "ip", ["45.33.32.156", "8.8.8.8", "1.1.1.1"])
    by_ip = flagged(spark, "ip", [("beacon", "45.33.32.156"), ("exfiltration", "1.1.1.1"), ("beacon", "1.1.1.1")])
    domains, by_domain = values(spark, "domain", ["Evil.tk"]), flagged(spark, "domain", [("dns_tunnel", "evil.tk")])
    got = rows_of(indicators.sort_indicators(indicators.prioritize_indicators(ips, domains, by_ip, by_domain)))
    assert [(r["value"], r["priority"], r["reason"]) for r in got] == [
        ("1.1.1.1", "critical", "Flagged by 2 detectors"), ("evil.tk", "high", "Flagged by dns_tunnel"),
        ("45.33.32.156", "high", "Flagged by beacon"), ("8.8.8.8", "medium", "External IP from traffic")]
    assert got[0]["source_detectors"] == ["beacon", "exfiltration"]


def test_caps_never_cut_critical(spark):
    rows = [(f"c{i}", "ip", "critical", "", [], 2) for i in range(30)] + [(f"m{i:02d}", "ip", "medium", "", [], 0) for i in range(30)]
    rows += [(f"h{i}", "ip", "high", "", [], 1) for i in range(9)] + [(f"l{i}", "domain", "low", "", [], 0) for i in range(9)]
    df = spark.createDataFrame(rows, "value STRING, indicator_type STRING, priority STRING, reason STRING, source_detectors ARRAY<STRING>, detection_count BIGINT")
    kept = rows_of(indicators.cap_by_priority(df))
    count = {p: sum(r["priority"] == p for r in kept) for p in ("critical", "high", "medium", "low")}
    assert count == {"critical": 30, "high": 5, "medium": 10, "low": 5}
    assert sorted(r["value"] for r in kept if r["priority"] == "medium") == [f"m{i:02d}" for i in range(10)]


def test_selection_by_traffic(spark):
    f = spark.createDataFrame([flow("10.0.0.1", f"45.33.0.{i}", 1000 + i, 443, 1, 1000 - i, T0) for i in range(10)] + [flow("10.0.0.1", "10.0.0.2", 1, 2, 1, 99999, T0)], FLOW)
    dns = spark.createDataFrame([
        (T0, "10.0.0.1", "8.8.8.8", "Evil.tk.", "A", ["45.33.0.0"], 50), (T0, "10.0.0.1", "8.8.8.8", "g00gle.com", "A", ["45.33.0.1", "9.9.9.9"], 50),
        (T0, "10.0.0.1", "8.8.8.8", "mail.google.com", "A", ["45.33.0.1"], 50), (T0, "10.0.0.1", "8.8.8.8", "quiet.org", "A", ["45.33.0.9"], 50),
        (T0, "10.0.0.1", "8.8.8.8", "nas.local", "A", ["45.33.0.0"], 50)], DNS)
    tls = spark.createDataFrame([(T0, "10.0.0.1", "45.33.0.2", 443, "site.example", "TLS 1.3", None, None)], TLS)
    got = {r["value"]: r for r in rows_of(indicators.select_indicators(f, dns, tls, legit_domain_list(spark), 0.4))}
    assert set(got) == {"45.33.0.0", "45.33.0.1", "45.33.0.2", "evil.tk", "g00gle.com", "site.example"}
    assert got["g00gle.com"]["spoofed_brand"] == "google" and not got["evil.tk"]["is_typosquat"]
    summary = rows_of(indicators.selection_summary(f, dns, tls, legit_domain_list(spark), 0.4))[0]
    assert (summary["total_conversations"], summary["selected_conversations"], summary["public_ips"], summary["domains"],
            summary["typosquat_suspects"], summary["domains_filtered_by_legit"]) == (11, 4, 3, 3, 1, 1)
    bottom = {r["value"] for r in rows_of(indicators.select_indicators(f, dns, tls, legit_domain_list(spark), 0.1, largest=False))}
    assert bottom == {"45.33.0.9", "quiet.org"}


def test_user_domain_list(spark, tmp_path):
    (tmp_path / "mine.txt").write_text("# known\n\n Example.ORG \nexample.org\n")
    assert rows_of(read_domain_list(spark, str(tmp_path / "mine.txt"))) == [{"domain": "example.org"}]


# ---- look-ups ------------------------------------------------------------------------------


def source(spark, ddl, rows):
    """A source table from dicts; columns that are left out are NULL."""
    df = spark.createDataFrame([], ddl)
    full = [tuple(r.get(c) for c in df.columns) for r in rows]
    return spark.createDataFrame(full, ddl)


def otx(spark, rows):
    return source(spark, schemas.INTEL_OTX, [{"malware_families": [], **r} for r in rows])


def abuse(spark, rows):
    return source(spark, schemas.INTEL_ABUSE, [{"indicator_type": "ip", "is_whitelisted": False, "categories": [], **r} for r in rows])


def vt(spark, rows):
    zero = dict.fromkeys(("malicious_count", "suspicious_count", "harmless_count", "undetected_count", "total_engines"), 0)
    return source(spark, schemas.INTEL_VT, [{**zero, "tags": [], **r} for r in rows])


def test_cascade_stages(spark):
    ind = spark.createDataFrame([("1.1.1.1", "ip"), ("2.2.2.2", "ip"), ("3.3.3.3", "ip"), ("a.com", "domain"), ("b.com", "domain")], "value STRING, indicator_type STRING")
    o = otx(spark, [dict(indicator="1.1.1.1", indicator_type="ip", pulse_count=2), dict(indicator="2.2.2.2", indicator_type="ip", pulse_count=1),
                    dict(indicator="3.3.3.3", indicator_type="ip", pulse_count=0), dict(indicator="a.com", indicator_type="domain", pulse_count=4, malware_families=["rat"])])
    a = abuse(spark, [dict(indicator=i, abuse_confidence_score=s, total_reports=0) for i, s in (("2.2.2.2", 80), ("1.1.1.1", 0), ("3.3.3.3", 99))])
    v = vt(spark, [dict(indicator=i, indicator_type=t, malicious_count=7, total_engines=90, tags=["x"]) for i, t in (("2.2.2.2", "ip"), ("a.com", "domain"), ("3.3.3.3", "ip"))])
    got = {r["indicator"]: r for r in rows_of(intel.cascade(ind, o, a, v, max_slow=2))}
    assert got["3.3.3.3"]["abuse"] is None and got["3.3.3.3"]["vt"] is None and got["3.3.3.3"]["overall_threat_level"] == "unknown"
    assert got["2.2.2.2"]["overall_threat_level"] == "malicious" and got["2.2.2.2"]["source_count"] == 3
    assert got["1.1.1.1"]["slow_selected"] and got["1.1.1.1"]["vt"] is None and got["1.1.1.1"]["overall_threat_level"] == "suspicious"
    assert got["a.com"]["vt"] is None and got["b.com"]["otx"] is None
    enriched = intel.cascade(ind, o, a, v)
    stats = rows_of(intel.cascade_stats(enriched))[0]
    assert (stats["otx_flagged"], stats["abuse_total"], stats["abuse_flagged"], stats["vt_total"], stats["vt_checked"]) == (3, 2, 1, 3, 2)
    listed = rows_of(intel.flagged_indicators(enriched))
    assert [r["indicator"] for r in listed] == ["2.2.2.2", "a.com", "1.1.1.1"]
    assert listed[0]["summary"] == "VT: 7/7 | AbuseIPDB: 80% | OTX: 1 pulses" and listed[1]["malware_families"] == ["rat", "x"]
    only_abuse = {r["indicator"]: r for r in rows_of(intel.cascade(ind, None, a, None))}
    assert only_abuse["3.3.3.3"]["abuse_flagged"] and only_abuse["a.com"]["source_count"] == 0


def many(spark, n, suspicious):
    rows = [(f"10.0.0.{i:02d}", "ip", "suspicious" if i < suspicious else "unknown") for i in range(n)]
    return spark.createDataFrame(rows, "indicator STRING, indicator_type STRING, overall_threat_level STRING")


def test_slow_source_selection(spark):
    def picked(n, suspicious, limit):
        return rows_of(intel.prioritize_for_slow_source(many(spark, n, suspicious), [F.col("indicator").desc()], limit))

    small = picked(3, 0, 10)
    assert len(small) == 3 and {r["selection_reason"] for r in small} == {"auto-selected (small set)"}
    enough = picked(15, 10, 8)
    assert len(enough) == 8 and all(r["overall_threat_level"] == "suspicious" for r in enough)
    assert {r["selection_reason"] for r in enough} == {"marked suspicious by preliminary scan"}
    filled = picked(15, 5, 8)
    assert len(filled) == 8 and sum(r["overall_threat_level"] == "suspicious" for r in filled) == 5
    assert all("fallback" in r["selection_reason"] for r in filled)
    assert {r["indicator"] for r in filled} >= {"10.0.0.14", "10.0.0.13", "10.0.0.12"}


def test_two_phase_and_single(spark):
    ind = spark.createDataFrame([("1.1.1.1", "ip"), ("a.com", "domain")], "value STRING, indicator_type STRING")
    o = otx(spark, [dict(indicator="a.com", indicator_type="domain", pulse_count=1)])
    a = abuse(spark, [dict(indicator="1.1.1.1", abuse_confidence_score=80, total_reports=1), dict(indicator="a.com", indicator_type="domain", abuse_confidence_score=99)])
    v = vt(spark, [dict(indicator="1.1.1.1", indicator_type="ip", total_engines=90)])
    got = {r["indicator"]: r for r in rows_of(intel.sort_enriched(intel.enrich(ind, o, a, v)))}
    assert got["a.com"]["abuse"] is None and got["a.com"]["overall_threat_level"] == "suspicious" and got["1.1.1.1"]["source_count"] == 2
    assert rows_of(intel.enrichment_stats(intel.enrich(ind, o, a, v)))[0]["vt_queries"] == 2
    one = rows_of(intel.enrich_single(spark, "1.1.1.1", "ip", o, a, v))
    assert len(one) == 1 and one[0]["overall_threat_level"] == "malicious"


def test_cache_life(spark):
    res = spark.createDataFrame([("Evil.com", "domain", "malicious"), ("8.8.8.8", "ip", "clean")], "indicator STRING, indicator_type STRING, overall_threat_level STRING")
    c = cache.cache_entries(res, 1000.0)
    asked = spark.createDataFrame([("evil.COM", "domain"), ("8.8.8.8", "ip"), ("9.9.9.9", "ip"), ("8.8.8.8", "domain")], "value STRING, indicator_type STRING")
    hits, misses = cache.split_by_cache(asked, c, 2000.0)
    assert {r["cache_key"] for r in rows_of(hits)} == {"domain:evil.com", "ip:8.8.8.8"} and all(r["cached"] for r in rows_of(hits))
    assert {(r["value"], r["indicator_type"]) for r in rows_of(misses)} == {("9.9.9.9", "ip"), ("8.8.8.8", "domain")}
    later = 1000.0 + 7 * 3600
    assert {r["cache_key"] for r in rows_of(cache.split_by_cache(asked, c, later)[0])} == {"ip:8.8.8.8"}
    assert rows_of(cache.cache_stats(asked, c, later))[0] == {"size": 2, "max_size": 10000, "hits": 1, "misses": 3, "hit_rate": 0.25, "expirations": 1}
    merged = {r["cache_key"]: r["created_at"] for r in rows_of(cache.merge_cache(c, res.limit(1), 5000.0))}
    assert merged == {"domain:evil.com": 5000.0, "ip:8.8.8.8": 1000.0}
    many_rows = spark.range(25).select(F.col("id").cast("string").alias("indicator"), F.lit("ip").alias("indicator_type"), F.lit("clean").alias("overall_threat_level"), "id")
    big = cache.cache_entries(many_rows, 0.0).withColumn("created_at", F.col("id").cast("double")).drop("id")
    assert {int(r["indicator"]) for r in rows_of(cache.prune_cache(big, 10.0, max_size=25))} == set(range(2, 25))
    assert cache.prune_cache(big, 10.0, max_size=26).count() == 25


def test_response_shaping(spark, tmp_path):
    docs = {
        "otx": {"pulse_info": {"count": 12, "pulses": [{"id": str(i), "name": f"p{i}", "created": "x", "tags": ["APT-1", "b"] if i else ["a"]} for i in range(12)]},
                "country_code": "US", "asn": "AS1"},
        "vt": {"data": {"attributes": {"last_analysis_stats": {"malicious": 3, "harmless": 60, "timeout": 2}, "categories": {"x": "c2", "y": "c2", "z": "ads"}, "tags": ["t"], "asn": 5}}},
        "abuse": {"data": {"abuseConfidenceScore": 80, "totalReports": 4, "isTor": True, "reports": [{"categories": [18, 14]}, {"categories": [14, 4]}]}},
    }
    for name, doc in docs.items():
        lines = [{"indicator": "1.2.3.4", "indicator_type": "ip", "response": json.dumps(doc)}, {"indicator": "5.6.7.8", "indicator_type": "ip", "response": json.dumps({"error": "limit"})},
                 {"indicator": "a.com", "indicator_type": "domain", "response": None}]
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(x) for x in lines))

    def shaped(name, f, ddl):
        df = f(shaping.read_responses(spark, str(tmp_path / f"{name}.json")))
        spark.createDataFrame([], ddl).unionByName(df)
        return {r["indicator"]: r for r in rows_of(df)}

    o = shaped("otx", shaping.shape_otx, schemas.INTEL_OTX)
    assert o["1.2.3.4"]["pulse_count"] == 12 and len(o["1.2.3.4"]["pulses"]) == 12 and o["1.2.3.4"]["tags"] == ["APT-1", "a", "b"]
    few = shaped("otx", lambda r: shaping.shape_otx(r, max_pulses=10), schemas.INTEL_OTX)
    assert len(few["1.2.3.4"]["pulses"]) == 10 and few["1.2.3.4"]["pulse_count"] == 12
    assert o["1.2.3.4"]["malware_families"] == ["APT-1"] and o["5.6.7.8"]["error"] == "limit" and o["a.com"]["error"] == "no response"
    v = shaped("vt", shaping.shape_vt, schemas.INTEL_VT)
    assert (v["1.2.3.4"]["malicious_count"], v["1.2.3.4"]["total_engines"], v["1.2.3.4"]["categories"]) == (3, 65, ["ads", "c2"])
    a = shaped("abuse", shaping.shape_abuse, schemas.INTEL_ABUSE)
    assert a["1.2.3.4"]["categories"] == [4, 14, 18] and a["1.2.3.4"]["is_tor_node"] and set(a) == {"1.2.3.4", "5.6.7.8"}


# ---- whole analyses ------------------------------------------------------------------------


def test_whole_analysis(spark, tmp_path):
    packets = spark.createDataFrame([packet(i, T0 + 60 * i, "10.0.0.5", "45.33.32.156", 900_000) for i in range(30)], PACKET)
    dns = spark.createDataFrame([(T0, "10.0.0.5", "8.8.8.8", "x.dnscat.evil.tk", "TXT", ["45.33.32.156"], 99)], DNS)
    tls = spark.createDataFrame([(T0, "10.0.0.5", "45.33.32.156", 443, "pastebin.com", "TLS 1.3", True, False)], TLS)
    t = tables_from_packets(packets, dns, tls)
    assert isinstance(t, Tables)
    sections = compute_statistics(t)
    assert rows_of(sections["overview"])[0]["total_packets"] == 30 and rows_of(sections["tls_overview"])[0]["self_signed_certs"] == 1
    o = otx(spark, [dict(indicator="45.33.32.156", indicator_type="ip", pulse_count=7)])
    out = analyze(spark, t, o)
    assert {r["value"] for r in rows_of(out["indicators"])} == {"45.33.32.156", "x.dnscat.evil.tk", "pastebin.com"}
    assert "ip.addr == 45.33.32.156" in {r["filter"] for r in rows_of(out["filters"])}
    write_results({"findings": out["findings"], "filters": out["filters"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "findings")).count() == out["findings"].count() > 0
    filters = spark.read.parquet(str(tmp_path / "out" / "filters"))
    write_filter_list(filters, str(tmp_path / "list"))
    write_filter_file(filters, str(tmp_path / "file"))
    assert spark.read.json(str(tmp_path / "list")).count() == filters.count()
    lines = [r["value"] for r in rows_of(spark.read.text(str(tmp_path / "file")))]
    assert any(line.startswith("# ") for line in lines) and any(line.endswith("ip.addr == 45.33.32.156") for line in lines)


def test_second_path(spark):
    packets = spark.createDataFrame([packet(i, T0 + 60 * i, "10.0.0.5", "45.33.32.156", 900_000) for i in range(30)], PACKET)
    dns = spark.createDataFrame([(T0, "10.0.0.5", "8.8.8.8", "x.dnscat.evil.tk", "TXT", ["45.33.32.156"], 99)], DNS)
    t = tables_from_packets(packets, dns, spark.createDataFrame([], TLS))
    o = otx(spark, [dict(indicator="45.33.32.156", indicator_type="ip", pulse_count=7)])
    second = {r["indicator"]: r for r in rows_of(enrich_all(t, o))}
    assert second["45.33.32.156"]["priority"] in ("high", "critical") and second["45.33.32.156"]["overall_threat_level"] == "malicious"
