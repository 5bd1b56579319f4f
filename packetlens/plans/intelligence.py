"""Catalogue: indicator selection, priorities, intelligence joins, cache, display filters, report texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens import constants as K
from packetlens import schemas
from packetlens.functions import intel as I
from packetlens.functions import names
from packetlens.operators import cache as C
from packetlens.operators import filters as D
from packetlens.operators import flows as fl
from packetlens.operators import indicators as N
from packetlens.operators import intel as X
from packetlens.operators import textops
from packetlens.operators.detectors import evaluate
from packetlens.operators.lookalikes import imitated_brands
from packetlens.operators.detectors.dns_tunnel import DnsTunnelDetector
from packetlens.operators.detectors.exfiltration import ExfiltrationDetector
from packetlens.plans import sqltext as S
from packetlens.plans.catalog import query
from packetlens.plans.detection import DNS_CTE, EXFIL_CTE
from packetlens.plans.traffic import FLOWS_CTE, packets
from packetlens.plans.views import view
from packetlens.sources.lists import bundled_legit_domains, legit_domain_list

# ---- tables --------------------------------------------------------------------------------


def _conform(df, ddl):
    """The columns of a schema; those the view does not supply are NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in T.DataType.fromDDL(ddl).fields
    ])


def intel_tables(spark, sf):
    """The three source tables, typed, from the intelligence view."""
    base = view(spark, sf, "intel_v")
    families = F.when(F.col("has_malware_tag"), F.array(F.lit("apt-tool"), F.lit("botnet"))).otherwise(F.array().cast("array<string>"))
    otx = base.withColumns({"malware_families": families, "tags": families})
    codes = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(14), F.lit(18), F.lit(99))).otherwise(F.array().cast("array<int>"))
    abuse = base.withColumns({"abuse_confidence_score": F.col("abuse_score"), "categories": codes})
    vt = base.withColumns({
        "harmless_count": F.lit(0), "undetected_count": F.greatest(F.col("total_engines") - 20, F.lit(0)),
        "tags": F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("scanner"))).otherwise(F.array().cast("array<string>")),
    })
    return (_conform(otx, schemas.INTEL_OTX), _conform(abuse, schemas.INTEL_ABUSE), _conform(vt, schemas.INTEL_VT))


def _indicators(spark, sf):
    return view(spark, sf, "intel_v").select(F.col("indicator").alias("value"), "indicator_type")


def _dns(spark, sf):
    return view(spark, sf, "dns_v").withColumn("response_ips", F.array("response_ip"))


# ---- names ---------------------------------------------------------------------------------

_CLEAN = "trim(lower({c}), '.')"


def _suffix_hit(c: str, listed) -> str:
    labels = f"string_split({c}, '.')"
    return (f"list_filter([array_to_string({labels}[i:], '.') FOR i IN range(1, greatest(len({labels}), 1))], "
            f"lambda x: x IN {S.in_list(listed)})[1]")


def _normal(c: str) -> str:
    out = f"translate(lower({c}), '{''.join(K.LOOKALIKE_CHARACTERS)}', '{''.join(K.LOOKALIKE_CHARACTERS.values())}')"
    for pair, single in K.LOOKALIKE_PAIRS.items():
        out = f"replace({out}, '{pair}', '{single}')"
    return out


BRAND_CTE = f"""
doms AS (SELECT DISTINCT trim(lower(domain), '.') AS domain FROM (SELECT query_name AS domain FROM dns_v UNION SELECT sni FROM tls_v) u),
mains AS (SELECT domain, string_split(domain, '.')[-2] AS main, {_normal('domain')} AS full_norm FROM doms),
brands AS (SELECT unnest({S.sql_list(K.BRANDS)}) AS brand),
spoofs AS (SELECT domain, min(brand) AS spoofed_brand FROM mains, brands
  WHERE main IS NOT NULL AND main NOT IN {S.in_list(K.BRANDS)} AND ({_normal('main')} = brand OR levenshtein(main, brand) <= 2
    OR (contains(full_norm, brand) AND NOT contains(domain, brand))) GROUP BY domain),
known AS (SELECT domain, spoofed_brand, spoofed_brand IS NULL AND {_suffix_hit('domain', bundled_legit_domains())} IS NOT NULL AS is_legit
  FROM doms LEFT JOIN spoofs USING (domain))
"""


def _all_names(spark, sf):
    both = fl.all_domains(view(spark, sf, "dns_v"), view(spark, sf, "tls_v"))
    return both.select(names.clean_domain("domain").alias("domain")).distinct()


@query("typosquats", ["dns_v", "tls_v"], "SELECT domain, spoofed_brand FROM spoofs", BRAND_CTE)
def typosquats(spark, sf):
    return _all_names(spark, sf).withColumn("spoofed_brand", names.imitated_brand("domain")).where("spoofed_brand IS NOT NULL")


#: Brands as a table: the listed ones, and one per customer that some names of the views are an edit or two away from.
_MANY_BRANDS = "SELECT concat('sit', c_custkey % 5000) AS brand FROM {customer}"


@query("typosquats_of_many", ["dns_v", "tls_v"], f"""
SELECT domain, min(brand) AS spoofed_brand FROM mains, (SELECT brand FROM brands UNION {_MANY_BRANDS.replace('{customer}', 'customer')}) b
WHERE main IS NOT NULL AND main NOT IN (SELECT brand FROM brands UNION {_MANY_BRANDS.replace('{customer}', 'customer')})
  AND ({_normal('main')} = brand OR levenshtein(main, brand) <= 2 OR (contains(full_norm, brand) AND NOT contains(domain, brand))) GROUP BY domain""", BRAND_CTE)
def typosquats_of_many(spark, sf):
    many = spark.sql(_MANY_BRANDS, customer=view(spark, sf, "customer"))
    listed = spark.createDataFrame([(b,) for b in K.BRANDS], "brand string")
    return imitated_brands(_all_names(spark, sf), listed.union(many))


@query("legit_domains_removed", ["dns_v", "tls_v"], "SELECT domain FROM known WHERE is_legit", BRAND_CTE)
def legit_domains_removed(spark, sf):
    found = N.classify_domains(_all_names(spark, sf), legit_domain_list(spark))
    return found.where("is_legit").select("domain")


@query("domain_checks", ["dns_v", "tls_v"], f"""
SELECT domain, {_normal('domain')} AS normalized, {_suffix_hit('domain', bundled_legit_domains())} IS NOT NULL AS is_legit,
  domain = '' OR regexp_matches(domain, '[.](local|lan|internal|localhost|in-addr[.]arpa|ip6[.]arpa)$') OR {_suffix_hit('domain', K.SAFE_DOMAINS_CASCADE)} IS NOT NULL AS is_safe,
  regexp_full_match(domain, '[a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?([.][a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?)*') AS is_valid,
  levenshtein(split_part(domain, '.', 1), 'google') <= 2 AS near_google FROM doms""", BRAND_CTE)
def domain_checks(spark, sf):
    return _all_names(spark, sf).select(
        "domain", names.normalize_lookalike("domain").alias("normalized"),
        names.listed_suffix("domain", bundled_legit_domains()).isNotNull().alias("is_legit"),
        names.is_safe_domain("domain").alias("is_safe"), names.is_valid_domain("domain").alias("is_valid"),
        names.is_similar(F.substring_index("domain", ".", 1), F.lit("google")).alias("near_google"),
    )


# ---- selection -----------------------------------------------------------------------------

SELECT_CTE = FLOWS_CTE.rstrip() + f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY byte_count DESC, src_ip, dst_ip, src_port NULLS FIRST, dst_port NULLS FIRST, protocol) AS rn,
  count(*) OVER () AS n FROM flows),
chosen AS (SELECT * FROM ranked WHERE rn <= greatest(1, CAST(floor(n * 0.4::DOUBLE) AS BIGINT))),
pub AS (SELECT DISTINCT CASE WHEN NOT {S.private_registry('src_ip')} THEN src_ip ELSE dst_ip END AS ip FROM chosen
  WHERE NOT {S.private_registry('src_ip')} OR NOT {S.private_registry('dst_ip')}),
pairs AS (SELECT response_ip AS ip, query_name AS domain FROM dns_v UNION SELECT dst_ip, sni FROM tls_v),
rel AS (SELECT DISTINCT trim(lower(domain), '.') AS domain FROM pairs WHERE ip IN (SELECT ip FROM pub)
  AND NOT regexp_matches(trim(lower(domain), '.'), '[.](local|lan|internal|arpa)$')),
""" + BRAND_CTE.strip()


@query("address_names", ["dns_v", "tls_v"], "SELECT response_ip AS ip, query_name AS domain FROM dns_v UNION SELECT dst_ip, sni FROM tls_v")
def address_names(spark, sf):
    return N.address_names(_dns(spark, sf), view(spark, sf, "tls_v"))


@query("selected_indicators", ["traffic_v", "dns_v", "tls_v"], """
SELECT ip AS value, 'ip' AS indicator_type, false AS is_typosquat, CAST(NULL AS VARCHAR) AS spoofed_brand FROM pub
UNION ALL SELECT domain, 'domain', spoofed_brand IS NOT NULL, spoofed_brand FROM rel JOIN known USING (domain) WHERE NOT is_legit""", SELECT_CTE)
def selected_indicators(spark, sf):
    flows = fl.build_flows(packets(spark, sf))
    return N.select_indicators(flows, _dns(spark, sf), view(spark, sf, "tls_v"), legit_domain_list(spark))


@query("selection_summary", ["traffic_v", "dns_v", "tls_v"], """
SELECT (SELECT count(*) FROM flows) AS total_conversations, (SELECT count(*) FROM chosen) AS selected_conversations,
  (SELECT count(*) FROM pub) AS public_ips, count(*) FILTER (NOT is_legit) AS domains, count(*) FILTER (spoofed_brand IS NOT NULL) AS typosquat_suspects,
  count(*) FILTER (is_legit) AS domains_filtered_by_legit, (SELECT count(*) FROM pub) + count(*) FILTER (NOT is_legit) AS total_indicators
FROM rel JOIN known USING (domain)""", SELECT_CTE)
def selection_summary(spark, sf):
    flows = fl.shuffled_flows(packets(spark, sf), ["byte_count"])
    return N.selection_summary(flows, _dns(spark, sf), view(spark, sf, "tls_v"), legit_domain_list(spark))


# ---- priorities ----------------------------------------------------------------------------

# Flags are those of real findings on the traffic and the DNS and TLS tables. One address in ten is moved into a CDN range.
_SEEN = {
    "seen_ips": """SELECT DISTINCT CASE WHEN CAST(split_part(ip, '.', 4) AS INT) % 10 = 3 THEN concat('104.16.0.', split_part(ip, '.', 4)) ELSE ip END AS ip
  FROM (SELECT src_ip AS ip FROM {traffic_v} UNION SELECT dst_ip FROM {traffic_v}) t""",
    "seen_domains": "SELECT query_name AS domain FROM {dns_v} UNION SELECT sni AS domain FROM {tls_v}",
}
#: Bytes from which a destination of the test traffic counts as a large transfer; some of them stay below at sf0.01.
_LARGE = 31_500_000
_HOUR = "hour(make_timestamp(CAST(floor(start_time) AS BIGINT) * 1000000))"
FLAG_CTE = EXFIL_CTE.strip() + "," + DNS_CTE.strip() + f""",
late AS (SELECT * FROM outf WHERE {_HOUR} >= 22 OR {_HOUR} < 6),
hits AS (SELECT 'large' AS rule, dst_ip, src_ip FROM outf WHERE dst_ip IN (SELECT dst_ip FROM dest WHERE bytes_out >= {_LARGE})
  UNION ALL SELECT 'ratio', dst_ip, src_ip FROM outf WHERE dst_ip IN (SELECT dst_ip FROM dest WHERE bytes_in > 0 AND bytes_out >= {_LARGE} AND bytes_out / bytes_in >= 10)
  UNION ALL SELECT 'late', dst_ip, src_ip FROM late WHERE dst_ip IN (SELECT dst_ip FROM late GROUP BY 1 HAVING sum(byte_count) >= {_LARGE})),
flagged_ips AS (SELECT DISTINCT 'exfiltration' AS detector, rule, dst_ip, unnest([dst_ip, src_ip]) AS ip FROM hits
  UNION ALL SELECT DISTINCT 'dns_tunnel', 'tunnel', parent, src_ip FROM named WHERE parent IN (SELECT parent FROM points WHERE points >= 35)),
flagged_domains AS (SELECT 'dns_tunnel' AS detector, parent AS domain FROM points WHERE points >= 35
  UNION ALL SELECT DISTINCT 'exfiltration', arg_max(d, length(d)) FROM (SELECT lower(sni) AS s FROM tls_v) t,
    (SELECT unnest({S.sql_list(K.CLOUD_STORAGE_DOMAINS + K.PASTE_DOMAINS)}) AS d) l WHERE ends_with('.' || s, '.' || d) GROUP BY s),
"""


def _seen_and_flagged(spark, sf):
    """(addresses seen, domains seen, flagged addresses, flagged domains), all from one evaluation of the rules.

    These detectors read flows only to add them up per edge, so the flows themselves are not written.
    """
    dns, tls = view(spark, sf, "dns_v"), view(spark, sf, "tls_v")
    tables = fl.Tables(flows=fl.build_flows(packets(spark, sf)), dns=dns, tls=tls)
    ledger = evaluate(tables, detectors=[DnsTunnelDetector(), ExfiltrationDetector(min_bytes=_LARGE)])
    last = F.split_part("ip", F.lit("."), F.lit(4))
    in_cdn = F.when(last.cast("int") % 10 == 3, F.concat(F.lit("104.16.0."), last)).otherwise(F.col("ip"))
    seen_ips = fl.all_addresses(ledger.evidence.edges).select(in_cdn.alias("ip")).distinct()
    seen_domains = ledger.evidence.names.select(F.col("query_name").alias("domain")).union(tls.select("sni")).distinct()
    return seen_ips, seen_domains, ledger.addresses(), N.finding_domains(ledger.findings())


def _plain(text: str) -> str:
    return text.replace("{", "").replace("}", "")


_CDN_CASE = "CASE " + " ".join(f"WHEN {S.in_network('ip', c)} THEN '{c}'" for c in K.CDN_RANGES) + " END"
_PRIORITY = "CASE WHEN n >= 2 THEN 'critical' WHEN n = 1 THEN 'high' ELSE '{quiet}' END"
_REASON = "CASE WHEN n >= 2 THEN concat('Flagged by ', n, ' detectors') WHEN n = 1 THEN 'Flagged by ' || d ELSE '{quiet}' END"

PRIORITY_CTE = FLAG_CTE + ", ".join(f"{k} AS ({_plain(v)})" for k, v in _SEEN.items()) + f""",
ip_rows AS (SELECT ip AS value, 'ip' AS indicator_type, coalesce(n, 0) AS n, ds, d,
  CASE WHEN {S.private_registry('ip')} THEN 'Private IP range' WHEN {S.in_network('ip', K.MULTICAST_V4)} THEN 'Reserved/special address'
    ELSE 'Known CDN range (' || ({_CDN_CASE}) || ')' END AS skip
  FROM seen_ips LEFT JOIN (SELECT ip, count(*) AS n, min(detector) AS d, array_to_string(list_sort(list_distinct(list(detector))), ',') AS ds FROM flagged_ips GROUP BY 1) f USING (ip)),
dom_rows AS (SELECT domain AS value, 'domain' AS indicator_type, coalesce(n, 0) AS n, ds, d,
  CASE WHEN domain = '' THEN 'Empty domain' WHEN {_suffix_hit('domain', K.SAFE_DOMAINS_PRIORITY)} IS NOT NULL THEN 'Known safe domain (' || {_suffix_hit('domain', K.SAFE_DOMAINS_PRIORITY)} || ')'
    WHEN regexp_matches(domain, '[.](in-addr|ip6)[.]arpa$') THEN 'Reverse DNS lookup' WHEN regexp_matches(domain, '[.](local|lan|internal)$') THEN 'Local domain' END AS skip
  FROM (SELECT DISTINCT trim(lower(domain), '.') AS domain FROM seen_domains) s
  LEFT JOIN (SELECT domain, count(*) AS n, min(detector) AS d, array_to_string(list_sort(list_distinct(list(detector))), ',') AS ds FROM flagged_domains GROUP BY 1) f USING (domain)),
judged AS (SELECT value, indicator_type, CASE WHEN skip IS NOT NULL THEN 'skip' ELSE {_PRIORITY.format(quiet='medium')} END AS priority,
    coalesce(skip, {_REASON.format(quiet='External IP from traffic')}) AS reason, CASE WHEN skip IS NULL THEN coalesce(ds, '') ELSE '' END AS source_detectors,
    CASE WHEN skip IS NULL THEN n ELSE 0 END AS detection_count FROM ip_rows
  UNION ALL SELECT value, indicator_type, CASE WHEN skip IS NOT NULL THEN 'skip' ELSE {_PRIORITY.format(quiet='low')} END,
    coalesce(skip, {_REASON.format(quiet='Domain from traffic')}), CASE WHEN skip IS NULL THEN coalesce(ds, '') ELSE '' END,
    CASE WHEN skip IS NULL THEN n ELSE 0 END FROM dom_rows)
"""


def _flat(df):
    return df.withColumn("source_detectors", F.array_join("source_detectors", ","))


def _judged(spark, sf):
    seen_ips, seen_domains, flagged_ips, flagged_domains = _seen_and_flagged(spark, sf)
    by_ip = N.classify_addresses(seen_ips, flagged_ips)
    return by_ip.unionByName(N.classify_domain_priority(seen_domains, flagged_domains))


@query("indicator_classes", ["traffic_v", "dns_v", "tls_v"], "SELECT * FROM judged", PRIORITY_CTE)
def indicator_classes(spark, sf):
    return _flat(_judged(spark, sf))


@query("indicator_priority", ["traffic_v", "dns_v", "tls_v"], "SELECT * FROM judged WHERE priority <> 'skip'", PRIORITY_CTE)
def indicator_priority(spark, sf):
    return _flat(N.sort_indicators(N.prioritize_indicators(*_seen_and_flagged(spark, sf))))


@query("indicator_priority_capped", ["traffic_v", "dns_v", "tls_v"], """
SELECT value, indicator_type, priority, reason, source_detectors, detection_count FROM (
  SELECT *, row_number() OVER (PARTITION BY priority ORDER BY detection_count DESC, indicator_type, value) AS rn FROM judged WHERE priority <> 'skip') r
WHERE priority = 'critical' OR rn <= CASE priority WHEN 'high' THEN 5 WHEN 'medium' THEN 10 ELSE 5 END""", PRIORITY_CTE)
def indicator_priority_capped(spark, sf):
    return _flat(N.cap_by_priority(N.prioritize_indicators(*_seen_and_flagged(spark, sf))))


# ---- intelligence --------------------------------------------------------------------------

INTEL_CTE = """
lv AS (SELECT *, CASE WHEN malicious_count >= 5 THEN 'malicious' WHEN malicious_count >= 1 OR suspicious_count >= 3 THEN 'suspicious' WHEN total_engines > 0 THEN 'clean' ELSE 'unknown' END AS vt_level,
  CASE WHEN is_whitelisted THEN 'clean' WHEN abuse_score >= 75 THEN 'malicious' WHEN abuse_score >= 25 THEN 'suspicious' WHEN total_reports = 0 THEN 'clean' ELSE 'unknown' END AS abuse_level,
  CASE WHEN pulse_count >= 3 OR has_malware_tag THEN 'malicious' WHEN pulse_count >= 1 THEN 'suspicious' ELSE 'unknown' END AS otx_level,
  pulse_count >= 1 OR has_malware_tag AS otx_flag, abuse_score >= 25 OR total_reports >= 3 AS abuse_flag,
  concat(malicious_count, '/', CASE WHEN malicious_count + suspicious_count + greatest(total_engines - 20, 0) = 0 THEN total_engines ELSE malicious_count + suspicious_count + greatest(total_engines - 20, 0) END) AS ratio
  FROM intel_v),
staged AS (SELECT *, otx_flag AS abuse_wanted, otx_flag AND abuse_flag AS abuse_flagged FROM lv),
picked AS (SELECT indicator FROM staged WHERE otx_flag ORDER BY CASE WHEN abuse_flagged THEN 0 ELSE 2 END, indicator LIMIT 9),
casc AS (SELECT s.*, p.indicator IS NOT NULL AS slow_selected, list_filter([otx_level, CASE WHEN abuse_wanted THEN abuse_level END, CASE WHEN p.indicator IS NOT NULL THEN vt_level END], lambda x: x IS NOT NULL) AS levels
  FROM staged s LEFT JOIN picked p USING (indicator)),
cascl AS (SELECT *, CASE WHEN list_contains(levels, 'malicious') THEN 'malicious' WHEN list_contains(levels, 'suspicious') THEN 'suspicious' WHEN list_contains(levels, 'clean') THEN 'clean' ELSE 'unknown' END AS level FROM casc)
"""


def _sources(vt, abuse, vt_end, abuse_end):
    return (f"list_filter([CASE WHEN {vt} AND malicious_count > 0 THEN 'VT: ' || ratio || '{vt_end}' END, CASE WHEN {abuse} AND abuse_score > 0 THEN concat('AbuseIPDB: ', abuse_score, '%{abuse_end}') END,"
            f" CASE WHEN pulse_count > 0 THEN concat('OTX: ', pulse_count, ' pulses') END], lambda x: x IS NOT NULL)")


def _full(spark, sf):
    otx, abuse, vt = intel_tables(spark, sf)
    rows = _indicators(spark, sf).withColumnRenamed("value", "indicator")
    for name, source in (("otx", otx), ("abuse", abuse), ("vt", vt)):
        rows = rows.join(X._packed(source, name), X.KEY, "left")
    return X.with_assessment(rows)


@query("threat_levels", ["intel_v"], f"""
SELECT indicator, vt_level, abuse_level, otx_level, CASE WHEN 'malicious' IN (vt_level, abuse_level, otx_level) THEN 'malicious' WHEN 'suspicious' IN (vt_level, abuse_level, otx_level) THEN 'suspicious'
  WHEN 'clean' IN (vt_level, abuse_level, otx_level) THEN 'clean' ELSE 'unknown' END AS overall_threat_level, otx_flag, abuse_flag, malicious_count >= 1 AS vt_flag, ratio AS detection_ratio, 3 AS source_count,
  coalesce(nullif(array_to_string({_sources('true', 'true', ' detections', ' confidence')}, ' | '), ''), 'No threat indicators found') AS summary,
  array_to_string(list_filter([CASE WHEN pulse_count > 0 THEN concat(pulse_count, ' pulses') END, CASE WHEN has_malware_tag THEN 'apt-tool, botnet' END], lambda x: x IS NOT NULL), ' - ') AS otx_details,
  array_to_string(list_filter([CASE WHEN abuse_score > 0 THEN concat(abuse_score, '% confidence') END, CASE WHEN total_reports > 0 THEN concat(total_reports, ' reports') END, CASE WHEN s_suppkey % 3 = 0 THEN 'Port Scan, Brute-Force' END], lambda x: x IS NOT NULL), ' - ') AS abuse_details,
  ratio || CASE WHEN s_suppkey % 2 = 0 THEN ' - scanner' ELSE '' END AS vt_details, CASE WHEN s_suppkey % 3 = 0 THEN 'Port Scan,Brute-Force,Category-99' ELSE '' END AS category_names
FROM lv""", INTEL_CTE)
def threat_levels(spark, sf):
    return _full(spark, sf).select(
        "indicator", I.vt_threat_level("vt").alias("vt_level"), I.abuse_threat_level("abuse").alias("abuse_level"),
        I.otx_threat_level("otx").alias("otx_level"), "overall_threat_level", I.otx_flagged("otx").alias("otx_flag"),
        I.abuse_flagged("abuse").alias("abuse_flag"), I.vt_malicious("vt").alias("vt_flag"),
        I.detection_ratio("vt").alias("detection_ratio"), "source_count", "summary", I.otx_details("otx").alias("otx_details"),
        I.abuse_details("abuse").alias("abuse_details"), I.vt_details("vt").alias("vt_details"),
        F.array_join(I.category_names("abuse.categories"), ",").alias("category_names"),
    )


def _cascade(spark, sf):
    return X.cascade(_indicators(spark, sf), *intel_tables(spark, sf))


@query("cascade", ["intel_v"], """
SELECT indicator, otx_flag AS otx_flagged, abuse_wanted, abuse_flagged, slow_selected, level AS overall_threat_level, CAST(len(levels) AS INTEGER) AS source_count FROM cascl""", INTEL_CTE)
def cascade(spark, sf):
    return _cascade(spark, sf).select(
        "indicator", "otx_flagged", "abuse_wanted", "abuse_flagged", "slow_selected", "overall_threat_level", "source_count")


@query("cascade_stats", ["intel_v"], """
SELECT count(*) AS total_indicators, count(*) AS otx_checked, count(*) FILTER (otx_flag) AS otx_flagged, 0::BIGINT AS otx_errors, count(*) FILTER (abuse_wanted) AS abuse_total,
  count(*) FILTER (abuse_wanted) AS abuse_checked, count(*) FILTER (abuse_flagged) AS abuse_flagged, 0::BIGINT AS abuse_errors, count(*) FILTER (slow_selected) AS vt_total,
  count(*) FILTER (slow_selected) AS vt_checked, count(*) FILTER (slow_selected AND malicious_count >= 1) AS vt_malicious, 0::BIGINT AS vt_errors,
  count(*) FILTER (level = 'malicious') AS total_malicious, count(*) FILTER (level = 'suspicious') AS total_suspicious FROM cascl""", INTEL_CTE)
def cascade_stats(spark, sf):
    return X.cascade_stats(_cascade(spark, sf))


@query("cascade_without_pulses", ["intel_v"], """
SELECT indicator, abuse_flag AS abuse_flagged, indicator IN (SELECT indicator FROM lv WHERE abuse_flag ORDER BY indicator LIMIT 9) AS slow_selected,
  CASE WHEN 'malicious' IN (abuse_level, v) THEN 'malicious' WHEN 'suspicious' IN (abuse_level, v) THEN 'suspicious' WHEN 'clean' IN (abuse_level, v) THEN 'clean' ELSE 'unknown' END AS overall_threat_level
FROM (SELECT *, CASE WHEN indicator IN (SELECT indicator FROM lv WHERE abuse_flag ORDER BY indicator LIMIT 9) THEN vt_level ELSE 'unknown' END AS v FROM lv) l""", INTEL_CTE)
def cascade_without_pulses(spark, sf):
    # Without pulses every address is asked for abuse reports.
    _, abuse, vt = intel_tables(spark, sf)
    return X.cascade(_indicators(spark, sf), None, abuse, vt).select("indicator", "abuse_flagged", "slow_selected", "overall_threat_level")


@query("flagged_indicators", ["intel_v"], f"""
SELECT indicator, indicator_type, level AS threat_level, array_to_string({_sources('slow_selected', 'abuse_wanted', '', '')}, ' | ') AS summary,
  array_to_string(list_sort(list_distinct(CASE WHEN has_malware_tag THEN ['apt-tool', 'botnet'] ELSE [] END || CASE WHEN slow_selected AND s_suppkey % 2 = 0 THEN ['scanner'] ELSE [] END)), ',') AS malware_families
FROM cascl WHERE level IN ('malicious', 'suspicious')""", INTEL_CTE)
def flagged_indicators(spark, sf):
    return X.flagged_indicators(_cascade(spark, sf)).drop("sources").withColumn(
        "malware_families", F.array_join("malware_families", ","))


def _two_phase(indicators: str) -> str:
    """CTEs of both phases over a table like ``lv``; ``done`` has the results."""
    return f""",
prelim AS (SELECT *, CASE WHEN 'malicious' IN (abuse_level, otx_level) THEN 'malicious' WHEN 'suspicious' IN (abuse_level, otx_level) THEN 'suspicious' WHEN 'clean' IN (abuse_level, otx_level) THEN 'clean' ELSE 'unknown' END AS pre FROM {indicators}),
slow AS (SELECT indicator, CASE WHEN (SELECT count(*) FROM prelim) <= 10 THEN 'auto-selected (small set)'
    WHEN (SELECT count(*) FROM prelim WHERE pre IN ('malicious', 'suspicious')) >= 10 THEN 'marked suspicious by preliminary scan' ELSE 'fallback selection' END AS selection_reason
  FROM prelim ORDER BY CASE WHEN (SELECT count(*) FROM prelim) <= 10 THEN 0 WHEN pre IN ('malicious', 'suspicious') THEN 0 ELSE 1 END, indicator LIMIT 10),
done AS (SELECT p.*, s.indicator IS NOT NULL AS slow_selected, CASE WHEN 'malicious' IN (pre, v) THEN 'malicious' WHEN 'suspicious' IN (pre, v) THEN 'suspicious' WHEN 'clean' IN (pre, v) THEN 'clean' ELSE 'unknown' END AS level
  FROM (SELECT prelim.*, CASE WHEN indicator IN (SELECT indicator FROM slow) THEN vt_level ELSE 'unknown' END AS v FROM prelim) p LEFT JOIN slow s USING (indicator))
"""


TWO_PHASE_CTE = INTEL_CTE.strip() + _two_phase("lv")


@query("vt_priority", ["intel_v"], "SELECT indicator, selection_reason FROM slow", TWO_PHASE_CTE)
def vt_priority(spark, sf):
    otx, abuse, _ = intel_tables(spark, sf)
    first = X.enrich(_indicators(spark, sf), otx, abuse)
    return X.prioritize_for_slow_source(first, [F.col("indicator")]).select("indicator", "selection_reason")


@query("enriched", ["intel_v"], "SELECT indicator, slow_selected, level AS overall_threat_level, CASE WHEN slow_selected THEN 3 ELSE 2 END AS source_count FROM done", TWO_PHASE_CTE)
def enriched(spark, sf):
    return X.sort_enriched(X.enrich(_indicators(spark, sf), *intel_tables(spark, sf))).select(
        "indicator", "slow_selected", "overall_threat_level", "source_count")


@query("enrichment_stats", ["intel_v"], """
SELECT count(*) AS total_indicators, count(*) AS otx_queries, count(*) AS abuse_queries, count(*) FILTER (slow_selected) AS vt_queries, count(*) FILTER (NOT slow_selected) AS vt_skipped,
  count(*) FILTER (level = 'malicious') AS malicious_found, count(*) FILTER (level = 'suspicious') AS suspicious_found FROM done""", TWO_PHASE_CTE)
def enrichment_stats(spark, sf):
    return X.enrichment_stats(X.enrich(_indicators(spark, sf), *intel_tables(spark, sf)))


# ---- cache ---------------------------------------------------------------------------------

# Every look-up of the cascade is cached, written s_suppkey * 500 seconds before now; old ones have expired.
_NOW = 1_700_000_000.0
CACHE_CTE = INTEL_CTE.strip() + f""",
ttl AS (SELECT *, CASE level WHEN 'malicious' THEN 21600 WHEN 'suspicious' THEN 43200 WHEN 'clean' THEN 86400 ELSE 14400 END AS life FROM cascl),
entries AS (SELECT 'ip:' || lower(indicator) AS cache_key, indicator, level, {_NOW}::DOUBLE - s_suppkey * 500 AS created_at, {_NOW}::DOUBLE - s_suppkey * 500 + life AS expires_at FROM ttl)
"""


def _cache(spark, sf):
    rows = _cascade(spark, sf).select("indicator", "indicator_type", "overall_threat_level")
    ages = view(spark, sf, "intel_v").select("indicator", (F.col("s_suppkey") * 500).alias("age"))
    written = C.cache_entries(rows.join(ages, "indicator"), _NOW)
    return written.withColumns({"created_at": F.col("created_at") - F.col("age"), "expires_at": F.col("expires_at") - F.col("age")}).drop("age")


@query("cache_split", ["intel_v"], f"""
SELECT i.indicator, coalesce(e.expires_at >= {_NOW}, false) AS cached FROM intel_v i LEFT JOIN entries e USING (indicator)""", CACHE_CTE)
def cache_split(spark, sf):
    hits, misses = C.split_by_cache(_indicators(spark, sf), _cache(spark, sf), _NOW)
    return hits.select("indicator", F.lit(True).alias("cached")).unionByName(
        misses.select(F.col("value").alias("indicator"), F.lit(False).alias("cached")))


@query("cache_prune", ["intel_v"], f"""
SELECT cache_key, level AS overall_threat_level, created_at, expires_at FROM (SELECT *, row_number() OVER (ORDER BY created_at, cache_key) AS rn, count(*) OVER () AS n FROM entries WHERE expires_at >= {_NOW}) r
WHERE rn > CASE WHEN n >= 20 THEN greatest(1, n // 10) ELSE 0 END""", CACHE_CTE)
def cache_prune(spark, sf):
    return C.prune_cache(_cache(spark, sf), _NOW, max_size=20).select("cache_key", "overall_threat_level", "created_at", "expires_at")


@query("cache_merge", ["intel_v"], f"""
SELECT cache_key, level AS overall_threat_level, CASE WHEN expires_at < {_NOW} THEN {_NOW}::DOUBLE ELSE created_at END AS created_at FROM entries""", CACHE_CTE)
def cache_merge(spark, sf):
    # What has expired is looked up again; the new entry of a key replaces the old one.
    cache = _cache(spark, sf)
    _, misses = C.split_by_cache(_indicators(spark, sf), cache, _NOW)
    looked_up = _cascade(spark, sf).select("indicator", "indicator_type", "overall_threat_level")
    looked_up = looked_up.join(misses.select(F.col("value").alias("indicator")), "indicator", "left_semi")
    return C.merge_cache(cache, looked_up, _NOW).select("cache_key", "overall_threat_level", "created_at")


@query("cache_stats", ["intel_v"], f"""
SELECT (SELECT count(*) FROM entries) AS size, 10000 AS max_size, count(*) FILTER (expires_at >= {_NOW}) AS hits, count(*) FILTER (expires_at IS NULL OR expires_at < {_NOW}) AS misses,
  round_even(count(*) FILTER (expires_at >= {_NOW}) / count(*), 3) AS hit_rate, count(*) FILTER (expires_at < {_NOW}) AS expirations
FROM intel_v LEFT JOIN entries USING (indicator)""", CACHE_CTE)
def cache_stats(spark, sf):
    return C.cache_stats(_indicators(spark, sf), _cache(spark, sf), _NOW)


CACHED_TWO_PHASE_CTE = CACHE_CTE.strip() + f""",
missed AS (SELECT * FROM lv WHERE indicator IN (SELECT indicator FROM entries WHERE expires_at < {_NOW}))""" + _two_phase("missed")


def _with_cache(spark, sf):
    sources = intel_tables(spark, sf)
    return C.enrich_with_cache(_indicators(spark, sf), _cache(spark, sf), _NOW, lambda misses: X.enrich(misses, *sources))


@query("enrich_with_cache", ["intel_v"], f"""
SELECT indicator, level AS overall_threat_level, true AS cached, CAST(NULL AS BOOLEAN) AS slow_selected, CAST(NULL AS INTEGER) AS source_count FROM entries WHERE expires_at >= {_NOW}
UNION ALL SELECT indicator, level, false, slow_selected, CASE WHEN slow_selected THEN 3 ELSE 2 END FROM done""", CACHED_TWO_PHASE_CTE)
def enrich_with_cache(spark, sf):
    return _with_cache(spark, sf).results.select("indicator", "overall_threat_level", "cached", "slow_selected", "source_count")


@query("cache_after_lookups", ["intel_v"], f"""
SELECT cache_key, level AS overall_threat_level, created_at FROM entries WHERE expires_at >= {_NOW}
UNION ALL SELECT 'ip:' || lower(indicator), level, {_NOW}::DOUBLE FROM done""", CACHED_TWO_PHASE_CTE)
def cache_after_lookups(spark, sf):
    return _with_cache(spark, sf).cache.select("cache_key", "overall_threat_level", "created_at")


@query("enrich_with_cache_stats", ["intel_v"], f"""
SELECT (SELECT count(*) FROM entries WHERE expires_at >= {_NOW}) AS cached_hits, (SELECT count(*) FROM entries) AS total_indicators, count(*) AS api_lookups, 0::BIGINT AS errors,
  count(*) AS otx_queries, count(*) AS abuse_queries, count(*) FILTER (slow_selected) AS vt_queries, count(*) FILTER (NOT slow_selected) AS vt_skipped,
  count(*) FILTER (level = 'malicious') AS malicious_found, count(*) FILTER (level = 'suspicious') AS suspicious_found FROM done""", CACHED_TWO_PHASE_CTE)
def enrich_with_cache_stats(spark, sf):
    return _with_cache(spark, sf).stats


# ---- display filters -----------------------------------------------------------------------

_F = "'{category}' AS category, '{severity}' AS severity, {confidence}::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS related_finding_id"


def _f(category="custom", severity="medium", confidence=0.5):
    return _F.format(category=category, severity=severity, confidence=confidence)


_PAIRS = "(SELECT DISTINCT src_ip, dst_ip FROM traffic_v) p"


def _pairs(spark, sf):
    return packets(spark, sf).select("src_ip", "dst_ip").distinct()


@query("filter_ip", ["traffic_v"], f"""
SELECT DISTINCT 'IP: ' || ip AS name, 'ip.addr == ' || ip AS filter, 'Traffic involving ' || ip AS description, {_f()} FROM (SELECT src_ip AS ip FROM traffic_v UNION SELECT dst_ip FROM traffic_v) t
UNION ALL SELECT DISTINCT 'IP: ' || src_ip, 'ip.src == ' || src_ip, 'Traffic involving ' || src_ip, {_f()} FROM traffic_v
UNION ALL SELECT DISTINCT 'IP: ' || dst_ip, 'ip.dst == ' || dst_ip, 'Traffic involving ' || dst_ip, {_f()} FROM traffic_v""")
def filter_ip(spark, sf):
    p = packets(spark, sf)
    return (D.ip_filter(fl.all_addresses(p))
            .unionByName(D.ip_filter(p.select("src_ip").distinct(), "src_ip", "src"))
            .unionByName(D.ip_filter(p.select("dst_ip").distinct(), "dst_ip", "dst")))


@query("filter_conversation", ["traffic_v"], f"""
SELECT concat('Conversation: ', src_ip, ' ↔ ', dst_ip) AS name, concat_ws(' && ', 'ip.addr == ' || src_ip, 'ip.addr == ' || dst_ip,
  CASE WHEN src_port <> 0 THEN concat(CASE WHEN proto IN ('tcp', 'udp') THEN proto ELSE 'tcp' END, '.port == ', src_port) END,
  CASE WHEN dst_port <> 0 THEN concat(CASE WHEN proto IN ('tcp', 'udp') THEN proto ELSE 'tcp' END, '.port == ', dst_port) END, proto) AS filter,
  concat('Traffic between ', src_ip, ' and ', dst_ip) AS description, {_f('conversation')}
FROM (SELECT DISTINCT src_ip, dst_ip, src_port, dst_port, lower(protocol) AS proto FROM traffic_v) t""")
def filter_conversation(spark, sf):
    rows = packets(spark, sf).select("src_ip", "dst_ip", "src_port", "dst_port", F.lower("protocol").alias("proto")).distinct()
    return D.conversation_filter(rows, "src_ip", "dst_ip", "src_port", "dst_port", "proto")


@query("filter_subnet", ["traffic_v"], f"""
SELECT 'Subnet: ' || s AS name, 'ip.dst == ' || s AS filter, 'Traffic involving subnet ' || s AS description, {_f()}
FROM (SELECT DISTINCT regexp_replace(dst_ip, '[0-9]+$', '0') || '/24' AS s FROM traffic_v) t""")
def filter_subnet(spark, sf):
    nets = packets(spark, sf).select(F.concat(F.regexp_replace("dst_ip", "[0-9]+$", "0"), F.lit("/24")).alias("subnet")).distinct()
    return D.subnet_filter(nets, direction="dst")


@query("filter_port", ["traffic_v"], f"""
SELECT concat('Port ', dst_port, '/', upper(p)) AS name, concat(p, '.dstport == ', dst_port) AS filter, concat('Traffic on port ', dst_port, '/', upper(p)) AS description, {_f()}
FROM (SELECT DISTINCT dst_port, CASE WHEN protocol = 'UDP' THEN 'udp' ELSE 'tcp' END AS p FROM traffic_v WHERE dst_port BETWEEN 1 AND 65535) t""")
def filter_port(spark, sf):
    rows = packets(spark, sf).where("dst_port IS NOT NULL").select("dst_port", "protocol").distinct()
    return D.port_filter(rows, "dst_port", "protocol", "dst")


@query("filter_port_range", ["traffic_v"], f"""
SELECT concat('Ports ', least(src_port, dst_port), '-', greatest(src_port, dst_port), '/TCP') AS name,
  concat('tcp.port >= ', least(src_port, dst_port), ' && tcp.port <= ', greatest(src_port, dst_port)) AS filter,
  concat('Traffic on ports ', least(src_port, dst_port), '-', greatest(src_port, dst_port), '/TCP') AS description, {_f()}
FROM (SELECT DISTINCT src_port, dst_port FROM traffic_v WHERE src_port IS NOT NULL) t""")
def filter_port_range(spark, sf):
    return D.port_range_filter(packets(spark, sf).select("src_port", "dst_port").distinct(), "src_port", "dst_port")


@query("filter_dns_query", ["dns_v"], f"""
SELECT 'DNS: ' || q AS name, 'dns.qry.name contains "' || q || '"' AS filter, 'DNS queries for ' || q AS description, {_f('suspicious_domain')} FROM (SELECT DISTINCT query_name AS q FROM dns_v) t
UNION ALL SELECT 'DNS: ' || q, 'dns.qry.name == "' || q || '"', 'DNS queries for ' || q, {_f('suspicious_domain')} FROM (SELECT DISTINCT query_name AS q FROM dns_v) t""")
def filter_dns_query(spark, sf):
    rows = view(spark, sf, "dns_v").select("query_name").distinct()
    return D.dns_query_filter(rows, "query_name").unionByName(D.dns_query_filter(rows, "query_name", exact=True))


@query("filter_dns_response", ["dns_v"], f"""
SELECT 'DNS Response: ' || query_name AS name, concat('dns.qry.name contains "', query_name, '" && dns.a == ', response_ip) AS filter,
  'DNS responses for ' || query_name AS description, {_f('suspicious_domain')} FROM (SELECT DISTINCT query_name, response_ip FROM dns_v) t""")
def filter_dns_response(spark, sf):
    return D.dns_response_filter(view(spark, sf, "dns_v").select("query_name", "response_ip").distinct(), "query_name", "response_ip")


@query("filter_time_range", ["traffic_v"], f"""
SELECT concat('Time: ', a, ' to ', b) AS name, concat('(ip.src == ', src_ip, ') && (frame.time >= "', a, '" && frame.time <= "', b, '")') AS filter,
  concat('Traffic between ', a, ' and ', b) AS description, {_f('time_bounded')}
FROM (SELECT src_ip, strftime(make_timestamp(CAST(floor(min(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS a,
  strftime(make_timestamp(CAST(floor(max(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS b FROM traffic_v GROUP BY src_ip) t""")
def filter_time_range(spark, sf):
    spans = packets(spark, sf).groupBy("src_ip").agg(
        F.timestamp_seconds(F.floor(F.min("ts"))).alias("start"), F.timestamp_seconds(F.floor(F.max("ts"))).alias("end"))
    return D.time_range_filter(spans.withColumn("extra", F.concat(F.lit("ip.src == "), "src_ip")), additional="extra")


@query("filter_protocol", ["traffic_v"], f"""
SELECT 'Protocol: ' || upper(p) AS name, {S.case_of('lower(p)', K.PROTOCOL_FILTER_WORDS, 'lower(p)')} AS filter, concat('All ', upper(p), ' traffic') AS description, {_f('protocol', 'info', 1.0)}
FROM (SELECT DISTINCT protocol AS p FROM traffic_v UNION SELECT DISTINCT {S.app_protocol()} FROM traffic_v) t""")
def filter_protocol(spark, sf):
    pairs = packets(spark, sf).select("protocol", "app_protocol").distinct()
    return D.protocol_filter(pairs.select(F.explode(F.array("protocol", "app_protocol")).alias("protocol")).distinct())


@query("filter_beacon", ["beacon_flows_v"], f"""
SELECT concat('Beacon: ', src_ip, ' → ', dst_ip, ':', dst_port) AS name, concat('ip.src == ', src_ip, ' && ip.dst == ', dst_ip, ' && tcp.dstport == ', dst_port) AS filter,
  concat('Regular call-backs (interval: ~', printf('%.1f', 60.0 + n % 7), 's)') AS description, {_f('beacon', 'high', 0.7)}
FROM (SELECT src_ip, dst_ip, dst_port, count(*) AS n FROM beacon_flows_v GROUP BY ALL) t""")
def filter_beacon(spark, sf):
    rows = view(spark, sf, "beacon_flows_v").groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(
        (F.count(F.lit(1)) % 7 + F.lit(60.0)).alias("interval"))
    return D.beacon_filter(rows, dst_port="dst_port", protocol="protocol", interval="interval")


@query("filter_dns_tunnel", ["dns_v"], f"""
SELECT 'DNS Tunnel: ' || p AS name, 'dns.qry.name contains "' || p || '"' AS filter, 'Data carried in names below ' || p AS description, {_f('dns_tunnel', 'high', 0.7)}
FROM (SELECT DISTINCT {S.registered_parent('query_name')} AS p FROM dns_v) t WHERE p <> ''""")
def filter_dns_tunnel(spark, sf):
    return D.dns_tunnel_filter(view(spark, sf, "dns_v").select(names.registered_parent("query_name").alias("domain")).distinct())


@query("filter_exfiltration", ["traffic_v"], f"""
SELECT concat('Exfiltration: ', src_ip, ' → ', dst_ip) AS name, concat('ip.src == ', src_ip, ' && ip.dst == ', dst_ip, ' && tcp.len > ', b) AS filter,
  'Large transfer out to ' || dst_ip AS description, {_f('exfiltration', 'high', 0.6)}
FROM (SELECT src_ip, dst_ip, max(length) AS b FROM traffic_v GROUP BY ALL) t""")
def filter_exfiltration(spark, sf):
    rows = packets(spark, sf).groupBy("src_ip", "dst_ip").agg(F.max("length").alias("min_bytes"))
    return D.exfiltration_filter(rows, min_bytes="min_bytes")


@query("filter_port_scan", ["traffic_v"], f"""
SELECT concat('Port Scan: ', src_ip, ' → ', dst_ip) AS name, concat('ip.src == ', src_ip, ' && ip.dst == ', dst_ip, ' && tcp.flags.syn == 1 && tcp.flags.ack == 0') AS filter,
  'Connection attempts by ' || src_ip AS description, {_f('port_scan', 'medium', 0.8)} FROM {_PAIRS}""")
def filter_port_scan(spark, sf):
    return D.port_scan_filter(_pairs(spark, sf), "src_ip", "dst_ip")


@query("filter_malicious_ip", ["intel_v"], f"""
SELECT concat('Malicious: ', indicator, CASE WHEN pulse_count > 2 THEN ' (C2)' ELSE '' END) AS name, 'ip.addr == ' || indicator AS filter,
  concat('Packets of the reported address ', indicator, ' [via OTX]') AS description, {_f('malicious_ip', 'critical', 0.9)} FROM intel_v""")
def filter_malicious_ip(spark, sf):
    rows = view(spark, sf, "intel_v").select(F.col("indicator").alias("ip"), F.when(F.col("pulse_count") > 2, "C2").alias("kind"), F.lit("OTX").alias("src"))
    return D.malicious_ip_filter(rows, threat_type="kind", source="src")


@query("filter_combined", ["traffic_v"], f"""
SELECT 'Either end' AS name, CASE WHEN src_ip < dst_ip THEN concat('(ip.addr == ', src_ip, ') || (ip.addr == ', dst_ip, ')') ELSE 'ip.addr == ' || dst_ip END AS filter, src_ip AS description, {_f()} FROM {_PAIRS}""")
def filter_combined(spark, sf):
    a, b = (F.concat(F.lit("ip.addr == "), c) for c in ("src_ip", "dst_ip"))
    texts = F.when(F.col("src_ip") < F.col("dst_ip"), F.array(a, b)).otherwise(F.array(b))
    rows = _pairs(spark, sf).select(texts.alias("texts"), F.lit("Either end").alias("name"), F.col("src_ip").alias("description"))
    return D.combined_filter(rows)


@query("filter_raw", ["tls_v"], f"""
SELECT sni AS name, 'tls.handshake.extensions_server_name == "' || sni || '"' AS filter, version AS description, {_f()}
FROM (SELECT DISTINCT sni, version FROM tls_v WHERE sni <> '') t""")
def filter_raw(spark, sf):
    rows = view(spark, sf, "tls_v").where("sni <> ''").select(
        F.col("sni").alias("name"), F.concat(F.lit('tls.handshake.extensions_server_name == "'), "sni", F.lit('"')).alias("filter"),
        F.col("version").alias("description")).distinct()
    return D.raw_filter(rows)


@query("filters_deduplicated", ["traffic_v"], f"""
SELECT 'a' AS name, 'ip.addr == ' || ip AS filter, min(x) AS description, {_f()} FROM (SELECT src_ip AS ip, dst_ip AS x FROM traffic_v) t GROUP BY ip""")
def filters_deduplicated(spark, sf):
    rows = D.ip_filter(_pairs(spark, sf), "src_ip", meta={"name": F.lit("a"), "description": F.col("dst_ip")})
    return D.deduplicate(rows, [F.col("description")])


def _vt_confidence(selected="slow_selected", abuse="abuse_wanted"):
    return (f"greatest(0.5, CASE WHEN {selected} AND malicious_count > 5 THEN 0.8 WHEN {selected} AND malicious_count > 0 THEN 0.6 END,"
            f" CASE WHEN {abuse} AND abuse_score > 50 THEN abuse_score / 100.0 END, CASE WHEN pulse_count > 5 THEN 0.7 END)::DOUBLE")


@query("display_filters_intel", ["intel_v"], f"""
SELECT concat('Malicious: ', indicator, CASE WHEN kind <> '' THEN ' (' || kind || ')' ELSE '' END) AS name, 'ip.addr == ' || indicator AS filter,
  concat('Packets of the reported address ', indicator, CASE WHEN src <> '' THEN ' [via ' || src || ']' ELSE '' END) AS description,
  'malicious_ip' AS category, 'critical' AS severity, round({_vt_confidence()}, 6) AS confidence, CAST(NULL AS VARCHAR) AS related_finding_id
FROM (SELECT *, array_to_string((CASE WHEN abuse_wanted AND abuse_score > 50 AND s_suppkey % 3 = 0 THEN ['Port Scan', 'Brute-Force', 'Category-99'] ELSE [] END || CASE WHEN pulse_count > 0 AND has_malware_tag THEN ['apt-tool', 'botnet'] ELSE [] END)[1:2], ', ') AS kind,
  concat_ws(', ', CASE WHEN slow_selected AND malicious_count > 0 THEN 'VirusTotal' END, CASE WHEN abuse_wanted AND abuse_score > 50 THEN 'AbuseIPDB' END, CASE WHEN pulse_count > 0 THEN 'OTX' END) AS src
  FROM cascl WHERE level IN ('malicious', 'suspicious')) t""", INTEL_CTE)
def display_filters_intel(spark, sf):
    return D.filters_from_enrichment(_cascade(spark, sf)).withColumn("confidence", F.round("confidence", 6))


# ---- report texts --------------------------------------------------------------------------

_QUADS = r"regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')"
_PUBLIC = ("list_filter(list_distinct(" + _QUADS + "), lambda x: CAST(split_part(x, '.', 1) AS INT) <= 255 AND CAST(split_part(x, '.', 2) AS INT) <= 255 AND CAST(split_part(x, '.', 3) AS INT) <= 255"
           " AND CAST(split_part(x, '.', 4) AS INT) <= 255 AND CAST(split_part(x, '.', 1) AS INT) NOT IN (10, 127) AND NOT (CAST(split_part(x, '.', 1) AS INT) = 192 AND CAST(split_part(x, '.', 2) AS INT) = 168)"
           " AND NOT (CAST(split_part(x, '.', 1) AS INT) = 172 AND CAST(split_part(x, '.', 2) AS INT) BETWEEN 16 AND 31))")


@query("text_ips", [], f"""
SELECT 'doc' AS kind, doc_id AS id, 0::BIGINT AS turn, unnest(list_sort({_PUBLIC})) AS ip FROM documents
UNION ALL SELECT 'conv', conv_id, turn, unnest(list_sort({_PUBLIC})) FROM conversations""")
def text_ips(spark, sf):
    docs = view(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    conv = view(spark, sf, "conversations").select(F.lit("conv").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return textops.report_ips(docs.unionByName(conv), ["kind", "id", "turn"])


# Reports written around whole document texts, so that every section occurs.
_REPORTS = """SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('# Report', chr(10), '## ', CASE WHEN doc_id % 2 = 0 THEN 'Executive Summary' ELSE 'EXECUTIVE SUMMARY' END, chr(10), chr(10)) END,
  text, chr(10), chr(10), '## Assessment', chr(10), CASE doc_id % 4 WHEN 0 THEN '**Overall Threat Level**: ' WHEN 1 THEN 'Overall Threat Level: ' WHEN 2 THEN 'Threat level: ' ELSE 'Level ' END,
  CASE doc_id % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'LOW' WHEN 4 THEN 'minimal' ELSE 'none' END, chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('### Wireshark', chr(10), 'ip.addr == 45.33.0.', doc_id % 256, chr(10), '`TCP.port == 443` and dns.qry.name contains "x', doc_id % 7, '"', chr(10)) ELSE 'ip.src == 10.0.0.1' END) AS text FROM {documents}"""


def _reports(spark, sf):
    return spark.sql(_REPORTS, documents=view(spark, sf, "documents"))


_REPORTS_CTE = f"reports AS ({_plain(_REPORTS)})"
_STATED = " ".join(
    "WHEN " + " OR ".join(f"contains(upper(text), '{p}{level}')" for p in K.REPORT_THREAT_PREFIXES) + f" THEN '{level.lower()}'"
    for level in K.REPORT_THREAT_LEVELS)


@query("text_threat_level", [], f"""
SELECT doc_id, CASE {_STATED} ELSE 'unknown' END AS threat_level FROM reports""", _REPORTS_CTE)
def text_threat_level(spark, sf):
    return _reports(spark, sf).select("doc_id", textops.report_threat_level("text").alias("threat_level"))


@query("text_summary", [], r"""
SELECT doc_id, CASE WHEN s > 0 THEN regexp_replace(regexp_replace(regexp_replace(substr(text, s, e - s), '^\s+|\s+$', '', 'g'), '^[^\n]*\n?', ''), '^\s+|\s+$', '', 'g') END AS executive_summary
FROM (SELECT doc_id, text, s, coalesce(list_min(list_filter([CASE WHEN instr(rest, m) > 1 THEN s + 19 + instr(rest, m) END FOR m IN ['## ', '### ', '# ']], lambda x: x IS NOT NULL)), length(text) + 1) AS e
  FROM (SELECT doc_id, text, instr(upper(text), 'EXECUTIVE SUMMARY') AS s, substr(text, instr(upper(text), 'EXECUTIVE SUMMARY') + 20) AS rest FROM reports) a) b""", _REPORTS_CTE)
def text_summary(spark, sf):
    return _reports(spark, sf).select("doc_id", textops.executive_summary("text").alias("executive_summary"))


_FIELDS_RE = "(?:" + "|".join(f.replace(".", "[.]") for f in K.REPORT_FILTER_FIELDS) + ")[^`\\n]*"


@query("text_filters", [], f"""
SELECT doc_id, unnest(list_sort(list_distinct(regexp_extract_all(text, '{_FIELDS_RE}', 0, 'i')))) AS filter
FROM reports WHERE contains(upper(text), 'WIRESHARK')""", _REPORTS_CTE)
def text_filters(spark, sf):
    return _reports(spark, sf).select("doc_id", F.explode(textops.quoted_filters("text")).alias("filter"))
