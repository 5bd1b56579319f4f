"""Small pieces of comparison SQL shared by the query catalogue."""

from __future__ import annotations

from packetlens import constants as K


def case_of(column: str, values: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {k} THEN '{v}'" for k, v in values.items())
    return f"(CASE {column} {arms} ELSE {default} END)"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def app_protocol(src="src_port", dst="dst_port") -> str:
    return f"coalesce({case_of(dst, K.PORT_APP_PROTOCOL)}, {case_of(src, K.PORT_APP_PROTOCOL)}, 'UNKNOWN')"


def _octet(c: str, i: int) -> str:
    return f"TRY_CAST(split_part({c}, '.', {i}) AS INTEGER)"


def private_api(c: str) -> str:
    quad = f"regexp_full_match({c}, '[0-9]+([.][0-9]+){{3}}')"
    return (
        f"coalesce({quad} AND ({_octet(c, 1)} IN (10, 127) OR ({_octet(c, 1)} = 172 AND {_octet(c, 2)} BETWEEN 16 AND 31)"
        f" OR ({_octet(c, 1)} = 192 AND {_octet(c, 2)} = 168)), false)"
    )


def private_core(c: str) -> str:
    link_local = f"({_octet(c, 1)} = 169 AND {_octet(c, 2)} = 254)"
    return f"coalesce({c} = '::1' OR {private_api(c)} OR {link_local}, false)"


def private_detector(c: str) -> str:
    return (
        f"coalesce(starts_with({c}, '10.') OR starts_with({c}, '127.') OR starts_with({c}, '192.168.')"
        f" OR (starts_with({c}, '172.') AND {_octet(c, 2)} BETWEEN 16 AND 31), false)"
    )


def ip_number(c: str) -> str:
    return (
        f"({_octet(c, 1)}::BIGINT * 16777216 + {_octet(c, 2)} * 65536 + {_octet(c, 3)} * 256 + {_octet(c, 4)})"
    )


def _bounds(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    a, b, c, d = (int(x) for x in base.split("."))
    low = ((a * 256 + b) * 256 + c) * 256 + d
    return low, low + 2 ** (32 - int(bits)) - 1


def in_network(c: str, cidr: str) -> str:
    low, high = _bounds(cidr)
    return f"{ip_number(c)} BETWEEN {low} AND {high}"


def in_networks(c: str, cidrs) -> str:
    return "(" + " OR ".join(in_network(c, x) for x in cidrs) + ")"


def private_registry(c: str) -> str:
    return f"({in_networks(c, K.REGISTRY_PRIVATE_V4)} AND NOT {in_networks(c, K.REGISTRY_PUBLIC_EXCEPTIONS_V4)})"


def entropy(text: str) -> str:
    return f"(CASE WHEN {text} = '' THEN 0.0 ELSE round(list_aggregate(string_split(lower({text}), ''), 'entropy'), 9) END)"


def simple_parent(c: str) -> str:
    labels = f"string_split(rtrim({c}, '.'), '.')"
    return f"(CASE WHEN len({labels}) >= 2 THEN array_to_string({labels}[-2:], '.') ELSE {c} END)"


def simple_subdomain(c: str) -> str:
    labels = f"string_split(rtrim({c}, '.'), '.')"
    return f"(CASE WHEN len({labels}) > 2 THEN array_to_string({labels}[:-3], '.') ELSE '' END)"


def registered_parent(c: str) -> str:
    labels = f"string_split(rtrim(lower({c}), '.'), '.')"
    return (
        f"(CASE WHEN len({labels}) < 2 THEN NULL WHEN len({labels}) >= 3 AND {labels}[-2] IN {in_list(K.SECOND_LEVEL_LABELS)}"
        f" THEN array_to_string({labels}[-3:], '.') ELSE array_to_string({labels}[-2:], '.') END)"
    )


def subdomain_under(c: str, parent: str) -> str:
    full = f"rtrim(lower({c}), '.')"
    return f"nullif(substr({full}, 1, greatest(length({full}) - length({parent}) - 1, 0)), '')"


def format_binary(size: str) -> str:
    arms, last = [], 4
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        text = f"printf('%.1f', CAST({size} AS DOUBLE) / {1024**power}.0) || ' {unit}'"
        arms.append(f"WHEN {size} < {1024 ** (power + 1)} THEN {text}" if power < last else f"ELSE {text}")
    return "(CASE " + " ".join(arms) + " END)"
