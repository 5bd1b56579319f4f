"""Domain names: parents, entropy, allow-lists and look-alikes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlens import constants as K
from packetlens.functions import as_col, let


def _trimmed(name: Column) -> Column:
    return F.rtrim(name, F.lit("."))


def _last_labels(name: Column, n: int) -> Column:
    return F.substring_index(name, ".", -n)


def parent_domain(name: Column | str) -> Column:
    """Last two labels as written; a single-label name is its own parent."""
    name = as_col(name)
    return F.when(_trimmed(name).contains("."), _last_labels(_trimmed(name), 2)).otherwise(name)


def subdomain(name: Column | str) -> Column:
    """Everything before the last two labels, or the empty string."""
    trimmed = _trimmed(as_col(name))
    return F.substr(
        trimmed, F.lit(1), F.greatest(F.length(trimmed) - F.length(_last_labels(trimmed, 2)) - 1, F.lit(0))
    )


def registered_parent(name: Column | str) -> Column:
    """Lower-case parent; keeps three labels after a generic second level such as ``co``. NULL without a dot."""
    trimmed = _trimmed(F.lower(as_col(name)))
    second_level = F.substring_index(_last_labels(trimmed, 2), ".", 1)
    return F.when(
        trimmed.contains("."),
        F.when(second_level.isin(K.SECOND_LEVEL_LABELS), _last_labels(trimmed, 3)).otherwise(_last_labels(trimmed, 2)),
    )


def subdomain_under(name: Column | str, parent: Column | str) -> Column:
    """Lower-case text before ``.parent``, or NULL."""
    full, parent = _trimmed(F.lower(as_col(name))), F.lower(as_col(parent))
    head = F.substr(full, F.lit(1), F.greatest(F.length(full) - F.length(parent) - 1, F.lit(0)))
    return F.when(full.endswith(parent), F.nullif(head, F.lit("")))


def entropy(text: Column | str) -> Column:
    """Shannon entropy in bits over the lower-cased characters, to nine decimals.

    A higher-order expression over the distinct characters: apply it to distinct names.
    """
    def bits(t):
        n = F.length(t)

        def share(c):
            return (n - F.length(F.replace(t, c, F.lit("")))) / n

        shares = F.transform(F.array_distinct(F.split(t, "")), share)
        return F.round(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), 9)

    text = F.lower(as_col(text))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(let(text, bits))


def has_suspicious_tld(name: Column | str, extended: bool = False) -> Column:
    """Ends in one of the often-abused top-level domains."""
    tlds = K.SUSPICIOUS_TLDS_EXTENDED if extended else K.SUSPICIOUS_TLDS
    return F.lower(as_col(name)).rlike(r"\.(" + "|".join(tlds) + r")$")


def clean_domain(name: Column | str) -> Column:
    """Lower case, without leading and trailing dots."""
    return F.trim(F.lower(as_col(name)), F.lit("."))


def suffix_sizes(name: Column | str) -> Column:
    """Numbers of labels, from all down to two, that a clean name's suffixes have; NULL if it has one label."""
    name = as_col(name)
    n = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1
    return F.when(n >= 2, F.sequence(n, F.lit(2), F.lit(-1)))


def last_labels(name: Column, n: Column) -> Column:
    """The last ``n`` labels, where ``n`` is a column."""
    return F.call_function("substring_index", name, F.lit("."), -n)


def domain_suffixes(name: Column | str) -> Column:
    """The name and each parent that still has two labels, longest first."""

    def of(clean):
        sizes = F.coalesce(suffix_sizes(clean), F.array().cast("array<int>"))
        return F.transform(sizes, lambda n: last_labels(clean, n))

    return let(clean_domain(name), of)


def listed_suffix(name: Column | str, listed: list[str]) -> Column:
    """The longest suffix of the name found in a short constant list, else NULL."""
    hits = F.filter(domain_suffixes(name), lambda s: s.isin(listed))
    return F.get(hits, F.lit(0))


def _ends_with_any(name: Column, suffixes: list[str]) -> Column:
    # One pattern, so that a long name expression is evaluated once and not per suffix.
    return name.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def is_local_name(name: Column | str, suffixes: list[str]) -> Column:
    """Ends in one of the given local suffixes."""
    return _ends_with_any(clean_domain(name), suffixes)


def is_safe_domain(name: Column | str) -> Column:
    """Empty, local, reverse look-up or under a major provider."""
    clean = clean_domain(name)
    return (
        (clean == "")
        | _ends_with_any(clean, K.LOCAL_SUFFIXES_CASCADE + K.REVERSE_SUFFIXES)
        | listed_suffix(name, K.SAFE_DOMAINS_CASCADE).isNotNull()
    )


def has_benign_suffix(name: Column | str) -> Column:
    """Under a parent whose random-looking host names are normal."""
    # Whole labels: a name that merely ends in the same letters is not exempt.
    listed = "|".join(s.lstrip(".").replace(".", r"\.") for s in K.BENIGN_HIGH_ENTROPY_SUFFIXES)
    return as_col(name).rlike(rf"(^|\.)({listed})$")


def normalize_lookalike(name: Column | str) -> Column:
    """Replace look-alike characters, then look-alike pairs, in lower case."""
    text = F.translate(
        F.lower(as_col(name)), "".join(K.LOOKALIKE_CHARACTERS), "".join(K.LOOKALIKE_CHARACTERS.values())
    )
    for pair, single in K.LOOKALIKE_PAIRS.items():
        text = F.replace(text, F.lit(pair), F.lit(single))
    return text


def is_similar(a: Column, b: Column, max_distance: int = K.MAX_EDIT_DISTANCE) -> Column:
    """Within ``max_distance`` edits; the cheap length test runs first."""
    return (F.abs(F.length(a) - F.length(b)) <= max_distance) & (F.levenshtein(a, b, max_distance) >= 0)


def imitated_brand(name: Column | str, brands: list[str] | None = None) -> Column:
    """The brand a domain imitates, else NULL. An exact brand name imitates nothing.

    The brand list is a short constant that is searched per name, not joined; of several
    candidates the alphabetically first wins. Apply to distinct names.
    """
    brands = sorted(brands or K.BRANDS)

    def search(clean):
        main = F.try_element_at(F.split(clean, r"\."), F.lit(-2))
        parts = F.struct(
            clean.alias("clean"),
            main.alias("main"),
            normalize_lookalike(main).alias("main_normal"),
            normalize_lookalike(clean).alias("full_normal"),
        )
        return let(parts, imitated)

    def imitated(p):
        def by(brand):
            hidden = p["full_normal"].contains(brand) & ~p["clean"].contains(brand)
            return (p["main_normal"] == brand) | is_similar(p["main"], brand) | hidden

        hits = F.filter(F.array(*[F.lit(b) for b in brands]), by)
        return F.when(p["main"].isNotNull() & ~p["main"].isin(brands), F.get(hits, F.lit(0)))

    return let(clean_domain(name), search)


def tunnel_tools(name: Column | str) -> Column:
    """Known tunnel tools whose name is an inner label of the query."""
    lower = F.lower(as_col(name))
    hits = [F.when(lower.contains(f".{tool}."), F.lit(tool)) for tool in K.TUNNEL_TOOLS]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def hosting_service(sni: Column | str) -> Column:
    """The longest listed cloud or paste domain that is the server name or a parent of it, else NULL."""
    sni = F.lower(as_col(sni))
    listed = sorted(K.CLOUD_STORAGE_DOMAINS + K.PASTE_DOMAINS, key=lambda d: (-len(d), d))
    return F.coalesce(*[F.when((sni == d) | sni.endswith(f".{d}"), F.lit(d)) for d in listed])


def is_valid_domain(name: Column | str) -> Column:
    """Dot-separated labels of letters, digits and inner hyphens, at most 253 characters."""
    label = r"[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    name = as_col(name)
    return F.coalesce((F.length(name) <= 253) & name.rlike(rf"^{label}(\.{label})*$"), F.lit(False))
