"""Human-readable sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlens.functions import as_col


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def format_bytes(size: Column | str, style: str = "binary") -> Column:
    """Size with a unit.

    * ``binary``       one decimal, base 1024, up to TB
    * ``binary_large`` one decimal, base 1024, up to PB
    * ``report``       whole bytes, one decimal for KB and MB, two for GB, base 1024
    * ``decimal``      whole bytes, two decimals, base 1000, up to GB
    """
    size = as_col(size)
    if style in ("binary", "binary_large"):
        units = ["B", "KB", "MB", "GB", "TB"] + (["PB"] if style == "binary_large" else [])
        result = None
        for power, unit in enumerate(units):
            text = F.concat(_fixed(size.cast("double") / float(1024**power), 1), F.lit(f" {unit}"))
            limit = size < 1024 ** (power + 1)
            if power == len(units) - 1:
                return result.otherwise(text)
            result = F.when(limit, text) if result is None else result.when(limit, text)
    if style == "report":
        value = size.cast("double")
        return (
            F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1024**2, F.concat(_fixed(value / 1024.0, 1), F.lit(" KB")))
            .when(size < 1024**3, F.concat(_fixed(value / float(1024**2), 1), F.lit(" MB")))
            .otherwise(F.concat(_fixed(value / float(1024**3), 2), F.lit(" GB")))
        )
    if style == "decimal":
        def scaled(divisor, unit):
            exact = F.bround(size.cast("decimal(20,0)") / F.lit(divisor).cast("decimal(10,0)"), 2)
            return F.concat(exact.cast("decimal(20,2)").cast("string"), F.lit(f" {unit}"))

        return (
            F.when(size >= 1_000_000_000, scaled(1_000_000_000, "GB"))
            .when(size >= 1_000_000, scaled(1_000_000, "MB"))
            .when(size >= 1_000, scaled(1_000, "KB"))
            .otherwise(F.concat(size.cast("string"), F.lit(" bytes")))
        )
    raise ValueError(f"unknown size style: {style}")


def format_duration(seconds: Column | str) -> Column:
    """``1.5s``, ``2m 3s`` or ``1h 2m``."""
    seconds = as_col(seconds)
    whole = F.floor(seconds).cast("bigint")

    def parts(a, a_unit, b, b_unit):
        return F.concat(a.cast("string"), F.lit(a_unit + " "), b.cast("string"), F.lit(b_unit))

    return (
        F.when(seconds < 60, F.concat(_fixed(seconds, 1), F.lit("s")))
        .when(seconds < 3600, parts(F.floor(whole / 60), "m", whole % 60, "s"))
        .otherwise(parts(F.floor(whole / 3600), "h", F.floor((whole % 3600) / 60), "m"))
    )


def iso_time(epoch: Column | str) -> Column:
    """Epoch seconds as ISO text in UTC, whatever the session's time zone."""
    text = utc_text(F.timestamp_seconds(as_col(epoch)))
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))


def utc_text(instant: Column) -> Column:
    """A TIMESTAMP as ``yyyy-MM-dd HH:mm:ss`` in UTC. Zone-less times add no offset, so the session's zone has no say."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.substring(F.timestamp_add("SECOND", F.floor(F.unix_micros(instant) / 1_000_000), start).cast("string"), 1, 19)
