"""Domain lists: one domain per line, ``#`` starts a comment line."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def bundled_legit_domains() -> list[str]:
    """The list that ships with the package (about a hundred entries)."""
    lines = (Path(__file__).parent.parent / "data" / "legit_domains.txt").read_text().splitlines()
    return [line.strip().lower() for line in lines if line.strip() and not line.strip().startswith("#")]


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """A domain list of any size as a table with one column ``domain``."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .where((line != "") & ~line.startswith("#"))
        .select(F.lower(line).alias("domain"))
        .distinct()
    )


def legit_domain_list(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A user's list, or the bundled one."""
    if path is not None:
        return read_domain_list(spark, path)
    # A relation of the plan itself, whose size is known: names that are looked up in it need not be shuffled.
    return spark.sql("SELECT explode(split(:listed, ' ')) AS domain", {"listed": " ".join(bundled_legit_domains())})
