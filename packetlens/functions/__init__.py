"""Column builders. None of them uses a Python UDF."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict) -> Column:
    """A constant map column from a Python dict."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def rank_of(c: Column | str, ranks: dict, default: int = 99) -> Column:
    """Sort rank of an enumerated text column; unknown values sort last."""
    return F.coalesce(F.try_element_at(literal_map(ranks), as_col(c)), F.lit(default))


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` computed once, however often the body (or a pushed-down filter) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_place(condition: Column) -> Column:
    """An expensive condition that must run where it is written, after a distinct or an aggregation.

    Catalyst moves plain filters below the aggregation, where they would run on every row
    instead of every distinct value. It does not move a condition that reads the partition id.
    """
    return F.when(F.spark_partition_id() >= 0, condition)
