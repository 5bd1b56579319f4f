"""Result tables written out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from packetlens.operators.filters import filter_file_lines


def write_results(tables: dict[str, DataFrame], path: str, file_format: str = "parquet", mode: str = "error") -> None:
    """One data set per table below ``path``, split by capture where there is such a column."""
    for name, df in tables.items():
        writer = df.write.mode(mode).format(file_format)
        if "capture" in df.columns:
            writer = writer.partitionBy("capture")
        writer.save(f"{path}/{name}")


def write_filter_list(filters: DataFrame, path: str) -> None:
    """Filters as JSON lines."""
    filters.write.json(path)


def write_filter_file(filters: DataFrame, path: str) -> None:
    """Filters in the text form a packet viewer's filter file uses."""
    filter_file_lines(filters).write.text(path)
