"""From documents to packed sequences: rules, line de-duplication, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
Nulls, empty texts, repeated rows and empty tables are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm.common import stored, table
from packetlens.llm.decontam import drop_leaks
from packetlens.llm.line_dedup import drop_shared_lines
from packetlens.llm.packing import pack_documents
from packetlens.llm.rules import keep_good
from packetlens.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from every text; ``n_chars`` follows the text."""
    kept = drop_shared_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), size))
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens, fingerprints and the latent space are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
