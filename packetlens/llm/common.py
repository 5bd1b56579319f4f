"""Helpers of the training-data operators: stored tables, ASCII words, connected components."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.session import ensure_checkpoint_dir

#: The white space of word and line rules.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of an Arrow batch that become Python objects at one time.
SLICE_ROWS = 512


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8. ``bytes.split`` knows exactly these six blanks; ``str.split`` more."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batches, rows: int = SLICE_ROWS):
    """Cut Arrow batches so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def to_batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def ascii_lower(c):
    """A-Z lower-cased, all else kept. Plain ``lower`` would also fold other letters, so it serves ASCII text only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Alternating large and small stars: each round ties neighbours to the smallest node seen, so chains
    shorten by a factor per round, and the links never outnumber those given. Hubs are aggregates and
    equi-joins, which the session's skew handling splits. Every round is stored; only a count and a
    checksum reach the driver. Null ends and loops are ignored.
    """
    a, b = F.col("a"), F.col("b")
    pairs = links.filter(a != b).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    pairs = stored(pairs, "links")
    seen = _checksum(pairs)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")
        )
        pairs = stored(small.filter("lo <> hi").distinct(), "links")
        now = _checksum(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)


def _checksum(pairs: DataFrame) -> tuple[int, int]:
    r = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])
