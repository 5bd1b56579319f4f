"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # Plans here are large expressions; capturing a call site for every column call is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Streams with timers keep their state in RocksDB.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "packetlens") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder ``checkpoint()`` writes to.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session without
    one gets a temporary folder; on a cluster a missing setting is an error, because a folder
    on one machine would be lost with that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="packetlens-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_once(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read back: computed once, read by column, with known sizes."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled_once(df: DataFrame) -> DataFrame:
    """``df`` from its shuffles, which run now and stay as long as it is in use: whatever reads it begins at their files.

    Nothing is stored besides. Each reading repeats what stands above the last shuffle, and lost files are made again.
    A plan without shuffles stays as it is.
    """
    spark, run = df.sparkSession, df._jdf.queryExecution()
    if "Exchange" not in run.executedPlan().toString():
        return df
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(run.toRdd(), df._jdf.schema(), False), spark)
