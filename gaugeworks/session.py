"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's own state store that timers, lists and maps of keyed streams need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = "*", app: str = "gaugeworks", **conf) -> SparkSession:
    """Session for tests and single-machine runs; a cluster brings its own."""
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc_session(spark: SparkSession) -> SparkSession:
    """All operators read timestamps as UTC instants; pin the session to it.

    Naive parquet timestamps are then read as instants too, without a cast that would keep
    time filters from the scan. Skewed joins are split even where that costs a shuffle of
    the aggregated result: a join on a hot site followed by a sum per site is the rule here.
    """
    for key, value in (("spark.sql.session.timeZone", "UTC"),
                       ("spark.sql.parquet.inferTimestampNTZ.enabled", "false"),
                       ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting (tests, a laptop) gets a folder of its own; on a
    cluster a folder of one machine would lose what the others wrote, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
            folder = tempfile.mkdtemp(prefix="gaugeworks-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; gone when the session ends."""
    folder = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; survives the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to at least three tasks a core, for steps that cost much time a row: a small
    file is read by one task however long its rows take. Tables in many pieces stay as they are."""
    wanted = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
