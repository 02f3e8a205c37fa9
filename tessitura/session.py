"""Session helpers: configuration, table loading and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; sizes of partitions are left to the cluster and AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessitura")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path for one written table, in the folder the cluster names in spark.checkpoint.dir.

    Only where the setting is absent on one machine (tests) a local folder is chosen and set. On a cluster each executor would write to
    its own disk, so there its absence is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), f"tessitura-{os.getuid()}"))
        root = context.getCheckpointDir()
    folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    # The folder goes when the session's JVM ends, if its reader has not let go of it before.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/table"


def _remove(session: weakref.ref, path: str) -> None:
    spark = session()
    if spark is None:
        return
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended, and its tables with it
        pass


@contextmanager
def written_tables(spark: SparkSession):
    """Within this block the tables that operators write are noted, and removed at its end: put the use of a result inside it.

    A long session would otherwise keep them until it ends.
    """
    own: list[str] = []
    _NOTED.append(own)
    try:
        yield own
    finally:
        _NOTED.remove(own)
        for path in own:
            _remove(weakref.ref(spark), path)


_NOTED: list[list[str]] = []


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back, so that lost executors cost nothing."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    for noted in _NOTED:
        noted.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Tasks for work that is heavy for its size, which partition sizes alone would put into too few."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def at_least_parallel(df: DataFrame) -> DataFrame:
    """df as it is if it is read in as many pieces as there are cores, else spread over them, for expensive functions that follow."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
