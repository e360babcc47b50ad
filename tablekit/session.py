"""Session settings, the shared folder, and the one place where lineage is cut."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tablekit

# Settings every job here relies on. They are runtime settings, so they can be
# put on a session the cluster has already started.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even when the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # Functions of this package travel to the Python workers inside the task,
    # so workers need neither the package nor a common working folder.
    cloudpickle.register_pickle_by_value(tablekit)
    return spark


def local_session(cores: str | int = "*", name: str = "tablekit") -> SparkSession:
    """Single-machine session for tests and the bench."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    On a cluster a warehouse on the driver's own disk is none that executors see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = spark.sparkContext.master.startswith("local")
    if not local and _located(spark, warehouse)[1].getScheme() == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_tablekit"


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder; it goes when the session's JVM ends, or by ``remove``."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path, fs = _located(spark, folder)
    fs.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``new_folder`` gave, once nothing reads it any more."""
    path, fs = _located(spark, folder)
    fs.delete(path, True)


def _located(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where two passes must see the same rows in the same partitions, or
    where an iterative job would grow its plan without end.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
