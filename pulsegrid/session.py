"""Session defaults for tests and the bench; a cluster brings its own."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@lru_cache(maxsize=1)
def local_folder() -> str:
    """A folder of this machine for sessions that run on it alone; removed at the end of the process."""
    path = tempfile.mkdtemp(prefix="pulsegrid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def local_session(app: str = "pulsegrid", cpus: str | int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("PULSEGRID_DRIVER_MEMORY", "12g"))
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.checkpoint.dir", local_folder())
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder below the shared one the cluster names. Only a master that is this one process may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = local_folder()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: columnar, pruned on reading, safe when executors are lost.

    Meant for results that several branches of a plan read.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
