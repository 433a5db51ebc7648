"""The folder all executors share, for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Path named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all tasks run in this process (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"master {sc.master}: name a folder that all executors share in spark.checkpoint.dir")
    own = getattr(sc, "_barterflow_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="barterflow-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
        sc._barterflow_shared = own
    return f"file://{own}"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has the folder removed when the driver's JVM ends; until then results may be read from it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def materialised(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Frees what finished steps of a long job left on the driver: their broadcasts and shuffles are dropped once the JVM has collected what referred to them."""
    spark._jvm.System.gc()
