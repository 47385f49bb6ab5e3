"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_kept: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder named in spark.checkpoint.dir, deleted when the application ends.

    A session on a single machine that names none (tests) gets a temporary folder; a cluster raises, since its
    executors share no folder of the driver.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loomgraph')}"
        spark.conf.set(CHECKPOINT_KEY, root)
    folder = f"{root.rstrip('/')}/loomgraph-tables-{spark.sparkContext.applicationId}"
    if folder not in _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _kept.add(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once, written as Parquet to the shared folder and read back, so that later plans prune its columns."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
