"""Intermediate tables in the folder that driver and executors share, and names for columns of their own."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


_cleared: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder named in spark.checkpoint.dir, deleted when the application ends.

    Where a session names none, a single-machine one (tests) gets a temporary folder; a cluster raises, since its
    executors share no folder of the driver.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loomgraph')}"
        spark.conf.set(CHECKPOINT_KEY, root)
    folder = f"{root.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"
    if folder not in _cleared:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _cleared.add(folder)
    return folder


def fresh(taken: Iterable[str], name: str) -> str:
    """`name`, with underscores before it until no column of `taken` is called so in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def staged(df: DataFrame, label: str, codec: str = "zstd", folder: str | None = None) -> DataFrame:
    """Write df once as Parquet, to `folder` or a part of the shared one, and read it back.

    The result has no lineage beyond those files, so a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = folder or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
