"""Incremental extraction: changed files are parsed as they arrive and supersede what was known of them.

A file stream reads each path once, so changes arrive as drops: root/<drop>/<path of the file>.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.windows import last_per_key
from loomgraph.sources.files import parse_files


def file_stream(spark: SparkSession, root: str, pattern: str = "*.{kt,java,kts}") -> DataFrame:
    """A stream of files(path, ext, modified, text) under root; path is the file's place behind its drop."""
    read = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("_metadata.file_path", f"^.*?/{re.escape(os.path.basename(root.rstrip('/')))}/[^/]+/", "")
    return read.select(path.alias("path"), F.substring_index(path, ".", -1).alias("ext"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def keep_parsed(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append every parsed file to a Parquet table; a batch that is run again overwrites its own part of it."""

    def add(batch: DataFrame, number: int) -> None:
        seen = batch.select("path", "modified")
        parse_files(batch).join(seen, "path").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest version of each file."""
    return last_per_key(spark.read.parquet(table), ["path"], "modified", "batch").drop("batch")
