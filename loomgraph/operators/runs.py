"""Runs that parse only what changed: a manifest of the files of the last run, compared before any text is read."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.files import parse_files

# Paths named in one read; more changed files are read in several.
PATHS_A_READ = 10_000
KEY = ["path", "length", "modified"]


def manifest(spark: SparkSession, *roots: str, pattern: str = "*.{kt,java,kts}") -> DataFrame:
    """(path, length, modified) of the files under the roots; contents are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(roots))
    return read.select("path", "length", F.col("modificationTime").alias("modified")).filter("not path rlike '/(build|[.]gradle)/'").dropDuplicates(["path"])


def _latest(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    runs = [int(s.getPath().getName()[4:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("run-")]
    done = [n for n in runs if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run-{n}/manifest/_SUCCESS"))]
    return max(done, default=0)


def refresh(spark: SparkSession, folder: str, *roots: str, pattern: str = "*.{kt,java,kts}") -> tuple[DataFrame, dict[str, int]]:
    """Parsed files under the roots, and how many were changed (or new) and removed since the last run into `folder`.

    Only changed files are read; rows of removed and changed files are retired and all others taken over. Without a
    change the last run's table is returned and nothing is written. A run counts once its manifest is complete, so one
    that was cut off is made anew.
    """
    last = _latest(spark, folder)
    now = manifest(spark, *roots, pattern=pattern)
    if last:
        known = spark.read.parquet(f"{folder}/run-{last}/manifest")
        changed, removed = now.join(known, KEY, "left_anti"), known.join(now, "path", "left_anti").count()
    else:
        changed, removed = now, 0
    counts = {"changed": changed.count(), "removed": removed}
    if last and not any(counts.values()):
        return spark.read.parquet(f"{folder}/run-{last}/parsed"), counts
    out = f"{folder}/run-{last + 1}"
    paths = (r["path"] for r in changed.select("path").toLocalIterator())
    mode = "overwrite"
    while part := list(islice(paths, PATHS_A_READ)):
        text = spark.read.text(part, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        parse_files(text.withColumn("ext", F.substring_index("path", ".", -1))).write.mode(mode).parquet(f"{out}/parsed")
        mode = "append"
    if last:
        kept = now.join(known, KEY, "left_semi").select("path")
        spark.read.parquet(f"{folder}/run-{last}/parsed").join(kept, "path", "left_semi").write.mode(mode).parquet(f"{out}/parsed")
    now.write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/parsed"), counts
