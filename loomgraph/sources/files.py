"""Source trees as a table of files, and the tables that parsing them gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import EXCLUDED_SCOPES, SKIPPED_CALLS
from loomgraph.functions.exprs import code_lines
from loomgraph.sources.declarations import Source, dependencies

SYMBOL = "name string, qualified_name string, kind string, line int, package_name string"
REF = "target_name string, target_qualified_name string, kind string, line int, context string, qualifier string"
META = (
    "package_name string, qualified_name string, simple_name string, imports array<string>, annotations array<string>, supertypes array<string>, is_interface boolean, "
    "is_abstract boolean, is_object boolean, is_data_class boolean, language string, methods array<string>, declaration_line int"
)
PARSED = f"path string, symbols array<struct<{SYMBOL.replace(' string', ':string').replace(' int', ':int')}>>, refs array<struct<{REF.replace(' string', ':string').replace(' int', ':int')}>>, parse_error string"


def scan_files(spark: SparkSession, *roots: str, pattern: str = "*.{kt,java,kts}") -> DataFrame:
    """files(path, name, ext, source_set, text) under the roots, each path once, outside build output."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(list(roots), wholetext=True)
    df = read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter("not path rlike '/(build|[.]gradle)/'")
    name = F.substring_index("path", "/", -1)
    return df.dropDuplicates(["path"]).select("path", name.alias("name"), F.substring_index(name, ".", -1).alias("ext"), F.regexp_extract("path", r"/src/([^/]+)/", 1).alias("source_set"), "text")


def source_sets(files: DataFrame) -> DataFrame:
    """Source sets that hold a file, the usual ones first."""
    usual = ["main", "test", "androidTest", "commonMain", "commonTest"]
    rank = F.coalesce(*[F.when(F.col("source_set") == s, F.lit(i)) for i, s in enumerate(usual)], F.lit(len(usual)))
    return files.filter("source_set <> ''").select("source_set").distinct().withColumn("rank", rank).orderBy("rank", "source_set").drop("rank")


def build_file_names(files: DataFrame, key: str) -> DataFrame:
    """The build script of each `key`: Kotlin before Groovy, else "none"."""
    has = lambda n: F.max(F.col("name") == n)
    return files.groupBy(key).agg(F.when(has("build.gradle.kts"), "build.gradle.kts").when(has("build.gradle"), "build.gradle").otherwise("none").alias("build_file"))


def projects_of_module(projects: DataFrame, module: str | None) -> DataFrame:
    """projects(name, path), of one module if named by name, path or path without its colon."""
    if module is None:
        return projects.orderBy("path")
    return projects.filter((F.col("name") == module) | (F.col("path") == module) | (F.col("path") == f":{module}")).orderBy("path")


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, ext, text) with arrays of symbols and refs; a file that cannot be parsed has only parse_error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, ext, text in b[["path", "ext", "text"]].itertuples(index=False):
                try:
                    s = Source(text or "", ext != "java")
                    rows.append((path, s.symbols(), s.references(), None))
                except (IndexError, KeyError, RecursionError, ValueError) as e:
                    rows.append((path, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "symbols", "refs", "parse_error"])

    return files.filter(F.col("ext").isin("kt", "java", "kts")).select("path", "ext", "text").mapInPandas(run, PARSED)


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("symbols").alias("ord", "s")).select("path", "ord", "s.*")


def refs_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("refs").alias("ord", "r")).select("path", "ord", "r.*")


def metadata_of(files: DataFrame) -> DataFrame:
    """One component a Kotlin or Java file (not scripts), with its code lines counted in the JVM.

    A file that cannot be parsed gives a row with its path and parse_error only.
    """
    names = [f.split(" ")[0] for f in META.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, ext, text, n in b[["path", "ext", "text", "line_count"]].itertuples(index=False):
                try:
                    rows.append((path, *Source(text or "", ext == "kt").metadata(path.rpartition("/")[2]), n, None))
                except (IndexError, KeyError, RecursionError, ValueError) as e:
                    rows.append((path, *[None] * (len(names) + 1), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", *names, "line_count", "parse_error"]).astype(object)

    read = files.filter(F.col("ext").isin("kt", "java")).select("path", "ext", "text", code_lines(F.col("text")).alias("line_count"))
    return read.mapInPandas(run, f"path string, {META}, line_count long, parse_error string")


def script_dependencies(files: DataFrame, excluded: tuple[str, ...] = EXCLUDED_SCOPES, skipped: tuple[str, ...] = SKIPPED_CALLS) -> DataFrame:
    """deps(path, ord, scope, artifact_group, artifact, version) of build scripts; repeated lines stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *d) for p, t in b[["path", "text"]].itertuples(index=False) for i, d in enumerate(dependencies(t or "", frozenset(excluded), frozenset(skipped)))]
            yield pd.DataFrame(rows, columns=["path", "ord", "scope", "artifact_group", "artifact", "version"])

    return files.select("path", "text").mapInPandas(run, "path string, ord int, scope string, artifact_group string, artifact string, version string")


def resolved_dependencies(deps: DataFrame, excluded: tuple[str, ...] = EXCLUDED_SCOPES) -> DataFrame:
    """deps(scope, artifact_group, artifact, version, ord): no excluded scopes or null groups, each artifact of a scope once."""
    from loomgraph.functions.windows import first_per_key

    kept = deps.filter(~F.col("scope").isin(*excluded) & F.col("artifact_group").isNotNull()).withColumn("version", F.coalesce("version", F.lit("unspecified")))
    return first_per_key(kept, ["scope", "artifact_group", "artifact"], "ord")
