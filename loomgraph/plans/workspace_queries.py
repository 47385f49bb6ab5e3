"""Queries from files to projects and roll-ups over the fixture tables, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import workspaces
from loomgraph.plans.adapters import plain, table
from loomgraph.plans.catalog import register
from loomgraph.plans.summaries import ENTRIES

# Orders are files: at the root, in one of seven projects, two of them nested, or outside all of them.
_FILES = """SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN '/w' WHEN 1 THEN '/other' WHEN 2 THEN '/w/p1/inner' WHEN 3 THEN '/w/p1/innermost' ELSE '/w/p' || CAST(o_orderkey % 5 AS STRING) END
    || CASE o_orderkey % 4 WHEN 0 THEN '/src/main/kotlin/F' WHEN 1 THEN '/src/test/java/F' WHEN 2 THEN '/src/extra/F' ELSE '/F' END || CAST(o_orderkey AS STRING) || '.kt' AS path FROM {orders}"""
_DIRS = ["/w", "/w/p0", "/w/p1", "/w/p1/inner", "/w/p2", "/w/p3", "/w/p4"]


def _roots(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, _DIRS))).alias("dir")).withColumn("project", F.when(F.col("dir") == "/w", ":").otherwise(F.replace(F.expr("substring(dir, 3)"), F.lit("/"), F.lit(":"))))


@register(
    "owned_files",
    "",
    f"""WITH f AS ({plain(_FILES)}), r AS (SELECT unnest({_DIRS}) AS dir), o AS (SELECT k, path, max(dir) AS dir FROM f JOIN r ON starts_with(path, dir || '/') GROUP BY 1, 2)
    SELECT k, CASE WHEN dir = '/w' THEN ':' ELSE replace(substr(dir, 3), '/', ':') END AS project, substr(path, length(dir) + 2) AS rel_path FROM o""",
)
def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.owned_files(table(spark, sf_dir, _FILES), _roots(spark)).select("k", "project", "rel_path")


# Candidates of three strategies for every customer as a project; directories exist where an order of the customer says so.
_CANDIDATES = """SELECT CAST(c_custkey AS STRING) AS project, s AS strategy, 'd' || CAST(c_custkey AS STRING) || '/' || CAST(s * 10 + i AS STRING) AS dir FROM {customer}, (VALUES (1), (2), (3)) a(s), (VALUES (0), (1), (2)) b(i)"""
_EXISTING = "SELECT DISTINCT 'd' || CAST(o_custkey AS STRING) || '/' || CAST((1 + o_orderkey % 3) * 10 + o_orderkey % 4 AS STRING) AS dir FROM {orders} WHERE o_orderkey % 3 >= o_custkey % 3"


@register("source_dirs_by_strategy", "", f"SELECT DISTINCT project, dir FROM (SELECT *, min(strategy) OVER (PARTITION BY project) AS first FROM ({plain(_CANDIDATES)}) WHERE dir IN ({plain(_EXISTING)})) WHERE strategy = first")
def _by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.discovered_dirs(table(spark, sf_dir, _CANDIDATES), table(spark, sf_dir, _EXISTING))


_PAIRS = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '/w/root' WHEN 1 THEN '/w/root/a/b' WHEN 2 THEN '/w/a1' ELSE 'w/root' END AS root, CASE c_custkey % 6 WHEN 5 THEN '/w' ELSE '/w/root' END || '/a/' || CASE c_custkey % 5 WHEN 0 THEN 'b' ELSE 'c' || CAST(c_custkey AS STRING) END AS dir FROM {customer}"


@register(
    "relative_dirs",
    "",
    f"""WITH p AS (SELECT *, list_filter(string_split(root, '/'), lambda x: x <> '') AS a, list_filter(string_split(dir, '/'), lambda x: x <> '') AS b FROM ({plain(_PAIRS)})),
    n AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n FROM p)
    SELECT k, CASE WHEN starts_with(root, '/') THEN array_to_string(list_concat(list_transform(range(len(a) - n), lambda x: '..'), b[n + 1 : len(b)]), '/') ELSE dir END AS relative FROM n""",
)
def _relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _PAIRS).select("k", workspaces.relative_dir(F.col("root"), F.col("dir")).alias("relative"))


# A nation is a project whose analysis failed where its name begins so; regions of only such nations have no number.
_ANALYSED = "SELECT r_name AS build, n_name AS project, r_name <> 'ASIA' AND n_nationkey % 4 <> 1 AS analysed FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"


@register(
    "rolled_totals",
    "",
    f"""WITH p AS ({plain(_ANALYSED)}), e AS ({plain(ENTRIES)}), x AS (SELECT build, project, (SELECT count(*) FROM e WHERE e.project = p.project) AS s,
      CASE WHEN analysed THEN (SELECT count(*) FROM e WHERE e.project = p.project AND severity = 'WARNING') END AS w FROM p)
    SELECT CAST(GROUPING(build, project) AS INT) AS level, build, project, CAST(sum(s) AS BIGINT) AS n_symbols, CAST(sum(w) AS BIGINT) AS n_warnings FROM x GROUP BY ROLLUP (build, project)""",
)
def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, ENTRIES)
    return workspaces.rolled_totals(table(spark, sf_dir, _ANALYSED), e, e)


# Every supplier is a project with a main class of a function and a test class, every third without its own script.
_TREES = """SELECT s_suppkey AS k, '/w/s' || CAST(s_suppkey AS STRING) AS dir, s_suppkey % 3 AS script FROM {supplier}"""


@register(
    "summaries_from_files",
    "",
    f"""WITH t AS ({plain(_TREES)}) SELECT ':s' || k AS project, CASE script WHEN 0 THEN 'none' WHEN 1 THEN 'build.gradle.kts' ELSE 'build.gradle' END AS build_file,
      CASE WHEN k % 2 = 0 THEN 'main=3 [src/main/java,src/main/kotlin], test=1 [src/test/kotlin], bench=0 []' ELSE 'main=2 [src/main/kotlin], test=1 [src/test/kotlin], bench=0 []' END AS source_sets,
      CAST(CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END AS BIGINT) AS n_symbols, CAST(CASE script WHEN 0 THEN 0 ELSE 2 END AS BIGINT) AS n_dependencies FROM t""",
)
def _from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, _TREES)
    put = lambda path, text, where: F.when(where, F.struct(F.lit(path).alias("at"), text.alias("text")))
    script = F.lit('dependencies {\n  api("g:a:1")\n  implementation("g:b:2")\n  default("g:c:3")\n}')
    made = F.array_compact(
        F.array(
            put("/src/main/kotlin/p/A.kt", F.concat(F.lit("package p\nclass A"), "k", F.lit(" {\n  fun m() = 1\n}\n")), F.lit(True)),
            put("/src/main/java/J.java", F.lit("class J {}"), F.col("k") % 2 == 0),
            put("/src/test/kotlin/ATest.kt", F.lit("class ATest"), F.lit(True)),
            put("/src/bench/B.kt", F.lit("class B"), F.lit(True)),
            put("/build.gradle.kts", script, F.col("script") == 1),
            put("/build.gradle", script, F.col("script") == 2),
            put("/notes.md", F.lit("x"), F.lit(True)),
        )
    )
    files = t.select("dir", F.explode(made).alias("f")).select(F.concat("dir", "f.at").alias("path"), "f.text")
    found = workspaces.projects_of_scripts(files, "/w").select("dir", "build_file")
    projects = t.select(F.concat(F.lit(":s"), F.col("k").cast("string")).alias("project"), "dir").join(found, "dir", "left").withColumn("build_file", F.coalesce("build_file", F.lit("none")))
    rows = workspaces.nested_summaries(projects, workspaces.summary_tables(files, projects))
    sets = F.transform("source_sets", lambda s: F.concat(s["source_set"], F.lit("="), s["n_symbols"].cast("string"), F.lit(" ["), F.array_join(s["dirs"], ","), F.lit("]")))
    return rows.withColumn("source_sets", F.array_join(sets, ", "))
