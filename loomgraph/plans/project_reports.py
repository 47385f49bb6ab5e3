"""Queries of whole documents over the fixture tables, line by line, with the SQL each is checked against."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import documents
from loomgraph.plans.adapters import plain, table
from loomgraph.plans.catalog import ORACLES, QUERIES

# Nations are projects of builds, which are regions; customers are symbols and findings, suppliers hubs, lines dependencies.
_PLACES = "SELECT n_nationkey AS k, ':' || n_name AS project, r_name AS build, n_nationkey AS project_ord FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
_PROJECTS = f"SELECT *, CASE k % 3 WHEN 0 THEN 'build.gradle' WHEN 1 THEN 'build.gradle.kts' ELSE 'none' END AS build_file, k % 4 AS n_dirs, CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS n_subprojects FROM ({_PLACES}) p"
_SETS = f"SELECT k, project, build, project_ord, 1 AS set_ord, 'main' AS source_set FROM ({_PLACES}) p WHERE k % 6 <> 5 UNION ALL SELECT k, project, build, project_ord, 2, CASE k % 2 WHEN 0 THEN 'test' ELSE 'bare' END FROM ({_PLACES}) p WHERE k % 6 <> 5"
_SYMBOLS = f"""SELECT p.k, project, build, project_ord, c_custkey AS item, CASE WHEN c_custkey % 7 = 0 AND k % 2 = 0 THEN 'test' ELSE 'main' END AS source_set,
    CASE c_custkey % 3 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'FUNCTION' ELSE 'PROPERTY' END AS kind, 'S' || CAST(c_custkey % 60 AS STRING) AS name, 'com.' || lower(c_mktsegment) AS package_name,
    'f' || CAST(c_custkey AS STRING) || '.kt' AS file, CAST(c_custkey % 90 + 1 AS BIGINT) AS line FROM {{customer}} JOIN ({_PLACES}) p ON c_nationkey = k WHERE k % 7 <> 6"""
_FOUND = f"""SELECT k, project, build, project_ord, c_custkey AS ord, CASE WHEN c_acctbal < -500 THEN 'FORBIDDEN' WHEN c_acctbal < 0 THEN 'WARNING' ELSE 'INFO' END AS severity,
    CASE WHEN c_acctbal < -500 THEN 0 WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS severity_rank, 'found ' || CAST(c_custkey % 80 AS STRING) AS message, 'mend ' || CAST(c_custkey AS STRING) AS suggestion
    FROM {{customer}} JOIN ({_PLACES}) p ON c_nationkey = k WHERE k % 8 <> 3"""
_CYCLES = f"SELECT k, project, build, project_ord, c_custkey AS ord, 'S' || CAST(c_custkey % 60 AS STRING) || ' -> T -> S' || CAST(c_custkey % 60 AS STRING) AS path FROM {{customer}} JOIN ({_PLACES}) p ON c_nationkey = k WHERE k % 4 = 1 AND c_custkey % 5 = 0"
_DEPS = f"""SELECT k, project, build, project_ord, l_orderkey * 10 + l_linenumber AS ord, CASE l_returnflag WHEN 'A' THEN 'api' ELSE 'implementation' END AS scope, 'g' || CAST(l_suppkey AS STRING) AS artifact_group,
    'a' || CAST(l_partkey AS STRING) AS artifact, '1.' || CAST(l_linenumber AS STRING) AS version FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN ({_PLACES}) p ON s_nationkey = k WHERE l_linenumber = 6 AND k % 9 <> 4"""
_DEPENDENTS = """SELECT DISTINCT l_suppkey AS place, l_partkey AS nth, 'D' || CAST(l_partkey AS STRING) AS name,
    CASE l_partkey % 4 WHEN 0 THEN 'app/src/test/D' WHEN 1 THEN 'lib/DTest' WHEN 2 THEN 'D' ELSE 'app/src/main/D' END || CAST(l_partkey AS STRING) || '.kt' AS path, CAST(l_partkey % 50 + 1 AS BIGINT) AS line
    FROM {lineitem} WHERE l_linenumber >= CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 7 END AND l_suppkey % 11 <> 7"""
_HUBS = f"""SELECT p.k, project, build, project_ord, s_suppkey AS place, 'S' || CAST(s_suppkey % 60 AS STRING) AS name, CASE s_suppkey % 3 WHEN 0 THEN 'service' ELSE '' END AS role,
    CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'app/src/main/H.kt' WHEN 2 THEN 'lib/HTest.kt' ELSE 'app/H.kt' END AS path, CAST(s_suppkey AS BIGINT) AS line, CAST(coalesce(n, 0) AS BIGINT) AS dependent_count, s_suppkey % 4 = 2 AS is_test
    FROM {{supplier}} JOIN ({_PLACES}) p ON s_nationkey = p.k LEFT JOIN (SELECT place, count(*) AS n FROM ({_DEPENDENTS}) d GROUP BY 1) d ON d.place = s_suppkey"""


def _tables(spark: SparkSession, sf_dir: str, doc: str) -> dict[str, DataFrame]:
    names = {"projects": _PROJECTS, "sets": _SETS, "symbols": _SYMBOLS, "found": _FOUND, "cycles": _CYCLES, "deps": _DEPS, "hubs": _HUBS}
    out = {n: table(spark, sf_dir, sql).withColumn("doc", F.col(doc)) for n, sql in names.items()}
    dependents = table(spark, sf_dir, _DEPENDENTS)
    listed = dependents.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("nth", "name", "path", "line"))).alias("dependents"))
    out["hubs"] = out["hubs"].join(listed, "place", "left").withColumn("dependents", F.coalesce("dependents", F.array().cast(listed.schema["dependents"].dataType)))
    out["cycles"] = out["cycles"].withColumn("nodes", F.split("path", " -> "))
    each = lambda n, word: F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.concat(F.lit(word), i.cast("string")))
    full = lambda n, word: F.when(F.col(n) > 0, each(n, word)).otherwise(F.array().cast("array<string>"))
    out["projects"] = out["projects"].withColumns({"source_dirs": full("n_dirs", "src/d"), "subprojects": full("n_subprojects", ":sub")})
    return out


@partial(QUERIES.setdefault, "project_report_lines")
def _project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.project_documents(**_tables(spark, sf_dir, "project"))


@partial(QUERIES.setdefault, "build_report_lines")
def _build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.build_documents(**_tables(spark, sf_dir, "build"))


@partial(QUERIES.setdefault, "hub_tree_lines")
def _hub_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = table(spark, sf_dir, _HUBS).withColumn("doc", F.col("build"))
    return documents.hub_document(hubs, table(spark, sf_dir, _DEPENDENTS).join(hubs.select("doc", "place"), "place"))


# A build's document takes edges to the builds whose names follow its own, in the order of the nations that give them.
_EDGES = f"SELECT build AS doc, k AS ord, build AS from_build, 'B' || CAST(k % 3 AS STRING) AS to_build FROM ({_PLACES}) p WHERE k % 5 <> 2 UNION ALL SELECT build, k + 100, 'B' || CAST(k % 2 AS STRING), build FROM ({_PLACES}) p WHERE k % 5 = 1"


@partial(QUERIES.setdefault, "cross_build_tree_lines")
def _cross_build_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = table(spark, sf_dir, _HUBS).withColumn("doc", F.col("build")).filter("k % 5 <> 4")
    cycles = table(spark, sf_dir, _CYCLES).select(F.col("build").alias("doc"), "ord", F.split("path", " -> ").alias("nodes"))
    docs = hubs.select("doc").distinct().withColumn("analysed", F.lit(True)).unionByName(spark.range(2).select(F.concat(F.lit("none"), F.col("id").cast("string")).alias("doc"), (F.col("id") == 1).alias("analysed")))
    return documents.cross_build_document(docs, table(spark, sf_dir, _EDGES).join(docs, "doc", "left_semi"), hubs, table(spark, sf_dir, _DEPENDENTS).join(hubs.select("doc", "place"), "place"), cycles.join(docs, "doc", "left_semi"))


def _with(doc: str) -> str:
    named = {"projects": _PROJECTS, "sets": _SETS, "symbols": _SYMBOLS, "found": _FOUND, "cycles": _CYCLES, "deps": _DEPS, "hubs": _HUBS}
    return ", ".join([f"{n} AS (SELECT *, {doc} AS doc FROM ({plain(sql)}))" for n, sql in named.items()] + [f"dependents AS ({plain(_DEPENDENTS)})"])


_LABEL = "CASE WHEN dependent_count = 1 THEN 'dependent' ELSE 'dependents' END"
_HUB = f"""'- **' || name || '**' || CASE WHEN role <> '' THEN ' [' || role || ']' ELSE '' END || CASE WHEN path <> '' THEN ' — ' || path || ':' || line ELSE '' END
    || CASE WHEN dependent_count >= 50 THEN ' — super node (' || dependent_count || ' ' || {_LABEL} || ')' ELSE ' (' || dependent_count || ' ' || {_LABEL} || ')' END"""
_ICON = "CASE severity WHEN 'FORBIDDEN' THEN chr(128683) WHEN 'WARNING' THEN chr(9888) || chr(65039) ELSE chr(8505) || chr(65039) END"


def _place(parts: list[str], ctes: str) -> str:
    """Statements of (doc, key, line), numbered within a document by their keys, lists of numbers that compare one by one."""
    every = " UNION ALL ".join(parts)
    return f"WITH {ctes} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY key, line) AS place, line FROM ({every})"


def _at(source: str, key: str, *lines: str, distinct: bool = False) -> list[str]:
    """Lines that follow one another at a key."""
    d = "DISTINCT " if distinct else ""
    return [f"SELECT {d}doc, [{key}, {i}] AS key, {x} AS line FROM {source}" for i, x in enumerate(lines)]


def _lit(*lines: str) -> list[str]:
    return ["'" + x.replace("'", "''") + "'" for x in lines]


_HEAD = _lit(*documents.SYMBOL_HEAD)
_ROW = "'| ' || kind || ' | ' || name || ' | ' || package_name || ' | ' || file || ' | ' || line || ' |'"
_FOUND_LINES = (f"'- **' || {_ICON} || '** ' || message", "'  - ' || suggestion")
_TREE = _at("hubs", "{p}, 1, place, 0", _HUB) + ["SELECT doc, [{p}, 1, place, 1, nth] AS key, '  - ' || d.name || ' — ' || d.path || ':' || d.line AS line FROM hubs JOIN dependents d USING (place) WHERE dependent_count < 50"] + _at("hubs", "{p}, 1, place, 2", "''")


def _tree(part: int) -> list[str]:
    return [x.replace("{p}", str(part)) for x in _TREE] + _at("hubs", f"{part}, 0", *_lit("## Hub Classes", ""), distinct=True)


ORACLES["project_report_lines"] = _place(
    [
        *_at("projects", "0, 0", "'# ' || doc", "''"),
        *_at("sets", "1, set_ord, 0, 0", "'## ' || source_set", "''"),
        *_at("sets WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.doc = sets.doc AND s.source_set = sets.source_set)", "1, set_ord, 0, 1", *_lit("No symbols extracted.", "")),
        *_at("sets WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.doc = sets.doc AND s.source_set = sets.source_set)", "1, set_ord, 0, 1", *_HEAD),
        *_at("sets WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.doc = sets.doc AND s.source_set = sets.source_set)", "1, set_ord, 2", "''"),
        *_at("symbols JOIN sets USING (doc, source_set)", "1, set_ord, 1, item", _ROW.replace("kind", "symbols.kind")),
        *_at("projects WHERE doc NOT IN (SELECT doc FROM sets)", "1, 0, 0", *_lit("## Symbols", "")),
        *_at("projects WHERE doc NOT IN (SELECT doc FROM sets) AND doc IN (SELECT doc FROM symbols)", "1, 0, 1", *_HEAD),
        *_at("projects WHERE doc NOT IN (SELECT doc FROM sets) AND doc NOT IN (SELECT doc FROM symbols)", "1, 0, 1", *_lit("No symbols extracted.")),
        *_at("symbols WHERE doc NOT IN (SELECT doc FROM sets)", "1, 0, 2, item", _ROW),
        *_at("projects WHERE doc NOT IN (SELECT doc FROM sets)", "1, 0, 3", "''"),
        *_tree(2),
        *_at("found", "3, 0", *_lit("## Findings", ""), distinct=True),
        *_at("found", "3, 1, severity_rank, ord", *_FOUND_LINES),
        *_at("found", "3, 2", "''", distinct=True),
        *_at("cycles", "4, 0", *_lit("## Circular Dependencies", ""), distinct=True),
        *_at("cycles", "4, 1, ord", "'- ' || path"),
        *_at("cycles", "4, 2", "''", distinct=True),
        *_at("projects", "5, 0", *_lit("## Dependencies", "")),
        *_at("projects WHERE doc NOT IN (SELECT doc FROM deps)", "5, 1", *_lit("No dependencies found.", "")),
        *_at("deps", "5, 1", *_lit("| Scope | Artifact | Version |", "|-------|----------|---------|"), distinct=True),
        *_at("deps", "5, 2, ord", "'| ' || scope || ' | ' || artifact_group || ':' || artifact || ' | ' || version || ' |'"),
        *_at("deps", "5, 3", "''", distinct=True),
        *_at("projects", "6, 0", "'## Build'", "''", "'- Build file: ' || build_file", "'- Source dirs: ' || CASE n_dirs WHEN 0 THEN 'none' WHEN 1 THEN 'src/d1' WHEN 2 THEN 'src/d1, src/d2' ELSE 'src/d1, src/d2, src/d3' END"),
        *_at("projects WHERE n_subprojects > 0", "6, 1", "'- Subprojects: :sub1, :sub2'"),
        *_at("projects", "6, 2", "''"),
    ],
    _with("project"),
)
_HUB_OF = "(SELECT s.*, set_ord, h.role, h.dependent_count FROM symbols s JOIN sets t USING (doc, project, source_set) LEFT JOIN (SELECT doc, project, name, arg_max(role, place) AS role, arg_max(dependent_count, place) AS dependent_count FROM hubs GROUP BY 1, 2, 3) h USING (doc, project, name) WHERE kind = 'CLASS')"
_SET_COUNTS = "(SELECT t.doc, t.project_ord, t.set_ord, t.source_set, count(*) FILTER (WHERE kind = 'FUNCTION') AS f, count(*) FILTER (WHERE kind = 'PROPERTY') AS v FROM sets t JOIN symbols USING (doc, project, source_set) GROUP BY ALL)"
_ONCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, message ORDER BY project_ord, ord) AS rn FROM found) WHERE rn = 1)"
_SEVERAL = "(SELECT doc FROM projects GROUP BY 1 HAVING count(*) > 1 OR sum(n_subprojects) > 0)"
ORACLES["build_report_lines"] = _place(
    [
        *_at("(SELECT DISTINCT doc FROM projects)", "0, 0", "'# ' || doc", "''", "'## Overview'", "''"),
        *_at("(SELECT doc, count(*) AS p, (SELECT count(*) FROM symbols s WHERE s.doc = projects.doc) AS n FROM projects GROUP BY 1)", "0, 1", "'- ' || n || ' symbols across ' || p || ' project(s)'"),
        *_at("(SELECT doc, count(*) AS w FROM found WHERE severity <> 'INFO' GROUP BY 1)", "0, 2", "'- ' || w || ' warning(s)'"),
        *_at("(SELECT doc, string_agg(DISTINCT package_name, ', ' ORDER BY package_name) AS p FROM symbols GROUP BY 1)", "0, 3", "'- packages: ' || p"),
        *_at("(SELECT DISTINCT doc FROM projects)", "0, 4", "''"),
        *_at(_SEVERAL, "1, 0", *_lit("## Projects", "", "| Project | Symbols | Source Sets | Report |", "|---------|---------|------------|--------|")),
        *_at(f"projects p WHERE doc IN {_SEVERAL}", "1, 1, project_ord", "'| ' || project || ' | ' || (SELECT count(*) FROM symbols s WHERE s.project = p.project) || ' | ' || coalesce((SELECT string_agg(source_set, ', ' ORDER BY set_ord) FROM sets s WHERE s.project = p.project), '-') || ' | [view](' || substr(project, 2) || '/context.md) |'"),
        *_at(_SEVERAL, "1, 2", "''"),
        *_at(_SET_COUNTS, "2, project_ord, set_ord, 0", "'## ' || source_set", "''"),
        *_at(_HUB_OF, "2, project_ord, set_ord, 1, item", f"'- class `' || name || '`' || CASE WHEN role <> '' THEN ' [' || role || ']' ELSE '' END || CASE WHEN dependent_count > 0 THEN ' (' || dependent_count || ' ' || {_LABEL} || ')' ELSE '' END || ' — ' || package_name || ', ' || file || ':' || line"),
        *_at(f"{_SET_COUNTS} WHERE f > 0", "2, project_ord, set_ord, 2", "'- ' || f || ' functions'"),
        *_at(f"{_SET_COUNTS} WHERE v > 0", "2, project_ord, set_ord, 3", "'- ' || v || ' properties'"),
        *_at(_SET_COUNTS, "2, project_ord, set_ord, 4", "''"),
        *_tree(3),
        *_at("deps", "4, 0", *_lit("## Dependencies", ""), distinct=True),
        *_at("(SELECT doc, scope, min(project_ord * 10000000000 + ord) AS first, string_agg(artifact_group || ':' || artifact || ':' || version, ', ' ORDER BY project_ord, ord, artifact_group || ':' || artifact || ':' || version) AS x FROM deps GROUP BY 1, 2)", "4, 1, first", "'- ' || scope || ': ' || x"),
        *_at("deps", "4, 2", "''", distinct=True),
        *_at("(SELECT doc FROM found UNION SELECT doc FROM cycles)", "5, 0", *_lit("## Problems", "")),
        *_at(_ONCE, "5, 1, severity_rank, project_ord, ord", *_FOUND_LINES),
        *_at("cycles", "5, 2", *_lit("", "### Circular Dependencies", ""), distinct=True),
        *_at("cycles", "5, 3, project_ord, ord", "'- ' || path"),
        *_at("(SELECT doc FROM found UNION SELECT doc FROM cycles)", "5, 4", "''"),
    ],
    _with("build"),
)
_BRANCH = "CASE WHEN lead(1) OVER w IS NULL THEN '└──' ELSE '├──' END || ' ' || d.path || ':' || d.line"
_IS_TEST = "(d.path LIKE '%/test/%' OR d.path LIKE '%Test%')"
_TABLE = "' || name || '` | ' || path || ':' || line || ' | ' || dependent_count || ' | ' || role || ' |'"
_COLUMNS = _lit("| Class | File | Dependents | Role |", "|-------|------|------------|------|")
ORACLES["hub_tree_lines"] = _place(
    [
        *_at("hubs", "0, 0", *_lit("# Hub Classes", "", "Classes with the most inbound dependencies across the codebase.", ""), distinct=True),
        *_at("hubs WHERE NOT is_test", "1, 0", *_COLUMNS, distinct=True),
        *_at("hubs WHERE NOT is_test", "1, 1, place", f"'| `{_TABLE}"),
        *_at("hubs WHERE NOT is_test", "1, 2", "''", distinct=True),
        *_at("hubs WHERE is_test", "2, 0", *_lit("### Test", ""), *_COLUMNS, distinct=True),
        *_at("hubs WHERE is_test", "2, 1, place", f"'| ' || chr(129514) || ' `{_TABLE}"),
        *_at("hubs WHERE is_test", "2, 2", "''", distinct=True),
        *_at("hubs WHERE dependent_count >= 3", "3, place, 0", "'## ' || CASE WHEN is_test THEN chr(129514) || ' ' ELSE '' END || name", "''", "'```'", "path || ':' || line || ' — ' || dependent_count || ' dependents'"),
        f"SELECT doc, [3, place, 1, row_number() OVER w] AS key, {_BRANCH} || CASE WHEN {_IS_TEST} THEN ' ' || chr(129514) ELSE '' END AS line FROM hubs JOIN dependents d USING (place) WHERE dependent_count >= 3 WINDOW w AS (PARTITION BY place ORDER BY {_IS_TEST}, nth)",
        *_at("hubs WHERE dependent_count >= 3", "3, place, 2", "'```'", "''"),
    ],
    _with("build"),
)
_EXTERNAL = "split_part(d.path, '/', 1) <> split_part(h.path, '/', 1) AND h.path <> ''"
ORACLES["cross_build_tree_lines"] = _place(
    [
        *_at("docs", "0, 0", *_lit("# Cross-Build References", "")),
        *_at("docs WHERE doc = 'none0'", "1, 0", *_lit("No cross-build references detected.", "")),
        *_at("docs WHERE doc = 'none1'", "5, 0", *_lit("No shared hubs or cycles detected in cross-build analysis.", "")),
        *_at("edges", "1, -1", *_lit("## Build Dependencies", ""), distinct=True),
        *_at("(SELECT doc, from_build, min(ord) AS f FROM edges GROUP BY 1, 2)", "1, f, 0", "'### ' || from_build", "''"),
        *_at("(SELECT *, min(ord) OVER (PARTITION BY doc, from_build) AS f FROM edges)", "1, f, 1, ord", "'- depends on **' || to_build || '**'"),
        *_at("(SELECT doc, from_build, min(ord) AS f FROM edges GROUP BY 1, 2)", "1, f, 2", "''"),
        *_at("shared", "2, 0", *_lit("## Shared Hub Classes", ""), *_COLUMNS, distinct=True),
        *_at("shared", "2, 1, place", f"'| `{_TABLE}"),
        *_at("shared", "2, 2", "''", distinct=True),
        *_at("shared WHERE dependent_count > 0", "3, place, 0", "'### ' || name", "''", "'```'", "path || ':' || line || ' — ' || dependent_count || ' dependents'"),
        f"SELECT doc, [3, place, 1, nth] AS key, {_BRANCH} || CASE WHEN {_EXTERNAL} THEN ' ' || chr(128279) ELSE '' END AS line FROM shared h JOIN dependents d USING (place) WINDOW w AS (PARTITION BY place ORDER BY nth)",
        *_at("shared WHERE dependent_count > 0", "3, place, 2", "'```'", "''"),
        *_at("cycles", "4, 0", *_lit("## Cross-Build Cycles", ""), distinct=True),
        *_at("cycles", "4, 1, ord", "'- ' || path"),
        *_at("cycles", "4, 2", "''", distinct=True),
    ],
    _with("build").replace("cycles AS (SELECT *", "all_cycles AS (SELECT *")
    + f", shared AS (SELECT * FROM hubs WHERE k % 5 <> 4), docs AS (SELECT DISTINCT doc FROM shared UNION ALL VALUES ('none0'), ('none1')), edges AS (SELECT * FROM ({plain(_EDGES)}) WHERE doc IN (SELECT doc FROM docs)), cycles AS (SELECT * FROM all_cycles WHERE doc IN (SELECT doc FROM docs))",
)
