"""Queries of summaries and reports over the fixture tables, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.windows import numbered_in_order
from loomgraph.operators import index, reports, summary
from loomgraph.plans.adapters import REFS, SYMBOLS, code_graph, plain, table
from loomgraph.plans.catalog import _edges, register

# Builds are regions, projects nations, symbols customers; files are events of a user's project.
ENTRIES = """
SELECT c_custkey AS item, r_name AS build, n_name AS project, CASE c_custkey % 4 WHEN 0 THEN 'test' ELSE 'main' END AS source_set,
  CASE c_custkey % 3 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'FUNCTION' ELSE 'PROPERTY' END AS kind, 'com.' || lower(c_mktsegment) AS package_name,
  'C' || CAST(c_custkey % 50 AS STRING) AS name, CASE WHEN c_acctbal < 0 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
FILES = """
SELECT 'p' || CAST(user_id % 20 AS STRING) AS project, props AS text,
  'p' || CAST(user_id % 20 AS STRING) || CASE event_id % 9 WHEN 0 THEN '/build/gen/' WHEN 1 THEN '/.gradle/' WHEN 2 THEN '/src/main/kotlin/a/' WHEN 3 THEN '/src/test/java/b/' ELSE '/' END ||
  CASE event_id % 8 WHEN 0 THEN 'build.gradle.kts' WHEN 1 THEN 'gradle.properties' WHEN 2 THEN 'libs.versions.toml' WHEN 3 THEN 'F' || CAST(event_id AS STRING) || '.kt'
    WHEN 4 THEN 'F' || CAST(event_id AS STRING) || '.java' WHEN 5 THEN 'notes.md' WHEN 6 THEN 'workspace.json' ELSE 'x.toml' END AS path
FROM {events}"""
PROJECTS = """
SELECT r_name AS build, ':' || CASE WHEN n_nationkey % 3 = 0 THEN r_name WHEN n_nationkey % 3 = 1 THEN r_name || ':' || n_name ELSE n_name END AS identity_path, n_name AS dir
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""
DEPS = """
SELECT n_name AS project, 'g' || CAST(l_suppkey % 9 AS STRING) AS artifact_group, CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'a' || CAST(l_partkey AS STRING) END AS artifact, '1.' || CAST(l_linenumber AS STRING) AS version, l_orderkey AS item
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey"""
HUBS = """
SELECT 'Part' || CAST(l_partkey AS STRING) AS name, CASE l_partkey % 3 WHEN 0 THEN 'src/test/A.kt' WHEN 1 THEN 'src/main/PartTest.kt' ELSE 'src/main/A.kt' END AS path, count(DISTINCT l_orderkey) AS dependent_count
FROM {lineitem} GROUP BY l_partkey"""
CALLS = """
SELECT event_id AS ref_id, 'm' || CAST(event_id % 4 AS STRING) AS target_name,
  CASE event_id % 5 WHEN 0 THEN 'x = this.' WHEN 1 THEN 'a.b' || CAST(event_id % 7 AS STRING) || '.' WHEN 2 THEN '' WHEN 3 THEN 'api.m9(it.' ELSE 'api.' END || 'm' || CAST(event_id % 4 AS STRING) || ' (1)' AS context
FROM {events}"""
CLASSES = """
SELECT event_id AS symbol_id, 'u' || CAST(user_id AS STRING) AS file, 'pkg' || CAST(user_id % 5 AS STRING) AS package_name, event_id % 10 AS a, event_id % 40 AS b FROM {events} WHERE event_type = 'signup'"""

_F = "files AS (" + plain(FILES) + ")"
_E = "entries AS (" + plain(ENTRIES) + ")"


def _query(name: str, sql: str, source: str, build) -> None:
    register(name, "", sql)(lambda spark, sf_dir: build(table(spark, sf_dir, source)))


_query("indexable_files", f"WITH {_F}, n AS (SELECT path, split_part(path, '/', -1) AS f FROM files) SELECT DISTINCT path FROM n WHERE regexp_matches(f, '[.](kt|java|kts)$') OR (f IN ('gradle.properties', 'libs.versions.toml', 'workspace.json', 'x.toml') AND path NOT LIKE '%/build/%' AND path NOT LIKE '%/.gradle/%')", FILES, summary.indexable_files)
_query("source_dirs", f"WITH {_F} SELECT DISTINCT project, regexp_extract(path, '^(p[0-9]+/src/[a-z]+/[a-z]+)/', 1) AS dir FROM files WHERE path LIKE '%/src/%'", FILES, summary.source_dirs)
_query(
    "source_set_dirs",
    f"WITH {_E} SELECT DISTINCT project, source_set, project || '/src/' || source_set || '/kotlin,' || project || '/src/' || source_set || '/java' AS dirs FROM entries",
    ENTRIES,
    lambda e: summary.source_set_dirs(e.select(F.col("project").alias("project_dir"), "source_set").distinct()).select(F.col("project_dir").alias("project"), "source_set", F.array_join("dirs", ",").alias("dirs")),
)
_query("declared_inputs", f"WITH {_F} SELECT project, path, sha256(coalesce(text, '')) AS content_key FROM files WHERE path LIKE '%/build.gradle.kts' OR (path LIKE '%/src/%' AND regexp_matches(path, '[.](kt|java)$'))", FILES, summary.declared_inputs)


@register(
    "included_projects",
    "",
    f"""WITH p AS ({plain(PROJECTS)}) SELECT build, coalesce(nullif(CASE WHEN starts_with(identity_path, ':' || build) THEN substr(identity_path, length(build) + 2) ELSE identity_path END, ''), ':') AS project, dir, 'builds/' || lower(build) AS relative_dir FROM p
    UNION ALL SELECT 'LONE', ':', 'lone', 'builds/lone'""",
)
def _included(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, PROJECTS)
    builds = p.select("build").distinct().selectExpr("build", "lower(build) AS dir").unionByName(spark.range(1).selectExpr("'LONE' AS build", "'lone' AS dir"))
    return summary.included_projects(builds.withColumn("relative_dir", F.concat(F.lit("builds/"), "dir")), p)


_query("dependencies_without_blanks", f"SELECT * FROM ({plain(DEPS)}) WHERE artifact <> ' '", DEPS, lambda d: summary.checked_dependencies(d, strict=False)[0])
_query("quarantined_dependencies", f"SELECT * FROM ({plain(DEPS)}) WHERE artifact = ' '", DEPS, lambda d: summary.checked_dependencies(d, strict=False)[1])
_query(
    "symbol_entries",
    f"SELECT symbol_id, split_part(name, '.', -1) AS name, CASE WHEN kind IN ('FUNCTION', 'PROPERTY') THEN kind ELSE 'CLASS' END AS kind, CASE WHEN package_name = 'pkg0' THEN '_root_' ELSE package_name END AS package_name, file FROM ({plain(SYMBOLS)})",
    SYMBOLS,
    lambda s: summary.symbol_entries(
        s.select("symbol_id", "name", "kind", F.when(F.col("package_name") == "pkg0", "").otherwise(F.col("package_name")).alias("package_name"), F.concat(F.lit("/w/src/"), "file").alias("file"), F.lit("/w/src").alias("source_dir"))
    ),
)
_query(
    "source_set_counts",
    f"WITH {_E} SELECT project, source_set, count(*) FILTER (WHERE kind = 'FUNCTION') AS n_functions, count(*) FILTER (WHERE kind = 'PROPERTY') AS n_properties, coalesce(string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (WHERE kind = 'CLASS'), '') AS classes FROM entries GROUP BY 1, 2",
    ENTRIES,
    lambda e: summary.source_set_counts(e, ["project"]),
)
_query("packages_of_project", f"WITH {_E} SELECT project, string_agg(DISTINCT package_name, ', ' ORDER BY package_name) AS packages FROM entries GROUP BY 1", ENTRIES, lambda e: summary.packages(e, ["project"]))
_SUMMARIES = f"""{_E}, d AS (SELECT project, count(*) AS n_dependencies FROM ({plain(DEPS)}) GROUP BY 1),
    s AS (SELECT project, count(*) AS n_symbols, string_agg(DISTINCT source_set, ', ' ORDER BY source_set) AS source_sets, count(*) FILTER (WHERE severity = 'WARNING') AS n_warnings FROM entries GROUP BY 1),
    summaries AS (SELECT project, coalesce(n_symbols, 0) AS n_symbols, coalesce(source_sets, '-') AS source_sets, coalesce(n_dependencies, 0) AS n_dependencies, coalesce(n_warnings, 0) AS n_warnings FROM s FULL JOIN d USING (project))"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, ENTRIES)
    return summary.project_summaries(e, table(spark, sf_dir, DEPS), e, ["project"])


register("project_summaries", "", f"WITH {_SUMMARIES} SELECT * FROM summaries")(_summaries)
_BUILDS = "builds AS (SELECT build, count(DISTINCT project) AS n_projects, count(*) AS n_symbols, count(*) FILTER (WHERE severity = 'WARNING') AS n_warnings FROM entries GROUP BY 1)"


@register("summaries_with_included", "", f"WITH {_SUMMARIES}, {_BUILDS} SELECT project AS name, n_symbols, n_warnings, 0 AS src_ord FROM summaries UNION ALL SELECT build, n_symbols, n_warnings, 1 FROM builds")
def _with_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda df, c: df.select(F.col(c).alias("name"), "n_symbols", "n_warnings")
    return summary.with_included(shown(_summaries(spark, sf_dir), "project"), shown(_builds(spark, sf_dir), "build"))


def _builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, ENTRIES)
    return e.groupBy("build").agg(F.countDistinct("project").alias("n_projects"), F.count("*").alias("n_symbols"), F.count_if(F.col("severity") == "WARNING").alias("n_warnings")).withColumn("relative_dir", F.lower("build"))


_label = lambda n, one: f"CASE WHEN {n} = 1 THEN '{one}' ELSE '{one}s' END"


@register(
    "dashboard_lines",
    "",
    f"""WITH {_SUMMARIES}, {_BUILDS}, t AS (SELECT (SELECT count(*) FROM summaries) AS np, (SELECT count(*) FROM builds) AS nb, (SELECT sum(n_symbols) FROM summaries) + (SELECT sum(n_symbols) FROM builds) AS s,
      (SELECT sum(n_warnings) FROM summaries) + (SELECT sum(n_warnings) FROM builds) AS w)
    SELECT '- ' || s || ' symbols across ' || np || ' ' || {_label("np", "project")} AS line FROM t UNION ALL SELECT '- ' || w || ' ' || {_label("w", "warning")} FROM t WHERE w > 0
    UNION ALL SELECT '- ' || nb || ' ' || {_label("nb", "included build")} FROM t WHERE nb > 0
    UNION ALL SELECT '| ' || project || ' | ' || n_symbols || ' | ' || source_sets || ' | ' || n_dependencies || ' | ' || n_warnings || ' |' FROM summaries
    UNION ALL SELECT '| ' || build || ' | ' || n_projects || ' | ' || n_symbols || ' | ' || n_warnings || ' | [view](../' || lower(build) || '/.loomgraph/context.md) |' FROM builds""",
)
def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard(_summaries(spark, sf_dir), _builds(spark, sf_dir)).filter(~F.col("line").contains("## ")).select("line")


_over = lambda name, uses, sql, build: register(name, uses, sql)(lambda spark, sf_dir: build(code_graph(spark, sf_dir)))
_over("components_by_package", "c0", "SELECT package_name, count(*) AS n, string_agg(simple_name, ', ' ORDER BY simple_name) AS members FROM c0 GROUP BY 1", lambda g: summary.by_package(g.components))
_over("entry_points_simple", "c", "SELECT qualified_name, arg_min(k, k * 1e12 + component_id)::INT AS rank FROM (SELECT *, CASE WHEN has_main THEN 0 WHEN role = 'CONTROLLER' THEN 1 END AS k FROM c) WHERE k IS NOT NULL GROUP BY 1", lambda g: summary.simple_entry_points(g.components, _edges(g)).select("qualified_name", "rank"))


@register("hub_roles", "c", f"SELECT h.*, r.role FROM ({plain(HUBS)}) h LEFT JOIN (SELECT simple_name, arg_max(role, component_id) AS role FROM c GROUP BY 1) r ON r.simple_name = h.name")
def _hub_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.hub_roles(table(spark, sf_dir, HUBS), code_graph(spark, sf_dir).components).select("name", "path", "dependent_count", "role")


_query("hub_display", f"SELECT *, path LIKE '%/test/%' OR path LIKE '%Test%' AS is_test, dependent_count >= 3 AS detailed, dependent_count >= 50 AS super_node FROM ({plain(HUBS)})", HUBS, summary.hub_display)
_CLASS_HUBS = "SELECT 'C' || CAST(l_linenumber * 3 AS STRING) AS name, 'SERVICE' AS role, count(*) AS dependent_count FROM {lineitem} GROUP BY l_linenumber"


@register("tagged_classes", "", f"WITH {_E}, h AS ({plain(_CLASS_HUBS)}) SELECT e.item, e.name, h.role, h.dependent_count FROM entries e LEFT JOIN h USING (name) WHERE kind = 'CLASS'")
def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.tagged_classes(table(spark, sf_dir, ENTRIES), table(spark, sf_dir, _CLASS_HUBS)).select("item", "name", "role", "dependent_count")


_LOOPS = "SELECT a, b, event_id FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS z, event_id FROM {events}) t WHERE a = z AND a <> b"
_query("distinct_cycles", f"SELECT DISTINCT a || ' -> ' || b || ' -> ' || a AS path FROM ({plain(_LOOPS)})", _LOOPS, lambda t: summary.distinct_cycles(t.select(F.array("a", "b", "a").alias("nodes"))).select(F.array_join("nodes", " -> ").alias("path")))
_WANTED = "SELECT DISTINCT 'm' || CAST(event_id % 30 AS STRING) AS wanted FROM {events} UNION SELECT DISTINCT 'pkg1.C' || CAST(event_id % 40 AS STRING) FROM {events}"


@register(
    "usages_by_name",
    "symbols used",
    f"""SELECT wanted, s.symbol_id, count(u.ref_id) AS n_usages FROM ({plain(_WANTED)}) w JOIN symbols s ON w.wanted IN (split_part(s.name, '.', -1), s.name, s.qualified_name) LEFT JOIN used u ON u.symbol_id = s.symbol_id GROUP BY 1, 2""",
)
def _by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = table(spark, sf_dir, SYMBOLS), table(spark, sf_dir, REFS)
    return summary.usages_by_name(s, index.usage_totals(s, r), table(spark, sf_dir, _WANTED))


@register("symbols_in_files", "symbols refs", "SELECT symbol_id, file FROM symbols WHERE file IN (SELECT file FROM refs WHERE kind = 'CALL')")
def _in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.symbols_in_files(table(spark, sf_dir, SYMBOLS), table(spark, sf_dir, REFS).filter("kind = 'CALL'")).select("symbol_id", "file")


_query(
    "call_receivers",
    "SELECT event_id AS ref_id, CASE event_id % 5 WHEN 1 THEN 'b' || (event_id % 7) WHEN 4 THEN 'api' END AS receiver_name FROM events",
    CALLS,
    lambda c: summary.call_receivers(c).select("ref_id", "receiver_name"),
)


@register(
    "receiver_types",
    "symbols refs",
    f""", k AS ({plain(CLASSES)}), p AS (SELECT symbol_id, file, package_name, 'p' || a AS property, 'C' || b AS t, 0 AS pos FROM k UNION ALL SELECT symbol_id, file, package_name, 'q', 'C' || a, 1 FROM k),
    i AS (SELECT file, target_name, arg_max(target_qualified_name, ref_id) AS q FROM refs WHERE kind = 'IMPORT' GROUP BY 1, 2),
    l AS (SELECT split_part(name, '.', -1) AS s, min(qualified_name) AS q FROM symbols GROUP BY 1 HAVING count(*) = 1)
    SELECT p.file, property, arg_max(coalesce(i.q, l.q, package_name || '.' || t), symbol_id * 2 + pos) AS type FROM p LEFT JOIN i ON i.file = p.file AND i.target_name = t LEFT JOIN l ON l.s = t GROUP BY 1, 2""",
)
def _receiver_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = table(spark, sf_dir, SYMBOLS), table(spark, sf_dir, REFS)
    lines = F.split(F.concat(F.lit("package x\nclass A(val p"), "a", F.lit(": C"), "b", F.lit(", private\n  var q : C"), "a", F.lit(") {\n  val late: C1\n}")), "\n")
    classes = table(spark, sf_dir, CLASSES).select("symbol_id", "file", "package_name", F.lit(2).alias("line"), lines.alias("lines"))
    return summary.receiver_types(classes, r.filter("kind = 'IMPORT'"), s)


# Classes of many forms, and findings that name some of them, of constants and of names that are no class at all.
_NAMED = """
SELECT c_custkey AS item, n_nationkey AS project_ord, ':' || n_name AS project, 'com.' || lower(c_mktsegment) AS package_name, CASE c_custkey % 9 WHEN 4 THEN 'test' ELSE 'main' END AS source_set,
  CASE c_custkey % 11 WHEN 0 THEN 'ILogger' WHEN 1 THEN 'FileLogger' WHEN 2 THEN 'LoggerImpl' WHEN 3 THEN 'DefaultILogger' WHEN 4 THEN 'MockILogger' WHEN 5 THEN 'OrderService' WHEN 6 THEN 'FakeOrderService'
    WHEN 7 THEN 'MAX_SERVICE' WHEN 8 THEN 'DefaultLogger' WHEN 9 THEN 'IItem' ELSE 'TestOrderService' END || CASE WHEN c_custkey % 13 < 9 THEN CAST(c_custkey % 13 AS STRING) ELSE '' END AS name,
  'Interface `' || CASE c_custkey % 5 WHEN 0 THEN 'ILogger' WHEN 1 THEN 'MAX_X' WHEN 2 THEN 'Plain' WHEN 3 THEN 'OrderService' ELSE 'Gone' END || CASE WHEN c_custkey % 7 < 4 THEN CAST(c_custkey % 7 AS STRING) ELSE '' END || '` has only one implementation: `X`' AS message
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
_INTERFACES = f"""WITH e AS ({plain(_NAMED)}), k AS (SELECT DISTINCT name FROM e WHERE item % 3 <> 1),
    cand AS (SELECT regexp_extract(message, 'Interface `(\\w+)` has', 1) AS name, project AS package_name, 'main' AS source_set, 0 AS kind, project_ord AS p, item AS o FROM e WHERE item % 2 = 0
      UNION ALL SELECT name, package_name, source_set, 1, project_ord, item FROM e WHERE item % 3 <> 1 AND (regexp_matches(name, '(Service|Repository|Provider|Factory)$') OR regexp_matches(name, '^I[A-Z].'))),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, p, o) AS rn FROM cand WHERE NOT regexp_matches(name, '^[A-Z0-9_]+$')) WHERE rn = 1),
    based AS (SELECT *, regexp_replace(name, '^I', '') AS base FROM first),
    interfaces AS (SELECT name, package_name, source_set,
      (SELECT count(*) FROM k WHERE k.name <> based.name AND NOT regexp_matches(lower(k.name), '^(mock|fake|stub)|(mock|fake|stub)$') AND (k.name IN (base || 'Impl', 'Default' || based.name, 'Default' || base) OR (ends_with(k.name, base) AND k.name <> base))) AS n_impl,
      EXISTS (SELECT 1 FROM k WHERE k.name IN ('Mock' || based.name, based.name || 'Mock', 'Fake' || based.name, based.name || 'Fake')) AS has_mock FROM based) """


def _interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, _NAMED)
    return summary.interfaces_of_summaries(e.filter("item % 2 = 0").withColumn("ord", F.col("item")), e.filter("item % 3 <> 1"))


register("interfaces_from_findings", "", _INTERFACES + "SELECT * FROM interfaces")(_interfaces)
register(
    "interfaces_lines",
    "",
    _INTERFACES
    + """SELECT row_number() OVER (ORDER BY part, n_impl DESC, name) AS place, part, line FROM (SELECT CASE WHEN source_set = 'test' THEN 2 ELSE 1 END AS part, n_impl, name,
        '| `' || name || '` | ' || package_name || ' | ' || n_impl || ' | ' || CASE WHEN has_mock THEN 'yes' ELSE 'no' END || ' |' AS line FROM interfaces)""",
)(lambda spark, sf_dir: numbered_in_order(reports.interfaces_report(_interfaces(spark, sf_dir)), "place", "part", "a", "b", "line").select("place", "part", "line"))


_BUILD_EDGES = "SELECT DISTINCT 'b' || CAST(l_suppkey % 40 AS STRING) AS from_build, 'b' || CAST(l_partkey % 50 AS STRING) AS to_build FROM {lineitem} WHERE l_suppkey % 40 <> l_partkey % 50 AND l_partkey % 50 < 40"
_query("build_diagram", f"SELECT '    ' || from_build || ' --> ' || to_build AS line FROM ({plain(_BUILD_EDGES)}) UNION ALL VALUES ('```mermaid'), ('flowchart TD'), ('```')", _BUILD_EDGES, lambda e: reports.build_diagram(e).select("line"))


@register(
    "cross_build_lines",
    "",
    f"""WITH e AS ({plain(_BUILD_EDGES)}), h AS ({plain(HUBS)}) SELECT DISTINCT '### ' || from_build AS line FROM e UNION ALL SELECT '- depends on **' || to_build || '**' FROM e
    UNION ALL SELECT '| `' || name || '` | ' || path || ':1 | ' || dependent_count || ' | OTHER |' FROM h UNION ALL SELECT DISTINCT '- ' || a || ' -> ' || b || ' -> ' || a FROM ({plain(_LOOPS)})""",
)
def _cross_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = table(spark, sf_dir, HUBS).withColumns({"line": F.lit(1), "role": F.lit("OTHER")})
    cycles = summary.distinct_cycles(table(spark, sf_dir, _LOOPS).select(F.array("a", "b", "a").alias("nodes")))
    return reports.cross_build_report(table(spark, sf_dir, _BUILD_EDGES), hubs, cycles).select("line")
