"""Registry of the engine's own queries with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import exprs
from loomgraph.operators import graph, index, reports, resolve, rollup, rules
from loomgraph.plans.adapters import ANNOTATIONS, COMPONENTS, IMPORTS, REFS, SUPERTYPES, SYMBOLS, code_graph, plain, spread, table
from loomgraph.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Named relations of the checks; a check lists those it starts from.
BASE = {
    "c0": plain(COMPONENTS),
    "imports": plain(IMPORTS),
    "supertypes": plain(SUPERTYPES),
    "annotations": plain(ANNOTATIONS),
    "symbols": plain(SYMBOLS),
    "refs": plain(REFS),
    "roles": "SELECT component_id, arg_min(r, pos) AS r FROM (SELECT component_id, pos, CASE split_part(name, '.', -1) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in exprs.ANNOTATION_ROLES.items())
    + " END AS r FROM annotations) WHERE r IS NOT NULL GROUP BY component_id",
    "c": "SELECT c0.*, coalesce(r, CASE " + " ".join(f"WHEN simple_name LIKE '%{k}' THEN '{v}'" for k, v in exprs.ENDING_ROLES.items()) + " ELSE 'OTHER' END) AS role FROM c0 LEFT JOIN roles USING (component_id)",
    "fqn": "SELECT qualified_name AS q, max(component_id) AS id FROM c0 GROUP BY 1",
    "uniq": "SELECT simple_name AS s, min(component_id) AS id FROM c0 GROUP BY 1 HAVING count(*) = 1",
    "imp1": "SELECT component_id, split_part(name, '.', -1) AS s, arg_min(name, pos) AS q FROM imports GROUP BY 1, 2",
    "sup": """SELECT t.component_id AS owner_id, t.pos, t.name, CASE WHEN contains(t.name, '.') THEN f1.id ELSE coalesce(f2.id, f3.id, u.id) END AS target_id
        FROM supertypes t JOIN c0 o USING (component_id) LEFT JOIN fqn f1 ON f1.q = t.name LEFT JOIN imp1 i ON i.component_id = t.component_id AND i.s = t.name
        LEFT JOIN fqn f2 ON f2.q = i.q LEFT JOIN fqn f3 ON f3.q = o.package_name || '.' || t.name LEFT JOIN uniq u ON u.s = t.name""",
    "ie": "SELECT DISTINCT component_id AS from_id, id AS to_id FROM imports JOIN fqn ON q = name WHERE component_id <> id",
    "se": "SELECT DISTINCT owner_id AS from_id, target_id AS to_id FROM sup WHERE owner_id <> target_id",
    "pe": """SELECT DISTINCT t.component_id AS from_id, b.component_id AS to_id FROM (SELECT component_id, package_name, unnest(regexp_extract_all(code_text, '[\\p{L}\\p{N}_]+')) AS s FROM c0 WHERE package_name <> '') t
        JOIN c0 b ON b.package_name = t.package_name AND b.simple_name = t.s AND length(b.simple_name) >= 2 WHERE t.component_id <> b.component_id""",
    "edges": "SELECT * FROM ie UNION SELECT * FROM se UNION SELECT * FROM pe",
    "impl": "SELECT DISTINCT target_id AS iface_id, owner_id AS impl_id FROM sup JOIN c0 ON component_id = target_id WHERE is_interface AND owner_id <> target_id",
    "exact": "SELECT qualified_name AS q, max(symbol_id) AS id FROM symbols GROUP BY 1",
    "lone": "SELECT split_part(name, '.', -1) AS s, count(*) AS n, min(symbol_id) AS id FROM symbols GROUP BY 1",
    "rimp": "SELECT file, target_name, arg_min(target_qualified_name, ref_id) AS q FROM refs WHERE kind = 'IMPORT' GROUP BY 1, 2",
    "resolved": """SELECT r.*, coalesce(e.id, CASE WHEN l.n = 1 THEN l.id WHEN l.n > 1 THEN e2.id END) AS symbol_id FROM refs r LEFT JOIN exact e ON e.q = r.target_qualified_name
        LEFT JOIN lone l ON l.s = r.target_name LEFT JOIN rimp i ON i.file = r.file AND i.target_name = r.target_name LEFT JOIN exact e2 ON e2.q = i.q""",
    "used": """SELECT DISTINCT s.symbol_id, x.ref_id FROM (SELECT ref_id, file, line, id AS symbol_id FROM refs JOIN (SELECT qualified_name AS q, symbol_id AS id FROM symbols) ON q = target_qualified_name
        UNION ALL SELECT ref_id, file, line, symbol_id FROM resolved WHERE symbol_id IS NOT NULL) x JOIN symbols s USING (symbol_id) WHERE NOT (s.file = x.file AND s.line = x.line)""",
}


def check(uses: str, sql: str) -> str:
    """A statement with the named relations it uses, each with what it needs in turn."""
    names = list(BASE)
    needed: list[str] = []

    def need(n: str) -> None:
        for m in names[: names.index(n)]:
            if f" {m} " in BASE[n].replace("\n", " ").replace(")", " ").replace("(", " ") + " ":
                need(m)
        if n not in needed:
            needed.append(n)

    for n in uses.split():
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({BASE[n]})" for n in needed) + " " + sql if needed else sql


def register(name: str, uses: str = "", sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = check(uses, sql)
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(g: resolve.CodeGraph) -> graph.Dependencies:
    return graph.dependencies(g, g.components)


def _over_graph(name: str, uses: str, sql: str | None, build) -> None:
    register(name, uses, sql)(lambda spark, sf_dir: build(code_graph(spark, sf_dir)))


_over_graph(
    "hub_classes",
    "c0 edges",
    """SELECT hub, n_edges, count(*) AS dependent_count, string_agg(dep_name, ',' ORDER BY dep_name, dep) AS dependents FROM (
        SELECT t.qualified_name AS hub, f.simple_name AS dep_name, f.qualified_name AS dep, h.n_edges FROM edges JOIN c0 t ON t.component_id = to_id JOIN c0 f ON f.component_id = from_id
        JOIN (SELECT qualified_name AS q, count(*) AS n_edges FROM edges JOIN c0 ON component_id = to_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) h ON h.q = t.qualified_name GROUP BY ALL)
    GROUP BY hub, n_edges""",
    lambda g: graph.hub_classes(g.components, _edges(g)),
)
flagship = QUERIES["hub_classes"]
_over_graph("import_edges", "ie", "SELECT * FROM ie", graph.import_edges)
_over_graph("supertype_resolve_ladder", "sup", "SELECT * FROM sup", resolve.resolved_supertypes)
_over_graph("same_package_edges", "pe", "SELECT * FROM pe", lambda g: graph.same_package_edges(g.components, g.components))
_over_graph("edge_union_distinct", "edges", "SELECT * FROM edges", lambda g: _edges(g).edges())
_over_graph(
    "graph_roots",
    "c0 edges",
    "SELECT component_id, qualified_name FROM c0 WHERE NOT is_data_class AND component_id IN (SELECT from_id FROM edges) AND component_id NOT IN (SELECT to_id FROM edges)",
    lambda g: graph.graph_roots(g.components, _edges(g)).select("component_id", "qualified_name"),
)
_over_graph("role_of_component", "c", "SELECT component_id, role FROM c", lambda g: g.components.select("component_id", "role"))
_over_graph(
    "layer_of_package",
    "c0",
    "SELECT DISTINCT package_name, CASE " + " ".join(f"WHEN lower(split_part(package_name, '.', -1)) IN {v} THEN '{k}'" for k, v in exprs.LAYERS.items()) + " ELSE 'OTHER' END AS layer FROM c0",
    lambda g: g.components.select("package_name").distinct().withColumn("layer", exprs.layer(F.col("package_name"))),
)


_over_graph(
    "layer_of_component",
    "c0",
    "SELECT component_id, CASE WHEN contains(path, '/test/') THEN 'TEST' " + " ".join(f"WHEN lower(split_part(package_name, '.', -1)) IN {v} THEN '{k}'" for k, v in exprs.LAYERS.items()) + " ELSE 'OTHER' END AS layer FROM c0",
    lambda g: g.components.select("component_id", exprs.layer(F.col("package_name"), exprs.is_test_path(F.col("path"))).alias("layer")),
)


def package_prefix(components: DataFrame) -> DataFrame:
    """One row: the longest segment-wise prefix of all non-empty packages; least and greatest array decide it."""
    p = components.filter("package_name <> ''").select(F.split("package_name", r"\.").alias("p")).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    same = F.transform(F.arrays_zip("a", "b"), lambda x: F.when(x["a"] == x["b"], F.lit(1)).otherwise(0))
    stop = F.coalesce(F.nullif(F.array_position(same, 0), F.lit(0).cast("long")), F.least(F.size("a"), F.size("b")) + 1)
    return p.select(F.array_join(F.slice("a", F.lit(1), (stop - 1).cast("int")), ".").alias("prefix"))


_PREFIX = """prefix AS (SELECT array_to_string(list_filter(a[1:least(len(a), len(b))], lambda x, i: a[1:i] = b[1:i]), '.') AS prefix FROM
    (SELECT min(string_split(package_name, '.')) AS a, max(string_split(package_name, '.')) AS b FROM c0 WHERE package_name <> ''))"""
register("common_package_prefix")(lambda spark, sf_dir: package_prefix(table(spark, sf_dir, COMPONENTS)))
ORACLES["common_package_prefix"] = check("c0", "SELECT 1").removesuffix(" SELECT 1") + f", {_PREFIX} SELECT prefix FROM prefix"


@register("package_group")
def _package_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, COMPONENTS)
    df = c.crossJoin(F.broadcast(package_prefix(c)))
    rest = F.when(F.col("package_name").startswith(F.col("prefix")), F.expr("substring(package_name, length(prefix) + 1)")).otherwise(F.col("package_name"))
    group = F.substring_index(F.regexp_replace(rest, r"^\.", ""), ".", 1)
    return df.select("component_id", F.when((F.col("package_name") == "") | (group == ""), "(root)").otherwise(group).alias("package_group"))


ORACLES["package_group"] = check("c0", "SELECT 1").removesuffix(" SELECT 1") + (
    f", {_PREFIX} SELECT component_id, coalesce(nullif(split_part(regexp_replace(CASE WHEN starts_with(package_name, prefix) THEN substr(package_name, length(prefix) + 1) ELSE package_name END, '^\\.', ''), '.', 1), ''), '(root)') AS package_group FROM c0, prefix"
)

_TESTLIKE = "path LIKE '%/test/%'"


def plugins(g: resolve.CodeGraph, methods: DataFrame) -> DataFrame:
    """component_id of components that declare `apply` and extend something named a plugin: methods(component_id, name)."""
    named = g.supertypes.filter(F.col("name").contains("Plugin")).select("component_id").distinct()
    return methods.filter("name = 'apply'").select("component_id").distinct().join(named, "component_id", "left_semi")


def entry_points(g: resolve.CodeGraph, edges: DataFrame | graph.Dependencies, methods: DataFrame | None = None) -> DataFrame:
    """TEST over MOCK over APP (a main function, a controller or, with methods given, a plugin); the first of a qualified
    name by component_id. Where nothing qualifies, the graph's roots are APP."""
    n = F.col("simple_name")
    if methods is None:
        components = g.components.withColumn("is_plugin", F.lit(False))
    else:
        marked = plugins(g, methods).withColumn("is_plugin", F.lit(True))
        components = g.components.join(marked, "component_id", "left").withColumn("is_plugin", F.coalesce("is_plugin", F.lit(False)))
    kind = (
        F.when(exprs.is_test_path(F.col("path")) | n.rlike("(Test|Spec)$"), "TEST")
        .when(n.rlike("Mock|Fake|Stub"), "MOCK")
        .when(F.col("has_main") | (F.col("role") == "CONTROLLER") | F.col("is_plugin"), "APP")
    )
    named = components.withColumn("kind", kind).filter("kind is not null").groupBy("qualified_name").agg(F.min(F.struct("component_id", "kind")).alias("x")).select("qualified_name", "x.kind")
    roots = graph.graph_roots(g.components, edges).select("qualified_name", F.lit("APP").alias("kind")).distinct()
    none = named.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return named.unionByName(roots.crossJoin(F.broadcast(none)).drop("n"))


# Every component runs; some parts apply, and of those some extend a plugin, as do some that do not apply.
_METHODS = "SELECT p_partkey AS component_id, 'run' AS name FROM {part} UNION ALL SELECT p_partkey, 'apply' FROM {part} WHERE p_partkey % 11 IN (3, 5)"
_PLUGIN_TYPES = "SELECT p_partkey AS component_id, CAST(9 AS BIGINT) AS pos, CASE p_partkey % 4 WHEN 0 THEN 'org.ext.Plugin' ELSE 'BuildPluginBase' END AS name FROM {part} WHERE p_partkey % 11 IN (5, 7)"
_KINDS = f"""k AS (SELECT qualified_name, component_id, CASE WHEN {_TESTLIKE} OR regexp_matches(simple_name, '(Test|Spec)$') THEN 'TEST' WHEN regexp_matches(simple_name, 'Mock|Fake|Stub') THEN 'MOCK'
      WHEN has_main OR role = 'CONTROLLER' OR component_id IN (SELECT component_id FROM m WHERE name = 'apply' INTERSECT SELECT component_id FROM p) THEN 'APP' END AS k FROM kc),
    named AS (SELECT qualified_name, arg_min(k, component_id) AS kind FROM k WHERE k IS NOT NULL GROUP BY 1)
    SELECT * FROM named UNION ALL SELECT DISTINCT qualified_name, 'APP' FROM kc WHERE NOT EXISTS (FROM named) AND NOT is_data_class AND component_id IN (SELECT from_id FROM edges) AND component_id NOT IN (SELECT to_id FROM edges)"""


def _kinds_oracle(components: str, methods: str = plain(_METHODS)) -> str:
    return check("c edges", "").rstrip() + f", m AS ({methods}), p AS ({plain(_PLUGIN_TYPES)}), kc AS ({components}), {_KINDS}"


@register("entry_points_analysis")
def _entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    with_plugins = resolve.CodeGraph(g.components, g.imports, g.supertypes.unionByName(table(spark, sf_dir, _PLUGIN_TYPES)), g.annotations)
    return entry_points(with_plugins, _edges(g), table(spark, sf_dir, _METHODS))


ORACLES["entry_points_analysis"] = _kinds_oracle("SELECT * FROM c")


@register("entry_points_of_roots")
def _entry_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helper and utility classes hold no test, mock, main function or controller, so their roots are the entries."""
    g = code_graph(spark, sf_dir)
    own = resolve.CodeGraph(g.components.filter("role IN ('HELPER', 'UTIL')"), g.imports, g.supertypes, g.annotations)
    return entry_points(own, _edges(g))


ORACLES["entry_points_of_roots"] = _kinds_oracle("SELECT * FROM c WHERE role IN ('HELPER', 'UTIL')", "SELECT NULL::BIGINT AS component_id, '' AS name")
_over_graph(
    "entry_points_report",
    "c0",
    """SELECT qualified_name, arg_min(CASE WHEN regexp_matches(lower(simple_name), '^(mock|fake|stub)|(mock|fake|stub)$') THEN 'MOCK' WHEN regexp_matches(simple_name, '(Test|Spec)$') OR path LIKE '%/test/%' THEN 'TEST' ELSE 'APP' END, component_id) AS kind
        FROM c0 WHERE NOT is_interface GROUP BY 1""",
    lambda g: g.components.filter("not is_interface")
    .withColumn("kind", F.when(exprs.mock_like(F.col("simple_name")), "MOCK").when(F.col("simple_name").rlike("(Test|Spec)$") | exprs.is_test_path(F.col("path")), "TEST").otherwise("APP"))
    .groupBy("qualified_name")
    .agg(F.min_by("kind", "component_id").alias("kind")),
)

FOUND = ["severity", "message", "file", "suggestion"]


def _rule(name: str, uses: str, sql: str | None, rule) -> None:
    _over_graph(name, uses, sql, lambda g: rule(g).select(*FOUND))


_LAST = "split_part(package_name, '.', -1)"
_FORBIDDEN = "('util', 'utils', 'helper', 'helpers', 'manager', 'managers', 'misc', 'base')"
_rule(
    "rule_smell",
    "c",
    f"""SELECT CASE WHEN {_LAST} IN {_FORBIDDEN} THEN 'FORBIDDEN' ELSE 'WARNING' END AS severity, '`' || simple_name || '` is a ' || lower(role) || ' class' AS message, path AS file,
        'Behavior in ' || lower(role) || ' classes belongs closer to where it''s used.' AS suggestion FROM c WHERE role IN ('MANAGER', 'HELPER', 'UTIL')""",
    rules.smell_classes,
)
_rule(
    "rule_forbidden_package",
    "c0",
    f"""SELECT DISTINCT 'FORBIDDEN' AS severity, 'Package `' || package_name || '` uses forbidden name `' || {_LAST} || '`' AS message, '.' AS file,
        'Rename the package to describe what it does instead of a generic name.' AS suggestion FROM c0 WHERE {_LAST} IN {_FORBIDDEN}""",
    rules.forbidden_packages,
)
_rule(
    "rule_forbidden_class",
    "c0",
    f"""SELECT 'WARNING' AS severity, '`' || simple_name || '` contains forbidden pattern `' || p || '`' AS message, path AS file, 'Rename to describe what the class does instead of using a generic name.' AS suggestion
        FROM (SELECT *, CASE WHEN contains(simple_name, 'Helper') THEN 'Helper' WHEN contains(simple_name, 'Manager') THEN 'Manager' WHEN contains(simple_name, 'Utils') THEN 'Utils' WHEN contains(simple_name, 'Util') THEN 'Util' END AS p FROM c0)
        WHERE p IS NOT NULL AND NOT {_TESTLIKE}""",
    rules.forbidden_class_names,
)
_rule(
    "rule_single_impl",
    "c0 impl",
    """SELECT 'INFO' AS severity, 'Interface `' || i.simple_name || '` has only one implementation: `' || m.simple_name || '`' AS message, i.path AS file, 'Consider using `' || m.simple_name || '` directly unless needed for testing.' AS suggestion
        FROM (SELECT iface_id, min(impl_id) AS impl_id FROM impl GROUP BY 1 HAVING count(*) = 1) x JOIN c0 i ON i.component_id = iface_id JOIN c0 m ON m.component_id = impl_id""",
    rules.single_implementations,
)
_rule(
    "rule_god_class",
    "c imports",
    """SELECT 'WARNING' AS severity, '`' || simple_name || '` may be doing too much (' || concat_ws(', ', CASE WHEN n > 30 THEN n || ' imports' END, CASE WHEN n_methods > 25 THEN n_methods || ' methods' END, CASE WHEN line_count > 1000 THEN line_count || ' lines' END) || ')' AS message,
        path AS file, 'Split into smaller, focused classes with a single responsibility.' AS suggestion
        FROM c LEFT JOIN (SELECT component_id, count(*) AS n FROM imports GROUP BY 1) USING (component_id) WHERE role <> 'CONFIGURATION' AND (n > 30 OR n_methods > 25 OR line_count > 1000)""",
    rules.god_classes,
)
_CHAINS = """, up AS (SELECT s.owner_id AS id, t.component_id AS pid, t.simple_name AS n, t.qualified_name AS q FROM sup s JOIN (SELECT owner_id, min(pos) AS pos FROM sup GROUP BY 1) USING (owner_id, pos)
    JOIN c0 t ON t.component_id = target_id WHERE NOT t.is_interface),
    walk AS (SELECT component_id, component_id AS at, [qualified_name] AS seen, [simple_name] AS names FROM c0
      UNION ALL SELECT w.component_id, up.pid, list_append(seen, q), list_append(names, n) FROM walk w JOIN up ON up.id = w.at WHERE NOT list_contains(seen, q)),
    chains AS (SELECT component_id, max(len(names)) - 1 AS depth, array_to_string(arg_max(names, len(names)), ' -> ') AS chain FROM walk GROUP BY 1) """


def _recursive(uses: str, sql: str) -> str:
    return check(uses, "SELECT 1").removesuffix(" SELECT 1").replace("WITH ", "WITH RECURSIVE ", 1) + _CHAINS + sql


_over_graph("inheritance_depth", "", None, graph.inheritance_chains)
ORACLES["inheritance_depth"] = _recursive("c0 sup", "SELECT component_id, depth, chain FROM chains")
_rule("rule_deep_inheritance", "", None, rules.deep_inheritance)
ORACLES["rule_deep_inheritance"] = _recursive(
    "c0 sup",
    """SELECT 'WARNING' AS severity, '`' || simple_name || '` has inheritance depth ' || depth || ': ' || chain AS message, path AS file, 'Deep inheritance makes code rigid. Prefer composition.' AS suggestion
    FROM chains JOIN c0 USING (component_id) WHERE depth >= 3 AND NOT is_interface""",
)
_DI = """SELECT s AS severity, m AS message, path AS file, a AS suggestion FROM (
    SELECT *, row_number() OVER (PARTITION BY m ORDER BY owner_id, pos) AS rn FROM (
      SELECT x.owner_id, x.pos, o.path, CASE WHEN f.n IS NOT NULL THEN 'WARNING' ELSE 'INFO' END AS s,
        CASE WHEN f.n IS NOT NULL THEN 'Dependency on concrete `' || t.simple_name || '` instead of interface `' || f.n || '`' ELSE 'Dependency on concrete class `' || t.simple_name || '` in `' || o.simple_name || '`' END AS m,
        CASE WHEN f.n IS NOT NULL THEN 'Depend on `' || f.n || '` instead of the concrete class.' ELSE 'Consider extracting an interface for `' || t.simple_name || '`.' END AS a
      FROM (SELECT i.component_id AS owner_id, i.pos, coalesce(f2.id, f3.id, u.id) AS target_id FROM imports i JOIN c0 o USING (component_id) JOIN imp1 i1 ON i1.component_id = i.component_id AND i1.s = split_part(i.name, '.', -1)
            LEFT JOIN fqn f2 ON f2.q = i1.q LEFT JOIN fqn f3 ON f3.q = o.package_name || '.' || i1.s LEFT JOIN uniq u ON u.s = i1.s) x
      JOIN c0 o ON o.component_id = x.owner_id JOIN c0 t ON t.component_id = x.target_id
      LEFT JOIN (SELECT owner_id, arg_min(simple_name, pos) AS n FROM sup JOIN c0 ON component_id = target_id WHERE is_interface GROUP BY 1) f ON f.owner_id = x.target_id
      WHERE o.path NOT LIKE '%/test/%' AND NOT o.is_interface AND NOT (t.is_interface OR t.is_abstract OR t.is_data_class))) WHERE rn = 1"""
_rule("rule_dependency_inversion", "c0 imports imp1 fqn uniq sup", _DI, rules.dependency_inversion)
_OPEN = f"""SELECT component_id, simple_name, path FROM c WHERE NOT {_TESTLIKE} AND role NOT IN ('OTHER', 'CONFIGURATION', 'ENTITY') AND NOT is_interface AND NOT is_data_class
    AND simple_name NOT IN (SELECT regexp_replace(regexp_replace(simple_name, 'Test$', ''), 'Spec$', '') FROM c WHERE {_TESTLIKE})"""
_rule(
    "rule_missing_test",
    "c",
    f"""SELECT 'INFO' AS severity, n || ' classes have no corresponding test file' AS message, '.' AS file, 'Consider adding tests for key components, especially: ' || p AS suggestion
        FROM (SELECT count(*) AS n FROM ({_OPEN})), (SELECT string_agg('`' || simple_name || '`', ', ' ORDER BY component_id) AS p FROM (SELECT * FROM ({_OPEN}) ORDER BY component_id LIMIT 5)) WHERE n > 10
        UNION ALL SELECT 'INFO', '`' || simple_name || '` has no test', path, 'Consider adding `' || simple_name || 'Test`.' FROM ({_OPEN}) WHERE (SELECT count(*) FROM ({_OPEN})) <= 10""",
    rules.missing_tests,
)


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), "event_id").filter("b is not null")


_TRANS = "t AS (SELECT DISTINCT a, b FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND a <> b)"
_CYCLES = f"""WITH RECURSIVE {_TRANS},
    w AS (SELECT a AS head, b AS last, [a, b] AS nodes FROM t WHERE a < b UNION ALL SELECT head, t.b, list_append(nodes, t.b) FROM w JOIN t ON t.a = w.last WHERE t.b > head AND NOT list_contains(nodes, t.b)),
    cycles AS (SELECT array_to_string(list_append(nodes, head), ' -> ') AS path FROM w JOIN t ON t.a = w.last AND t.b = w.head) """
register("canonical_cycles")(lambda spark, sf_dir: graph.canonical_cycles(_transitions(spark, sf_dir)))
ORACLES["canonical_cycles"] = _CYCLES + "SELECT path FROM cycles"
# The walk itself as a recursion, one move a row: take the next start, follow the next edge, or step back. `adj` lists
# the edges between nodes that reach each other; `seen` are nodes entered, `at` how many edges each open node has used.
_WALK = """WITH RECURSIVE e AS (SELECT project, a, b, min(ord) AS ord FROM raw WHERE a <> b GROUP BY ALL),
    reach AS (SELECT project, a, b FROM e UNION SELECT r.project, r.a, e.b FROM reach r JOIN e ON e.project = r.project AND e.a = r.b),
    inner_e AS (SELECT e.* FROM e JOIN reach r ON r.project = e.project AND r.a = e.b AND r.b = e.a),
    adj AS (SELECT project, a, list(b ORDER BY ord, b) AS bs, min(ord) AS first FROM inner_e GROUP BY 1, 2),
    g AS (SELECT project, list(a ORDER BY first, a) AS starts, map(list(a), list(bs)) AS follow FROM adj GROUP BY 1),
    dfs AS (SELECT project, starts, follow, 0 AS n, CAST([] AS VARCHAR[]) AS stack, CAST([] AS BIGINT[]) AS pos, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR[]) AS path FROM g
      UNION ALL
      SELECT project, starts, follow, n + 1,
        CASE WHEN len(stack) = 0 THEN [start] WHEN b IS NULL THEN stack[1 : len(stack) - 1] WHEN list_contains(seen, b) THEN stack ELSE list_append(stack, b) END,
        CASE WHEN len(stack) = 0 THEN [CAST(0 AS BIGINT)] WHEN b IS NULL THEN pos[1 : len(pos) - 1] WHEN list_contains(seen, b) THEN used ELSE list_append(used, 0) END,
        CASE WHEN len(stack) = 0 THEN list_append(seen, start) WHEN b IS NULL OR list_contains(seen, b) THEN seen ELSE list_append(seen, b) END,
        CASE WHEN len(stack) > 0 AND list_contains(stack, b) THEN list_append(stack[list_position(stack, b) :], b) END
      FROM (SELECT *, list_filter(starts, lambda x: NOT list_contains(seen, x))[1] AS start, CASE WHEN len(stack) > 0 THEN follow[stack[-1]][pos[-1] + 1] END AS b,
              CASE WHEN len(pos) > 0 THEN list_append(pos[1 : len(pos) - 1], pos[-1] + 1) END AS used FROM dfs)
      WHERE len(stack) > 0 OR start IS NOT NULL),
    cycles AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY n) - 1 AS ord, array_to_string(path, ' -> ') AS path FROM dfs WHERE path IS NOT NULL) """
_ONE_GRAPH = "raw AS (SELECT 'events' AS project, a, b, event_id AS ord FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id FROM events) WHERE b IS NOT NULL)"
_BY_USER = _ONE_GRAPH.replace("'events' AS project", "CAST(user_id AS VARCHAR) AS project").replace("AS b, event_id FROM", "AS b, event_id, user_id FROM")


def _walked(raw: str, sql: str) -> str:
    return _WALK.replace("WITH RECURSIVE ", f"WITH RECURSIVE {raw}, ", 1) + sql


def _event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transitions(spark, sf_dir).groupBy("a", "b").agg(F.min("event_id").alias("ord")).withColumn("project", F.lit("events"))
    return graph.back_edge_cycles(t)


_CIRCULAR = "SELECT 'WARNING' AS severity, 'Circular dependency: ' || path AS message, '.' AS file, 'Break the cycle by extracting a shared interface or moving shared logic to a separate class.' AS suggestion"
register("rule_circular")(lambda spark, sf_dir: rules.circular_dependencies(_event_cycles(spark, sf_dir)).select(*FOUND))
ORACLES["rule_circular"] = _walked(_ONE_GRAPH, f"{_CIRCULAR} FROM cycles WHERE ord < 10")


@register("cycles_by_project")
def _cycles_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's transitions are the graph of one project."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("project"), F.col("event_id").alias("ord"), F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    return graph.back_edge_cycles(t.filter("b is not null")).select("project", F.col("ord").cast("long").alias("ord"), F.array_join("path", " -> ").alias("path"))


ORACLES["cycles_by_project"] = _walked(_BY_USER, "SELECT project, ord, path FROM cycles")
register("cycles_of_components")(lambda spark, sf_dir: _component_cycles(code_graph(spark, sf_dir)))


def _component_cycles(g: resolve.CodeGraph) -> DataFrame:
    return graph.component_cycles(g.components, _edges(g)).select(F.col("ord").cast("long").alias("ord"), F.array_join("path", " -> ").alias("path"))


@register("findings_sorted")
def _findings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.in_report_order(rules.all_findings(code_graph(spark, sf_dir), _event_cycles(spark, sf_dir)))
    return found.select("ord", "severity_rank", "file", "rule_ord", "message")


def _sorted_oracle() -> str:
    """All nine rules' statements, numbered by severity, file, rule, item and message; items are the rules' own."""
    tables = ", ".join(f"{n} AS ({BASE[n]})" for n in BASE if n not in ("symbols", "refs", "exact", "lone", "rimp", "resolved", "used"))
    items = f"""r1 AS (SELECT component_id AS item, path AS file, CASE WHEN {_LAST} IN {_FORBIDDEN} THEN 'FORBIDDEN' ELSE 'WARNING' END AS severity, '`' || simple_name || '` is a ' || lower(role) || ' class' AS message FROM c WHERE role IN ('MANAGER', 'HELPER', 'UTIL')),
    r2 AS (SELECT min(component_id) AS item, '.' AS file, 'FORBIDDEN' AS severity, 'Package `' || package_name || '` uses forbidden name `' || {_LAST} || '`' AS message FROM c0 WHERE {_LAST} IN {_FORBIDDEN} GROUP BY package_name),
    r3 AS (SELECT component_id AS item, path AS file, 'WARNING' AS severity, '`' || simple_name || '` contains forbidden pattern `' || p || '`' AS message FROM (SELECT *, regexp_extract(simple_name, 'Helper|Manager|Utils|Util') AS p FROM c0) WHERE p <> '' AND NOT {_TESTLIKE}),
    r4 AS (SELECT iface_id AS item, i.path AS file, 'INFO' AS severity, 'Interface `' || i.simple_name || '` has only one implementation: `' || m.simple_name || '`' AS message FROM (SELECT iface_id, min(impl_id) AS impl_id FROM impl GROUP BY 1 HAVING count(*) = 1) x JOIN c0 i ON i.component_id = iface_id JOIN c0 m ON m.component_id = impl_id),
    r5 AS (SELECT component_id AS item, path AS file, 'WARNING' AS severity, '`' || simple_name || '` may be doing too much (' || concat_ws(', ', CASE WHEN n > 30 THEN n || ' imports' END, CASE WHEN n_methods > 25 THEN n_methods || ' methods' END, CASE WHEN line_count > 1000 THEN line_count || ' lines' END) || ')' AS message
      FROM c LEFT JOIN (SELECT component_id, count(*) AS n FROM imports GROUP BY 1) USING (component_id) WHERE role <> 'CONFIGURATION' AND (n > 30 OR n_methods > 25 OR line_count > 1000)),
    r6 AS (SELECT component_id AS item, path AS file, 'WARNING' AS severity, '`' || simple_name || '` has inheritance depth ' || depth || ': ' || chain AS message FROM chains JOIN c0 USING (component_id) WHERE depth >= 3 AND NOT is_interface),
    r7 AS (SELECT ord AS item, '.' AS file, 'WARNING' AS severity, 'Circular dependency: ' || path AS message FROM cycles WHERE ord < 10),
    r8 AS ({_DI.replace("SELECT s AS severity, m AS message, path AS file, a AS suggestion FROM", "SELECT owner_id AS item, path AS file, s AS severity, m AS message FROM", 1)}),
    r9 AS (SELECT 0 AS item, '.' AS file, 'INFO' AS severity, n || ' classes have no corresponding test file' AS message FROM (SELECT count(*) AS n FROM ({_OPEN})) WHERE n > 10
      UNION ALL SELECT component_id, path, 'INFO', '`' || simple_name || '` has no test' FROM ({_OPEN}) WHERE (SELECT count(*) FROM ({_OPEN})) <= 10)"""
    every = " UNION ALL ".join(f"SELECT {i} AS rule_ord, item, file, severity, message FROM r{i}" for i in range(1, 10))
    walk = _WALK.replace("WITH RECURSIVE ", "", 1)
    return f"""WITH RECURSIVE {tables}{_CHAINS}, {_ONE_GRAPH}, {walk}, {items}, f AS (SELECT *, CASE severity WHEN 'FORBIDDEN' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS severity_rank FROM ({every}))
    SELECT row_number() OVER (ORDER BY severity_rank, file, rule_ord, item, message) AS ord, severity_rank, file, rule_ord, message FROM f"""


ORACLES["findings_sorted"] = _sorted_oracle()


_over_graph("greedy_chain", "", None, lambda g: graph.greedy_chains(g.components, _edges(g), g.components.filter("has_main")))
ORACLES["greedy_chain"] = check("c edges", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT from_id, count(*) AS n FROM edges GROUP BY 1),
    nb AS (SELECT e.from_id AS node, list(e.to_id ORDER BY coalesce(n, 0) DESC, e.to_id) AS nb FROM edges e JOIN c ON component_id = to_id AND role <> 'CONFIGURATION' LEFT JOIN o ON o.from_id = e.to_id GROUP BY 1),
    walk AS (SELECT component_id AS entry, [component_id] AS nodes FROM c WHERE has_main
      UNION ALL SELECT entry, list_append(nodes, x) FROM (SELECT entry, nodes, list_filter(nb, lambda y: NOT list_contains(nodes, y))[1] AS x FROM walk JOIN nb ON node = nodes[-1] WHERE len(nodes) <= 6) WHERE x IS NOT NULL)
    SELECT entry, array_to_string(arg_max(nodes, len(nodes)), ' -> ') AS chain FROM walk GROUP BY 1"""


@register("code_line_count")
def _code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commented(spark, sf_dir).select("doc_id", exprs.code_lines(F.col("code")).alias("n_code"))


def _commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with comments put before, into and behind their lines."""
    return _read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE doc_id % 4 WHEN 0 THEN concat('// head\n', text) WHEN 1 THEN concat('/* a\n b */\n', text, '\n  // tail') WHEN 2 THEN concat('x /* y */ z\n', text, '\n/* open') ELSE text END AS code"
    )


_COMMENTED = "d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '// head' || chr(10) || text WHEN 1 THEN '/* a' || chr(10) || ' b */' || chr(10) || text || chr(10) || '  // tail' WHEN 2 THEN 'x /* y */ z' || chr(10) || text || chr(10) || '/* open' ELSE text END AS code FROM documents)"
ORACLES["code_line_count"] = f"""WITH {_COMMENTED}, l AS (SELECT doc_id, unnest(string_split_regex(code, '\\r\\n|\\n|\\r')) AS s FROM d)
    SELECT doc_id, count(*) FILTER (WHERE trim(s, chr(32) || chr(9) || chr(13)) <> '' AND NOT starts_with(ltrim(s), '//') AND NOT starts_with(ltrim(s), '/*') AND NOT s = ' b */') AS n_code FROM l GROUP BY 1"""


@register("strip_comments")
def _strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commented(spark, sf_dir).select("doc_id", F.sha2(exprs.strip_comments(F.col("code")), 256).alias("code_sha256"))


ORACLES["strip_comments"] = f"""WITH {_COMMENTED}, r AS (SELECT doc_id, string_split(regexp_replace(code, '/\\*[\\s\\S]*?\\*/', '', 'g'), chr(10)) AS s FROM d)
    SELECT doc_id, sha256(array_to_string(list_filter(s, lambda x: NOT starts_with(ltrim(x), '//')), chr(10))) AS code_sha256 FROM r"""


def _index(name: str, uses: str, sql: str | None, build) -> None:
    register(name, uses, sql)(lambda spark, sf_dir: build(table(spark, sf_dir, SYMBOLS), table(spark, sf_dir, REFS)))


_index("symbol_resolve", "resolved", "SELECT ref_id, symbol_id FROM resolved", lambda s, r: index.resolve_refs(s, r).select("ref_id", "symbol_id"))
_index("find_usages", "used", "SELECT * FROM used", index.usages)
_index("usage_counts", "symbols used", "SELECT symbol_id, qualified_name, count(*) AS n_usages FROM used JOIN symbols USING (symbol_id) WHERE kind NOT IN ('FUNCTION', 'PROPERTY') GROUP BY 1, 2", index.usage_counts)
_index(
    "asof_containing_method",
    "symbols refs",
    "SELECT ref_id, symbol_id AS caller_id FROM refs r ASOF LEFT JOIN (SELECT file, line, min(symbol_id) AS symbol_id FROM symbols WHERE kind = 'FUNCTION' GROUP BY 1, 2) s ON r.file = s.file AND r.line >= s.line",
    lambda s, r: index.containing_methods(s, r).select("ref_id", "caller_id"),
)
_index(
    "call_graph",
    "symbols refs",
    """, m AS (SELECT r.*, s.symbol_id AS caller_id FROM refs r ASOF JOIN (SELECT file, line, min(symbol_id) AS symbol_id FROM symbols WHERE kind = 'FUNCTION' GROUP BY 1, 2) s ON r.file = s.file AND r.line >= s.line WHERE r.kind = 'CALL'),
    x AS (SELECT coalesce(starts_with(t.qualified_name, m.receiver || '.'), FALSE) AS own, m.ref_id, a.qualified_name AS caller, t.qualified_name AS target, m.file, m.line, t.file AS tf, t.line AS tl, a.package_name = t.package_name AS same,
        regexp_replace(t.qualified_name, '\\.[^.]*$', '') = regexp_replace(a.qualified_name, '\\.[^.]*$', '') OR EXISTS (SELECT 1 FROM refs i WHERE i.kind = 'IMPORT' AND i.file = m.file AND i.target_qualified_name = regexp_replace(t.qualified_name, '\\.[^.]*$', '')) AS near
        FROM m JOIN symbols a ON a.symbol_id = m.caller_id JOIN symbols t ON t.kind = 'FUNCTION' AND split_part(t.name, '.', -1) = m.target_name),
    y AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE own) OVER w AS nr, count(*) FILTER (WHERE near) OVER w AS nn, count(*) FILTER (WHERE same) OVER w AS ns FROM x WINDOW w AS (PARTITION BY ref_id))
    SELECT DISTINCT caller, target FROM y WHERE CASE WHEN nr > 0 AND n > 1 THEN own WHEN nn > 0 AND nn < n THEN near WHEN ns > 0 AND ns < n THEN same ELSE TRUE END AND NOT (tf = file AND tl = line) AND caller <> target""",
    index.call_graph,
)
ORACLES["call_graph"] = ORACLES["call_graph"].replace(") , m AS", "), m AS")


# Builds are regions, projects nations, symbols customers, findings of them by account balance.
def _tree(spark: SparkSession, sf_dir: str, rows: str, key: str) -> DataFrame:
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("build"), F.col("n_name").alias("project"))
    return _read(spark, sf_dir, rows).join(F.broadcast(places), F.col(key) == F.col("n_nationkey"))


def _severity(balance: str):
    return F.when(F.col(balance) < 0, "WARNING").otherwise("INFO").alias("severity")


@register("project_table", "", """SELECT r_name AS build, n_name AS project, count(*) AS n_symbols, count(*) FILTER (WHERE c_acctbal < 0) AS n_warnings FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def _project_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tree(spark, sf_dir, "customer", "c_nationkey").select("build", "project", _severity("c_acctbal"))
    return rollup.totals(c, c, ["build", "project"])


@register("dashboard_totals", "", """SELECT r_name AS build, count(*) AS n_symbols, count(*) FILTER (WHERE c_acctbal < 0) AS n_warnings FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tree(spark, sf_dir, "customer", "c_nationkey").select("build", "project", _severity("c_acctbal"))
    return rollup.totals(c, c, ["build"])


@register(
    "workspace_hubs",
    "",
    "SELECT r_name AS build, s_name AS name, count(*) AS dependent_count FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 30",
)
def _workspace_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("dependent_count"))
    s = _tree(spark, sf_dir, "supplier", "s_nationkey").select("s_suppkey", "build", F.col("s_name").alias("name"))
    return rollup.workspace_hubs(counts.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("build", "name", "dependent_count"))


@register("findings_dedup", "", "SELECT message, build FROM (SELECT c_mktsegment || c_nationkey AS message, r_name AS build, row_number() OVER (PARTITION BY c_mktsegment || c_nationkey ORDER BY r_regionkey, c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE n = 1")
def _findings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tree(spark, sf_dir, "customer", "c_nationkey").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("build") == F.col("r_name"))
    found = c.select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("message"), "build", F.col("r_regionkey").alias("src_ord"), F.col("c_custkey").alias("item"))
    return rollup.distinct_findings(found).select("message", "build")


@register("build_edges", "", "SELECT DISTINCT 'b' || (l_suppkey % 40) AS from_build, 'b' || (l_partkey % 50) AS to_build FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 50 AND l_partkey % 50 < 40")
def _build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = _read(spark, sf_dir, "lineitem").selectExpr("concat('b', cast(l_suppkey % 40 as string)) AS build", "concat('b', cast(l_partkey % 50 as string)) AS artifact")
    builds = spark.range(40).selectExpr("concat('b', cast(id as string)) AS build")
    return rollup.build_edges(deps, builds)


@register(
    "deps_by_scope",
    "",
    "SELECT build, scope, row_number() OVER (PARTITION BY build ORDER BY f, scope) AS scope_ord, a AS artifacts FROM (SELECT l_orderkey AS build, l_returnflag AS scope, min(l_linenumber) AS f, string_agg('a' || l_partkey, ', ' ORDER BY l_linenumber, 'a' || l_partkey) AS a FROM lineitem GROUP BY 1, 2)",
)
def _deps_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS build", "l_returnflag AS scope", "concat('a', cast(l_partkey as string)) AS artifact", "l_linenumber AS ord")
    return rollup.dependencies_by_scope(deps, ["build"])


_CLASSES = "SELECT CASE event_id % 6 WHEN 0 THEN 'IThing' WHEN 1 THEN 'Thing' WHEN 2 THEN 'DefaultThing' WHEN 3 THEN 'MockIThing' WHEN 4 THEN 'Repository' ELSE 'THING_' END || CAST(event_id % 29 AS STRING) || CASE event_id % 5 WHEN 0 THEN 'Impl' WHEN 1 THEN 'Service' ELSE '' END AS name FROM {events}"
register(
    "interface_candidates",
    "",
    f"""WITH n AS (SELECT DISTINCT name FROM ({plain(_CLASSES)})),
    i AS (SELECT name, CASE WHEN starts_with(name, 'I') THEN substr(name, 2) ELSE name END AS base FROM n WHERE NOT regexp_matches(name, '^[A-Z0-9_]+$') AND (regexp_matches(name, '(Service|Repository|Provider|Factory)$') OR (regexp_matches(name, '^I[A-Z]') AND length(name) > 2))),
    m AS (SELECT name AS impl FROM n WHERE NOT regexp_matches(lower(name), '^(mock|fake|stub)|(mock|fake|stub)$'))
    SELECT name, count(impl) AS n_impl, bool_or(name IN (SELECT x.name FROM i x JOIN n ON n.name IN ('Mock' || x.name, x.name || 'Mock', 'Fake' || x.name, x.name || 'Fake'))) AS has_mock
    FROM i LEFT JOIN m ON impl <> name AND (impl = base || 'Impl' OR impl = 'Default' || base OR (ends_with(impl, base) AND impl <> base)) GROUP BY 1""",
)(lambda spark, sf_dir: rollup.interface_candidates(table(spark, sf_dir, _CLASSES)))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Kotlin file for every part and supplier."""
    head = "CASE WHEN package_name = '' THEN '' ELSE concat('package ', package_name, '\\n\\n') END"
    word = "CASE component_id % 3 WHEN 0 THEN 'data class' WHEN 1 THEN 'class' ELSE 'interface' END"
    body = (
        f"concat({head}, 'import java.util.UUID\\nimport com.shop.supplier.S', component_id % 10, '\\n\\n@Service(\"x\")\\n', {word}, ' ', simple_name, '(val id: Int) : S', component_id % 10, "
        "'(id), Face {\\n  // fun no()\\n  fun m0() = helper(1)\\n  fun m1(): String { return \"}\" }\\n  val p = Made(\"{\")\\n}\\n')"
    )
    return spread(table(spark, sf_dir, COMPONENTS)).selectExpr("concat('/src/main/kotlin/', component_id, '.kt') AS path", "'kt' AS ext", f"{body} AS text")


_BASED = "b AS (SELECT *, '/src/main/kotlin/' || component_id || '.kt' AS file, CASE WHEN package_name = '' THEN 5 ELSE 7 END AS l FROM c0)"
register("extract_symbols")(lambda spark, sf_dir: files.symbols_of(files.parse_files(_rendered(spark, sf_dir))).drop("ord"))
ORACLES["extract_symbols"] = check("c0", "SELECT 1").removesuffix(" SELECT 1") + f""", {_BASED}
    SELECT file AS path, simple_name AS name, qualified_name, CASE component_id % 3 WHEN 0 THEN 'DATA_CLASS' WHEN 1 THEN 'CLASS' ELSE 'INTERFACE' END AS kind, l AS line, package_name FROM b
    UNION ALL SELECT file, simple_name || '.' || m, qualified_name || '.' || m, k, l + d, package_name FROM b, (VALUES ('m0', 'FUNCTION', 2), ('m1', 'FUNCTION', 3), ('p', 'PROPERTY', 4)) v(m, k, d)"""
register("extract_refs")(lambda spark, sf_dir: files.refs_of(files.parse_files(_rendered(spark, sf_dir))).drop("ord", "qualifier"))
ORACLES["extract_refs"] = check("c0", "SELECT 1").removesuffix(" SELECT 1") + f""", {_BASED}, r AS (SELECT file, l, 'S' || component_id % 10 AS s FROM b)
    SELECT file AS path, 'UUID' AS target_name, 'java.util.UUID' AS target_qualified_name, 'IMPORT' AS kind, l - 4 AS line, 'import java.util.UUID' AS context FROM r
    UNION ALL SELECT file, s, 'com.shop.supplier.' || s, 'IMPORT', l - 3, 'import com.shop.supplier.' || s FROM r
    UNION ALL SELECT file, s, 'com.shop.supplier.' || s, 'SUPERTYPE', l, s FROM r UNION ALL SELECT file, 'Face', NULL, 'SUPERTYPE', l, 'Face' FROM r
    UNION ALL SELECT file, 'helper', NULL, 'CALL', l + 2, 'helper(1)' FROM r UNION ALL SELECT file, 'Made', NULL, 'CONSTRUCTOR', l + 4, 'Made("{{")' FROM r""".replace("{{", "{")
register("extract_metadata")(
    lambda spark, sf_dir: files.metadata_of(_rendered(spark, sf_dir)).select(
        "path", "qualified_name", "is_interface", "is_data_class", "line_count", "declaration_line", *[F.array_join(c, ",").alias(c) for c in ("imports", "annotations", "supertypes", "methods")]
    )
)
ORACLES["extract_metadata"] = check("c0", "SELECT 1").removesuffix(" SELECT 1") + f""", {_BASED}
    SELECT file AS path, qualified_name, component_id % 3 = 2 AS is_interface, component_id % 3 = 0 AS is_data_class, CASE WHEN l = 5 THEN 8 ELSE 9 END AS line_count, l AS declaration_line,
      'com.shop.supplier.S' || component_id % 10 AS imports, 'Service' AS annotations, 'S' || component_id % 10 || ',Face' AS supertypes, 'm0,m1' AS methods FROM b"""
_SCRIPTS = "SELECT 'b' || CAST(l_orderkey AS STRING) AS path, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'default' WHEN 2 THEN 'implementation' ELSE 'testImplementation' END AS scope, 'g' || CAST(l_suppkey AS STRING) AS g, 'a' || CAST(l_partkey AS STRING) AS a, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ':1.0' END AS v FROM {lineitem}"


@register("dependency_parse", "", f"SELECT path, scope, g AS artifact_group, a AS artifact, '1.0' AS version FROM ({plain(_SCRIPTS)}) WHERE v <> '' AND scope <> 'default'")
def _dependency_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  "), "scope", F.lit('("'), "g", F.lit(":"), "a", "v", F.lit('")'))
    scripts = table(spark, sf_dir, _SCRIPTS).groupBy("path").agg(F.concat(F.lit("dependencies {\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n}")).alias("text"))
    return files.script_dependencies(scripts).drop("ord")


_over_graph(
    "mermaid_nodes",
    "c0 edges",
    """SELECT DISTINCT '        ' || regexp_replace(qualified_name, '[^a-zA-Z0-9]', '_', 'g') || '[' || simple_name || ']' AS line FROM c0 WHERE qualified_name IN (SELECT qualified_name FROM c0 JOIN (SELECT from_id AS i FROM edges UNION SELECT to_id FROM edges) ON i = component_id)""",
    lambda g: reports.dependency_diagram(g.components.withColumn("package_group", F.lit("all")), _edges(g)).filter("line like '%[%]'").select("line").distinct(),
)
