"""Assembly of project and build summaries, and the tables that reports read from them.

entries(build, project, source_set, item, kind, name, package_name): the symbols of a scan, kind one of three.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.exprs import enum_like, interface_like, last_segment
from loomgraph.functions.windows import first_per_key, last_per_key
from loomgraph.operators.graph import Dependencies, graph_roots
from loomgraph.operators.rollup import named_counts, totals

# Build and configuration files that a search covers beside sources.
BUILD_FILES = ("build.gradle.kts", "settings.gradle.kts", "gradle.properties", "libs.versions.toml", "workspace.json")
CONFIG_EXTENSIONS = ("toml", "properties")
SOURCE_EXTENSIONS = ("kt", "java", "kts")
# Hubs with as many dependents get a detail tree, or stand without one.
DETAIL_DEPENDENTS = 3
SUPER_DEPENDENTS = 50
NO_RECEIVERS = ("this", "super", "it", "Companion")
CLASS_HEADER_LINES = 15


def indexable_files(paths: DataFrame) -> DataFrame:
    """paths(path): sources, build scripts and configuration, each once, outside build output and caches."""
    name = F.substring_index("path", "/", -1)
    ext = F.substring_index(name, ".", -1)
    wanted = ext.isin(*SOURCE_EXTENSIONS) | ((name.isin(*BUILD_FILES) | ext.isin(*CONFIG_EXTENSIONS)) & ~F.col("path").rlike("/(build|[.]gradle)/"))
    return paths.filter(wanted).select("path").distinct()


def source_dirs(files: DataFrame) -> DataFrame:
    """files(project, path): the conventional source directories src/<set>/kotlin and src/<set>/java that hold a file."""
    found = F.regexp_extract("path", r"^(.*?/?src/[^/]+/(?:kotlin|java))/", 1)
    return files.select("project", found.alias("dir")).filter("dir <> ''").distinct()


def source_set_dirs(sets: DataFrame) -> DataFrame:
    """sets(project_dir, source_set) with its two directories."""
    base = F.concat("project_dir", F.lit("/src/"), "source_set")
    return sets.withColumn("dirs", F.array(F.concat(base, F.lit("/kotlin")), F.concat(base, F.lit("/java"))))


def included_projects(builds: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects of included builds: builds(build, dir, relative_dir) and projects(build, identity_path, dir).

    A path loses the build's prefix, an empty one is ":", and a build without projects is its own only project.
    """
    path = F.regexp_replace("identity_path", F.concat(F.lit(r"^\Q:"), "build", F.lit(r"\E")), F.lit(""))
    own = projects.withColumn("project", F.coalesce(F.nullif(path, F.lit("")), F.lit(":"))).select("build", "project", "dir")
    lone = builds.join(projects.select("build").distinct(), "build", "left_anti").select("build", F.lit(":").alias("project"), "dir")
    return own.unionByName(lone).join(builds.select("build", "relative_dir"), "build", "left")


def declared_inputs(files: DataFrame) -> DataFrame:
    """files(project, path, text) an incremental run depends on: sources under src and build scripts, with a content key."""
    name = F.substring_index("path", "/", -1)
    source = F.col("path").rlike(r"(^|/)src/.*[.](kt|java|kts)$")
    script = name.isin("build.gradle.kts", "build.gradle", "settings.gradle.kts", "settings.gradle")
    return files.filter(source | script).select("project", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_key"))


def checked_dependencies(deps: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """deps(artifact_group, artifact, version, ...) without blank parts, and the rows that have one.

    strict: reading the first table fails on such a row; else it leaves them out.
    """
    blank = reduce(lambda a, b: a | b, [F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("artifact_group", "artifact", "version")])
    if not strict:
        return deps.filter(~blank), deps.filter(blank)
    checked = F.when(blank, F.raise_error(F.lit("a dependency has a blank group, artifact or version")).cast("string")).otherwise(F.col("artifact"))
    return deps.withColumn("artifact", checked), deps.filter(blank)


def symbol_entries(symbols: DataFrame) -> DataFrame:
    """symbols(name, kind, package_name, file, line, source_dir) as report entries: last name, three kinds, relative path."""
    kind = F.when(F.col("kind").isin("FUNCTION", "PROPERTY"), F.col("kind")).otherwise("CLASS")
    relative = F.expr("CASE WHEN startswith(file, source_dir || '/') THEN substring(file, length(source_dir) + 2) ELSE file END")
    package = F.coalesce(F.nullif("package_name", F.lit("")), F.lit("_root_"))
    return symbols.withColumns({"name": last_segment(F.col("name")), "kind": kind, "package_name": package, "file": relative}).drop("source_dir")


def with_included(root: DataFrame, *builds: DataFrame) -> DataFrame:
    """Summaries of the root project and of all included builds, marked by origin (0 the root's)."""
    return reduce(DataFrame.unionByName, [df.withColumn("src_ord", F.lit(i)) for i, df in enumerate((root, *builds))])


def source_set_counts(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Functions, properties and the sorted class names of each source set."""
    count = lambda k: F.count_if(F.col("kind") == k)
    classes = F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "CLASS", F.col("name")))), ", ")
    return entries.groupBy(*keys, "source_set").agg(count("FUNCTION").alias("n_functions"), count("PROPERTY").alias("n_properties"), classes.alias("classes"))


def packages(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct packages of each project or build, sorted."""
    return entries.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("package_name")), ", ").alias("packages"))


def project_summaries(entries: DataFrame, deps: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row a project: symbols, source sets, dependencies and warnings; a project with none of them has no row."""
    sets = entries.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("source_set")), ", ").alias("source_sets"))
    needs = deps.groupBy(*keys).agg(F.count("*").alias("n_dependencies"))
    all_ = totals(entries, found, keys).join(sets, keys, "full").join(needs, keys, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    shown = all_.select(*keys, zero("n_symbols"), F.coalesce(F.nullif("source_sets", F.lit("")), F.lit("-")).alias("source_sets"), zero("n_dependencies"), zero("n_warnings"))
    return shown.filter("n_symbols > 0 or n_dependencies > 0 or source_sets <> '-'")


def by_package(components: DataFrame) -> DataFrame:
    """Components of each package as one sorted text."""
    return components.groupBy("package_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("simple_name")), ", ").alias("members"))


def hub_roles(hubs: DataFrame, components: DataFrame) -> DataFrame:
    """hubs(name, ...) with the role of the last component of that simple name."""
    named = last_per_key(components.select("component_id", "simple_name", "role"), ["simple_name"], "component_id")
    return hubs.join(named.select(F.col("simple_name").alias("name"), "role"), "name", "left")


def hub_display(hubs: DataFrame) -> DataFrame:
    """hubs(name, path, dependent_count): on a test path or not, with a detail tree, too large for one."""
    test = F.col("path").contains("/test/") | F.col("path").contains("Test")
    n = F.col("dependent_count")
    return hubs.withColumns({"is_test": test, "detailed": n >= DETAIL_DEPENDENTS, "super_node": n >= SUPER_DEPENDENTS})


def tagged_classes(entries: DataFrame, hubs: DataFrame) -> DataFrame:
    """Class entries with the role and number of dependents of the hub of their name."""
    return entries.filter("kind = 'CLASS'").join(hubs.select("name", "role", "dependent_count"), "name", "left")


def distinct_cycles(cycles: DataFrame) -> DataFrame:
    """cycles(nodes array): each list once; a rotation is another list."""
    return cycles.select("nodes").distinct()


def simple_entry_points(components: DataFrame, edges: DataFrame | Dependencies) -> DataFrame:
    """Components with a main method, then controllers, each qualified name once; the graph's roots where there is none."""
    rank = F.when(F.col("has_main"), 0).when(F.col("role") == "CONTROLLER", 1)
    named = first_per_key(components.withColumn("rank", rank).filter("rank is not null").select("qualified_name", "rank", "component_id"), ["qualified_name"], "rank", "component_id")
    none = named.limit(1).agg(F.count("*").alias("n")).filter("n = 0").drop("n")
    roots = graph_roots(components, edges).select("qualified_name", F.lit(2).alias("rank"), "component_id")
    return named.unionByName(roots.crossJoin(F.broadcast(none)))


def usages_by_name(symbols: DataFrame, totals: DataFrame, names: DataFrame) -> DataFrame:
    """names(wanted): every symbol whose last segment, name or qualified name it is, with its usages, of totals(symbol_id, n_usages)."""
    forms = F.array_distinct(F.array(last_segment(F.col("name")), F.col("name"), F.col("qualified_name")))
    hits = symbols.select("symbol_id", F.explode(forms).alias("wanted")).join(names.distinct(), "wanted")
    return hits.join(totals, "symbol_id", "left").groupBy("wanted", "symbol_id").agg(F.coalesce(F.sum("n_usages"), F.lit(0).cast("long")).alias("n_usages"))


def symbols_in_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols declared in the files (file)."""
    return symbols.join(files.select("file").distinct(), "file", "left_semi")


def call_receivers(calls: DataFrame) -> DataFrame:
    """calls(context, target_name, ...) with receiver_name: what stands before the first call of that name, if a name."""
    found = F.expr("regexp_extract(context, concat('(\\\\w+)[.]\\\\Q', target_name, '\\\\E\\\\s*[(]'), 1)")
    return calls.withColumn("receiver_name", F.when((found != "") & ~found.isin(*NO_RECEIVERS), found))


def receiver_types(classes: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, property, type): the types of properties that class headers declare.

    classes(symbol_id, file, package_name, line, lines array) are those of kind CLASS or DATA_CLASS; the header ends at
    the first later line with a brace, or after CLASS_HEADER_LINES. A type is an import (file, target_name,
    target_qualified_name), else the only symbol of that simple name, else of the class's package; the last class wins.
    """
    header = F.slice("lines", F.col("line"), F.lit(CLASS_HEADER_LINES))
    brace = F.array_position(F.transform(header, lambda s, i: (i > 0) & s.contains("{")), True)
    text = F.array_join(F.when(brace > 0, F.slice(header, F.lit(1), brace.cast("int"))).otherwise(header), "\n")
    pattern = r"(?:val|var)[ \t]+(\w+)[ \t]*:[ \t]*(\w+)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("t"))
    found = classes.filter("line between 1 and size(lines)").select("symbol_id", "file", "package_name", F.posexplode(pairs).alias("pos", "x"))
    found = found.select("symbol_id", "file", "package_name", "pos", F.col("x.p").alias("property"), F.col("x.t").alias("type_name"))
    direct = last_per_key(imports.select("file", F.col("target_name").alias("type_name"), "ref_id", F.col("target_qualified_name").alias("imported")), ["file", "type_name"], "ref_id").drop("ref_id")
    lone = symbols.groupBy(last_segment(F.col("name")).alias("type_name")).agg(F.count("*").alias("n"), F.min("qualified_name").alias("only")).filter("n = 1").drop("n")
    own = F.when(F.col("package_name") != "", F.concat("package_name", F.lit("."), "type_name"))
    typed = found.join(direct, ["file", "type_name"], "left").join(lone, "type_name", "left").withColumn("type", F.coalesce("imported", "only", own)).filter("type is not null")
    return last_per_key(typed.select("file", "property", "type", "symbol_id", "pos"), ["file", "property"], "symbol_id", "pos").select("file", "property", "type")


def interfaces_of_summaries(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The interfaces of a workspace: (name, package_name, source_set, n_impl, has_mock), each name once.

    found(message, project, project_ord, ord) names interfaces by its messages; those come first, with their project as
    package, in source set "main". classes(name, package_name, source_set, project_ord, item) add the names that read
    like interfaces, and are what implementations and mocks are looked for in. Constants in capitals and dotted names are
    none. Of several candidates the first by project and place counts. A workspace without candidates gives no row.
    """
    place = F.struct(F.lit(0).alias("kind"), F.col("project_ord").cast("long").alias("p"), F.col("ord").cast("long").alias("o"))
    named = found.select(F.regexp_extract("message", r"Interface `(\w+)` has", 1).alias("name"), F.col("project").alias("package_name"), F.lit("main").alias("source_set"), place.alias("place"))
    named = named.filter((F.col("name") != "") & ~enum_like(F.col("name")))
    place = F.struct(F.lit(1).alias("kind"), F.col("project_ord").cast("long").alias("p"), F.col("item").cast("long").alias("o"))
    alike = classes.filter(interface_like(F.col("name"))).select("name", "package_name", "source_set", place.alias("place"))
    once = named.unionByName(alike).groupBy("name").agg(F.min_by(F.struct("package_name", "source_set"), "place").alias("x")).select("name", "x.*")
    return once.join(named_counts(once.select("name"), classes.select("name").distinct()), "name")


def numbered(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Rows numbered within keys: the order in which a report prints them."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
