"""From directories to summaries: which project a file belongs to, where its sources are, and what each project holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.summary import SOURCE_EXTENSIONS, symbol_entries
from loomgraph.sources.files import parse_files, script_dependencies, symbols_of
from loomgraph.storage import cut_lineage

# Source sets that come first, in this order, and build scripts by precedence.
USUAL_SETS = ("main", "test", "androidTest", "commonMain", "commonTest")
SCRIPTS = ("build.gradle.kts", "build.gradle")


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def relative_dir(root: Column, path: Column) -> Column:
    """path as seen from root, with `..` for each step up; the path itself where only one of them is absolute."""
    a, b = _parts(root), _parts(path)
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    shared = F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b)))
    return F.when(path.startswith("/") == root.startswith("/"), F.array_join(steps, "/")).otherwise(path)


def owned_files(files: DataFrame, projects: DataFrame) -> DataFrame:
    """files(path, ...) with the project whose dir is the nearest above it: projects(project, dir) and the path below dir.

    Every directory is looked up under each of its ancestors, so this is an equi-join; files outside all projects go.
    """
    parent = F.regexp_replace("path", "/[^/]*$", "")
    parts = F.split("parent", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = files.select(parent.alias("parent")).distinct().select("parent", F.explode(above).alias("dir"))
    nearest = dirs.join(projects.select("project", "dir"), "dir").groupBy("parent").agg(F.max_by(F.struct("project", "dir"), F.length("dir")).alias("x")).select("parent", "x.*")
    return files.withColumn("parent", parent).join(nearest, "parent").withColumn("rel_path", F.expr("substring(path, length(dir) + 2)")).drop("parent")


def projects_of_scripts(files: DataFrame, root: str) -> DataFrame:
    """(project, name, dir, build_file): each directory under root that holds a build script, and root itself, as ":"."""
    name = F.substring_index("path", "/", -1)
    dirs = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), name.alias("name")).filter(F.col("dir").startswith(f"{root}/") | (F.col("dir") == root))
    has = lambda n: F.max(F.col("name") == n)
    kept = dirs.groupBy("dir").agg(F.when(has(SCRIPTS[0]), SCRIPTS[0]).when(has(SCRIPTS[1]), SCRIPTS[1]).otherwise("none").alias("build_file")).filter((F.col("build_file") != "none") | (F.col("dir") == root))
    below = F.expr(f"substring(dir, {len(root) + 1})")
    path = F.when(F.col("dir") == root, ":").otherwise(F.replace(below, F.lit("/"), F.lit(":")))
    return kept.select(path.alias("project"), F.substring_index("dir", "/", -1).alias("name"), "dir", "build_file")


def discovered_dirs(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(project, dir): of candidates(project, strategy, dir) that exist, those of the project's first strategy with any."""
    live = candidates.join(existing.select("dir").distinct(), "dir", "left_semi")
    first = live.groupBy("project").agg(F.min("strategy").alias("strategy"))
    return live.join(first, ["project", "strategy"]).select("project", "dir").distinct()


def source_set_order(sets: DataFrame) -> DataFrame:
    """sets(project, source_set) with set_ord: the usual ones first, then by name."""
    rank = F.coalesce(*[F.when(F.col("source_set") == s, F.lit(i)) for i, s in enumerate(USUAL_SETS)], F.lit(len(USUAL_SETS)))
    return sets.withColumn("set_ord", F.row_number().over(Window.partitionBy("project").orderBy(rank, "source_set")))


def summary_tables(files: DataFrame, projects: DataFrame, deps: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of project summaries from files(path, text) and projects(project, dir, build_file).

    sets(project, set_ord, source_set), dirs(project, source_set, dir), symbols(project, source_set, item, name, kind,
    package_name, file, line) and deps(project, ord, scope, ...): given where a build knows them, else read from each
    project's build script. A source set is a directory under src with a source file; symbols come from its kotlin and
    java directories.
    """
    named = files.withColumn("ext", F.substring_index("path", ".", -1))
    owned = cut_lineage(owned_files(named, projects))
    sources = owned.filter(F.col("ext").isin(*SOURCE_EXTENSIONS)).withColumns(
        {"source_set": F.regexp_extract("rel_path", "^src/([^/]+)/", 1), "lang": F.regexp_extract("rel_path", "^src/[^/]+/(kotlin|java)/", 1)}
    ).filter("source_set <> ''")
    sets = source_set_order(sources.select("project", "source_set").distinct())
    inside = sources.filter("lang <> ''").withColumn("source_dir", F.concat(F.lit("src/"), "source_set", F.lit("/"), "lang"))
    places = inside.select("path", "project", "source_set", "rel_path", "source_dir", F.when(F.col("lang") == "kotlin", 0).otherwise(1).alias("lang_ord"))
    parsed = symbols_of(parse_files(inside.select("path", "ext", "text"))).join(places, "path").withColumnRenamed("rel_path", "file")
    order = Window.partitionBy("project", "source_set").orderBy("lang_ord", "file", "ord")
    symbols = symbol_entries(parsed.withColumn("item", F.row_number().over(order)).select("project", "source_set", "item", "name", "kind", "package_name", "file", "line", "source_dir"))
    if deps is None:
        scripts = owned.join(projects.select("project", "build_file"), "project").filter("rel_path = build_file")
        deps = script_dependencies(scripts.select("path", "text")).join(scripts.select("path", "project"), "path").drop("path")
    return {"sets": sets, "dirs": places.select("project", "source_set", F.col("source_dir").alias("dir")).distinct(), "symbols": symbols, "deps": deps}


def nested_summaries(projects: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row a project: build_file, its source sets (name, directories, symbols), all symbols and dependencies counted.

    A row holds names and counts of its source sets, not their symbols, so that no project becomes one unbounded row.
    """
    dirs = tables["dirs"].groupBy("project", "source_set").agg(F.array_sort(F.collect_list("dir")).alias("dirs"))
    counts = tables["symbols"].groupBy("project", "source_set").agg(F.count("*").alias("n_symbols"))
    sets = tables["sets"].join(dirs, ["project", "source_set"], "left").join(counts, ["project", "source_set"], "left")
    row = F.struct("set_ord", "source_set", F.coalesce("dirs", F.array().cast("array<string>")).alias("dirs"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))
    nested = sets.groupBy("project").agg(F.array_sort(F.collect_list(row)).alias("source_sets"))
    needs = tables["deps"].groupBy("project").agg(F.count("*").alias("n_dependencies"))
    out = projects.join(nested, "project", "left").join(needs, "project", "left")
    total = F.aggregate("source_sets", F.lit(0).cast("long"), lambda n, s: n + s["n_symbols"])
    return out.select("project", "build_file", "source_sets", F.coalesce(total, F.lit(0)).alias("n_symbols"), F.coalesce("n_dependencies", F.lit(0)).alias("n_dependencies"))


def rolled_totals(projects: DataFrame, symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols and warnings of every project, build and the workspace in one ROLLUP, told apart by `level` (0, 1, 3).

    projects(build, project, analysed); symbols and found(severity) by (build, project). A project whose analysis failed
    has no number of warnings (null), nor has a build or workspace where none succeeded; others count as usual.
    """
    keys = ["build", "project"]
    zero = F.lit(0).cast("long")
    rows = projects.select(*keys, zero.alias("s"), F.when(F.col("analysed"), zero).alias("w"))
    rows = rows.unionByName(symbols.groupBy(*keys).agg(F.count("*").alias("s")).select(*keys, "s", F.lit(None).cast("long").alias("w")))
    failed = projects.filter("not analysed").select(*keys)
    warned = found.groupBy(*keys).agg(F.count_if(F.col("severity") != "INFO").alias("w")).join(failed, keys, "left_anti")
    rows = rows.unionByName(warned.select(*keys, zero.alias("s"), "w"))
    rolled = rows.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), F.sum("s").alias("n_symbols"), F.sum("w").alias("n_warnings"))
    return rolled.select("level", *keys, "n_symbols", "n_warnings")
