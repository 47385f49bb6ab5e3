"""Reports as documents: lines placed by a hierarchical key, one document a project or build, written in parallel.

A block is (doc, part, a, b, lines): `part` is the section, `a` and `b` place a block in it, and its lines follow one
another. Sections that depend on other tables have a heading for exactly the documents that have rows there. `doc`
is the project or build; nothing is gathered beyond the lines of one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.exprs import external_build, report_path
from loomgraph.operators.rules import text
from loomgraph.operators.summary import DETAIL_DEPENDENTS, SUPER_DEPENDENTS

# Marks of severities, of tests and of dependents in another build, and the lines of a tree.
ICONS = {"FORBIDDEN": "\U0001f6ab", "WARNING": "⚠️", "INFO": "ℹ️"}
TEST_MARK, LINK_MARK = "\U0001f9ea", "\U0001f517"
CHILD, LAST_CHILD = "├──", "└──"
BEFORE, AFTER = -(1 << 62), 1 << 62


def block(df: DataFrame, part: int, lines: Column | list, a: Column | int = 0, b: Column | int = 0) -> DataFrame:
    """Lines at a place of a section; lines that are null are left out."""
    column = lambda x: F.lit(x) if isinstance(x, (int, str)) else x
    if isinstance(lines, list):
        lines = F.array_compact(F.array(*[column(x) for x in lines]))
    return df.select("doc", F.lit(part).alias("part"), column(a).cast("long").alias("a"), column(b).cast("long").alias("b"), lines.alias("lines"))


def placed(*blocks: DataFrame) -> DataFrame:
    """(doc, place, line): the lines of each document, numbered from 1."""
    rows = reduce(DataFrame.unionByName, blocks).select("doc", "part", "a", "b", F.posexplode("lines").alias("i", "line"))
    order = Window.partitionBy("doc").orderBy("part", "a", "b", "i", "line")
    return rows.select("doc", F.row_number().over(order).cast("long").alias("place"), "line")


def write_documents(lines: DataFrame, folder: str) -> None:
    """A text file for each document under folder/path=<its path>, written by the task that holds its lines."""
    rows = lines.withColumn("path", report_path(F.col("doc"))).repartition("path").sortWithinPartitions("path", "place")
    rows.select("path", F.col("line").alias("value")).write.mode("overwrite").partitionBy("path").text(folder)


def _having(df: DataFrame, docs: DataFrame, has: bool = True) -> DataFrame:
    """The documents with rows in df, or those without."""
    return docs.select("doc").join(df.select("doc").distinct(), "doc", "left_semi" if has else "left_anti")


def _section(docs: DataFrame, rows: DataFrame, part: int, title: list, body: DataFrame, tail: bool = True) -> list[DataFrame]:
    """A heading, the body and an empty line for each document with rows."""
    some = _having(rows, docs)
    return [block(some, part, title, BEFORE), body, *([block(some, part, [""], AFTER)] if tail else [])]


def _count(n: str, one: str) -> Column:
    return F.concat(F.col(n).cast("string"), F.lit(" "), F.when(F.col(n) == 1, one).otherwise(one + "s"))


def hub_blocks(hubs: DataFrame, part: int) -> DataFrame:
    """hubs(doc, place, name, role, path, line, dependent_count, dependents): a line each, and its dependents below.

    A hub of SUPER_DEPENDENTS or more stands alone, so a block has fewer lines than that.
    """
    head = F.concat(F.lit("- **"), "name", F.lit("**"), F.when(F.col("role") != "", text(" [{}]", "role")).otherwise(""), F.when(F.col("path") != "", text(" — {}:{}", "path", "line")).otherwise(""))
    great = F.col("dependent_count") >= SUPER_DEPENDENTS
    n = _count("dependent_count", "dependent")
    first = F.concat(head, F.when(great, F.concat(F.lit(" — super node ("), n, F.lit(")"))).otherwise(F.concat(F.lit(" ("), n, F.lit(")"))))
    below = F.transform("dependents", lambda d: F.concat(F.lit("  - "), d["name"], F.lit(" — "), d["path"], F.lit(":"), d["line"].cast("string")))
    return block(hubs, part, F.concat(F.array(first), F.when(great, F.array().cast("array<string>")).otherwise(below), F.array(F.lit(""))), F.col("place"))


def finding_lines() -> list[Column]:
    icon = F.element_at(F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv]), F.col("severity"))
    return [F.concat(F.lit("- **"), icon, F.lit("** "), "message"), text("  - {}", "suggestion")]


SYMBOL_HEAD = ["| Kind | Name | Package | File | Line |", "|------|------|---------|------|------|"]


def project_documents(projects: DataFrame, sets: DataFrame, symbols: DataFrame, hubs: DataFrame, found: DataFrame, cycles: DataFrame, deps: DataFrame) -> DataFrame:
    """The report of each project, as (doc, place, line).

    projects(doc, build_file, source_dirs, subprojects arrays), sets(doc, set_ord, source_set), symbols(doc, source_set,
    item, kind, name, package_name, file, line), hubs (see hub_blocks), found(doc, ord, severity, severity_rank, message,
    suggestion), cycles(doc, ord, nodes), deps(doc, ord, scope, artifact_group, artifact, version). A project without
    source sets lists its symbols flat; sections without rows are left out, but for symbols and dependencies.
    """
    row = text("| {} | {} | {} | {} | {} |", "kind", "name", "package_name", "file", "line")
    none = ["No symbols extracted.", ""]
    named = sets.join(symbols.select("doc", "source_set").distinct().withColumn("some", F.lit(True)), ["doc", "source_set"], "left")
    head = F.concat(F.array(text("## {}", "source_set"), F.lit("")), F.when(F.col("some"), F.array(*map(F.lit, SYMBOL_HEAD))).otherwise(F.array(*map(F.lit, none))))
    flat = _having(sets, projects, False)
    loose = symbols.join(flat, "doc", "left_semi")
    out = [
        block(projects, 0, [text("# {}", "doc"), ""]),
        block(named, 1, head, F.col("set_ord"), BEFORE),
        block(symbols.join(sets, ["doc", "source_set"]), 1, [row], F.col("set_ord"), F.col("item")),
        block(named.filter("some"), 1, [""], F.col("set_ord"), AFTER),
        *_section(flat, loose, 1, ["## Symbols", "", *SYMBOL_HEAD], block(loose, 1, [row], 0, F.col("item"))),
        block(_having(loose, flat, False), 1, ["## Symbols", "", *none]),
        *_section(projects, hubs, 2, ["## Hub Classes", ""], hub_blocks(hubs, 2), tail=False),
        *_section(projects, found, 3, ["## Findings", ""], block(found, 3, finding_lines(), F.col("severity_rank"), F.col("ord"))),
        *_section(projects, cycles, 4, ["## Circular Dependencies", ""], block(cycles, 4, [F.concat(F.lit("- "), F.array_join("nodes", " -> "))], F.col("ord"))),
        block(projects, 5, ["## Dependencies", ""], BEFORE),
        block(_having(deps, projects, False), 5, ["No dependencies found.", ""]),
        block(_having(deps, projects), 5, ["| Scope | Artifact | Version |", "|-------|----------|---------|"], BEFORE, 1),
        block(deps, 5, [text("| {} | {}:{} | {} |", "scope", "artifact_group", "artifact", "version")], F.col("ord")),
        block(_having(deps, projects), 5, [""], AFTER),
    ]
    dirs = F.coalesce(F.nullif(F.array_join("source_dirs", ", "), F.lit("")), F.lit("none"))
    subs = F.when(F.size("subprojects") > 0, text("- Subprojects: {}", F.array_join("subprojects", ", ")))
    out.append(block(projects, 6, ["## Build", "", text("- Build file: {}", "build_file"), text("- Source dirs: {}", dirs), subs, ""]))
    return placed(*out)


def build_documents(projects: DataFrame, sets: DataFrame, symbols: DataFrame, hubs: DataFrame, found: DataFrame, cycles: DataFrame, deps: DataFrame) -> DataFrame:
    """The report of each included build over all its projects, as (doc, place, line).

    projects(doc, project, project_ord, n_subprojects); the other tables as project_documents takes them, by (doc,
    project, project_ord), hubs with the place among all of their build. The table of projects shows where there are several, or one with
    subprojects. A class that a hub is named after carries its role and dependents. Findings show once a message.
    """
    builds = projects.select("doc").distinct()
    warned = found.groupBy("doc").agg(F.count_if(F.col("severity") != "INFO").alias("w"))
    packages = symbols.groupBy("doc").agg(F.count("*").alias("s"), F.array_join(F.sort_array(F.collect_set("package_name")), ", ").alias("packages"))
    facts = projects.groupBy("doc").agg(F.count("*").alias("p"), F.sum("n_subprojects").alias("subs")).join(packages, "doc", "left").join(warned, "doc", "left")
    overview = [text("# {}", "doc"), "", "## Overview", "", text("- {} symbols across {} project(s)", F.coalesce("s", F.lit(0)), "p"), F.when(F.col("w") > 0, text("- {} warning(s)", "w")), F.when(F.col("s") > 0, text("- packages: {}", "packages")), ""]
    shown = facts.filter("p > 1 or subs > 0").select("doc")
    counts = symbols.groupBy("doc", "project").agg(F.count("*").alias("n"))
    names = sets.groupBy("doc", "project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("set_ord", "source_set"))), lambda x: x["source_set"]), ", ").alias("sets"))
    listed = projects.join(shown, "doc", "left_semi").join(counts, ["doc", "project"], "left").join(names, ["doc", "project"], "left")
    line = text("| {} | {} | {} | [view]({}/context.md) |", "project", F.coalesce("n", F.lit(0)), F.coalesce("sets", F.lit("-")), report_path(F.col("project")))

    tags = hubs.select("doc", "project", "name", F.struct("role", "dependent_count").alias("hub"), "place").groupBy("doc", "project", "name").agg(F.max_by("hub", "place").alias("hub"))
    classes = symbols.filter("kind = 'CLASS'").join(tags, ["doc", "project", "name"], "left").select("doc", "project_ord", "source_set", "item", "name", "package_name", "file", "line", "hub.role", "hub.dependent_count")
    tag = F.concat(F.when(F.col("role") != "", text(" [{}]", "role")).otherwise(""), F.when(F.col("dependent_count") > 0, F.concat(F.lit(" ("), _count("dependent_count", "dependent"), F.lit(")"))).otherwise(""))
    shown_class = F.concat(F.lit("- class `"), "name", F.lit("`"), tag, text(" — {}, {}:{}", "package_name", "file", "line"))
    kinds = symbols.groupBy("doc", "project", "source_set").agg(F.count_if(F.col("kind") == "FUNCTION").alias("f"), F.count_if(F.col("kind") == "PROPERTY").alias("v"))
    full = sets.join(kinds, ["doc", "project", "source_set"])
    # sets follow one another by project, then by their own order
    at = F.col("project_ord") * (1 << 20) + F.col("set_ord")
    keyed = classes.join(sets.select("doc", "project_ord", "source_set", "set_ord"), ["doc", "project_ord", "source_set"])
    scopes = deps.groupBy("doc", "scope").agg(F.min(F.struct("project_ord", "ord")).alias("first"), F.array_sort(F.collect_list(F.struct("project_ord", "ord", F.concat_ws(":", "artifact_group", "artifact", "version").alias("x")))).alias("all"))
    once = found.groupBy("doc", "message").agg(F.min(F.struct("project_ord", "ord", "severity", "severity_rank", "suggestion")).alias("f")).select("doc", "message", "f.*")
    problems = _having(once.select("doc").unionByName(cycles.select("doc")), builds)
    out = [
        block(facts, 0, overview),
        block(shown, 1, ["## Projects", "", "| Project | Symbols | Source Sets | Report |", "|---------|---------|------------|--------|"], BEFORE),
        block(listed, 1, [line], F.col("project_ord")),
        block(shown, 1, [""], AFTER),
        block(full, 2, [text("## {}", "source_set"), ""], at, BEFORE),
        block(keyed, 2, [shown_class], at, F.col("item")),
        block(full, 2, [F.when(F.col("f") > 0, text("- {} functions", "f")), F.when(F.col("v") > 0, text("- {} properties", "v")), ""], at, AFTER),
        *_section(builds, hubs, 3, ["## Hub Classes", ""], hub_blocks(hubs, 3), tail=False),
        *_section(builds, deps, 4, ["## Dependencies", ""], block(scopes, 4, [text("- {}: {}", "scope", F.array_join(F.transform("all", lambda x: x["x"]), ", "))], F.col("first.project_ord"), F.col("first.ord"))),
        block(problems, 5, ["## Problems", ""], BEFORE),
        block(once, 5, finding_lines(), F.col("severity_rank"), F.col("project_ord") * (1 << 40) + F.col("ord")),
        block(_having(cycles, builds), 5, ["", "### Circular Dependencies", ""], 10),
        block(cycles, 5, [F.concat(F.lit("- "), F.array_join("nodes", " -> "))], 11 + F.col("project_ord"), F.col("ord")),
        block(problems, 5, [""], AFTER),
    ]
    return placed(*out)


def _is_test(path: Column) -> Column:
    return path.contains("/test/") | path.contains("Test")


def _branches(hubs: DataFrame, dependents: DataFrame, tests_last: bool) -> DataFrame:
    """dependents(doc, place, nth, path, line) below their hubs(doc, place, path): with connector, and their order in the tree."""
    rows = dependents.withColumn("test", _is_test(F.col("path"))).join(hubs.select("doc", "place", F.col("path").alias("hub_path")), ["doc", "place"])
    order = Window.partitionBy("doc", "place").orderBy(*([F.col("test")] if tests_last else []), "nth", "path", "line")
    last = F.lead(F.lit(1)).over(order).isNull()
    return rows.withColumns({"branch": F.row_number().over(order), "mark": F.when(last, LAST_CHILD).otherwise(CHILD)})


def hub_document(hubs: DataFrame, dependents: DataFrame) -> DataFrame:
    """hubs(doc, place, name, role, path, line, dependent_count, is_test): tables of production and test hubs, then trees.

    A hub of DETAIL_DEPENDENTS or more has a tree of its dependents(doc, place, nth, path, line), tests last and marked.
    """
    docs, own, test = hubs.select("doc").distinct(), hubs.filter("not is_test"), hubs.filter("is_test")
    table = ["| Class | File | Dependents | Role |", "|-------|------|------------|------|"]
    row = lambda mark: text("| " + mark + "`{}` | {}:{} | {} | {} |", "name", "path", "line", "dependent_count", "role")
    deep = hubs.filter(F.col("dependent_count") >= DETAIL_DEPENDENTS)
    tree = _branches(deep, dependents, True)
    branch = F.concat(F.col("mark"), text(" {}:{}", "path", "line"), F.when(F.col("test"), f" {TEST_MARK}").otherwise(""))
    return placed(
        block(docs, 0, ["# Hub Classes", "", "Classes with the most inbound dependencies across the codebase.", ""]),
        *_section(docs, own, 1, table, block(own, 1, [row("")], F.col("place"))),
        *_section(docs, test, 2, ["### Test", "", *table], block(test, 2, [row(f"{TEST_MARK} ")], F.col("place"))),
        block(deep, 3, [F.concat(F.lit("## "), F.when(F.col("is_test"), f"{TEST_MARK} ").otherwise(""), "name"), "", "```", text("{}:{} — {} dependents", "path", "line", "dependent_count")], F.col("place"), BEFORE),
        block(tree, 3, [branch], F.col("place"), F.col("branch")),
        block(deep, 3, ["```", ""], F.col("place"), AFTER),
    )


def cross_build_document(docs: DataFrame, edges: DataFrame, hubs: DataFrame, dependents: DataFrame, cycles: DataFrame) -> DataFrame:
    """docs(doc, analysed): edges(doc, ord, from_build, to_build) by source in order of appearance, shared hubs with trees, cycles.

    A dependent whose first path segment differs from its hub's is marked as another build's.
    """
    first = edges.groupBy("doc", "from_build").agg(F.min("ord").alias("first"))
    ordered = edges.join(first, ["doc", "from_build"])
    rooted = hubs.join(dependents.select("doc", "place").distinct(), ["doc", "place"], "left_semi")
    tree = _branches(hubs, dependents, False)
    branch = F.concat(F.col("mark"), text(" {}:{}", "path", "line"), F.when(external_build(F.col("path"), F.col("hub_path")), f" {LINK_MARK}").otherwise(""))
    row = text("| `{}` | {}:{} | {} | {} |", "name", "path", "line", "dependent_count", "role")
    bare = docs.join(edges.select("doc").distinct(), "doc", "left_anti").filter("not analysed")
    empty = docs.filter("analysed").join(hubs.select("doc").unionByName(cycles.select("doc")).distinct(), "doc", "left_anti")
    return placed(
        block(docs, 0, ["# Cross-Build References", ""]),
        block(bare, 1, ["No cross-build references detected.", ""]),
        *_section(docs, edges, 1, ["## Build Dependencies", ""], block(first, 1, [text("### {}", "from_build"), ""], F.col("first"), BEFORE), tail=False),
        block(ordered, 1, [text("- depends on **{}**", "to_build")], F.col("first"), F.col("ord")),
        block(first, 1, [""], F.col("first"), AFTER),
        *_section(docs, hubs, 2, ["## Shared Hub Classes", "", "| Class | File | Dependents | Role |", "|-------|------|------------|------|"], block(hubs, 2, [row], F.col("place"))),
        block(rooted, 3, [text("### {}", "name"), "", "```", text("{}:{} — {} dependents", "path", "line", "dependent_count")], F.col("place"), BEFORE),
        block(tree, 3, [branch], F.col("place"), F.col("branch")),
        block(rooted, 3, ["```", ""], F.col("place"), AFTER),
        *_section(docs, cycles, 4, ["## Cross-Build Cycles", ""], block(cycles, 4, [F.concat(F.lit("- "), F.array_join("nodes", " -> "))], F.col("ord"))),
        block(empty, 5, ["No shared hubs or cycles detected in cross-build analysis.", ""]),
    )
