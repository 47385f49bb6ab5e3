"""Reports as ordered lines of text: a DataFrame (part, a, b, line) that only the writer gathers."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.exprs import node_id
from loomgraph.operators.graph import Dependencies
from loomgraph.operators.rules import text
from loomgraph.storage import cut_lineage


def _lines(df: DataFrame, part: int, a, b, line) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.coalesce(a.cast("string"), F.lit("")).alias("a"), F.coalesce(b.cast("string"), F.lit("")).alias("b"), line.alias("line"))


def dependency_diagram(components: DataFrame, edges: DataFrame | Dependencies) -> DataFrame:
    """A Mermaid flowchart: a subgraph for each package group, then every edge once; no line without edges."""
    d = Dependencies.of(cut_lineage(edges) if isinstance(edges, DataFrame) else edges)
    ends = cut_lineage(d.ends())
    names = components.join(ends, "component_id", "left_semi").select("qualified_name").distinct()
    shown = components.join(names, "qualified_name", "left_semi")
    groups = shown.select("package_group").distinct()
    node = F.concat(F.lit("        "), node_id(F.col("qualified_name")), F.lit("["), "simple_name", F.lit("]"))
    arrows = d.named_by(components.select("component_id", node_id(F.col("qualified_name")).alias("label"))).select(F.col("a").alias("f"), F.col("b").alias("t"))
    any_edge = ends.limit(1).select(F.lit(1).alias("x"))
    head = any_edge.select(F.explode(F.array(F.lit("```mermaid"), F.lit("flowchart TD"))).alias("l"))
    out = _lines(head, 0, F.when(F.col("l") == "flowchart TD", "2").otherwise("1"), F.lit(""), F.col("l"))
    out = out.unionByName(_lines(groups, 1, F.col("package_group"), F.lit(""), text("    subgraph {}", "package_group")))
    out = out.unionByName(_lines(shown, 1, F.col("package_group"), F.concat(F.lit("1"), "simple_name"), node))
    out = out.unionByName(_lines(groups, 1, F.col("package_group"), F.lit("\U0010ffff"), F.lit("    end")))
    out = out.unionByName(_lines(arrows, 2, F.col("f"), F.col("t"), text("    {} --> {}", "f", "t")))
    return out.unionByName(_lines(any_edge, 3, F.lit(""), F.lit(""), F.lit("```")))


def sequence_diagrams(chains: DataFrame) -> DataFrame:
    """chains(entry, names array) of two nodes or more: a Mermaid sequence diagram each, by entry."""
    c = chains.filter(F.size("names") >= 2).withColumn("ids", F.transform("names", node_id)).withColumn("key", F.lpad(F.col("entry").cast("string"), 20, "0"))
    hop = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.concat(F.lit("    "), F.get("ids", i - 1), F.lit("->>"), F.get("ids", i), F.lit(": \n    "), F.get("ids", i), F.lit("-->>"), F.get("ids", i - 1), F.lit(": ")))
    people = F.transform(F.arrays_zip("ids", "names"), lambda x: F.concat(F.lit("    participant "), x["ids"], F.lit(" as "), x["names"]))
    body = F.concat(F.lit("### "), F.get("names", F.lit(0)), F.lit(" Flow\n\n```mermaid\nsequenceDiagram\n"), F.array_join(people, "\n"), F.lit("\n"), F.array_join(hop, "\n"), F.lit("\n```\n"))
    return _lines(c, 0, F.col("key"), F.lit(""), body)


def findings_report(found: DataFrame) -> DataFrame:
    """Sections of findings(severity, severity_rank, message, file, suggestion, source)."""
    titles = F.when(F.col("severity") == "FORBIDDEN", "## Forbidden").when(F.col("severity") == "WARNING", "## Warnings").otherwise("## Notes")
    heads = found.select("severity", "severity_rank").distinct()
    body = F.concat(F.lit("- "), "message", F.lit(" ("), "source", F.lit(")\n  - "), "suggestion")
    return _lines(heads, 0, F.col("severity_rank"), F.lit(""), titles).unionByName(_lines(found, 0, F.col("severity_rank"), F.concat(F.lit("1"), "message"), body))


def hub_report(hubs: DataFrame) -> DataFrame:
    """A table of hubs(hub, dependent_count, dependents), the most depended on first."""
    head = hubs.sparkSession.createDataFrame([("| Class | Dependents |\n|---|---|",)], "l string")
    order = F.lpad((F.lit(10**12) - F.col("dependent_count")).cast("string"), 13, "0")
    return _lines(head, 0, F.lit(""), F.lit(""), F.col("l")).unionByName(_lines(hubs, 1, order, F.col("hub"), text("| {} | {} |", "hub", "dependent_count")))


def entry_point_report(points: DataFrame) -> DataFrame:
    """Three sections of points(qualified_name, kind); an empty one says so."""
    kinds = points.sparkSession.createDataFrame([(0, "APP", "## App"), (1, "TEST", "## Test"), (2, "MOCK", "## Mock")], "part int, kind string, title string")
    counts = points.groupBy("kind").agg(F.count("*").alias("n"))
    heads = kinds.join(counts, "kind", "left").select("part", F.lit("").alias("a"), F.lit("").alias("b"), F.when(F.col("n").isNull(), F.concat("title", F.lit("\n\nNone detected."))).otherwise(F.col("title")).alias("line"))
    return heads.unionByName(points.join(F.broadcast(kinds), "kind").select("part", F.lit("1").alias("a"), F.col("qualified_name").alias("b"), F.concat(F.lit("- `"), "qualified_name", F.lit("`")).alias("line")))


def write_report(lines: DataFrame, folder: str, name: str) -> str:
    """One Markdown file of a report's lines in order; a report is gathered, so it must be of a size to read."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, ".gitignore"), "w", encoding="utf-8") as f:
        f.write("*\n")
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(r["line"] + "\n" for r in lines.orderBy("part", "a", "b", "line").toLocalIterator())
    return path


def clean(base: str, folder: str) -> bool:
    """Delete base/folder; a path that leads outside base is refused."""
    inside, target = os.path.realpath(base), os.path.realpath(os.path.join(base, folder))
    if os.path.commonpath([inside, target]) != inside or target == inside:
        raise ValueError(f"{folder} is not inside {base}")
    if not os.path.isdir(target):
        return False
    shutil.rmtree(target)
    return True


def build_diagram(edges: DataFrame) -> DataFrame:
    """A Mermaid flowchart of edges(from_build, to_build); no line without edges."""
    some = edges.limit(1).select(F.lit(1).alias("x"))
    ends = some.select(F.explode(F.array(F.lit("0```mermaid"), F.lit("1flowchart TD"))).alias("l"))
    arrows = F.concat(F.lit("    "), node_id(F.col("from_build")), F.lit(" --> "), node_id(F.col("to_build")))
    out = _lines(ends, 0, F.left("l", F.lit(1)), F.lit(""), F.expr("substring(l, 2)"))
    return out.unionByName(_lines(edges, 1, F.col("from_build"), F.col("to_build"), arrows)).unionByName(_lines(some, 2, F.lit(""), F.lit(""), F.lit("```")))


def dashboard(projects: DataFrame, builds: DataFrame) -> DataFrame:
    """Overview, projects(project, n_symbols, source_sets, n_dependencies, n_warnings) and builds(build, n_projects, n_symbols, n_warnings, relative_dir).

    Totals take in the included builds; the label counts the root's projects only.
    """
    p = projects.agg(F.count("*").alias("np"), F.coalesce(F.sum("n_symbols"), F.lit(0)).alias("ps"), F.coalesce(F.sum("n_warnings"), F.lit(0)).alias("pw"))
    b = builds.agg(F.count("*").alias("nb"), F.coalesce(F.sum("n_symbols"), F.lit(0)).alias("bs"), F.coalesce(F.sum("n_warnings"), F.lit(0)).alias("bw"))
    all_ = p.crossJoin(F.broadcast(b)).select("np", "nb", (F.col("ps") + F.col("bs")).alias("s"), (F.col("pw") + F.col("bw")).alias("w"))
    label = lambda n, one: F.when(F.col(n) == 1, one).otherwise(one + "s")
    overview = F.array_compact(
        F.array(
            F.lit("## Overview\n"),
            F.concat(F.lit("- "), "s", F.lit(" symbols across "), "np", F.lit(" "), label("np", "project")),
            F.when(F.col("w") > 0, F.concat(F.lit("- "), "w", F.lit(" "), label("w", "warning"))),
            F.when(F.col("nb") > 0, F.concat(F.lit("- "), "nb", F.lit(" "), label("nb", "included build"))),
        )
    )
    out = _lines(all_.select(F.posexplode(overview).alias("i", "l")), 0, F.col("i"), F.lit(""), F.col("l"))
    head = lambda n, title: all_.filter(f"{n} > 0").select(F.lit(title).alias("l"))
    table = head("np", "\n## Projects\n\n| Project | Symbols | Source Sets | Dependencies | Warnings |\n|---------|---------|------------|-------------|----------|")
    out = out.unionByName(_lines(table, 1, F.lit(""), F.lit(""), F.col("l"))).unionByName(_lines(projects, 2, F.col("project"), F.lit(""), text("| {} | {} | {} | {} | {} |", "project", "n_symbols", "source_sets", "n_dependencies", "n_warnings")))
    table = head("nb", "\n## Included Builds\n\n| Build | Projects | Symbols | Warnings | Context |\n|-------|----------|---------|----------|---------|")
    link = text("| {} | {} | {} | {} | [view](../{}/.loomgraph/context.md) |", "build", "n_projects", "n_symbols", "n_warnings", "relative_dir")
    return out.unionByName(_lines(table, 3, F.lit(""), F.lit(""), F.col("l"))).unionByName(_lines(builds, 4, F.col("build"), F.lit(""), link))


def cross_build_report(edges: DataFrame, hubs: DataFrame, cycles: DataFrame) -> DataFrame:
    """edges(from_build, to_build) by source, shared hubs(name, path, line, dependent_count, role), distinct cycles(nodes)."""
    out = _lines(edges.select("from_build").distinct(), 1, F.col("from_build"), F.lit(""), text("### {}", "from_build"))
    out = out.unionByName(_lines(edges, 1, F.col("from_build"), F.concat(F.lit("1"), "to_build"), text("- depends on **{}**", "to_build")))
    order = F.lpad((F.lit(10**12) - F.col("dependent_count")).cast("string"), 13, "0")
    out = out.unionByName(_lines(hubs, 2, order, F.col("name"), text("| `{}` | {}:{} | {} | {} |", "name", "path", "line", "dependent_count", "role")))
    shown = cycles.select(F.array_join("nodes", " -> ").alias("path"))
    return out.unionByName(_lines(shown, 3, F.col("path"), F.lit(""), text("- {}", "path")))


def interfaces_report(interfaces: DataFrame) -> DataFrame:
    """interfaces(name, package_name, n_impl, has_mock, source_set): those outside tests, then those of tests."""
    test = F.lower("source_set").contains("test").cast("int")
    order = F.lpad((F.lit(10**12) - F.col("n_impl")).cast("string"), 13, "0")
    mock = interfaces.withColumns({"mock": F.when(F.col("has_mock"), "yes").otherwise("no"), "test": test})
    return mock.select((F.col("test") + 1).alias("part"), order.alias("a"), F.col("name").alias("b"), text("| `{}` | {} | {} | {} |", "name", "package_name", "n_impl", "mock").alias("line"))
