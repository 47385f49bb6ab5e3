import os

from loomgraph.operators import documents

SETS = "doc string, project string, project_ord int, set_ord int, source_set string"
SYMBOLS = "doc string, project string, project_ord int, source_set string, item long, kind string, name string, package_name string, file string, line int"
HUBS = "doc string, project string, project_ord int, place int, name string, role string, path string, line int, dependent_count long, dependents array<struct<nth:long,name:string,path:string,line:int>>, is_test boolean"
FOUND = "doc string, project string, project_ord int, ord long, severity string, severity_rank int, message string, suggestion string"
CYCLES = "doc string, project string, project_ord int, ord long, nodes array<string>"
DEPS = "doc string, project string, project_ord int, ord long, scope string, artifact_group string, artifact string, version string"
PROJECTS = "doc string, project string, project_ord int, build_file string, source_dirs array<string>, subprojects array<string>, n_subprojects long"


def tables(spark, doc, **rows):
    """doc: what a row's document is, from its project."""
    schemas = {"projects": PROJECTS, "sets": SETS, "symbols": SYMBOLS, "hubs": HUBS, "found": FOUND, "cycles": CYCLES, "deps": DEPS}
    return {n: spark.createDataFrame([(doc(r[0]), *r) for r in rows.get(n, [])], schema) for n, schema in schemas.items()}


def texts(lines):
    out = {}
    for r in lines.orderBy("doc", "place").collect():
        out.setdefault(r.doc, []).append(r.line)
    return out


ROWS = {
    "projects": [(":a", 1, "build.gradle.kts", ["src/main/kotlin"], [":a:x"], 1), (":b", 2, "none", [], [], 0)],
    "sets": [(":a", 1, 1, "main"), (":a", 1, 2, "test")],
    "symbols": [(":a", 1, "main", 2, "FUNCTION", "go", "p", "A.kt", 3), (":a", 1, "main", 1, "CLASS", "A", "p", "A.kt", 1), (":b", 2, "main", 3, "CLASS", "B", "q", "B.kt", 1)],
    "hubs": [(":a", 1, 2, "Big", "", "", 0, 50, [(1, "x", "X.kt", 1)], False), (":a", 1, 1, "A", "service", "A.kt", 1, 1, [(1, "B", "B.kt", 4)], False)],
    "found": [(":a", 1, 2, "INFO", 2, "i", "j"), (":a", 1, 3, "FORBIDDEN", 0, "f", "g"), (":b", 2, 4, "INFO", 2, "i", "other")],
    "cycles": [(":a", 1, 1, ["A", "B", "A"])],
    "deps": [(":a", 1, 1, "api", "g", "x", "1"), (":b", 2, 1, "test", "g", "y", "2"), (":b", 2, 2, "api", "g", "z", "3")],
}
A_HUBS = ["## Hub Classes", "", "- **A** [service] — A.kt:1 (1 dependent)", "  - B — B.kt:4", "", "- **Big** — super node (50 dependents)", ""]


def test_project_documents(spark, tmp_path):
    lines = documents.project_documents(**tables(spark, lambda p: p, **ROWS))
    got = texts(lines)
    table = documents.SYMBOL_HEAD
    assert got[":a"] == [
        "# :a", "", "## main", "", *table, "| CLASS | A | p | A.kt | 1 |", "| FUNCTION | go | p | A.kt | 3 |", "", "## test", "", "No symbols extracted.", "", *A_HUBS,
        "## Findings", "", "- **\U0001f6ab** f", "  - g", "- **ℹ️** i", "  - j", "", "## Circular Dependencies", "", "- A -> B -> A", "",
        "## Dependencies", "", "| Scope | Artifact | Version |", "|-------|----------|---------|", "| api | g:x | 1 |", "", "## Build", "", "- Build file: build.gradle.kts", "- Source dirs: src/main/kotlin", "- Subprojects: :a:x", "",
    ]
    assert got[":b"][:7] == ["# :b", "", "## Symbols", "", *table, "| CLASS | B | q | B.kt | 1 |"] and got[":b"][-5:] == ["## Build", "", "- Build file: none", "- Source dirs: none", ""]
    documents.write_documents(lines, f"file://{tmp_path}/out")
    parts = [f for f in os.listdir(tmp_path / "out" / "path=a") if f.startswith("part-")]
    assert len(parts) == 1
    assert (tmp_path / "out" / "path=a" / parts[0]).read_text().split("\n")[:-1] == got[":a"]


def test_project_without_anything(spark):
    got = texts(documents.project_documents(**tables(spark, lambda p: p, projects=[(":", 1, "none", [], [], 0)])))
    assert got == {":": ["# :", "", "## Symbols", "", "No symbols extracted.", "", "## Dependencies", "", "No dependencies found.", "", "## Build", "", "- Build file: none", "- Source dirs: none", ""]}


def test_build_document(spark):
    got = texts(documents.build_documents(**tables(spark, lambda p: "inner", **ROWS)))["inner"]
    assert got == [
        "# inner", "", "## Overview", "", "- 3 symbols across 2 project(s)", "- 1 warning(s)", "- packages: p, q", "",
        "## Projects", "", "| Project | Symbols | Source Sets | Report |", "|---------|---------|------------|--------|", "| :a | 2 | main, test | [view](a/context.md) |", "| :b | 1 | - | [view](b/context.md) |", "",
        "## main", "", "- class `A` [service] (1 dependent) — p, A.kt:1", "- 1 functions", "", *A_HUBS,
        "## Dependencies", "", "- api: g:x:1, g:z:3", "- test: g:y:2", "",
        "## Problems", "", "- **\U0001f6ab** f", "  - g", "- **ℹ️** i", "  - j", "", "### Circular Dependencies", "", "- A -> B -> A", "",
    ]
    lone = texts(documents.build_documents(**tables(spark, lambda p: "lone", projects=[(":", 1, "none", [], [], 0)])))
    assert lone == {"lone": ["# lone", "", "## Overview", "", "- 0 symbols across 1 project(s)", ""]}


def test_trees(spark):
    hubs = spark.createDataFrame([("w", 1, "H", "", "app/H.kt", 2, 4, False), ("w", 2, "T", "dao", "lib/HTest.kt", 1, 1, True)], "doc string, place int, name string, role string, path string, line int, dependent_count int, is_test boolean")
    deps = spark.createDataFrame([("w", 1, 1, "app/src/test/A.kt", 1), ("w", 1, 2, "app/B.kt", 2), ("w", 1, 3, "lib/C.kt", 3), ("w", 1, 4, "D.kt", 4), ("w", 2, 1, "lib/E.kt", 5)], "doc string, place int, nth int, path string, line int")
    tests = "\U0001f9ea"
    got = texts(documents.hub_document(hubs, deps))["w"]
    assert got[-7:] == ["app/H.kt:2 — 4 dependents", "├── app/B.kt:2", "├── lib/C.kt:3", "├── D.kt:4", f"└── app/src/test/A.kt:1 {tests}", "```", ""]
    assert f"| {tests} `T` | lib/HTest.kt:1 | 1 | dao |" in got and f"## {tests} T" not in got
    docs = spark.createDataFrame([("w", True), ("x", False), ("y", True)], "doc string, analysed boolean")
    edges = spark.createDataFrame([("w", 1, "b", "c"), ("w", 2, "a", "c"), ("w", 3, "b", "a")], "doc string, ord int, from_build string, to_build string")
    cycles = spark.createDataFrame([("w", 1, ["a", "b", "a"])], "doc string, ord int, nodes array<string>")
    got = texts(documents.cross_build_document(docs, edges, hubs, deps, cycles))
    assert got["w"][:14] == ["# Cross-Build References", "", "## Build Dependencies", "", "### b", "", "- depends on **c**", "- depends on **a**", "", "### a", "", "- depends on **c**", "", "## Shared Hub Classes"]
    assert [x for x in got["w"] if "──" in x] == ["├── app/src/test/A.kt:1", "├── app/B.kt:2", "├── lib/C.kt:3 \U0001f517", "└── D.kt:4 \U0001f517", "└── lib/E.kt:5"]
    assert got["w"][-4:] == ["## Cross-Build Cycles", "", "- a -> b -> a", ""]
    assert got["x"][2:] == ["No cross-build references detected.", ""] and got["y"][2:] == ["No shared hubs or cycles detected in cross-build analysis.", ""]
