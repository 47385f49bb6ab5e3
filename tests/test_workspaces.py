import os

from pyspark.sql import functions as F

from loomgraph.operators import runs, workspaces
from loomgraph.sources import files

TREE = {
    "build.gradle.kts": 'plugins { kotlin("jvm") version "2.1.20" }\ndependencies {\n    implementation("com.example:shared-models:1.0.0")\n    testImplementation("io.kotest:kotest-runner-junit5:5.9.1")\n}\n',
    "src/main/kotlin/com/example/Service.kt": 'package com.example\n\nclass Service {\n    fun process(): String = "done"\n}\n',
    "src/test/kotlin/com/example/ServiceTest.kt": "package com.example\n\nclass ServiceTest {\n    fun testProcess() {}\n}\n",
    "lib/build.gradle": "// none\n",
    "lib/src/commonMain/kotlin/L.kt": "object L",
    "lib/src/zeta/kotlin/Z.kt": "class Z",
    "plain/src/main/java/P.java": "class P {}",
}


def put(root, tree):
    for path, text in tree.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_text(text)


def test_from_directories_to_summaries(spark, tmp_path):
    put(tmp_path, TREE)
    found = files.scan_files(spark, str(tmp_path), pattern="*.{kt,java,kts,gradle}")
    root = f"file://{tmp_path}"
    found = found.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    projects = workspaces.projects_of_scripts(found, root)
    assert sorted(tuple(r) for r in projects.select("project", "build_file").collect()) == [(":", "build.gradle.kts"), (":lib", "build.gradle")]
    tables = workspaces.summary_tables(found, projects)
    rows = {r.project: r for r in workspaces.nested_summaries(projects, tables).collect()}
    assert [(s.source_set, s.n_symbols, s.dirs) for s in rows[":"].source_sets] == [("main", 2, ["src/main/kotlin"]), ("test", 2, ["src/test/kotlin"])]
    assert (rows[":"].n_symbols, rows[":"].n_dependencies, rows[":"].build_file) == (4, 2, "build.gradle.kts")
    assert [(s.source_set, s.n_symbols) for s in rows[":lib"].source_sets] == [("commonMain", 1), ("zeta", 1)]
    assert [r.artifact for r in tables["deps"].orderBy("ord").collect()] == ["shared-models", "kotest-runner-junit5"]
    assert sorted((r.name, r.kind, r.package_name, r.file) for r in tables["symbols"].filter("project = ':' and source_set = 'main'").collect()) == [("Service", "CLASS", "com.example", "com/example/Service.kt"), ("process", "FUNCTION", "com.example", "com/example/Service.kt")]
    # a build that knows its dependencies gives them, and scripts are not asked
    given = spark.createDataFrame([(":", 1, "api", "g", "x", "1")], "project string, ord int, scope string, artifact_group string, artifact string, version string")
    assert {r.project: r.n_dependencies for r in workspaces.nested_summaries(projects, workspaces.summary_tables(found, projects, given)).collect()} == {":": 1, ":lib": 0}


def test_relative_dirs(spark):
    rows = [("/w/a", "/w/a"), ("/w/a", "/w/a/b/c"), ("/w/a", "/w/b"), ("/w/a/x", "/"), ("/", "/w"), ("/w", "rel/b"), ("a/b", "a/c"), ("/w/ab", "/w/abc"), ("/w/./a/", "/w//a/b")]
    df = spark.createDataFrame(rows, "root string, dir string").select(workspaces.relative_dir(F.col("root"), F.col("dir")))
    assert [r[0] for r in df.collect()] == ["", "b/c", "../b", "../../..", "w", "rel/b", "../c", "../abc", "b"]


def test_first_strategy_with_a_directory(spark):
    rows = [("p", 1, "a"), ("p", 2, "b"), ("p", 2, "b"), ("p", 3, "c"), ("q", 1, "d"), ("q", 3, "e"), ("r", 2, "gone")]
    existing = spark.createDataFrame([("b",), ("c",), ("d",), ("e",), ("d",)], "dir string")
    got = workspaces.discovered_dirs(spark.createDataFrame(rows, "project string, strategy int, dir string"), existing)
    assert sorted(map(tuple, got.collect())) == [("p", "b"), ("q", "d")]


def test_failed_projects_roll_up_as_null(spark):
    projects = spark.createDataFrame([("b", "x", True), ("b", "y", False), ("c", "z", False), ("b", "w", True)], "build string, project string, analysed boolean")
    symbols = spark.createDataFrame([("b", "x"), ("b", "x"), ("c", "z")], "build string, project string")
    found = spark.createDataFrame([("b", "x", "WARNING"), ("b", "x", "INFO"), ("b", "y", "WARNING")], "build string, project string, severity string")
    got = {(r.level, r.build, r.project): (r.n_symbols, r.n_warnings) for r in workspaces.rolled_totals(projects, symbols, found).collect()}
    assert got == {(0, "b", "x"): (2, 1), (0, "b", "y"): (0, None), (0, "b", "w"): (0, 0), (0, "c", "z"): (1, None), (1, "b", None): (2, 1), (1, "c", None): (1, None), (3, None, None): (3, 1)}


def test_second_run_reads_no_text(spark, tmp_path):
    put(tmp_path / "src", {"A.kt": "class A1", "B.kt": "class B1", "C.java": "class C1 {}"})
    folder = f"file://{tmp_path}/runs"
    names = lambda df: sorted(r.name for r in files.symbols_of(df).collect())
    first, counts = runs.refresh(spark, folder, str(tmp_path / "src"))
    assert names(first) == ["A1", "B1", "C1"] and counts == {"changed": 3, "removed": 0}
    # other text of the same length and time is only seen by a run that reads it
    at = os.stat(tmp_path / "src" / "A.kt")
    (tmp_path / "src" / "A.kt").write_text("class X1")
    os.utime(tmp_path / "src" / "A.kt", ns=(at.st_atime_ns, at.st_mtime_ns))
    again, counts = runs.refresh(spark, folder, str(tmp_path / "src"))
    assert names(again) == ["A1", "B1", "C1"] and counts == {"changed": 0, "removed": 0} and os.listdir(tmp_path / "runs") == ["run-1"]
    (tmp_path / "src" / "B.kt").write_text("class B2\nclass B3")
    os.remove(tmp_path / "src" / "C.java")
    put(tmp_path / "src", {"D.kt": "class D1"})
    third, counts = runs.refresh(spark, folder, str(tmp_path / "src"))
    assert names(third) == ["A1", "B2", "B3", "D1"] and counts == {"changed": 2, "removed": 1}
