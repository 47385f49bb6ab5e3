import os

from pyspark.sql import functions as F

import pytest

from loomgraph.operators import reports
from loomgraph.sources import files
from loomgraph.sources.declarations import Source, dependencies
from loomgraph.sources.lexer import tokens

KOTLIN = '''@file:Suppress("x")
package com.example.app // c
import com.example.Repo
import kotlin.test.*
import a.b.C as D
/* class Fake { /* nested */ } */
@Service("s") @a.b.Deep
data class User<T : Any>(private val id: Int, val n: String = "}{") : Base<T>(id), com.x.Face by lazy { 1 } {
    val full: String = "a ${n.map { "}" }} b"
    fun <R> hello(a: Int): String { return Helper(a).run(a, "x") }
    fun one() = two(3)
    companion object { fun make() = User<Int>(1, "") }
    enum class Color(val r: Int) { RED(1), GREEN(2) { fun q() {} }; fun mix() = 1 }
}
object Single : Base() { fun s() {} }
fun String.ext(): Int = length
val top = listOf(1, 2)
'''
JAVA = """package p.q; import java.util.List; import p.z.Base; import static p.S.*;
public abstract class A<T> extends Base<T> implements F, p.G { private int x = 1, y; A(int q) { super(q); }
  public String go(List<String> a) throws E { return f(a); } static class In { void m() {} } enum E2 { V; int z; } }
"""


def test_kotlin_symbols():
    assert [(n, k, line) for n, _, k, line, _ in Source(KOTLIN, True).symbols()] == [
        ("User", "DATA_CLASS", 8), ("User.hello", "FUNCTION", 10), ("User.one", "FUNCTION", 11), ("User.full", "PROPERTY", 9), ("Color", "ENUM", 13), ("Color.mix", "FUNCTION", 13),
        ("RED", "CLASS", 13), ("GREEN", "CLASS", 13), ("Single", "OBJECT", 15), ("ext", "FUNCTION", 16), ("top", "PROPERTY", 17),
    ]


def test_kotlin_references():
    got = [(n, q, k) for n, q, k, *_ in Source(KOTLIN, True).references()]
    assert got == [
        ("Repo", "com.example.Repo", "IMPORT"), ("test", "kotlin.test", "IMPORT"), ("C", "a.b.C", "IMPORT"), ("Base", None, "SUPERTYPE"), ("Face", None, "SUPERTYPE"),
        ("Helper", None, "CONSTRUCTOR"), ("run", None, "CALL"), ("two", None, "CALL"), ("listOf", None, "CALL"),
    ]


def test_kotlin_metadata():
    m = Source(KOTLIN, True).metadata("User.kt")
    assert m[:6] == ("com.example.app", "com.example.app.User", "User", ["com.example.Repo", "a.b.C"], ["Service", "a.b.Deep"], ["Base", "com.x.Face"])
    assert Source("package p\nfun f() = 1", True).metadata("Util.kt")[1] == "p.Util"


def test_java():
    s = Source(JAVA, False)
    assert [(n, k) for n, _, k, _, _ in s.symbols()] == [("A", "CLASS"), ("A.A", "FUNCTION"), ("A.go", "FUNCTION"), ("A.x", "PROPERTY"), ("A.y", "PROPERTY"), ("In", "CLASS"), ("In.m", "FUNCTION"), ("E2", "ENUM"), ("E2.z", "PROPERTY"), ("V", "CLASS")]
    assert [(n, q, k) for n, q, k, *_ in s.references()] == [("List", "java.util.List", "IMPORT"), ("Base", "p.z.Base", "IMPORT"), ("Base", "p.z.Base", "SUPERTYPE"), ("F", None, "SUPERTYPE"), ("G", None, "SUPERTYPE")]
    assert s.metadata("A.java")[7] and s.metadata("A.java")[11] == ["A", "go"]


@pytest.mark.parametrize("text", ["", "class", "class {", 'val x = "', "/* open", "fun (", "class A : ", "}}})", "enum class E {", '"""', "'", "@", "import", "class A<"])
def test_broken_text_ends(text):
    for kotlin in (True, False):
        s = Source(text, kotlin)
        s.symbols(), s.references(), s.metadata("F.kt")


def test_strings_hide_code():
    assert [t.text for t in tokens('a """x " ${ "}" } y""" b \'c\' "\\"" d')if t.kind == "name"] == ["a", "b", "d"]


def test_script_dependencies():
    script = 'dependencies { api("g:a:1") implementation("g:b:$v:x") default("g:c:1") testImplementation("no") api("g:a:1") }'
    assert dependencies(script, frozenset(["default"])) == [("api", "g", "a", "1"), ("implementation", "g", "b", "$v"), ("api", "g", "a", "1")]


def test_tree(spark, tmp_path):
    for path, text in {"src/test/kotlin/BTest.kt": "class BTest", "src/main/kotlin/A.kt": "package p\nclass A { fun m() {} }", "src/main/java/J.java": "class J {}", "build/x/K.kt": "class K", "build.gradle.kts": "x", "readme.md": ""}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    f = files.scan_files(spark, str(tmp_path))
    assert sorted(r.name for r in f.collect()) == ["A.kt", "BTest.kt", "J.java", "build.gradle.kts"]
    assert [r.source_set for r in files.source_sets(f).collect()] == ["main", "test"]
    assert files.build_file_names(f.withColumn("project", F.lit("x")), "project").first().build_file == "build.gradle.kts"
    assert sorted(r.name for r in files.symbols_of(files.parse_files(f)).collect()) == ["A", "A.m", "BTest", "J"]
    assert sorted(r.qualified_name for r in files.metadata_of(f).collect()) == ["BTest", "J", "p.A"]


def test_resolved_dependencies(spark):
    rows = [("api", "g", "a", None, 1), ("api", "g", "a", "2", 2), ("archives", "g", "b", "1", 3), ("api", None, "c", "1", 4)]
    got = files.resolved_dependencies(spark.createDataFrame(rows, "scope string, artifact_group string, artifact string, version string, ord int")).collect()
    assert [(r.artifact, r.version) for r in got] == [("a", "unspecified")]


def test_reports(spark, tmp_path):
    c = spark.createDataFrame([(0, "p.A", "A", "g"), (1, "p.B", "B", "g"), (2, "p.C", "C", "h")], "component_id long, qualified_name string, simple_name string, package_group string")
    e = spark.createDataFrame([(0, 1)], "from_id long, to_id long")
    path = reports.write_report(reports.dependency_diagram(c, e), str(tmp_path / "out"), "d.md")
    assert open(path).read().split("\n") == ["```mermaid", "flowchart TD", "    subgraph g", "        p_A[A]", "        p_B[B]", "    end", "    p_A --> p_B", "```", ""]
    assert reports.dependency_diagram(c, e.limit(0)).count() == 0
    points = reports.entry_point_report(spark.createDataFrame([("p.A", "APP")], "qualified_name string, kind string"))
    assert [r.line for r in points.orderBy("part", "a").collect()] == ["## App", "- `p.A`", "## Test\n\nNone detected.", "## Mock\n\nNone detected."]
    s = reports.sequence_diagrams(spark.createDataFrame([(1, ["A", "B"]), (2, ["C"])], "entry long, names array<string>")).collect()
    assert len(s) == 1 and "    A->>B: \n    B-->>A: " in s[0].line
    with pytest.raises(ValueError, match="not inside"):
        reports.clean(str(tmp_path), "../x")
    assert reports.clean(str(tmp_path), "out") and not reports.clean(str(tmp_path), "out")


API = """package com.example

class Api {
    fun fetch(): String = "data"
}

class Client(private val api: Api) {
    fun load(): String = api.fetch()
}
"""


def test_calls_from_source_go_to_the_type_of_their_receiver(spark):
    from loomgraph.operators import receivers

    other = "package com.example\n\nclass Other {\n    fun fetch() = 1\n}\n\ndata class Both(\n    val a: Other,\n    var b: com.x.Api,\n) {\n    fun go() = a?.fetch()\n    fun self() = this.fetch()\n}\n"
    imported = "package com.far\n\nimport com.example.Other\n\nclass Far(val api: Other) {\n    fun run() = api.fetch()\n}\n"
    files = [("/Api.kt", "kt", API), ("/Other.kt", "kt", other), ("/Far.kt", "kt", imported), ("/Empty.kt", "kt", None), ("/J.java", "java", "class J { void fetch() {} }")]
    df = spark.createDataFrame(files, "path string, ext string, text string")
    got = sorted(map(tuple, receivers.calls_of_sources(df).collect()))
    same_package = [("com.example.Both.self", f"com.example.{c}.fetch") for c in ("Api", "Other")]
    assert got == sorted([("com.example.Client.load", "com.example.Api.fetch"), ("com.example.Both.go", "com.example.Other.fetch"), ("com.far.Far.run", "com.example.Other.fetch"), *same_package])
    assert receivers.calls_of_sources(df.filter("path = '/Empty.kt'")).count() == 0


def test_receiver_of_the_context_comes_first(spark):
    from loomgraph.operators import receivers

    symbols = spark.createDataFrame([(1, "K", "p.K", "CLASS", "f", 1, "p"), (2, "A", "p.A", "CLASS", "g", 1, "p"), (3, "B", "p.B", "CLASS", "g", 9, "p")], "symbol_id long, name string, qualified_name string, kind string, file string, line int, package_name string")
    calls = [(1, "m", None, "CALL", "f", 2, "x.m(1)", "y"), (2, "m", None, "CALL", "f", 2, "m(1)", "y"), (3, "m", None, "CALL", "f", 2, "this.m(1)", "this"), (4, "m", None, "CALL", "f", 2, "m(1)", None), (5, "m", None, "NAME_REF", "f", 2, "x.m(1)", "x")]
    refs = spark.createDataFrame(calls, "ref_id long, target_name string, target_qualified_name string, kind string, file string, line int, context string, qualifier string")
    files = spark.createDataFrame([("f", "class K(val x: A, val y: B) {\n}"), ("g", "\n")], "path string, text string")
    assert {r.ref_id: r.receiver for r in receivers.bind_receivers(symbols, refs, files).collect()} == {1: "p.A", 2: "p.B", 3: None, 4: None, 5: None}


def test_a_broken_file_keeps_a_row(spark):
    df = spark.createDataFrame([("/A.kt", "kt", "class A"), ("/B.kt", "kt", "class B {" * 3000)], "path string, ext string, text string")
    got = {r.path: r for r in files.metadata_of(df).collect()}
    assert got["/A.kt"].parse_error is None and got["/A.kt"].simple_name == "A"
    assert got["/B.kt"].parse_error.startswith("RecursionError") and got["/B.kt"].simple_name is None


def test_rendered_sources_are_dealt_evenly(spark):
    from loomgraph.plans import catalog, java_queries, source_calls

    for build, folder in ((catalog._rendered, "/root/testdata/sf0.001"), (java_queries._java, "/root/testdata/sf0.001"), (source_calls._broken_files, "/root/testdata/sf0.01")):
        shares = [r["count"] for r in build(spark, folder).groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) >= 4 and max(shares) < 0.4 * sum(shares)
