import random
from collections import Counter

import pandas as pd
import pytest

from loomgraph.config import EngineConfig
from loomgraph.functions import exprs
from loomgraph.functions.joins import grid_join
from loomgraph.functions.windows import argmax_first, asof_backward, first_per_key, last_per_key
from loomgraph.operators import graph, index, rollup, rules, summary
from loomgraph.operators.resolve import CodeGraph, classified, resolve_names
from pyspark.sql import functions as F

COMPONENT = "component_id long, simple_name string, package_name string, qualified_name string, path string, is_interface boolean, is_abstract boolean, is_data_class boolean, n_methods long, line_count long, has_main boolean"


def code(spark, classes, imports=(), supertypes=(), annotations=()):
    """classes: (name, package, options); the rest: (owner number, name) in order."""
    rows = [
        (i, n, p, f"{p}.{n}" if p else n, o.get("path", f"src/main/kotlin/{n}.kt"), o.get("iface", False), o.get("abstract", False), o.get("data", False), o.get("methods", 1), o.get("lines", 50), False)
        for i, (n, p, o) in enumerate((*c, {})[:3] for c in classes)
    ]
    named = lambda pairs: spark.createDataFrame([(a, i, n) for i, (a, n) in enumerate(pairs)], "component_id long, pos long, name string")
    c, a = spark.createDataFrame(rows, COMPONENT), named(annotations)
    return CodeGraph(classified(c, a), named(imports), named(supertypes), a)


def messages(df):
    return sorted((r.severity, r.message) for r in df.collect())


@pytest.mark.parametrize(
    ("text", "n"),
    [("a\n\n// b\n  c", 2), ("/* a\nb\n*/\nc", 1), ("/* a */\nb", 1), ("a /* b\nc */ d", 2), ("/* a\n b */ c\nd", 1), ("", 0), ("a\r\nb\rc", 3), ("　//x", 1)],
)
def test_code_lines(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(exprs.code_lines(F.col("t"))).first()[0] == n


def test_names(spark):
    df = spark.createDataFrame([("a.b.C",), ("C",)], "n string").select(exprs.last_segment(F.col("n")), exprs.before_last(F.col("n")), exprs.node_id(F.col("n")))
    assert [tuple(r) for r in df.collect()] == [("C", "a.b", "a_b_C"), ("C", "", "C")]


def test_ladder(spark):
    g = code(spark, [("A", "p"), ("B", "p"), ("B", "q"), ("U", "r"), ("X", "")], imports=[(0, "ext.U"), (1, "q.B"), (0, "q.B")])
    names = [(0, "B"), (1, "B"), (0, "U"), (4, "B"), (0, "r.U"), (0, "r.V"), (2, "B"), (4, "X"), (4, "U")]
    got = {(r.owner_id, r.name): r.target_id for r in resolve_names(g, spark.createDataFrame(names, "owner_id long, name string")).collect()}
    # B of q by import; an outside import falls through; two B leave a bare name open; own package; unique name
    assert got == {(0, "B"): 2, (1, "B"): 2, (0, "U"): 3, (4, "B"): None, (0, "r.U"): 3, (0, "r.V"): None, (2, "B"): 2, (4, "X"): 4, (4, "U"): 3}


def test_hub_with_dependents(spark):
    g = code(spark, [("A", "e"), ("B", "e"), ("C", "e"), ("Hub", "e")], imports=[(0, "e.Hub"), (1, "e.Hub"), (2, "e.Hub"), (0, "e.B")])
    top = graph.hub_classes(g.components, graph.import_edges(g)).collect()
    assert [(r.hub, r.dependent_count, r.dependents) for r in sorted(top, key=lambda r: -r.n_edges)] == [("e.Hub", 3, "A,B,C"), ("e.B", 1, "A")]


def test_cycles_by_walk(spark):
    e = spark.createDataFrame([("p", i, a, b) for i, (a, b) in enumerate([("A", "B"), ("B", "A"), ("B", "C"), ("C", "C"), ("D", "A")])], "project string, ord int, a string, b string")
    assert [r.path for r in graph.back_edge_cycles(e).collect()] == [["A", "B", "A"]]


def test_cycles_of_a_walk_are_handed_on_in_pieces(monkeypatch):
    pairs = [(a, b) for a in range(6) for b in range(6) if a != b]
    group = pd.DataFrame([("p", i, a, b, 0) for i, (a, b) in enumerate(pairs)], columns=["project", "ord", "a", "b", "a_part"])
    whole = pd.concat(list(graph._walked(iter([group]))))
    monkeypatch.setattr(graph, "PIECE_NAMES", 4)
    pieces = list(graph._walked(iter([group[:7], group[7:]])))
    assert len(pieces) > 2 and max(sum(map(len, x["path"])) for x in pieces) < 4 + 7
    again = pd.concat(pieces)
    assert again.values.tolist() == whole.values.tolist() and again["nth"].tolist() == list(range(len(whole)))


def test_cycles_of_any_length(spark):
    ring = [(i, (i + 1) % 7) for i in range(7)] + [(7, 0), (6, 8), (8, 9), (3, 3)]
    e = spark.createDataFrame(ring, "a long, b long")
    cycles = graph.canonical_cycles(e)
    assert [r.path for r in cycles.collect()] == ["0 -> 1 -> 2 -> 3 -> 4 -> 5 -> 6 -> 0"]
    walked = graph.back_edge_cycles(e.selectExpr("'p' AS project", "a * 100 + b AS ord", "a", "b"))
    assert messages(rules.circular_dependencies(walked)) == [("WARNING", "Circular dependency: 0 -> 1 -> 2 -> 3 -> 4 -> 5 -> 6 -> 0")]
    assert graph.canonical_cycles(e.filter("a < b")).count() == 0


def walked(edges):
    """The cycles of one project by a plain recursive walk of each component: edges [(ord, a, b)]."""
    pairs = {}
    for o, a, b in edges:
        if a != b:
            pairs[a, b] = min(o, pairs.get((a, b), o))
    reach = {n: set() for p in pairs for n in p}
    for a in reach:
        todo = [a]
        while todo:
            x = todo.pop()
            new = {b for f, b in pairs if f == x} - reach[a]
            reach[a] |= new
            todo += new
    inner = sorted((o, a, b) for (a, b), o in pairs.items() if a in reach[b])
    follow, seen, out = {}, set(), []
    for _, a, b in inner:
        follow.setdefault(a, []).append(b)

    def visit(a, stack):
        seen.add(a)
        for b in follow[a]:
            if b in stack:
                out.append([*stack[stack.index(b) :], b])
            elif b not in seen:
                visit(b, [*stack, b])

    for a in follow:
        if a not in seen:
            visit(a, [a])
    return out, {frozenset(m for m in reach if m in reach[n] and n in reach[m]) for n in reach if n in reach[n]}


@pytest.mark.parametrize("most_local", [10_000, 0])
def test_components_and_walks_equal_brute_force(spark, most_local):
    rng = random.Random(3)
    graphs = {"tree": [(i, i // 2, i) for i in range(1, 9)], "ring": [(i, i, (i + 1) % 5) for i in range(5)], "two": [(0, 5, 1), (1, 1, 2), (2, 2, 1), (3, 2, 7), (4, 7, 8), (5, 8, 7), (6, 5, 5)]}
    graphs["mixed"] = [(i, rng.randrange(24), rng.randrange(24)) for i in range(40)]
    e = spark.createDataFrame([(p, *x) for p, xs in graphs.items() for x in xs], "project string, ord long, a long, b long")
    parts = {}
    for r in graph.strong_components(e, most_local).collect():
        parts.setdefault((r.project, r.component), set()).add(r.node)
    got = {}
    for r in graph.back_edge_cycles(e, most_local).orderBy("project", "ord").collect():
        got.setdefault(r.project, []).append([int(x) for x in r.path])
    for p, xs in graphs.items():
        cycles, comps = walked(xs)
        assert {frozenset(m) for (q, _), m in parts.items() if q == p} == comps
        assert got.get(p, []) == cycles


def test_complete_graph_ends_soon(spark):
    pairs = [("k", i * 12 + j, i, j) for i in range(12) for j in range(12) if i != j]
    cycles = graph.back_edge_cycles(spark.createDataFrame(pairs, "project string, ord long, a long, b long"))
    assert cycles.count() == 66  # of 132 edges 11 lead to a new node, 55 to a finished one
    assert messages(rules.circular_dependencies(cycles))[0][1].startswith("Circular dependency: 0 -> 1 -> ")


def test_large_components_are_found_without_rounds(spark, monkeypatch):
    # 240,000 edges that trimming leaves: a ring of as many nodes as edges would take a round a step to colour
    n = 240_000
    monkeypatch.setattr(graph, "_spread", lambda *_: pytest.fail("coloured in rounds"))
    ring = spark.range(n).selectExpr("'p' AS project", "id AS ord", "id AS a", f"(id + 1) % {n} AS b")
    pairs = spark.range(3000).selectExpr("'q' AS project", "id AS ord", "id AS a", "id + if(id % 2 = 0, 1, -1) AS b")
    parts = graph.strong_components(ring.unionByName(pairs))
    assert sorted(map(tuple, parts.groupBy("project").agg({"node": "count", "component": "max"}).collect())) == [("p", n, 0), ("q", 3000, 2998)]
    walked = graph.back_edge_cycles(pairs, names=spark.range(3000).selectExpr("id AS node", "concat('n', id % 10) AS name")).orderBy("ord").collect()
    assert [r.path for r in walked] == [[f"n{i % 10}", f"n{i % 10 + 1}", f"n{i % 10}"] for i in range(0, 3000, 2)] and [r.ord for r in walked] == list(range(1500))


def test_component_cycles_show_simple_names(spark):
    g = code(spark, [("A", "p"), ("B", "q"), ("C", "p")], imports=[(0, "q.B"), (1, "p.A"), (2, "p.A")])
    assert [r.path for r in graph.component_cycles(g.components, graph.import_edges(g)).collect()] == [["A", "B", "A"]]


def test_report_order_is_total(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1, 10), ("FORBIDDEN", "WARNING", "INFO")[k], k, f"m{rng.randrange(40)}", f"f{rng.randrange(4)}", "s", rng.randrange(5)) for k in [rng.randrange(3) for _ in range(500)]]
    schema = "rule_ord int, severity string, severity_rank int, message string, file string, suggestion string, item long"
    got = [(r.ord, (r.severity_rank, r.file, r.rule_ord, r.item, r.message)) for r in rules.in_report_order(spark.createDataFrame(rows, schema).repartition(7)).collect()]
    assert [k for _, k in sorted(got)] == sorted((r[2], r[4], r[0], r[6], r[3]) for r in rows) and sorted(o for o, _ in got) == list(range(1, 501))
    assert rules.in_report_order(spark.createDataFrame([], schema)).count() == 0


def test_greedy_chain(spark):
    # 0 leads to 1 (two ways on) before 2 (one); 1 to 3, whose only way back is taken already; 4 is configuration
    g = code(spark, [("A", "p"), ("B", "p"), ("C", "p"), ("D", "p"), ("E", "p")], annotations=[(4, "Configuration")])
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 4), (1, 3), (1, 0), (2, 3), (3, 0), (4, 0), (4, 1), (4, 2)], "from_id long, to_id long")
    chains = graph.greedy_chains(g.components, e, g.components.filter("component_id in (0, 2)"))
    assert sorted((r.entry, r.chain) for r in chains.collect()) == [(0, "0 -> 1 -> 3"), (2, "2 -> 3 -> 0 -> 1")]
    assert [r.chain for r in graph.greedy_chains(g.components, e, g.components.filter("component_id = 2"), hops=1).collect()] == ["2 -> 3"]


def test_same_package_reference(spark):
    g = code(spark, [("A", "p"), ("Bé", "p"), ("A", "q"), ("Cc", "p")])
    texts = spark.createDataFrame([(0, "val x: Bé = Ccc // Cc"), (3, "// A\n/* A */ call(Bé)")], "component_id long, code_text string")
    assert sorted(map(tuple, graph.same_package_edges(g.components, texts).collect())) == [(0, 1), (0, 3), (3, 1)]


def test_rules(spark):
    chain = [("Base", "m"), ("L1", "m"), ("L2", "m"), ("L3", "m")]
    g = code(spark, [*chain, ("StringHelper", "e.helpers"), ("Repo", "e", {"iface": True}), ("RepoImpl", "e"), ("God", "e", {"methods": 30, "lines": 1001}), ("Use", "e")], imports=[(8, "e.RepoImpl"), (8, "e.God")], supertypes=[(1, "Base"), (2, "L1"), (3, "L2"), (6, "Repo")])
    assert messages(rules.deep_inheritance(g)) == [("WARNING", "`L3` has inheritance depth 3: L3 -> L2 -> L1 -> Base")]
    assert messages(rules.smell_classes(g)) == [("FORBIDDEN", "`StringHelper` is a helper class")]
    assert messages(rules.forbidden_packages(g)) == [("FORBIDDEN", "Package `e.helpers` uses forbidden name `helpers`")]
    assert messages(rules.single_implementations(g)) == [("INFO", "Interface `Repo` has only one implementation: `RepoImpl`")]
    assert messages(rules.god_classes(g)) == [("WARNING", "`God` may be doing too much (30 methods, 1001 lines)")]
    assert messages(rules.dependency_inversion(g)) == [("INFO", "Dependency on concrete class `God` in `Use`"), ("WARNING", "Dependency on concrete `RepoImpl` instead of interface `Repo`")]
    assert messages(rules.missing_tests(g)) == [("INFO", "`StringHelper` has no test")]
    extra = EngineConfig().extended(class_patterns=["God"], replace_defaults=True)
    assert messages(rules.forbidden_class_names(g, extra)) == [("WARNING", "`God` contains forbidden pattern `God`")]


def test_cyclic_inheritance_ends(spark):
    g = code(spark, [("A", "p"), ("B", "p")], supertypes=[(0, "B"), (1, "A")])
    assert sorted((r.component_id, r.depth) for r in graph.inheritance_chains(g).collect()) == [(0, 1), (1, 1)]


def test_long_inheritance_chain(spark):
    n = 67
    g = code(spark, [(f"K{i}", "p") for i in range(n)], supertypes=[(i, f"K{i - 1}") for i in range(1, n)])
    assert {(r.component_id, r.depth) for r in graph.inheritance_chains(g).collect()} == {(i, i) for i in range(n)}


def test_windows(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 2, 7), ("k", 3, 7)], "k string, o int, m int")
    assert first_per_key(df, ["k"], "o").first().o == 1 and last_per_key(df, ["k"], "o").first().o == 3 and argmax_first(df, ["k"], "m", "o").first().o == 2


def test_asof_ties(spark):
    e = spark.createDataFrame([("f", 1, 10), ("f", 4, 12), ("f", 4, 11)], "file string, line int, id long")
    q = spark.createDataFrame([("f", 0), ("f", 1), ("f", 4), ("f", 9), ("g", 9)], "file string, line int")
    assert sorted(map(tuple, asof_backward(e, q, ["file"], "line", "id", "id").collect()), key=str) == sorted([("f", 0, None), ("f", 1, 10), ("f", 4, 11), ("f", 9, 11), ("g", 9, None)], key=str)


def test_build_edges(spark):
    deps = spark.createDataFrame([("api-client", "http-core"), ("api-client", "shared-models"), ("http-core", "shared-models"), ("http-core", "other"), ("api-client", "http-core"), ("http-core", "http-core")], "build string, artifact string")
    builds = spark.createDataFrame([("api-client",), ("http-core",), ("shared-models",)], "build string")
    assert sorted(map(tuple, rollup.build_edges(deps, builds).collect())) == [("api-client", "http-core"), ("api-client", "shared-models"), ("http-core", "shared-models")]


def test_interface_naming(spark):
    got = rollup.interface_candidates(spark.createDataFrame([("ILogger",), ("LoggerImpl",), ("FakeILogger",)], "name string")).collect()
    assert [tuple(r) for r in got] == [("ILogger", 1, True)]


def test_strict_dependencies_fail_on_blank_parts(spark):
    deps = spark.createDataFrame([("g", "a", "1"), ("g", " ", "1"), (None, "b", "2")], "artifact_group string, artifact string, version string")
    kept, bad = summary.checked_dependencies(deps, strict=False)
    assert (kept.count(), bad.count()) == (1, 2)
    with pytest.raises(Exception, match="blank group"):
        summary.checked_dependencies(deps)[0].collect()


def test_call_with_receiver_goes_to_its_type(spark):
    symbols = [(1, "Api.fetch", "p.Api.fetch", "FUNCTION", "Api", 2, "p"), (2, "Other.fetch", "q.Other.fetch", "FUNCTION", "Other", 2, "q"), (3, "Client.load", "q.Client.load", "FUNCTION", "Client", 3, "q")]
    s = spark.createDataFrame(symbols, "symbol_id long, name string, qualified_name string, kind string, file string, line long, package_name string")
    schema = "ref_id long, target_name string, target_qualified_name string, kind string, file string, line long, receiver string"
    for receiver, target in (("p.Api", "p.Api.fetch"), (None, "q.Other.fetch"), ("x.Unknown", "q.Other.fetch")):
        refs = spark.createDataFrame([(1, "fetch", None, "CALL", "Client", 4, receiver)], schema)
        assert [(r.caller, r.target) for r in index.call_graph(s, refs).collect()] == [("q.Client.load", target)]


def test_interfaces_of_summaries(spark):
    found = spark.createDataFrame([("Interface `ILogger` has only one implementation: `X`", ":b", 2, 1), ("Interface `ILogger` has only one implementation: `X`", ":a", 9, 1), ("Interface `MAX_X` has one", ":a", 1, 1), ("other", ":a", 1, 2)], "message string, project string, project_ord int, ord long")
    names = ["ILogger", "FileLogger", "MockILogger", "Logger", "LoggerImpl", "DefaultILogger", "OrderService", "SERVICE", "TestOrderService", "IT"]
    classes = spark.createDataFrame([(n, "p", "test", 1, i) for i, n in enumerate(names)], "name string, package_name string, source_set string, project_ord int, item long")
    got = sorted(tuple(r) for r in summary.interfaces_of_summaries(found, classes).select("name", "package_name", "source_set", "n_impl", "has_mock").collect())
    assert got == [("ILogger", ":b", "main", 3, True), ("OrderService", "p", "test", 1, False), ("TestOrderService", "p", "test", 0, False)]
    assert summary.interfaces_of_summaries(found.filter("false"), classes.filter("name = 'Logger'")).count() == 0


SYMBOL_ROW = "symbol_id long, name string, qualified_name string, kind string, file string, line long, package_name string"
REF_ROW = "ref_id long, target_name string, target_qualified_name string, kind string, file string, line long"


def test_usages_of_a_frequent_name_are_not_shuffled(spark):
    # 200 x 200 pairs of one name, some at a symbol's own place, ids that stand for several rows, a row without a place
    symbols = [(i, "C", "p.C", "CLASS", "f", i, "p") for i in range(200)] + [(3, "C", "p.C", "CLASS", "g", 3, "p"), (900, "D", "q.D", "CLASS", "f", 1, "q"), (901, "C", "p.C", "CLASS", None, 7, "p")]
    refs = [(1000 + i, "C", "p.C", "IMPORT", "f", i) for i in range(200)] + [(1000, "C", "p.C", "IMPORT", "f", 0), (1001, "D", "x.D", "IMPORT", "h", 1), (2000, "D", "x.D", "IMPORT", "f", 1), (2001, "D", None, "CALL", "h", 1)]
    s, r = spark.createDataFrame(symbols, SYMBOL_ROW), spark.createDataFrame(refs, REF_ROW)
    elsewhere = lambda f, n, g, m: (f, n) != (g, m) and (f is not None or n != m)
    want = {(x[0], y[0]) for x in symbols for y in refs if (x[2] == y[2] or x[0] == 900 and y[1] == "D") and elsewhere(x[4], x[5], y[4], y[5])}
    got = [tuple(x) for x in index.usages(s, r).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    totals = {x.symbol_id: x.n_usages for x in index.usage_totals(s, r).collect()}
    assert totals == Counter(i for i, _ in want)


@pytest.mark.parametrize("cell", [1, 7, 10_000])
def test_grid_join_is_the_join(spark, cell):
    a = spark.range(60).selectExpr("if(id < 40, 'hot', concat('k', id)) AS k", "id AS x")
    b = spark.range(50).selectExpr("if(id < 25, 'hot', concat('k', id)) AS k", "id AS y")
    got = sorted(map(tuple, grid_join(a, b, ["k"], cell).select("k", "x", "y").collect()))
    assert got == sorted(map(tuple, a.join(b, "k").select("k", "x", "y").collect())) and len(got) == 1010


def test_rows_of_a_grid_grow_with_the_input(spark, monkeypatch):
    # 3,000 by 3,000 pairs of one name in cells of one by one would repeat each row 3,000 times
    a, b = spark.range(3000).selectExpr("'hot' AS k", "id AS x"), spark.range(3000).selectExpr("'hot' AS k", "id AS y")
    repeated = []
    merged = type(a).join
    monkeypatch.setattr(type(a), "join", lambda self, other, on=None, *how: repeated.extend([self.count(), other.count()] if on == ["k", "__line", "__column"] else []) or merged(self, other, on, *how))
    got = grid_join(a, b, ["k"], 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(repeated) == 2 and max(repeated) <= 3000 * (1 + (16 * parts) ** 0.5)
    assert got.count() == got.select("x", "y").distinct().count() == 9_000_000


def test_links_by_name_are_the_edges(spark):
    # 40 classes of one name in a package that all name themselves, others that name them, links that imports hold too
    classes = [("Same", "p")] * 40 + [("User", "p"), ("Lone", "p"), ("Out", "q"), ("Same", "q")]
    g = code(spark, classes, imports=[(40, "p.Same"), (40, "p.Lone"), (42, "p.Same"), (41, "q.Out"), (39, "p.User")], supertypes=[(42, "Same")])
    texts = spark.createDataFrame([(i, "Same") for i in range(41)] + [(41, "Lone"), (42, "Same Out"), (43, "Same")], "component_id long, code_text string")
    plain = graph.dependency_edges(graph.import_edges(g), graph.supertype_edges(g), graph.same_package_edges(g.components, texts))
    d = graph.dependencies(g, texts)
    assert d.pairs.count() < 6 and plain.count() > 1600
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(d.edges(), plain)
    assert same(graph.hub_classes(g.components, d), graph.hub_classes(g.components, plain))
    for x in (d, plain):
        assert [r.component_id for r in graph.graph_roots(g.components, x).collect()] == []
    assert same(d.ends(), graph.Dependencies.of(plain).ends())
    labels = g.components.selectExpr("component_id", "qualified_name AS label")
    unlike = lambda x: graph.Dependencies.of(x).named_by(labels).filter("a <> b")
    assert same(unlike(d), unlike(plain)) and same(d.named_by(labels).select("a", "b"), graph.Dependencies.of(plain).named_by(labels).select("a", "b"))
    entries = g.components.filter("component_id % 5 = 0")
    assert same(graph.greedy_chains(g.components, d, entries), graph.greedy_chains(g.components, plain, entries))
