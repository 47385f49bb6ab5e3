"""The dependency graph: edges, hubs, roots, cycles, inheritance depth and chains."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.functions.exprs import strip_comments
from loomgraph.functions.joins import grid_join
from loomgraph.functions.windows import argmax_first
from loomgraph.operators.resolve import CodeGraph, by_qualified_name, resolved_supertypes
from loomgraph.storage import cut_lineage

# Edges that may be left when components are finished project by project; above it they are coloured in rounds. One takes
# a task 12 bytes at most, and a node of it as much as NODE_EDGES edges.
MOST_LOCAL_EDGES = 80_000_000
NODE_EDGES = 5
TRIM_ROUNDS = 4
# Names of cycles that a walk holds before it hands them on.
PIECE_NAMES = 1_000_000


def import_edges(graph: CodeGraph) -> DataFrame:
    hits = graph.imports.join(by_qualified_name(graph.components), F.col("name") == F.col("qualified_name"))
    return hits.filter("component_id <> found").select(F.col("component_id").alias("from_id"), F.col("found").alias("to_id")).distinct()


def supertype_edges(graph: CodeGraph) -> DataFrame:
    return resolved_supertypes(graph).filter("owner_id <> target_id").select(F.col("owner_id").alias("from_id"), F.col("target_id").alias("to_id")).distinct()


# A name in a package: what same-package references and the classes they mean have in common.
NAME = ["package_name", "simple_name"]


def same_package_links(components: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components that name another of their package in their code (texts: component_id, code_text), by name.

    uses(package_name, simple_name, from_id) and named(package_name, simple_name, to_id): every user of a name means
    every class of that name but itself. Texts become sets of identifier tokens, so no pattern is tried on a pair.
    """
    tokens = texts.select("component_id", F.explode(F.array_distinct(F.regexp_extract_all(strip_comments(F.col("code_text")), F.lit(r"[\p{L}\p{N}_]+"), 0))).alias("simple_name"))
    owner = components.filter("package_name <> ''").select("component_id", "package_name")
    named = components.filter("package_name <> '' and length(simple_name) >= 2").select(*NAME, F.col("component_id").alias("to_id")).distinct()
    uses = tokens.join(owner, "component_id").join(named.select(*NAME).distinct(), NAME, "left_semi").select(*NAME, F.col("component_id").alias("from_id")).distinct()
    return uses, named


def _linked(uses: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs of same-package links, each once; they grow with users times classes of a name."""
    return grid_join(uses, named, NAME).filter("from_id <> to_id").select("from_id", "to_id")


def same_package_edges(components: DataFrame, texts: DataFrame) -> DataFrame:
    return _linked(*(cut_lineage(x) for x in same_package_links(components, texts)))


def dependency_edges(*edge_sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, edge_sets).distinct()


@dataclass(frozen=True)
class Dependencies:
    """Dependency edges without the pairs of same-package links, whose number grows with the square of a name's classes.

    pairs(from_id, to_id), each once and none that the links hold as well; uses and named as in same_package_links.
    """

    pairs: DataFrame
    uses: DataFrame
    named: DataFrame

    @staticmethod
    def of(edges: DataFrame | Dependencies) -> Dependencies:
        """Plain edges(from_id, to_id), each once, without links."""
        if isinstance(edges, Dependencies):
            return edges
        none = edges.sparkSession.createDataFrame([], "package_name string, simple_name string, from_id long, to_id long")
        return Dependencies(edges, none.drop("to_id"), none.drop("from_id"))

    def edges(self) -> DataFrame:
        """All edges(from_id, to_id), each once."""
        return self.pairs.unionByName(_linked(self.uses, self.named))

    def _degrees(self, end: str, own: DataFrame, own_id: str, other: DataFrame, other_id: str) -> DataFrame:
        met = other.groupBy(*NAME).agg(F.count("*").alias("n"))
        itself = other.select(*NAME, F.col(other_id).alias(own_id), F.lit(1).alias("self"))
        links = own.join(met, NAME).join(itself, [*NAME, own_id], "left").select(F.col(own_id).alias(end), (F.col("n") - F.coalesce("self", F.lit(0))).alias("n"))
        return self.pairs.groupBy(end).agg(F.count("*").alias("n")).unionByName(links).groupBy(end).agg(F.sum("n").alias("n")).filter("n > 0")

    def in_degrees(self) -> DataFrame:
        """(to_id, n): how many edges lead to a node, if any."""
        return self._degrees("to_id", self.named, "to_id", self.uses, "from_id")

    def out_degrees(self) -> DataFrame:
        """(from_id, n): how many edges lead from a node, if any."""
        return self._degrees("from_id", self.uses, "from_id", self.named, "to_id")

    def ends(self) -> DataFrame:
        """component_id of every node with an edge."""
        return self.in_degrees().select(F.col("to_id").alias("component_id")).unionByName(self.out_degrees().select(F.col("from_id").alias("component_id"))).distinct()

    def named_by(self, labels: DataFrame) -> DataFrame:
        """Edges by labels(component_id, label), each pair of labels once: (a, b, from_id, to_id).

        from_id and to_id are the least edge of two different labels, and any of a label with itself.
        """
        at = lambda df, end, name: df.join(labels.select(F.col("component_id").alias(end), F.col("label").alias(name)), end)
        least = F.min(F.struct("from_id", "to_id")).alias("edge")
        plain = at(at(self.pairs, "from_id", "a"), "to_id", "b").groupBy("a", "b").agg(least)
        users = at(self.uses, "from_id", "a").groupBy(*NAME, "a").agg(F.min("from_id").alias("from_id"), F.max("from_id").alias("from_max"))
        means = at(self.named, "to_id", "b").groupBy(*NAME, "b").agg(F.min("to_id").alias("to_min"), F.max("to_id").alias("to_max"))
        # users of a label that all are classes of the name meet one another, unless there is but one
        met = users.join(means, NAME).filter("not (from_id = from_max and to_min = to_max and from_id = to_min)")
        linked = met.select("a", "b", F.struct("from_id", F.when(F.col("to_min") == F.col("from_id"), F.col("to_max")).otherwise(F.col("to_min")).alias("to_id")).alias("edge"))
        return plain.unionByName(linked).groupBy("a", "b").agg(F.min("edge").alias("edge")).select("a", "b", "edge.*")


def dependencies(graph: CodeGraph, texts: DataFrame) -> Dependencies:
    """The edges of imports, supertypes and same-package references (texts: component_id, code_text)."""
    uses, named = (cut_lineage(x) for x in same_package_links(graph.components, texts))
    pairs = dependency_edges(import_edges(graph), supertype_edges(graph))
    held = uses.select("from_id", *NAME)
    return Dependencies(cut_lineage(pairs.join(named, "to_id", "left").join(held, ["from_id", *NAME], "left_anti").select("from_id", "to_id")), uses, named)


def hub_classes(components: DataFrame, edges: DataFrame | Dependencies, limit: int = EngineConfig.project_hubs) -> DataFrame:
    """Most depended-on qualified names: rank by edges, report distinct dependents (their sorted simple names)."""
    d = Dependencies.of(edges)
    c = components.select("component_id", "qualified_name", "simple_name")
    to = c.select(F.col("component_id").alias("to_id"), F.col("qualified_name").alias("hub"))
    frm = c.select(F.col("component_id").alias("from_id"), F.col("qualified_name").alias("dep"), F.col("simple_name").alias("dep_name"))
    known = d.pairs.join(frm.select("from_id"), "from_id", "left_semi")
    counted = Dependencies(known, d.uses.join(frm.select("from_id"), "from_id", "left_semi"), d.named).in_degrees()
    raw = cut_lineage(counted.join(to, "to_id").groupBy("hub").agg(F.sum("n").alias("n_edges")).orderBy(F.desc("n_edges"), "hub").limit(limit))
    top = cut_lineage(to.join(F.broadcast(raw), "hub").select("to_id", "hub"))
    # of one class of a hub its own use is no edge; of several, each is used by the others
    meant = d.named.join(top, "to_id").groupBy(*NAME, "hub").agg(F.min("to_id").alias("least"), F.max("to_id").alias("most"))
    linked = d.uses.join(meant, NAME).filter("least <> most or least <> from_id").select("hub", "from_id")
    users = d.pairs.join(top, "to_id").select("hub", "from_id").unionByName(linked)
    names = users.join(frm, "from_id").groupBy("hub").agg(F.collect_set(F.struct("dep_name", "dep")).alias("d")).join(F.broadcast(raw), "hub")
    return names.select("hub", "n_edges", F.size("d").cast("long").alias("dependent_count"), F.array_join(F.transform(F.sort_array("d"), lambda x: x["dep_name"]), ",").alias("dependents"))


def graph_roots(components: DataFrame, edges: DataFrame | Dependencies) -> DataFrame:
    """Components with outgoing and no incoming edges that are not data classes."""
    d = Dependencies.of(edges)
    out = d.out_degrees().select(F.col("from_id").alias("component_id"))
    inn = d.in_degrees().select(F.col("to_id").alias("component_id"))
    return components.filter(~F.col("is_data_class")).join(out, "component_id", "left_semi").join(inn, "component_id", "left_anti")


def canonical_cycles(edges: DataFrame) -> DataFrame:
    """Every simple cycle, once, from its least node: edges(a, b) -> path.

    Edges from a node without a way in, or to one without a way out, are taken off first, so a graph without cycles
    leaves no path to follow; then paths grow by one self-join a step until none is open.
    """
    step = cut_lineage(edges.filter("a <> b").select("a", "b").distinct())
    left, n = step.count(), -1
    while left != n:
        n = left
        step = step.join(step.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(step.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        step = cut_lineage(step)
        left = step.count()
    paths = step.filter("a < b").select(F.col("a").alias("head"), F.col("b").alias("last"), F.array("a", "b").alias("nodes"))
    found = []
    while not found or not paths.isEmpty():
        closed = paths.join(step, (F.col("last") == step.a) & (F.col("head") == step.b))
        found.append(closed.select(F.concat("nodes", F.array("head")).alias("nodes")))
        grown = paths.join(step, F.col("last") == step.a).filter((F.col("b") > F.col("head")) & ~F.array_contains("nodes", F.col("b")))
        paths = cut_lineage(grown.select("head", F.col("b").alias("last"), F.concat("nodes", F.array("b")).alias("nodes")))
    return reduce(DataFrame.unionByName, found).select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), " -> ").alias("path"))


def _trimmed(live: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes that have both a way in and a way out, as far as a few rounds tell, and their number.

    Rounds end when they take off less than a tenth. Both sides of a join grow with the edges, so they are shuffled and
    never broadcast.
    """
    n = -1
    for _ in range(TRIM_ROUNDS):
        ways = [live.select("project", F.col(end).alias("node")).distinct() for end in ("a", "b")]
        nodes = cut_lineage(ways[0].join(ways[1].hint("merge"), ["project", "node"], "left_semi"))
        for end in ("a", "b"):
            live = live.join(nodes.withColumnRenamed("node", end).hint("merge"), ["project", end], "left_semi")
        live = cut_lineage(live)
        left = live.count()
        if left == 0 or 0.9 * n <= left <= n:
            return live, left
        n = left
    return live, n


def _spread(values: DataFrame, along: DataFrame, own: bool) -> DataFrame:
    """The least value that reaches each node along edges (a to b), to a fixed point: values(project, node, value).

    own: every node starts with a value, and takes a smaller one; else values go to nodes that have none.
    """
    while True:
        sent = along.join(values.select("project", F.col("node").alias("a"), "value"), ["project", "a"]).groupBy("project", F.col("b").alias("node")).agg(F.min("value").alias("sent"))
        if own:
            news = cut_lineage(values.join(sent, ["project", "node"], "left").select("project", "node", F.least("value", "sent").alias("value"), (F.col("sent") < F.col("value")).alias("new")))
            done = news.filter("new").isEmpty()
            values = news.drop("new")
        else:
            news = cut_lineage(sent.join(values.select("project", "node"), ["project", "node"], "left_anti").withColumnRenamed("sent", "value"))
            done = news.isEmpty()
            values = values.unionByName(news)
        if done:
            return values
        values = cut_lineage(values)


def _strong(starts: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """A number for each node, the same for all of its strongly connected component, by an iterative low-link walk.

    Node i's edges lead to follow[starts[i]:starts[i + 1]]; -1 is a node without a way out, which is on no cycle.
    """
    n = len(starts) - 1
    at, end, to = memoryview(starts[:-1].copy()), memoryview(starts[1:]), memoryview(follow)
    number, low, part = array("i", [-1]) * n, array("i", [0]) * n, array("i", [-1]) * n
    count, held = 0, []
    for start in range(n):
        if number[start] >= 0:
            continue
        path = [start]
        number[start] = low[start] = count
        count += 1
        held.append(start)
        while path:
            node = path[-1]
            i = at[node]
            if i < end[node]:
                at[node] = i + 1
                b = to[i]
                if b < 0:
                    continue
                if number[b] < 0:
                    number[b] = low[b] = count
                    count += 1
                    held.append(b)
                    path.append(b)
                elif part[b] < 0 and number[b] < low[node]:
                    low[node] = number[b]
            else:
                path.pop()
                if path and low[node] < low[path[-1]]:
                    low[path[-1]] = low[node]
                if low[node] == number[node]:
                    while part[node] < 0:
                        part[held.pop()] = node
    return np.frombuffer(part, np.int32)


def _local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strongly connected components of two nodes or more: batches(project, a, b) sorted by project and a.

    Edges of a project are held as numbers of 4 bytes.
    """

    def finished() -> pa.RecordBatch:
        own = np.concatenate(nodes)
        index = pd.Index(own)
        for i, b in enumerate(ends):
            ends[i] = index.get_indexer(b).astype(np.int32)
        part = _strong(np.append(np.concatenate(starts), n).astype(np.int64), np.concatenate(ends))
        on = np.flatnonzero(np.bincount(part, minlength=len(part))[part] > 1)
        _, first, of = np.unique(part[on], return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array([project] * len(on), types[0]), pa.array(own[on], types[1]), pa.array(own[on[first[of]]], types[1])], ["project", "node", "component"])

    project, nodes, starts, ends, n = None, [], [], [], 0
    for batch in batches:
        types = [batch.schema.field(0).type, batch.schema.field(1).type]
        p, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1), len(p)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if n and p[low] != project:
                yield finished()
                nodes, starts, ends, n = [], [], [], 0
            x, project = a[low:high], p[low]
            new = np.flatnonzero(np.concatenate(([not n or x[0] != last], x[1:] != x[:-1])))
            nodes.append(x[new])
            starts.append(new + n)
            ends.append(b[low:high])
            n, last = n + len(x), x[-1]
    if n:
        yield finished()


def _is_local(live: DataFrame, left: int, most_local: int) -> bool:
    """Whether `left` edges and their nodes, each as large as NODE_EDGES edges, may be held by one task."""
    if left > most_local or left * (1 + NODE_EDGES) <= most_local:
        return left <= most_local
    return left + NODE_EDGES * live.select("project", "a").distinct().count() <= most_local


def strong_components(edges: DataFrame, most_local: int = MOST_LOCAL_EDGES) -> DataFrame:
    """edges(project, a, b) -> (project, node, component): nodes on cycles, by the least node of their component.

    Nodes without a way in or out are trimmed off. While more than `most_local` edges are left, every node takes the
    least node that reaches it as its colour, and what reaches a colour's own node within the colour is its component;
    components and edges between colours go, and the rest is trimmed again. The last `most_local` edges, of all
    projects together, are finished project by project.
    """
    return _components(*_trimmed(cut_lineage(edges.filter("a <> b").select("project", "a", "b").distinct())), most_local)


def _components(live: DataFrame, left: int, most_local: int) -> DataFrame:
    """strong_components of `left` trimmed edges."""
    kind = live.schema["a"].dataType.simpleString()
    schema = f"project {live.schema['project'].dataType.simpleString()}, node {kind}, component {kind}"
    found = []
    while not _is_local(live, left, most_local):
        nodes = live.select("project", F.col("a").alias("node")).unionByName(live.select("project", F.col("b").alias("node")))
        colour = _spread(nodes.distinct().withColumn("value", F.col("node")), live, True)
        of = lambda end: colour.select("project", F.col("node").alias(end), F.col("value").alias(f"{end}_colour"))
        inside = cut_lineage(live.join(of("a"), ["project", "a"]).join(of("b"), ["project", "b"]).filter("a_colour = b_colour").select("project", "a", "b", F.col("a_colour").alias("colour")))
        back = inside.select("project", F.col("b").alias("a"), F.col("a").alias("b"))
        reached = _spread(colour.filter("node = value"), back, False)
        found.append(reached.join(inside.select("project", F.col("a").alias("node")).unionByName(inside.select("project", F.col("b").alias("node"))).distinct(), ["project", "node"], "left_semi").select("project", "node", F.col("value").alias("component")))
        done = reached.select("project", "node")
        live = inside.join(done.withColumnRenamed("node", "a"), ["project", "a"], "left_anti").join(done.withColumnRenamed("node", "b"), ["project", "b"], "left_anti").select("project", "a", "b")
        live, left = _trimmed(cut_lineage(live))
    # Spark sorts, and spills where it must, so that a task only keeps where edges lead
    found.append(live.select("project", "a", "b").repartition("project").sortWithinPartitions("project", "a").mapInArrow(_local_components, schema))
    return cut_lineage(reduce(DataFrame.unionByName, found))


def _cycles_of(a: np.ndarray, b: np.ndarray, shown: dict) -> Iterator[list[str]]:
    """The cycles of one component's edges, which come in their order."""
    codes, nodes = pd.factorize(a)
    follow = memoryview(pd.Index(nodes).get_indexer(b)[np.argsort(codes, kind="stable")])
    starts = np.concatenate(([0], np.cumsum(np.bincount(codes))))
    at, end = memoryview(starts[:-1].copy()), memoryview(starts[1:])
    text = [str(shown.get(x, x)) for x in nodes.tolist()]
    # a node's place on the stack; -1 before the walk comes to it, -2 when it is done
    stack, place = [0], array("q", [-1]) * len(nodes)
    place[0] = 0
    while stack:
        node = stack[-1]
        i = at[node]
        if i == end[node]:
            place[stack.pop()] = -2
            continue
        at[node] = i + 1
        to = follow[i]
        if place[to] >= 0:
            yield [*(text[x] for x in stack[place[to] :]), text[to]]
        elif place[to] == -1:
            place[to] = len(stack)
            stack.append(to)


def _walked(frames: Iterator[pd.DataFrame], order: tuple[str, ...] = ("ord",)) -> Iterator[pd.DataFrame]:
    """The cycles of components, in pieces of about PIECE_NAMES names: those of one together may be as long as its square.

    frames(project, a_part, a, b, order): edges, those of a component one after another in their order; nodes are shown by
    the column `name` of their edges, if there is one.
    """
    rows, names = [], 0
    key, first, held, shown = None, None, [], {}

    def piece() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["project", *order, "a_part", "nth", "path"])

    def finished() -> Iterator[pd.DataFrame]:
        nonlocal rows, names
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for nth, path in enumerate(_cycles_of(a, b, shown)):
            rows.append((key[0], *first, key[1], nth, path))
            names += len(path)
            if names >= PIECE_NAMES:
                yield piece()
                rows, names = [], 0

    for x in frames:
        p, part, a, b = (x[c].to_numpy() for c in ("project", "a_part", "a", "b"))
        cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (part[1:] != part[:-1])) + 1), len(x)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if held and key != (p[low], part[low]):
                yield from finished()
                shown = {}
            if not held:
                key, first = (p[low], part[low]), [x[c].iloc[low] for c in order]
            held.append((a[low:high], b[low:high]))
            if "name" in x:
                shown.update(zip(a[low:high].tolist(), x["name"].iloc[low:high], strict=True))
    if held:
        yield from finished()
    yield piece()


def back_edge_cycles(edges: DataFrame, most_local: int = MOST_LOCAL_EDGES, order: tuple[str, ...] = ("ord",), names: DataFrame | None = None) -> DataFrame:
    """One cycle for each back edge of a depth-first walk: edges(project, ord, a, b) -> project, ord, path.

    A cycle lies within one strongly connected component, so only components are walked, each on its own and in one task,
    from its first node in the order of edges; work is linear in a component's edges. Cycles are numbered within
    their project by component (in the order of first edges), then as the walk meets them. `order` are the columns that
    order edges; paths show nodes by names(node, name), or as they are.
    """
    live, left = _trimmed(cut_lineage(edges.filter("a <> b").groupBy("project", "a", "b").agg(F.min(F.struct(*order)).alias("first")).select("project", "a", "b", "first.*")))
    parts = _components(live.select("project", "a", "b"), left, most_local)
    of = lambda end: parts.select("project", F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    # parts grow with the edges: broadcast, they would pass through the driver
    inside = live.join(of("a").hint("merge"), ["project", "a"]).join(of("b").hint("merge"), ["project", "b"]).filter("a_part = b_part").drop("b_part")
    if names is not None:
        inside = inside.join(names.withColumnRenamed("node", "a").hint("merge"), "a")

    kind = lambda c: edges.schema[c].dataType.simpleString()
    schema = f"project {kind('project')}, {''.join(f'{c} {kind(c)}, ' for c in order)}a_part {kind('a')}, nth int, path array<string>"

    # dealt by rows, not by groups: most components are of a few edges, and a group of its own costs far more than they do
    parts_n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = inside.repartition(parts_n, "project", "a_part").sortWithinPartitions("project", "a_part", *order, "a", "b")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _walked(frames, order)

    found = cut_lineage(sorted_.mapInPandas(walk, schema))
    # components are sorted, not their cycles: a cycle's number is its place behind those of earlier components
    before = Window.partitionBy("project").orderBy(*order, "a_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("project", *order, "a_part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = found.join(starts.select("project", "a_part", "start"), ["project", "a_part"])
    return placed.select("project", (F.col("start") + F.col("nth")).cast("int").alias("ord"), "path")


def component_cycles(components: DataFrame, edges: DataFrame | Dependencies, project: str = "project") -> DataFrame:
    """Cycles of the dependency graph by qualified name, edges in scan order of their ends; paths show simple names."""
    named = components.filter("qualified_name is not null").select("component_id", "qualified_name")
    # a name's least component stands for it, so that edges are pairs of numbers
    labels = cut_lineage(named.withColumn("label", F.min("component_id").over(Window.partitionBy("qualified_name"))))
    ordered = Dependencies.of(edges).named_by(labels.select("component_id", "label")).withColumn("project", F.lit(project))
    names = labels.filter("component_id = label").select(F.col("label").alias("node"), F.substring_index("qualified_name", ".", -1).alias("name")).distinct()
    return back_edge_cycles(ordered, order=("from_id", "to_id"), names=names)


def inheritance_chains(graph: CodeGraph) -> DataFrame:
    """(component_id, depth, chain): how far first supertypes lead through classes, and their names.

    A functional graph, walked by one self-join a level until no walk goes on; a name seen before ends a walk. Joins of
    tables that grow with the components are shuffled: broadcast, each level would send them through the driver.
    """
    first = resolved_supertypes(graph).hint("merge").join(graph.supertypes.groupBy("component_id").agg(F.min("pos").alias("pos")).withColumnRenamed("component_id", "owner_id"), ["owner_id", "pos"])
    ids = graph.components.select("component_id", "simple_name", "qualified_name", "is_interface")
    parent = first.filter("target_id is not null").select(F.col("owner_id").alias("at"), "target_id")
    parent = parent.hint("merge").join(ids.filter("not is_interface").select(F.col("component_id").alias("target_id"), F.col("simple_name").alias("to_name"), F.col("qualified_name").alias("to_qualified")), "target_id")
    parent = cut_lineage(parent)
    walks = ids.select("component_id", F.col("component_id").alias("at"), F.array("qualified_name").alias("seen"), F.array("simple_name").alias("names"))
    ended = []
    while not ended or not walks.isEmpty():
        on = walks.join(parent.hint("merge"), "at", "left")
        stop = F.col("target_id").isNull() | F.array_contains("seen", F.col("to_qualified"))
        ended.append(on.filter(stop).select("component_id", "names"))
        walks = on.filter(~stop).select("component_id", F.col("target_id").alias("at"), F.concat("seen", F.array("to_qualified")).alias("seen"), F.concat("names", F.array("to_name")).alias("names"))
        walks = cut_lineage(walks)
    all_ = reduce(DataFrame.unionByName, ended)
    return all_.select("component_id", (F.size("names") - 1).cast("long").alias("depth"), F.array_join("names", " -> ").alias("chain"))


def greedy_chains(components: DataFrame, edges: DataFrame | Dependencies, entries: DataFrame, hops: int = EngineConfig.chain_hops) -> DataFrame:
    """From each entry (component_id) up to `hops` times the unvisited, non-configuration neighbour with most edges out."""
    d = Dependencies.of(edges)
    out = d.out_degrees().select(F.col("from_id").alias("to_id"), "n")
    usable = components.filter("role <> 'CONFIGURATION'").select(F.col("component_id").alias("to_id"))
    ranked = lambda df: df.join(usable, "to_id").join(out, "to_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    step = cut_lineage(ranked(d.pairs).select(F.col("from_id").alias("at"), "to_id", "n"))
    # a walk has visited at most `hops` nodes when it chooses, so one of the first hops + 1 of a name is open if any is
    place = F.row_number().over(Window.partitionBy(*NAME).orderBy(F.desc("n"), "to_id"))
    first = cut_lineage(ranked(d.named).withColumn("place", place).filter(F.col("place") <= hops + 1).drop("place"))
    uses = d.uses.withColumnRenamed("from_id", "at")
    walks = entries.select(F.col("component_id").alias("entry"), F.col("component_id").alias("at"), F.array("component_id").alias("nodes"))
    for _ in range(hops):
        options = walks.join(step, "at").select("entry", "nodes", "to_id", "n").unionByName(walks.join(uses, "at").join(first, NAME).select("entry", "nodes", "to_id", "n"))
        options = options.filter(~F.array_contains("nodes", F.col("to_id")))
        chosen = argmax_first(options, ["entry"], "n", "to_id").select("entry", "to_id")
        walks = walks.join(chosen, "entry", "left").select(
            "entry", F.coalesce("to_id", F.lit(-1)).alias("at"), F.when(F.col("to_id").isNotNull(), F.concat("nodes", F.array("to_id"))).otherwise(F.col("nodes")).alias("nodes")
        )
        walks = cut_lineage(walks)
    return walks.select("entry", F.array_join(F.transform("nodes", lambda x: x.cast("string")), " -> ").alias("chain"))
