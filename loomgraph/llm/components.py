"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.scratch import staged

MOST_ROUNDS = 60
HOT_KEYS = 1000


def hot_join(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """many joined to the row that `one` has for each key; one.n counts the rows of `many` that share the key.

    Of `total` rows at most HOT_KEYS keys can hold more than 1 / HOT_KEYS of them each: those rows of `one` are
    broadcast, so that no task gets all rows of a hot key; the others meet in an ordinary shuffle.
    """
    hot = F.col("n") * HOT_KEYS > total
    few = one.filter(hot).drop("n")
    rest = many.join(F.broadcast(few.select(key)), key, "left_anti").join(one.filter(~hot).drop("n"), key)
    return many.join(F.broadcast(few), key).unionByName(rest)


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges(u, v) there are, and whether they are stars: no node has two smaller neighbours, or one and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    r = each.agg(F.sum("up").alias("n"), F.count(F.when(F.expr("up > 0 and n > 1"), 1)).alias("tangled")).first()
    return r["n"] or 0, r["tangled"] == 0


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return hot_join(both.filter("v > u"), least, "u", 2 * n_edges).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of those (edges: u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = hot_join(edges, least, "u", n_edges).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b) but those that are their own component's least node.

    The component is its least node. Each round is a table in the shared folder; groups of any size are reduced by
    a minimum and joined, never gathered. Rounds end when every component is a star around its least node; links that
    are such stars already take none.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n_edges, stars = _state(edges)
    for _ in range(MOST_ROUNDS):
        if stars:
            break
        starred = staged(_large_star(edges, n_edges), "starred")
        # a large star makes no edge more than there were
        edges = staged(_small_star(starred, n_edges), "edges")
        n_edges, stars = _state(edges)
    if not stars:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
