"""Roll-ups of projects and builds: totals, edges between builds, workspace hubs and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.functions.exprs import interface_like, mock_like
from loomgraph.functions.windows import first_per_key


def build_edges(deps: DataFrame, builds: DataFrame) -> DataFrame:
    """deps(build, artifact): builds that depend on another build's name."""
    return deps.join(builds.select(F.col("build").alias("artifact")), "artifact", "left_semi").filter("artifact <> build").select(F.col("build").alias("from_build"), F.col("artifact").alias("to_build")).distinct()


def workspace_hubs(hubs: DataFrame, limit: int = EngineConfig.workspace_hubs) -> DataFrame:
    """hubs(build, name, dependent_count) of all builds, the most depended on; builds are not merged."""
    return hubs.orderBy(F.desc("dependent_count"), "name", "build").limit(limit)


def distinct_findings(found: DataFrame) -> DataFrame:
    """findings(message, src_ord, item, ...): each message once, from the first source."""
    return first_per_key(found, ["message"], "src_ord", "item")


def totals(symbols: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols and warnings (WARNING or FORBIDDEN) by project or build."""
    s = symbols.groupBy(*keys).agg(F.count("*").alias("n_symbols"))
    w = found.groupBy(*keys).agg(F.sum(F.when(F.col("severity") != "INFO", 1).otherwise(0)).alias("n_warnings"))
    return s.join(w, keys, "full").select(*keys, F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols"), F.coalesce("n_warnings", F.lit(0)).cast("long").alias("n_warnings"))


def dependencies_by_scope(deps: DataFrame, keys: list[str]) -> DataFrame:
    """deps(scope, artifact, ord): one text a scope, scopes numbered in order of first appearance (then by name)."""
    grouped = deps.groupBy(*keys, "scope").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "artifact"))).alias("a"))
    w = Window.partitionBy(*keys).orderBy("first", "scope")
    return grouped.select(*keys, "scope", F.row_number().over(w).cast("long").alias("scope_ord"), F.array_join(F.transform("a", lambda x: x["artifact"]), ", ").alias("artifacts"))


def named_counts(interfaces: DataFrame, names: DataFrame) -> DataFrame:
    """interfaces(name) with n_impl and has_mock, looked up among the distinct class names(name).

    Implementations are baseImpl, Default names and names that end in the base (the name without a leading I); mocks are
    none. A class is looked up under each of its endings, so this is an equi-join and not a comparison of all pairs.
    """
    iface = interfaces.select("name", F.regexp_replace("name", "^I", "").alias("base"))
    real = names.filter(~mock_like(F.col("name"))).select(F.col("name").alias("impl"))
    ends = real.select("impl", F.explode(F.expr("transform(sequence(1, length(impl)), i -> substring(impl, i))")).alias("base")).filter("impl <> base")
    # an interface that is all base ("I") takes only names made from nothing but that
    bare = real.filter(F.col("impl") != "").select("impl", F.lit("").alias("base"))
    ends = ends.unionByName(bare).unionByName(real.filter(F.col("impl").endswith("Impl")).select("impl", F.expr("left(impl, length(impl) - 4)").alias("base")))
    ends = ends.unionByName(real.filter(F.col("impl").startswith("Default")).select("impl", F.expr("substring(impl, 8)").alias("base")))
    whole = real.filter(F.col("impl").startswith("Default")).select("impl", F.expr("substring(impl, 8)").alias("name"))
    by_base = iface.join(ends, "base").select("name", "impl")
    found = by_base.unionByName(iface.join(whole, "name").select("name", "impl")).filter("impl <> name").distinct().groupBy("name").agg(F.count("*").alias("n_impl"))
    mocks = iface.select("name", F.explode(F.array(*[F.concat(F.lit(a), "name", F.lit(b)) for a, b in (("Mock", ""), ("", "Mock"), ("Fake", ""), ("", "Fake"))])).alias("mock"))
    mocked = mocks.join(names.select(F.col("name").alias("mock")), "mock", "left_semi").select("name", F.lit(True).alias("m")).distinct()
    return iface.join(found, "name", "left").join(mocked, "name", "left").select("name", F.coalesce("n_impl", F.lit(0)).cast("long").alias("n_impl"), F.coalesce("m", F.lit(False)).alias("has_mock"))


def interface_candidates(classes: DataFrame) -> DataFrame:
    """classes(name): interface-like names with the number of implementations by name and whether a mock exists."""
    names = classes.select("name").distinct()
    return named_counts(names.filter(interface_like(F.col("name"))), names)
