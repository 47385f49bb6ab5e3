"""Name resolution: which component a simple or qualified name means to an owner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.exprs import last_segment
from loomgraph.functions.windows import first_per_key, last_per_key


@dataclass(frozen=True)
class CodeGraph:
    """Normalised metadata of one scan; component_id follows scan order.

    components(component_id, simple_name, package_name, qualified_name, path, is_interface, is_abstract,
    is_data_class, n_methods, line_count, has_main, role); imports, supertypes, annotations(component_id, pos, name).
    """

    components: DataFrame
    imports: DataFrame
    supertypes: DataFrame
    annotations: DataFrame


def by_qualified_name(components: DataFrame) -> DataFrame:
    """qualified_name -> found; of components that share one the last."""
    return last_per_key(components.select("component_id", "qualified_name"), ["qualified_name"], "component_id").select("qualified_name", F.col("component_id").alias("found"))


def unique_simple_names(components: DataFrame) -> DataFrame:
    return components.groupBy("simple_name").agg(F.count("*").alias("n"), F.min("component_id").alias("found")).filter("n = 1").drop("n")


def resolve_names(graph: CodeGraph, names: DataFrame) -> DataFrame:
    """names(owner_id, name, ...) with target_id: the ladder of exact name, import, own package, unique simple name.

    A dotted name is only looked up as it is. The first import that ends in the name counts, and if it leads outside
    the project the next step is tried. Each step is a left join of its own, so their order in the plan is free.
    """
    exact = by_qualified_name(graph.components)
    first = first_per_key(graph.imports.select("component_id", "pos", F.col("name").alias("imported"), last_segment(F.col("name")).alias("name")), ["component_id", "name"], "pos")
    owner = graph.components.select(F.col("component_id").alias("owner_id"), F.col("package_name").alias("__package"))

    def step(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.join(exact.select(F.col("qualified_name").alias(key), F.col("found").alias(out)), key, "left")

    df = names.join(owner, "owner_id").withColumn("__own", F.concat("__package", F.lit("."), "name")).withColumn("__exact", F.col("name"))
    df = df.join(first.select(F.col("component_id").alias("owner_id"), "name", F.col("imported").alias("__imported")), ["owner_id", "name"], "left")
    df = step(step(step(df, "__exact", "__f1"), "__imported", "__f2"), "__own", "__f3")
    df = df.join(unique_simple_names(graph.components).select(F.col("simple_name").alias("name"), F.col("found").alias("__f4")), "name", "left")
    target = F.when(F.instr("name", ".") > 0, F.col("__f1")).otherwise(F.coalesce("__f2", "__f3", "__f4"))
    return df.select(*names.columns, target.alias("target_id"))


def resolved_supertypes(graph: CodeGraph) -> DataFrame:
    """(owner_id, pos, name, target_id) of every supertype."""
    return resolve_names(graph, graph.supertypes.select(F.col("component_id").alias("owner_id"), "pos", "name"))


def implementors(graph: CodeGraph) -> DataFrame:
    """(iface_id, impl_id): components with a supertype that resolves to an interface."""
    ifaces = graph.components.filter("is_interface").select(F.col("component_id").alias("iface_id"))
    hits = resolved_supertypes(graph).filter("owner_id <> target_id").select(F.col("target_id").alias("iface_id"), F.col("owner_id").alias("impl_id")).distinct()
    return hits.join(ifaces, "iface_id")


def classified(components: DataFrame, annotations: DataFrame) -> DataFrame:
    """Components with role: of the first annotation that names one, else of the name's ending."""
    from loomgraph.functions.exprs import annotation_role, name_role

    named = annotations.withColumn("__role", annotation_role(F.col("name"))).filter("__role is not null")
    first = first_per_key(named, ["component_id"], "pos").select("component_id", "__role")
    return components.join(first, "component_id", "left").withColumn("role", F.coalesce("__role", name_role(F.col("simple_name")))).drop("__role")
