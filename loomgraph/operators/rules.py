"""Structural rules: each gives findings (rule_ord, severity, severity_rank, message, file, suggestion, item)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.functions.exprs import is_test_path, last_segment
from loomgraph.functions.windows import first_per_key, numbered_in_order
from loomgraph.operators.graph import inheritance_chains
from loomgraph.operators.resolve import CodeGraph, implementors, resolve_names, resolved_supertypes
from loomgraph.storage import cut_lineage

SEVERITY_RANK = {"FORBIDDEN": 0, "WARNING": 1, "INFO": 2}


def text(template: str, *columns) -> Column:
    """A template whose {} take columns."""
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for c, rest in zip(columns, parts[1:], strict=True):
        pieces += [(F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(rest)]
    return F.concat(*pieces)


def findings(df: DataFrame, rule: int, severity, message: Column, suggestion: Column, file="path", item="component_id") -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    rank = reduce(lambda acc, kv: acc.when(severity == kv[0], kv[1]), SEVERITY_RANK.items(), F.when(F.lit(False), 0))
    return df.select(
        F.lit(rule).alias("rule_ord"), severity.alias("severity"), rank.alias("severity_rank"), message.alias("message"), (F.col(file) if isinstance(file, str) else file).alias("file"), suggestion.alias("suggestion"), F.col(item).alias("item")
    )


def here() -> Column:
    """The file of findings about no single file."""
    return F.lit(".")


def smell_classes(g: CodeGraph, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    df = g.components.filter(F.col("role").isin("MANAGER", "HELPER", "UTIL")).withColumn("label", F.lower("role"))
    severity = F.when(last_segment(F.col("package_name")).isin(*cfg.forbidden_packages), "FORBIDDEN").otherwise("WARNING")
    return findings(df, 1, severity, text("`{}` is a {} class", "simple_name", "label"), text("Behavior in {} classes belongs closer to where it's used.", "label"))


def forbidden_packages(g: CodeGraph, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    df = g.components.withColumn("last", last_segment(F.col("package_name"))).filter(F.col("last").isin(*cfg.forbidden_packages))
    df = df.groupBy("package_name", "last").agg(F.min("component_id").alias("component_id"))
    return findings(df, 2, "FORBIDDEN", text("Package `{}` uses forbidden name `{}`", "package_name", "last"), F.lit("Rename the package to describe what it does instead of a generic name."), here())


def forbidden_class_names(g: CodeGraph, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    hit = F.coalesce(*[F.when(F.col("simple_name").contains(p), F.lit(p)) for p in cfg.forbidden_class_patterns]) if cfg.forbidden_class_patterns else F.lit(None).cast("string")
    df = g.components.filter(~is_test_path(F.col("path"))).withColumn("hit", hit).filter("hit is not null")
    return findings(df, 3, "WARNING", text("`{}` contains forbidden pattern `{}`", "simple_name", "hit"), F.lit("Rename to describe what the class does instead of using a generic name."))


def single_implementations(g: CodeGraph, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    lone = implementors(g).groupBy("iface_id").agg(F.count("*").alias("n"), F.min("impl_id").alias("impl_id")).filter("n = 1")
    names = g.components.select(F.col("component_id").alias("impl_id"), F.col("simple_name").alias("impl"))
    df = lone.join(names, "impl_id").join(g.components.withColumnRenamed("component_id", "iface_id"), "iface_id")
    return findings(df, 4, "INFO", text("Interface `{}` has only one implementation: `{}`", "simple_name", "impl"), text("Consider using `{}` directly unless needed for testing.", "impl"), item="iface_id")


def god_classes(g: CodeGraph, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    n = g.imports.groupBy("component_id").agg(F.count("*").alias("n_imports"))
    df = g.components.filter("role <> 'CONFIGURATION'").join(n, "component_id", "left").withColumn("n_imports", F.coalesce("n_imports", F.lit(0)))
    limits = [("n_imports", cfg.max_imports, "imports"), ("n_methods", cfg.max_methods, "methods"), ("line_count", cfg.max_lines, "lines")]
    df = df.filter(reduce(Column.__or__, [F.col(c) > most for c, most, _ in limits]))
    reasons = F.concat_ws(", ", *[F.when(F.col(c) > most, text("{} " + unit, c)) for c, most, unit in limits])
    return findings(df, 5, "WARNING", text("`{}` may be doing too much ({})", "simple_name", reasons), F.lit("Split into smaller, focused classes with a single responsibility."))


def deep_inheritance(g: CodeGraph, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    deep = inheritance_chains(g).filter(F.col("depth") >= cfg.min_depth)
    df = deep.hint("merge").join(g.components.filter("not is_interface"), "component_id")
    return findings(df, 6, "WARNING", text("`{}` has inheritance depth {}: {}", "simple_name", "depth", "chain"), F.lit("Deep inheritance makes code rigid. Prefer composition."))


def circular_dependencies(cycles: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """cycles(ord, path array) of one project, the first ones in the order of the walk."""
    shown = cycles.orderBy("ord").limit(cfg.cycle_findings).select(F.array_join("path", " -> ").alias("path"), F.col("ord").cast("long").alias("component_id"))
    return findings(shown, 7, "WARNING", text("Circular dependency: {}", "path"), F.lit("Break the cycle by extracting a shared interface or moving shared logic to a separate class."), here())


def dependency_inversion(g: CodeGraph, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Imports bound by simple name to concrete classes; messages once, the first by owner and import."""
    c = g.components
    owners = c.filter(~is_test_path(F.col("path")) & ~F.col("is_interface")).select(F.col("component_id").alias("owner_id"), F.col("simple_name").alias("owner"), "path")
    names = g.imports.select(F.col("component_id").alias("owner_id"), "pos", last_segment(F.col("name")).alias("name")).join(owners.select("owner_id"), "owner_id", "left_semi")
    concrete = c.filter("not (is_interface or is_abstract or is_data_class)").select(F.col("component_id").alias("target_id"), F.col("simple_name").alias("target"))
    ifaces = c.filter("is_interface").select(F.col("component_id").alias("target_id"), F.col("simple_name").alias("iface"))
    first = first_per_key(resolved_supertypes(g).join(ifaces, "target_id"), ["owner_id"], "pos").select(F.col("owner_id").alias("target_id"), "iface")
    df = resolve_names(g, names).join(concrete, "target_id").join(first, "target_id", "left").join(owners, "owner_id")
    by_iface = F.col("iface").isNotNull()
    message = F.when(by_iface, text("Dependency on concrete `{}` instead of interface `{}`", "target", F.coalesce("iface", F.lit("")))).otherwise(text("Dependency on concrete class `{}` in `{}`", "target", "owner"))
    advice = F.when(by_iface, text("Depend on `{}` instead of the concrete class.", F.coalesce("iface", F.lit("")))).otherwise(text("Consider extracting an interface for `{}`.", "target"))
    df = first_per_key(df.withColumn("m", message).withColumn("a", advice).withColumn("s", F.when(by_iface, "WARNING").otherwise("INFO")), ["m"], "owner_id", "pos")
    return findings(df, 8, F.col("s"), F.col("m"), F.col("a"), item="owner_id")


def missing_tests(g: CodeGraph, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Testable classes without a test file: one finding each, or one for all when they are many."""
    test = is_test_path(F.col("path"))
    bare = F.regexp_replace(F.regexp_replace("simple_name", "Test$", ""), "Spec$", "")
    tested = g.components.filter(test).select(bare.alias("simple_name")).distinct()
    open_ = g.components.filter(~test & ~F.col("role").isin("OTHER", "CONFIGURATION", "ENTITY") & ~F.col("is_interface") & ~F.col("is_data_class")).join(tested, "simple_name", "left_anti")
    total = open_.agg(F.count("*").alias("n"))
    first = open_.orderBy("component_id").limit(cfg.untested_preview).agg(F.array_sort(F.collect_list(F.struct("component_id", "simple_name"))).alias("f"))
    many = total.crossJoin(first).filter(F.col("n") > cfg.untested_before_summary).withColumn("component_id", F.lit(0).cast("long"))
    preview = F.array_join(F.transform("f", lambda x: F.concat(F.lit("`"), x["simple_name"], F.lit("`"))), ", ")
    summary = findings(many, 9, "INFO", text("{} classes have no corresponding test file", "n"), text("Consider adding tests for key components, especially: {}", preview), here())
    few = open_.crossJoin(F.broadcast(total)).filter(F.col("n") <= cfg.untested_before_summary)
    return summary.unionByName(findings(few, 9, "INFO", text("`{}` has no test", "simple_name"), text("Consider adding `{}Test`.", "simple_name")))


def all_findings(g: CodeGraph, cycles: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Findings of all nine rules. Each rule's are written as it is computed, so no plan, and no set of broadcast tables
    in the driver, holds more than one rule's joins."""
    rules = [smell_classes, forbidden_packages, forbidden_class_names, single_implementations, god_classes, deep_inheritance]
    parts = [r(g, cfg) for r in rules] + [circular_dependencies(cycles, cfg), dependency_inversion(g, cfg), missing_tests(g, cfg)]
    return reduce(DataFrame.unionByName, [cut_lineage(p) for p in parts])


def in_report_order(found: DataFrame) -> DataFrame:
    """Findings with ord: numbered from 1 by severity, file, rule, item and message, over all rows without a single-task sort."""
    return numbered_in_order(found, "ord", "severity_rank", "file", "rule_ord", "item", "message", "suggestion")
