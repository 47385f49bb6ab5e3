"""Symbol index queries: resolution, usages and the call graph over symbols and references.

symbols(symbol_id, name, qualified_name, kind, file, line, package_name); refs(ref_id, target_name,
target_qualified_name, kind, file, line, and of calls with a known receiver its type: receiver).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.exprs import before_last, last_segment
from loomgraph.functions.joins import grid_join
from loomgraph.functions.windows import asof_backward, first_per_key, last_per_key
from loomgraph.storage import cut_lineage

# A symbol's own place is no usage.
ELSEWHERE = "not (file = s_file and line = s_line)"


def _by_qualified(symbols: DataFrame) -> DataFrame:
    return last_per_key(symbols.select("symbol_id", "qualified_name"), ["qualified_name"], "symbol_id").select("qualified_name", F.col("symbol_id").alias("exact_id"))


def _resolved(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with exact_id, the symbol of the reference's qualified name, and symbol_id."""
    exact = _by_qualified(symbols)
    lone = symbols.groupBy(last_segment(F.col("name")).alias("target_name")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("lone_id"))
    imported = refs.filter("kind = 'IMPORT' and target_qualified_name is not null")
    imported = first_per_key(imported.select("file", "target_name", "ref_id", F.col("target_qualified_name").alias("import_name")), ["file", "target_name"], "ref_id").drop("ref_id")
    df = refs.join(exact.withColumnRenamed("qualified_name", "target_qualified_name"), "target_qualified_name", "left")
    df = df.join(lone, "target_name", "left").join(imported, ["file", "target_name"], "left")
    df = df.join(exact.select(F.col("qualified_name").alias("import_name"), F.col("exact_id").alias("import_id")), "import_name", "left")
    chosen = F.coalesce("exact_id", F.when(F.col("n") == 1, F.col("lone_id")).when(F.col("n") > 1, F.col("import_id")))
    return df.select(*refs.columns, "exact_id", chosen.alias("symbol_id"))


def resolve_refs(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with symbol_id: by qualified name, else the one symbol of that simple name, else by the file's import of it."""
    return _resolved(symbols, refs).drop("exact_id")


def _sides(symbols: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols and references by qualified name, and the pairs of references that no qualified name resolves.

    `odd` marks ids that stand for several rows and rows without a place. Of all others a reference and a symbol meet
    once: by qualified name, or as the one symbol that the reference resolves to where no symbol has that name.
    """

    def once(df: DataFrame, key: str, file: str, line: str) -> DataFrame:
        again = F.count("*").over(Window.partitionBy(key)) > 1
        return df.distinct().withColumn("odd", again | F.col(file).isNull() | F.col(line).isNull())

    s = once(symbols.select("symbol_id", F.col("qualified_name").alias("name"), F.col("file").alias("s_file"), F.col("line").alias("s_line")), "symbol_id", "s_file", "s_line")
    r = once(refs.select("ref_id", F.col("target_qualified_name").alias("name"), "file", "line"), "ref_id", "file", "line")
    s, r = cut_lineage(s.withColumnRenamed("odd", "s_odd")), cut_lineage(r.withColumnRenamed("odd", "r_odd"))
    other = _resolved(symbols, refs).filter("exact_id is null and symbol_id is not null").select("ref_id", "symbol_id", "file", "line")
    other = other.join(r.select("ref_id", "r_odd").distinct(), "ref_id").join(s.drop("name"), "symbol_id").filter(ELSEWHERE)
    return s.filter("name is not null"), r.filter("name is not null"), cut_lineage(other.select("symbol_id", "ref_id", (F.col("r_odd") | F.col("s_odd")).alias("odd")))


def _odd_usages(s: DataFrame, r: DataFrame, other: DataFrame) -> DataFrame:
    """Usages of odd symbols or references, each once."""
    by_name = grid_join(r.filter("r_odd"), s, ["name"]).unionByName(grid_join(r.filter("not r_odd"), s.filter("s_odd"), ["name"]))
    return by_name.filter(ELSEWHERE).select("symbol_id", "ref_id").unionByName(other.filter("odd").select("symbol_id", "ref_id")).distinct()


def _any_odd(s: DataFrame, r: DataFrame, other: DataFrame) -> bool:
    return not (s.filter("s_odd").isEmpty() and r.filter("r_odd").isEmpty() and other.filter("odd").isEmpty())


def usages(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, ref_id) of every reference that means a symbol, other than at its own place.

    The pairs grow with references times symbols of a name, so they are made in even pieces and never shuffled.
    """
    s, r, other = _sides(symbols, refs)
    plain = grid_join(r.filter("not r_odd").drop("r_odd"), s.filter("not s_odd").drop("s_odd"), ["name"]).filter(ELSEWHERE)
    found = plain.select("symbol_id", "ref_id").unionByName(other.filter("not odd").select("symbol_id", "ref_id"))
    # without odd rows both sides need not be shuffled for them again
    return found if not _any_odd(s, r, other) else found.unionByName(_odd_usages(s, r, other))


def usage_totals(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, n_usages) of symbols with usages, counted by name and place without making the pairs."""
    s, r, other = _sides(symbols, refs)
    plain = r.filter("not r_odd")
    named = plain.groupBy("name").agg(F.count("*").alias("n"))
    here = plain.groupBy("name", F.col("file").alias("s_file"), F.col("line").alias("s_line")).agg(F.count("*").alias("n_here"))
    by_name = s.filter("not s_odd").join(named, "name").join(here, ["name", "s_file", "s_line"], "left").select("symbol_id", (F.col("n") - F.coalesce("n_here", F.lit(0))).alias("n"))
    rest = other.filter("not odd").select("symbol_id", F.lit(1).cast("long").alias("n")).unionByName(_odd_usages(s, r, other).select("symbol_id", F.lit(1).cast("long").alias("n")))
    return by_name.unionByName(rest).groupBy("symbol_id").agg(F.sum("n").alias("n_usages")).filter("n_usages > 0")


def usage_counts(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    types = symbols.filter("kind not in ('FUNCTION', 'PROPERTY')").select("symbol_id", "qualified_name")
    return usage_totals(symbols, refs).join(types, "symbol_id").groupBy("symbol_id", "qualified_name").agg(F.sum("n_usages").alias("n_usages"))


def containing_methods(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with caller_id: the function declared last at or before the reference in its file."""
    functions = symbols.filter("kind = 'FUNCTION'").select("file", "line", "symbol_id", F.col("symbol_id").alias("caller_id"))
    return asof_backward(functions, refs, ["file"], "line", "caller_id", "symbol_id")


def _functions(symbols: DataFrame) -> DataFrame:
    """Functions by qualified name, with how many share it and, of a single one, its place."""
    f = symbols.filter("kind = 'FUNCTION'").select(last_segment(F.col("name")).alias("target_name"), F.col("qualified_name").alias("target"), F.col("package_name").alias("target_package"), "file", "line")
    same = f.groupBy("target_name", "target", "target_package").agg(F.count("*").alias("weight"), F.min("file").alias("t_file"), F.min("line").alias("t_line"))
    return same.withColumn("owner", before_last(F.col("target")))


def call_graph(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(caller, target) qualified names of calls; several targets are narrowed by receiver, import or own class, package.

    Each rung is an equi-join of its own on (name, receiver), (name, owner) or (name, package); only calls that no rung
    narrows meet all functions of their name, as one row a caller, file and name. The receiver's functions (refs may
    have a column `receiver`, a qualified type) are taken where there are any; the other sets only where they are not
    empty and smaller than the whole. A function that stands at the call's own place is no target.
    """
    typed = refs if "receiver" in refs.columns else refs.withColumn("receiver", F.lit(None).cast("string"))
    calls = containing_methods(symbols, typed.filter("kind = 'CALL'")).filter("caller_id is not null")
    callers = symbols.select(F.col("symbol_id").alias("caller_id"), F.col("qualified_name").alias("caller"), F.col("package_name").alias("caller_package"))
    # the line matters only to a call that stands where a function is declared
    places = symbols.filter("kind = 'FUNCTION'").select("file", "line", F.lit(True).alias("declared")).distinct()
    calls = calls.join(callers, "caller_id").join(places, ["file", "line"], "left").withColumn("at", F.when(F.col("declared"), F.col("line")))
    key = ["caller", "caller_package", "target_name", "file", "receiver", "at"]
    calls = cut_lineage(calls.select(*key).distinct().withColumn("call_id", F.monotonically_increasing_id()))
    functions = cut_lineage(_functions(symbols))
    total = functions.groupBy("target_name").agg(F.sum("weight").alias("n"))

    def rung(hits: DataFrame, name: str) -> DataFrame:
        return hits.groupBy("call_id").agg(F.sum("weight").alias(name))

    parts = F.split("target", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    under = functions.filter(F.size(parts) > 1).withColumn("receiver", F.explode(prefixes))
    received = cut_lineage(calls.filter("receiver is not null").select("call_id", "target_name", "receiver").join(under, ["target_name", "receiver"]).select("call_id", "target", "weight"))
    imports = refs.filter("kind = 'IMPORT' and target_qualified_name is not null").select("file", F.col("target_qualified_name").alias("owner")).distinct()
    owners = calls.select("call_id", "target_name", before_last(F.col("caller")).alias("owner")).unionByName(calls.join(imports, "file").select("call_id", "target_name", "owner")).distinct()
    near = cut_lineage(owners.join(functions, ["target_name", "owner"]).select("call_id", "target", "weight"))
    packaged = functions.groupBy("target_name", F.col("target_package").alias("caller_package")).agg(F.sum("weight").alias("n_same"))
    counted = calls.join(total, "target_name").join(packaged, ["target_name", "caller_package"], "left").join(rung(received, "n_received"), "call_id", "left").join(rung(near, "n_near"), "call_id", "left")
    chosen = (
        F.when((F.col("n") > 1) & (F.col("n_received") > 0), "receiver")
        .when((F.col("n_near") > 0) & (F.col("n_near") < F.col("n")), "near")
        .when((F.col("n_same") > 0) & (F.col("n_same") < F.col("n")), "package")
        .otherwise("all")
    )
    counted = cut_lineage(counted.withColumn("rung", chosen).select("call_id", *key, "rung"))
    place = functions.select("target", "target_name", "target_package", "weight", "t_file", "t_line")
    of = {r: counted.filter(F.col("rung") == r) for r in ("receiver", "near", "package", "all")}
    hits = [
        of["receiver"].join(received.select("call_id", "target"), "call_id").join(place.drop("target_package"), ["target_name", "target"]),
        of["near"].join(near.select("call_id", "target"), "call_id").join(place.drop("target_package"), ["target_name", "target"]),
        of["package"].join(place, (of["package"].target_name == place.target_name) & (of["package"].caller_package == place.target_package)),
        of["all"].select("caller", "target_name", "file", "at").distinct().join(place.drop("target_package"), "target_name"),
    ]
    elsewhere = F.expr("not (weight = 1 and at is not null and t_file = file and t_line = at)") & (F.col("caller") != F.col("target"))
    return reduce(DataFrame.unionByName, [h.filter(elsewhere).select("caller", "target") for h in hits]).distinct()
