"""Call receivers bound from source text: parsed files to symbols and references, whose calls know their receiver's type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.exprs import lines
from loomgraph.functions.windows import numbered_in_order
from loomgraph.operators.index import call_graph
from loomgraph.operators.summary import NO_RECEIVERS, call_receivers, receiver_types
from loomgraph.sources.files import parse_files, refs_of, symbols_of
from loomgraph.storage import cut_lineage


def source_index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, ext, text) -> symbols(symbol_id, ...) and refs(ref_id, ...), numbered by path and place over all files."""
    parsed = cut_lineage(parse_files(files))
    symbols = numbered_in_order(symbols_of(parsed).withColumnRenamed("path", "file"), "symbol_id", "file", "ord").drop("ord")
    refs = numbered_in_order(refs_of(parsed).withColumnRenamed("path", "file"), "ref_id", "file", "ord").drop("ord")
    return symbols, refs


def bind_receivers(symbols: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs with `receiver`: the qualified type of the property that a call stands behind, as its own file declares it.

    The receiver's name is what the call's context shows before the name, else the name before the call's dot in the
    source (`qualifier`). Only calls are looked up, by (file, name); all other references keep a null receiver.
    """
    calls = call_receivers(refs.filter("kind = 'CALL'"))
    named = F.coalesce("receiver_name", F.when(~F.col("qualifier").isin(*NO_RECEIVERS), F.col("qualifier")))
    calls = calls.select("ref_id", "file", named.alias("property")).filter("property is not null")
    texts = files.select(F.col("path").alias("file"), lines(F.coalesce("text", F.lit(""))).alias("lines"))
    classes = symbols.filter("kind in ('CLASS', 'DATA_CLASS')").select("symbol_id", "file", "package_name", "line").join(texts, "file")
    imports = refs.filter("kind = 'IMPORT' and target_qualified_name is not null")
    types = receiver_types(classes, imports, symbols)
    bound = calls.join(types, ["file", "property"]).select("ref_id", F.col("type").alias("receiver"))
    return refs.join(bound, "ref_id", "left")


def calls_of_sources(files: DataFrame) -> DataFrame:
    """files(path, ext, text), each path once -> (caller, target): the call graph of source text, receivers first."""
    symbols, refs = source_index(files)
    return call_graph(symbols, bind_receivers(symbols, refs, files))
