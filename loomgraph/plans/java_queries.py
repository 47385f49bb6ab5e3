"""Java files rendered from the fixture's components and parsed again, with the SQL each result is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.adapters import COMPONENTS, spread, table
from loomgraph.plans.catalog import ORACLES, check, register
from loomgraph.sources import files


def _java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Java file for every part and supplier."""
    head = "CASE WHEN package_name = '' THEN '' ELSE concat('package ', package_name, ';\\n\\n') END"
    word = "CASE component_id % 3 WHEN 0 THEN 'public abstract class ' WHEN 1 THEN 'class ' ELSE 'interface ' END"
    supers = "concat(' extends S', component_id % 10, '<String>', CASE WHEN component_id % 3 = 2 THEN ', Face' ELSE ' implements Face' END)"
    body = (
        f"concat({head}, 'import java.util.List;\\nimport com.shop.supplier.S', component_id % 10, ';\\n\\n@Service(\"x\")\\n', {word}, simple_name, {supers}, "
        "' {\\n  // void no() {}\\n  private int x = 1, y;\\n  ', simple_name, '(int q) { super(q); }\\n  public String go(List<String> a) throws E { return f(\"}\"); }\\n}\\n')"
    )
    return spread(table(spark, sf_dir, COMPONENTS)).selectExpr("concat('/src/main/java/', component_id, '.java') AS path", "'java' AS ext", f"{body} AS text")


def _over_files(name: str, sql: str, build) -> None:
    register(name)(lambda spark, sf_dir: build(_java(spark, sf_dir)))
    based = "b AS (SELECT *, '/src/main/java/' || component_id || '.java' AS file, 'S' || component_id % 10 AS s, CASE WHEN package_name = '' THEN 5 ELSE 7 END AS l FROM c0)"
    ORACLES[name] = f"{check('c0', '').rstrip()}, {based} {sql}"


_over_files(
    "extract_java_symbols",
    """SELECT file AS path, simple_name AS name, qualified_name, CASE component_id % 3 WHEN 2 THEN 'INTERFACE' ELSE 'CLASS' END AS kind, l AS line, package_name FROM b
    UNION ALL SELECT file, simple_name || '.' || m, qualified_name || '.' || m, k, l + d, package_name FROM b, LATERAL (VALUES ('x', 'PROPERTY', 2), ('y', 'PROPERTY', 2), (simple_name, 'FUNCTION', 3), ('go', 'FUNCTION', 4)) v(m, k, d)""",
    lambda df: files.symbols_of(files.parse_files(df)).drop("ord"),
)
_over_files(
    "extract_java_refs",
    """SELECT file AS path, 'List' AS target_name, 'java.util.List' AS target_qualified_name, 'IMPORT' AS kind, l - 4 AS line, 'import java.util.List' AS context FROM b
    UNION ALL SELECT file, s, 'com.shop.supplier.' || s, 'IMPORT', l - 3, 'import com.shop.supplier.' || s FROM b
    UNION ALL SELECT file, s, 'com.shop.supplier.' || s, 'SUPERTYPE', l, s FROM b UNION ALL SELECT file, 'Face', NULL, 'SUPERTYPE', l, 'Face' FROM b""",
    lambda df: files.refs_of(files.parse_files(df)).drop("ord", "qualifier"),
)
_over_files(
    "extract_java_metadata",
    """SELECT file AS path, qualified_name, component_id % 3 = 2 AS is_interface, component_id % 3 = 0 AS is_abstract, CASE WHEN l = 5 THEN 8 ELSE 9 END AS line_count, l AS declaration_line,
      'com.shop.supplier.' || s AS imports, 'Service' AS annotations, s || ',Face' AS supertypes, simple_name || ',go' AS methods FROM b""",
    lambda df: files.metadata_of(df).select("path", "qualified_name", "is_interface", "is_abstract", "line_count", "declaration_line", *[F.array_join(c, ",").alias(c) for c in ("imports", "annotations", "supertypes", "methods")]),
)
