"""Fixture tables presented as code: components, imports, supertypes, symbols and references.

The statements are plain SQL that both Spark and the checking engine run, so a query and its check start from one
definition of the input and differ in everything after it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.resolve import CodeGraph, classified
from loomgraph.storage import cut_lineage

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]

COMPONENTS = """
SELECT component_id, simple_name, package_name, n_methods, line_count, has_main, is_interface, is_abstract, is_data_class,
       CASE WHEN package_name = '' THEN simple_name ELSE package_name || '.' || simple_name END AS qualified_name,
       root || simple_name || '.kt' AS path,
       'class ' || simple_name || ' : val a = Part' || CAST(component_id + 90 AS STRING) || '()' AS code_text
FROM (
  SELECT p_partkey AS component_id,
    CASE WHEN p_partkey % 23 = 0 THEN 'Common' ELSE 'Part' || CAST(p_partkey AS STRING) || CASE p_partkey % 10 WHEN 1 THEN 'Manager' WHEN 2 THEN 'Helper'
      WHEN 3 THEN 'Utils' WHEN 4 THEN 'Test' WHEN 5 THEN 'Service' ELSE '' END END AS simple_name,
    CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 'com.shop.' || CASE p_partkey % 9 WHEN 0 THEN 'util' WHEN 1 THEN 'service' WHEN 2 THEN 'helpers' WHEN 3 THEN 'repository'
      WHEN 4 THEN 'model' WHEN 5 THEN 'ui' WHEN 6 THEN 'config' WHEN 7 THEN 'base' ELSE 'core' END END AS package_name,
    CASE WHEN p_partkey % 10 = 4 THEN 'src/test/kotlin/' ELSE 'src/main/kotlin/' END AS root,
    CAST(p_size AS BIGINT) AS n_methods, CAST(floor(p_retailprice) AS BIGINT) AS line_count, p_partkey % 50 = 1 AS has_main,
    FALSE AS is_interface, p_partkey % 17 = 0 AS is_abstract, p_partkey % 19 = 0 AS is_data_class
  FROM {part}
  UNION ALL
  SELECT 1000000000 + s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ISupplier' ELSE 'Supplier' END || CAST(s_suppkey AS STRING), 'com.shop.supplier', 'src/main/kotlin/',
    CAST(1 AS BIGINT), CAST(10 AS BIGINT), FALSE, s_suppkey % 2 = 0, FALSE, FALSE
  FROM {supplier}) t"""

IMPORTS = f"""
SELECT component_id, CAST(row_number() OVER (PARTITION BY component_id ORDER BY o, name) AS BIGINT) AS pos, name FROM (
  SELECT DISTINCT l_partkey AS component_id, 3 AS o, 'com.shop.supplier.' || CASE WHEN l_suppkey % 2 = 0 THEN 'ISupplier' ELSE 'Supplier' END || CAST(l_suppkey AS STRING) AS name FROM {{lineitem}}
  UNION ALL
  SELECT a.component_id, 1, 'org.ext.' || b.simple_name FROM ({COMPONENTS}) a JOIN ({COMPONENTS}) b ON b.component_id = a.component_id + 1 WHERE a.component_id % 13 = 0
  UNION ALL
  SELECT a.component_id, 2, b.qualified_name FROM ({COMPONENTS}) a JOIN ({COMPONENTS}) b ON b.component_id = a.component_id + 2 WHERE a.component_id % 6 = 0
  UNION ALL
  SELECT a.component_id, 2, b.qualified_name FROM ({COMPONENTS}) a JOIN ({COMPONENTS}) b ON b.component_id = a.component_id - 2 WHERE a.component_id % 12 = 2) t"""

SUPERTYPES = f"""
SELECT component_id, CAST(row_number() OVER (PARTITION BY component_id ORDER BY o, name) AS BIGINT) AS pos, name FROM (
  SELECT a.component_id, 1 AS o, b.simple_name AS name FROM ({COMPONENTS}) a JOIN ({COMPONENTS}) b ON b.component_id = CAST(floor(a.component_id / 3) AS BIGINT) WHERE a.component_id % 4 <> 3 AND a.component_id < 1000000000
  UNION ALL
  SELECT p_partkey, 2, 'ISupplier' || CAST(2 + 2 * (p_partkey % 40) AS STRING) FROM {{part}} WHERE p_partkey % 7 = 0
  UNION ALL
  SELECT s_suppkey + 1000000000, 1, 'com.shop.supplier.ISupplier' || CAST(s_suppkey + 1 AS STRING) FROM {{supplier}} WHERE s_suppkey % 4 = 1) t"""

ANNOTATIONS = """
SELECT p_partkey AS component_id, CAST(1 AS BIGINT) AS pos, CASE p_partkey % 8 WHEN 0 THEN 'org.x.Service' WHEN 1 THEN 'RestController' WHEN 2 THEN 'javax.Entity' WHEN 3 THEN 'Configuration' ELSE 'Deprecated' END AS name FROM {part}
UNION ALL
SELECT p_partkey, CAST(2 AS BIGINT), 'a.b.Repository' FROM {part} WHERE p_partkey % 8 > 5"""

# Functions are events of type view; every user's log is a file.
SYMBOLS = """
SELECT event_id AS symbol_id, CASE event_type WHEN 'view' THEN 'FUNCTION' WHEN 'signup' THEN 'CLASS' ELSE 'PROPERTY' END AS kind,
  'pkg' || CAST(user_id % 5 AS STRING) AS package_name, 'u' || CAST(user_id AS STRING) AS file, event_id AS line,
  CASE event_type WHEN 'signup' THEN 'C' || CAST(event_id % 40 AS STRING) ELSE 'C' || CAST(user_id % 40 AS STRING) || '.m' || CAST(event_id % 30 AS STRING) END AS name,
  'pkg' || CAST(user_id % 5 AS STRING) || '.' || CASE event_type WHEN 'signup' THEN 'C' || CAST(event_id % 40 AS STRING) ELSE 'C' || CAST(user_id % 40 AS STRING) || '.m' || CAST(event_id % 30 AS STRING) END AS qualified_name
FROM {events} WHERE event_type IN ('view', 'signup', 'purchase')"""

REFS = """
SELECT event_id AS ref_id, CASE event_type WHEN 'click' THEN 'CALL' ELSE 'IMPORT' END AS kind, 'u' || CAST(user_id AS STRING) AS file, event_id AS line,
  CASE event_type WHEN 'click' THEN 'm' || CAST(event_id % 30 AS STRING) ELSE 'C' || CAST(event_id % 40 AS STRING) END AS target_name,
  CASE WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'pkg' || CAST(event_id % 5 AS STRING) || '.C' || CAST(event_id % 40 AS STRING) END AS receiver,
  CASE WHEN event_type = 'click' THEN NULL ELSE 'pkg' || CAST(event_id % 5 AS STRING) || '.C' || CAST(event_id % 40 AS STRING) END AS target_qualified_name
FROM {events} WHERE event_type IN ('click', 'error')"""


def plain(sql: str) -> str:
    """A statement over tables by their own names."""
    return sql.format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over tasks. Rows of a table of few blocks may each become a text that is parsed, and then its
    blocks must not decide how many tasks share that work."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(max(int(conf), df.sparkSession.sparkContext.defaultParallelism))


class StagedGraph:
    """The graph of one fixture; a relation becomes a table when it is first asked for, and then serves every join."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._read = lambda sql: table(spark, sf_dir, sql)

    @cached_property
    def annotations(self) -> DataFrame:
        return self._read(ANNOTATIONS)

    @cached_property
    def components(self) -> DataFrame:
        return cut_lineage(classified(self._read(COMPONENTS), self.annotations))

    @cached_property
    def imports(self) -> DataFrame:
        return cut_lineage(self._read(IMPORTS))

    @cached_property
    def supertypes(self) -> DataFrame:
        return cut_lineage(self._read(SUPERTYPES))


def code_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return StagedGraph(spark, sf_dir)
