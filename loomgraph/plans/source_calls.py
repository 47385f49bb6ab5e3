"""Queries that start from rendered source text and end in calls or components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import receivers
from loomgraph.plans.adapters import plain, spread, table
from loomgraph.plans.catalog import ORACLES, QUERIES
from loomgraph.sources import files

# A supplier's file: an Api class and a Client that holds the Api of another supplier, imported from elsewhere in every third.
_SOURCES = """SELECT s_suppkey AS s, 'p' || CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS STRING) AS package_name, CAST(floor((s_suppkey + 3) / 2) AS BIGINT) AS t, s_suppkey % 3 = 0 AS imported FROM {supplier}"""


def _client_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "concat('package com.shop.', package_name, '\\n\\n', CASE WHEN imported THEN concat('import com.else.Api', t, '\\n\\n') ELSE '' END"
    body = (
        f"{head}, 'class Api', s, ' {{\\n    fun fetch(): String = \"data.fetch()\" // api.fetch()\\n}}\\n\\nclass Client', s, '(\\n    private val api: Api', t, ',\\n    val n: Int,\\n) {{\\n"
        "    fun load(): String = api.fetch()\\n    fun near(): String = this.fetch()\\n    fun maybe(): String = api?.fetch() ?: near()\\n}\\n')"
    ).replace("{{", "{").replace("}}", "}")
    return spread(table(spark, sf_dir, _SOURCES)).selectExpr("concat('/src/main/kotlin/S', s, '.kt') AS path", "'kt' AS ext", f"{body} AS text")


QUERIES["calls_of_sources"] = lambda spark, sf_dir: receivers.calls_of_sources(_client_files(spark, sf_dir))
# An Api of a known supplier is the receiver's type by its unique name; an import from elsewhere has no such function, so
# the package decides, as it does without a receiver.
ORACLES["calls_of_sources"] = f"""WITH x AS ({plain(_SOURCES)}), api AS (SELECT s, 'com.shop.' || package_name || '.Api' || s || '.fetch' AS target, package_name FROM x),
    n AS (SELECT count(*) AS n FROM x), own AS (SELECT package_name, count(*) AS k FROM x GROUP BY 1),
    client AS (SELECT x.*, 'com.shop.' || package_name || '.Client' || s AS c FROM x),
    direct AS (SELECT client.*, a.target AS typed FROM client LEFT JOIN api a ON a.s = client.t AND NOT imported AND (SELECT n FROM n) > 1),
    call AS (SELECT c || '.load' AS caller, package_name, typed FROM direct UNION ALL SELECT c || '.maybe', package_name, typed FROM direct UNION ALL SELECT c || '.near', package_name, NULL FROM client)
    SELECT DISTINCT caller, typed AS target FROM call WHERE typed IS NOT NULL
    UNION SELECT caller, a.target FROM call JOIN own USING (package_name) JOIN api a ON a.package_name = call.package_name OR k = (SELECT n FROM n) WHERE typed IS NULL
    UNION SELECT c || '.maybe', c || '.near' FROM client WHERE (SELECT n FROM n) >= 1"""


def _broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's file; each seventh is nested so deeply that it cannot be parsed."""
    deep = F.when(F.col("s") % 7 == 0, F.expr("concat('class A', s, ' {', repeat(' class B {', 3000))")).otherwise(F.expr("concat('package p', s, '\\nclass A', s)"))
    return spread(table(spark, sf_dir, _SOURCES)).select(F.expr("concat('/src/S', s, '.kt')").alias("path"), F.lit("kt").alias("ext"), deep.alias("text"))


QUERIES["metadata_with_failures"] = lambda spark, sf_dir: files.metadata_of(_broken_files(spark, sf_dir)).select("path", "qualified_name", "line_count", F.col("parse_error").isNotNull().alias("failed"))
ORACLES["metadata_with_failures"] = f"""SELECT '/src/S' || s || '.kt' AS path, CASE WHEN s % 7 <> 0 THEN 'p' || s || '.A' || s END AS qualified_name, CAST(CASE WHEN s % 7 <> 0 THEN 2 END AS BIGINT) AS line_count, s % 7 = 0 AS failed FROM ({plain(_SOURCES)})"""
