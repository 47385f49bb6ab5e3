"""Exact deduplication by a heavy-hitter split (DataFrame functions only).

One scan turns every text into a digest. A Misra-Gries style frequent-items sketch over the digests proposes the
few that may be hot; their groups are counted exactly, and those verified winners (never more than `k` rows) are
broadcast, so rows of hot groups get their decision on the map side. All other digests go through one ordinary
shuffle; of n rows, a digest that is not among the `k` holds at most n / (k + 1), give or take the sketch's error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.scratch import fresh, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY_K = 1024
TRACKED = 8192


def normalised(text):
    """A-Z lower-cased, every other character as it is; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_digest(text):
    return F.sha2(normalised(text), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY_K, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of each group of equal texts stays. Null and empty texts are one group. A null
    doc_id ranks below every other; of rows that repeat a doc_id with the same text exactly one is kept. An empty
    table gives an empty result; other columns of `docs` are ignored.
    """
    text_id = text_digest(F.col(text_col))
    keys = staged(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_id.alias("text_sha256"), F.monotonically_increasing_id().alias("seq")),
        "digests",
    )
    row = F.struct("doc_id", "seq")
    sketch = keys.agg(F.expr(f"approx_top_k(text_sha256, {k}, {tracked})").alias("top"))
    proposed = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"), F.col("t.count").alias("estimate"))
    proposed = proposed.filter(F.col("estimate") > 1).select("text_sha256")
    winners = staged(
        keys.join(F.broadcast(proposed), "text_sha256").groupBy("text_sha256").agg(F.max(row).alias("best"), F.count("*").alias("group_size")),
        "winners",
    )
    hot = keys.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    cold = (
        keys.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("best", F.max(row).over(group))
        .withColumn("group_size", F.count("*").over(group))
    )
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("seq") == F.col("best.seq")).alias("kept"),
        "text_sha256",
    )


def rows_of(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, for each doc_id (a null id like any other) and text_sha256 with a kept decision.

    Rows that repeat both are collapsed before the shuffle, and the decisions meet them in that same shuffle.
    """
    ident, none, text = (fresh(docs.columns, c) for c in ("row_id", "row_null", "row_text"))
    own, low = F.col(id_col).cast("long"), F.lit(-(1 << 63))
    kept = decisions.filter("kept").select(F.coalesce("doc_id", low).alias(ident), F.col("doc_id").isNull().alias(none), F.col("text_sha256").alias(text))
    marked = docs.withColumn(ident, F.coalesce(own, low)).withColumn(none, own.isNull()).withColumn(text, text_digest(F.col(text_col)))
    key = [ident, none, text]
    return marked.dropDuplicates(key).join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps: one for each text."""
    return rows_of(docs, exact_dedup(docs, id_col, text_col), id_col, text_col)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
    FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
    WINDOW g AS (PARTITION BY h)"""
