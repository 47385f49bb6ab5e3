"""Joins whose results may be far larger than their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_ROWS = 2_000
# Cells that are made for a shuffle partition, so that partitions are even, where keys have that many pairs.
PART_CELLS = 16


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], cell: int = CELL_ROWS) -> DataFrame:
    """The inner join on keys in even pieces, so that no task makes all pairs of a frequent key.

    The pairs of a key are cut into cells of `cell` by `cell` rows, or of more rows where that still gives PART_CELLS
    cells for every partition. A row is repeated once for every cell of its line: pairs are neither shuffled nor kept,
    and what is shuffled grows with the root of their number, so with the input. Only keys of more than one cell are
    broadcast, at most one for every `cell` rows.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    met = many(left, "__lines").join(many(right, "__columns"), keys)
    side = met.agg(F.greatest(F.lit(cell), F.ceil(F.sqrt(F.sum(F.col("__lines").cast("double") * F.col("__columns")) / (PART_CELLS * parts)))).alias("__side"))
    cells = lambda n: F.ceil(F.col(n) / F.col("__side")).cast("int").alias(n)
    cut = F.broadcast(met.crossJoin(F.broadcast(side)).select(*keys, cells("__lines"), cells("__columns")).filter("__lines > 1 or __columns > 1"))

    def placed(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        df = df.join(cut, keys, "left").withColumn(own, F.pmod(F.xxhash64(*rest), F.coalesce(n_own, F.lit(1))).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1))).drop(n_own, n_other)
        return df.repartition(parts, *keys, "__line", "__column")

    lines = placed(left, "__line", "__lines", "__column", "__columns")
    columns = placed(right, "__column", "__columns", "__line", "__lines")
    return lines.hint("merge").join(columns, [*keys, "__line", "__column"]).drop("__line", "__column")
