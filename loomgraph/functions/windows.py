"""Positional semantics as windows with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import cut_lineage


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _ranked(df, keys, [F.asc(o) for o in order])


def last_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _ranked(df, keys, [F.desc(o) for o in order])


def argmax_first(df: DataFrame, keys: list[str], metric: str, *order: str) -> DataFrame:
    """The row of the largest metric; of ties the first by `order`."""
    return _ranked(df, keys, [F.desc(metric), *(F.asc(o) for o in order)])


def asof_backward(events: DataFrame, lookups: DataFrame, by: list[str], at: str, value: str, tie: str) -> DataFrame:
    """For each lookup the `value` of the latest event at or before it; of events at one place the first by `tie`.

    One shuffle by `by` and one sort, with no join: both sides are stacked and the value is carried forward.
    """
    e = events.select(*by, at, F.lit(0).alias("__kind"), (-F.col(tie)).alias("__tie"), F.col(value).alias("__value"))
    row = F.struct(*lookups.columns)
    stacked = e.unionByName(lookups.select(*by, at, F.lit(1).alias("__kind"), F.lit(0).cast(e.schema["__tie"].dataType).alias("__tie"), row.alias("__row")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "__kind", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stacked.withColumn("__found", F.last("__value", ignorenulls=True).over(w)).filter("__kind = 1")
    return carried.select("__row.*", F.col("__found").alias(value))


def numbered_in_order(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `name`: 1, 2, ... over all rows by `order`.

    Rows are range-partitioned and sorted in their partitions; each partition then starts behind the rows of those
    before it. Only the partitions' counts, one row a partition, are summed in one task.
    """
    keys = [F.col(o) for o in order]
    # an id's upper bits are its partition, the lower ones its place there
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__slot", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    part = F.shiftright("__slot", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__slot").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + place + 1).drop("__slot", "__part", "__start")
