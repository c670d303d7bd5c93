"""Places and running sums in an order of all rows, without one task that sees them all.

Rows are range-partitioned and stored, so that both steps see the same ranges. Each
range sums its own rows; the sums of all ranges, one short row each, are summed up;
and a row's result is what stands before its range plus what stands before it there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspan.session import shuffle_partitions, stored

_IN_PARTITION = (1 << 33) - 1  #: the bits of a monotonic id that count within its partition


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows before a row in the order; rows are written once."""
    ranged = df.withColumn(name, value).repartitionByRange(shuffle_partitions(df.sparkSession), *order)
    ranged = ranged.sortWithinPartitions(*order).select(
        "*",
        F.spark_partition_id().alias("_rs_range"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("_rs_at"),
    )
    ranged = stored(ranged, "ranged")
    ranges = ranged.groupBy("_rs_range").agg(F.sum(name).alias("_rs_sum"))
    before = F.sum("_rs_sum").over(Window.orderBy("_rs_range")) - F.col("_rs_sum")
    # one row a range: as many as there are shuffle partitions
    ranges = F.broadcast(ranges.select("_rs_range", before.alias("_rs_before")))
    within = F.sum(name).over(Window.partitionBy("_rs_range").orderBy("_rs_at")) - F.col(name)
    found = ranged.withColumn("_rs_within", within).join(ranges, "_rs_range")
    return found.withColumn(name, F.col("_rs_before") + F.col("_rs_within")).drop("_rs_range", "_rs_at", "_rs_within", "_rs_before")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with the 0-based place of each row in the order, ties in any order."""
    return running_sum(df, order, F.lit(1).cast("bigint"), name)
