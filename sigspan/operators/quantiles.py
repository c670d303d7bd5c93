"""Exact quantiles without one task that holds every value.

The built-in exact percentile gathers all distinct values in one task. Here a
small sketch only proposes a bracket around each wanted rank; one aggregate then
counts everything and ranks just the values in brackets. Two passes in all. The
sketch also cuts each bracket into value ranges, so that running counts are two-level
sums: within a range, and over the few ranges of a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 3 / ACCURACY
CUTS = 6  #: value ranges of a bracket


def melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, v) rows of the non-missing numeric values."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
            for c in columns
        ]
    )
    return (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.column", "cell.v")
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
    )


def _clipped(p: float) -> float:
    return min(1.0, max(0.0, p))


def _edges(probabilities: Sequence[float]) -> list[float]:
    """Both ends of each bracket and the cuts between them."""
    inner = [MARGIN * (2 * i / CUTS - 1) for i in range(1, CUTS)]
    return sorted({_clipped(p + d) for p in probabilities for d in (-MARGIN, *inner, MARGIN)})


def _in_bracket(probabilities: Sequence[float]) -> Column:
    """Whether ``v`` may hold a wanted rank; of a short column every value may.

    The sketch errs by 1 / ACCURACY of all ranks at most, a third of the margin.
    """
    edges = _edges(probabilities)

    def edge(p: float) -> Column:
        return F.col("edges")[edges.index(_clipped(p))]

    inside = [F.col("v").between(edge(p - MARGIN), edge(p + MARGIN)) for p in probabilities]
    return reduce(Column.__or__, inside, F.col("n") <= ACCURACY)


def sketch_of(long: DataFrame, probabilities: Sequence[float], *extra: Column) -> DataFrame:
    """One row per column: its count, the proposed edges and further aggregates."""
    return long.groupBy("column").agg(
        F.count("*").alias("n"),
        F.percentile_approx("v", _edges(probabilities), ACCURACY).alias("edges"),
        *extra,
    )


def exact_quantiles(
    long: DataFrame, probabilities: Sequence[float], sketch: DataFrame | None = None
) -> DataFrame:
    """Linearly interpolated quantiles of a ``melt`` result: (column, p, q).

    Further columns of the sketch pass through. The values are read twice: for
    the sketch, and for one aggregate that counts whole buckets and, inside the
    brackets, each distinct value. A rank outside the brackets fails the job.
    A task ranks the values of one range: about 0.01 % of a column's distinct values.
    The counts of whole ranges, at most CUTS + 1 for each quantile, are summed apart.
    """
    if sketch is None:
        sketch = sketch_of(long, probabilities)
    carried = [c for c in sketch.columns if c not in ("column", "edges")]
    above_edge = [
        (F.col("edges")[i] < F.col("v")).cast("int") for i in range(len(_edges(probabilities)))
    ]
    bucketed = long.join(F.broadcast(sketch), "column").withColumn(
        "bucket", reduce(Column.__add__, above_edge)
    )
    # Equal values collapse before the shuffle; a hot value is one row here.
    value = F.when(_in_bracket(probabilities), F.col("v")).alias("v")
    cells = bucketed.groupBy("column", "bucket", value).agg(
        F.count("*").alias("c"), *[F.first(c).alias(c) for c in carried]
    )
    # Of one bucket, values below a bracket (null here) come before those at its edge.
    within = Window.partitionBy("column", "bucket").orderBy(F.asc_nulls_first("v"))
    inside = F.sum("c").over(within) - F.col("c")
    totals = cells.groupBy("column", "bucket").agg(F.sum("c").alias("total"))
    table = totals.groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "total"))).alias("totals"))
    # one row a column, its ranges in a map: those before a range are summed where they are needed
    before = F.aggregate(
        F.map_values(F.map_filter("totals", lambda b, _: b < F.col("bucket"))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    placed = cells.select("*", inside.alias("inside")).join(F.broadcast(table), "column")
    placed = placed.select("*", (F.col("inside") + before).alias("first")).drop("inside", "totals")
    # In a step of its own: Spark would explode before the running counts.
    placed = placed.select("*", wanted).withColumn("rank", F.col("p") * (F.col("n") - 1))
    below, above = F.floor("rank"), F.ceil("rank")
    value = F.when(
        F.col("v").isNull(), F.raise_error(F.lit("A rank lies outside the sketched bracket"))
    ).otherwise(F.col("v"))

    def at(rank: Column) -> Column:
        inside = (F.col("first") <= rank) & (F.col("first") + F.col("c") > rank)
        return F.max(F.when(inside, value))

    hit = (F.col("first") <= above) & (F.col("first") + F.col("c") > below)
    return (
        placed.where(hit)
        .groupBy("column", "p")
        .agg(
            at(below).alias("lo"),
            at(above).alias("hi"),
            F.first(F.col("rank") - below).alias("t"),
            *[F.first(c).alias(c) for c in carried],
        )
        .select(
            "column", "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("t")).alias("q"), *carried
        )
    )


def describe(
    df: DataFrame, columns: Sequence[str], names: dict[float, str], sample_std: bool
) -> DataFrame:
    """One row per column: count, mean, std, min, the named quantiles, max.

    Missing values are skipped. ``sample_std`` divides by n - 1, else by n.
    """
    long = melt(df, columns)
    std = F.stddev_samp("v") if sample_std else F.stddev_pop("v")
    sketch = sketch_of(
        long,
        list(names),
        F.avg("v").alias("mean"),
        std.alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    return (
        exact_quantiles(long, list(names), sketch)
        .groupBy("column")
        .agg(
            F.first("n").alias("count"),
            *[F.first(c).alias(c) for c in ("mean", "std", "min")],
            *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in names.items()],
            F.first("max").alias("max"),
        )
    )
