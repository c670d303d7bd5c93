"""Connected components by large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspan.llm.common import settled, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: all larger ones, or all smaller ones and itself.

    edges: (u, v), both directions for large, u > v for small. The minima are
    pre-aggregated and joined back, so a vertex with many neighbours is never
    gathered; a hot join key is left to adaptive execution to split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        pairs = edges.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = pairs.unionByName(least.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(vertex, root) of every vertex of the edges; root is the smallest vertex reachable.

    Ends when a step leaves the edges as they are, which is a star around each
    root; the number of steps grows with the logarithm of the longest path.
    """
    first, second = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stored(edges.where(F.col(a) != F.col(b)).select(first, second).distinct(), name)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = _star(both, large=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = settled(_star(grown, large=False), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("vertex")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(
        roots.select("vertex", F.col("vertex").alias("root"))
    )
