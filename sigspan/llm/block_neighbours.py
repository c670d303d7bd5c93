"""Exact-scored nearest neighbours by a block matrix join (operator 9).

Equal vectors are one class, held with the few smallest of its ids. A class is scaled
to length one and quantised once: int8 values and one scale, together with the length
of what rounding lost. Classes that hold a query, and all classes, are dealt into a
grid of blocks, as int8 and three numbers each; a cell holds one block of either. In a
cell the product of the int8 blocks, one tile at a time, gives each cosine up to a bound:

    |a.b - s_a s_b (q_a.q_b)| <= |e_a| |s_b q_b| + |e_b|

where e is the rounding error of a unit vector. A pair survives if its upper bound
reaches the best lower bounds of its query so far, first in its cell, then over all
cells of the query. Vectors as given are fetched for survivors only, whose cosines are
computed in double precision, and a heap for each query keeps the best of them.

So each result is exact: the bounds only save work. A query's own id is no candidate,
so bounds and classes keep one place and one id more than are asked for. A class takes
part in as many cells as there are blocks on the other side and leaves about
k + 1 survivors in each.

Defined cases: vectors that are null, of zero length or norm, or that hold a null or
a component that isn't finite take no part; vectors of different dimension are not
compared; rows that repeat id and vector count once; candidates with the query's
own id are left out; ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspan.llm.common import schema_of, stored

NEAREST = 5
EVERY = 50  #: rows whose id is divisible by this are the queries
QUERY_BLOCK = 4096
ROW_BLOCK = 16_384
TILE = 512  #: rows of one product


def usable(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id, x (array of double), dim and the columns named; without vectors that can't be compared."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    found = vectors.select("vec_id", x.alias("x"), *more).where("vec_id is not null and size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    found = found.where(finite & F.exists("x", lambda v: v != 0))
    return found.dropDuplicates(["vec_id", "x", *more]).withColumn("dim", F.size("x"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of doubles as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that squares stay finite."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, length of the scaled values, and length of the rounding error."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    held = q * scale[:, None]
    return q, scale, np.linalg.norm(held, axis=1), np.linalg.norm(u - held, axis=1) + 1e-12


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision."""
    with np.errstate(all="ignore"):
        dot = np.einsum("ij,ij->i", a, b)
        norms = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        found = dot / norms
    odd = ~np.isfinite(found) | ~np.isfinite(norms) | ~(norms > 1e-140)  # squares overflow or vanish
    if odd.any():
        found[odd] = np.einsum("ij,ij->i", unit(a[odd]), unit(b[odd]))
    return found


class Block:
    """Quantised vectors of one dimension: int8 rows, scales, lengths and lengths of the errors."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("class").to_numpy()
        rows = b"".join(table.column("q").to_pylist())
        self.q = np.frombuffer(rows, np.int8).reshape(len(self.ids), -1)
        self.scale, self.length, self.error = (table.column(c).to_numpy() for c in ("scale", "length", "error"))


def survivors(queries: Block, rows: Block, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, row, lower, upper) of the pairs of a cell that may be among the k best of their query."""
    a = queries.q.astype(np.float32)  # products of int8 sum up exactly in float32 up to 1040 dimensions
    best = np.full((len(a), k), -np.inf)
    kept: list[tuple[np.ndarray, ...]] = []
    for first in range(0, len(rows.ids), TILE):
        at = slice(first, first + TILE)
        products = (a @ rows.q[at].astype(np.float32).T).astype(np.float64)
        estimate = products * queries.scale[:, None] * rows.scale[at]
        slack = queries.error[:, None] * rows.length[at] + rows.error[at] + 1e-9
        slack += 1e-6 * (1 + np.abs(estimate)) * (a.shape[1] > 1040)
        best = np.partition(np.concatenate([best, estimate - slack], 1), -k, axis=1)[:, -k:]
        i, j = np.nonzero(estimate + slack >= best.min(1)[:, None])
        kept.append((i, j + first, (estimate - slack)[i, j], (estimate + slack)[i, j]))
    for i, j, lower, upper in kept:  # once more, by the bounds of the whole cell
        still = upper >= best.min(1)[i]
        yield queries.ids[i[still]], rows.ids[j[still]], lower[still], upper[still]


def _cell(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = list(survivors(Block(queries), Block(rows), k)) if queries.num_rows and rows.num_rows else []
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "class", "lower", "upper"])

    return run


def classes(rows: DataFrame, k: int) -> DataFrame:
    """class, ids, dim, x, q, scale, length and error of each different vector; to be stored once.

    A class has a number of its own and holds its k + 1 smallest ids; a window's limit
    is taken where the rows are, so a vector of very many ids isn't gathered.
    """
    order = Window.partitionBy("dim", "x").orderBy("vec_id")
    few = rows.select("dim", "x", "vec_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    held = few.groupBy("dim", "x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    held = held.select(F.monotonically_increasing_id().alias("class"), "ids", "dim", "x")

    def quantise(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                q, *numbers = quantised(unit(matrix(part.column("x"))))
                part = part.append_column("q", pa.array([row.tobytes() for row in q], pa.binary()))
                for name, values in zip(("scale", "length", "error"), numbers):
                    part = part.append_column(name, pa.array(values))
                yield part

    schema = schema_of(held, q="binary", scale="double", length="double", error="double")
    return held.mapInArrow(quantise, schema)


def _rescored(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of surviving pairs from the vectors as they were given."""
    for batch in arrow:
        a, b, dims = batch.column("x"), batch.column("y"), batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            same = pa.array(dims == dim)
            score = cosines(matrix(a.filter(same)), matrix(b.filter(same)))
            part = batch.filter(same).drop_columns(["x", "y", "dim"])
            yield part.append_column("score", pa.array(score))


def _merged(k: int):
    """Heaps over the candidates of one query after the other."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []

        def result() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            columns = [[query] * len(best), list(range(1, len(best) + 1)), [-i for _, i in best], [s for s, _ in best]]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "rank", "vec_id", "score"])

        for batch in arrow:
            for name, ids, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "ids", "score"))):
                if name != query:
                    if heap:
                        yield result()
                    query, heap = name, []
                for i in ids:
                    entry = (score, -i)
                    if i == name or entry in heap:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        if heap:
            yield result()

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of every query.

    Both sides: vec_id, x, dim, as `usable` gives them; queries are rows, too.
    """
    spark = rows.sparkSession
    known = stored(classes(rows, k), "near-classes")
    # a query's class by its vector; the same vector asks once
    asked = stored(queries.join(known.select("dim", "x", "class"), ["dim", "x"]).select(F.col("vec_id").alias("query_id"), F.col("class").alias("query")), "near-queries")
    # classes of the query's own id give it no candidate: one, or more where an id has several vectors
    own = asked.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1
    wide = k + own
    light = ["dim", "class", "q", "scale", "length", "error"]
    asking = known.join(asked.select(F.col("query").alias("class")).distinct(), "class", "left_semi")
    asking = stored(asking.select(*light), "near-asking")
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    row_blocks = max(spark.sparkContext.defaultParallelism, -(-known.count() // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    left = asking.select(*light, block(query_blocks).alias("qb")).withColumn("rb", every(row_blocks))
    right = known.select(*light, block(row_blocks).alias("rb")).withColumn("qb", every(query_blocks))
    cells = left.groupBy("dim", "qb", "rb").cogroup(right.groupBy("dim", "qb", "rb"))
    pairs = stored(cells.applyInArrow(_cell(wide), "query long, class long, lower double, upper double"), "near-pairs")
    # the best lower bounds of a query over its cells decide what is computed again
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    floor = pairs.withColumn("_n", place).where(F.col("_n") <= wide).groupBy("query")
    floor = floor.agg(F.when(F.count(F.lit(1)) >= wide, F.min("lower")).otherwise(float("-inf")).alias("floor"))
    left_over = pairs.join(floor, "query").where(F.col("upper") >= F.col("floor")).select("query", "class")
    given = known.select(F.col("class").alias("query"), "x", "dim")
    full = left_over.join(given, "query").join(known.select("class", "ids", F.col("x").alias("y")), "class")
    full = full.select("query", "class", "ids", "x", "y", "dim")
    schema = schema_of(full.drop("x", "y", "dim"), score="double")
    scores = full.mapInArrow(_rescored, schema).join(asked, "query").select("query_id", "ids", "score")
    scores = scores.repartition("query_id").sortWithinPartitions("query_id")
    return scores.mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")


def search(vectors: DataFrame) -> DataFrame:
    """Every EVERY-th id against all rows."""
    rows = stored(usable(vectors), "near-vectors")
    return nearest(rows.where(F.col("vec_id") % EVERY == 0), rows)
