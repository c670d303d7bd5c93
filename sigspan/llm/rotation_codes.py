"""Near-duplicate vectors by randomised-rotation binary codes (operator 10).

A unit vector o is rotated by a fixed random rotation; its code is the signs, one
bit a dimension, and its correction factor f is the inner product of the rotated
vector with its own code vector c (signs over the square root of the dimension).
For a unit vector q rotated alike, <c, q> / f is an unbiased estimate of <o, q>. Its
error is the part of q orthogonal to o, seen through sqrt(1 - f^2) / f times a
direction that the rotation makes random, so for pairs with cosine >= t it stays
below

    EPSILON * sqrt(1 - t^2) * sqrt(1 - f^2) / f / sqrt(dimension - 1)

but for a chance of about 2e-9 (EPSILON = 6). Only pairs whose estimate reaches t less
this bound are computed again, in double precision, and linked by that.

Vectors are compared within labels, in cells of two groups of `GROUP` rows, so that a
label of any size is many small cells. A cell emits no pairs: for each of its rows
the number of links and one link to the smallest row of its component in the cell.
The work in a label is quadratic, as "all rows of a label" asks, at one bit a
dimension; rows, shuffles and memory of a cell are not.

Defined cases: vectors that are null, of zero length or norm, or that hold a null or
a component that isn't finite, and those with a null label, link with nothing;
vectors of different dimension are not compared; rows that repeat id, label and
vector count once and all get the same answer; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspan.llm.block_neighbours import cosines, matrix, unit, usable
from sigspan.llm.common import schema_of, stored
from sigspan.llm.components import components

THRESHOLD = 0.93
EPSILON = 6.0
GROUP = 2048
STRIP = 512  #: rows of a cell whose estimates are held at once
SEED = 10


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factor of each row."""
    rotated = unit(x) @ rotation(x.shape[1]).T
    return np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(1) / np.sqrt(x.shape[1])


def margin(factor: np.ndarray, dim: int, threshold: float = THRESHOLD) -> np.ndarray:
    """How far below the threshold the estimate of a linked pair may lie."""
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor
    return EPSILON * np.sqrt(1 - threshold**2) * spread / np.sqrt(max(dim - 1, 1)) + 1e-5


def links(codes, factors, x, y, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of y) with cosine >= threshold; codes and factors are those of x."""
    dim = x.shape[1]
    rotated = (unit(y) @ rotation(dim).T).astype(np.float32)
    for first in range(0, len(x), STRIP):
        bits = np.unpackbits(codes[first : first + STRIP], axis=1, count=dim).astype(np.float32)
        f = factors[first : first + STRIP]
        estimate = (2 * bits - 1) @ rotated.T / (np.sqrt(dim) * f[:, None])
        near = estimate >= (threshold - (margin(f, dim, threshold) if dim > 1 else 2))[:, None]
        a, b = np.nonzero(near)
        for piece in range(0, len(a), 1 << 16):
            i, j = a[piece : piece + (1 << 16)] + first, b[piece : piece + (1 << 16)]
            sure = cosines(x[i], y[j]) >= threshold
            yield i[sure], j[sure]


def coded(vectors: DataFrame) -> DataFrame:
    """The rows that can link, with code and factor."""
    rows = usable(vectors, "label").where("label is not null")

    def codes(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                bits, factors = encode(matrix(part.column("x")))
                part = part.append_column("code", pa.array([b.tobytes() for b in bits], pa.binary()))
                yield part.append_column("factor", pa.array(factors))

    return rows.mapInArrow(codes, schema_of(rows, code="binary", factor="double"))


def _cell(cell: pa.Table) -> pa.Table:
    """Number of links of each row, and the smallest id it is connected with in this cell."""
    side, ids = cell.column("side").to_numpy(), cell.column("vec_id").to_numpy()
    x, factors = matrix(cell.column("x")), cell.column("factor").to_numpy()
    codes = np.frombuffer(b"".join(cell.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)  # side 0: compared with its own group
    same = bool((side == 0).any())
    counts, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    if len(left) and len(right):
        for i, j in links(codes[left], factors[left], x[left], x[right]):
            i, j = left[i], right[j]
            other = ids[i] != ids[j]
            i, j = i[other], j[other]
            counts += np.bincount(i, minlength=len(ids))
            if not same:
                counts += np.bincount(j, minlength=len(ids))
            _join(parent, i, j)
    while True:  # every row to the root of its tree
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, ids)
    found = np.flatnonzero(counts)
    return pa.table({"vec_id": ids[found], "n": counts[found], "least": least[parent[found]]})


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hook the trees of linked rows together until each pair shares its root."""
    while len(i):
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = stored(coded(vectors), "codes")
    sizes = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.select("label", "dim", F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))
    dealt = rows.join(groups, ["label", "dim"]).withColumn("g", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    cells = dealt.select(
        "label", "dim", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"),
        F.signum(F.col("g") - F.col("h")).cast("int").alias("side"), "vec_id", "x", "code", "factor",
    )
    found = cells.groupBy("label", "dim", "i", "j").applyInArrow(_cell, "vec_id long, n long, least long")
    found = stored(found, "cell-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")), name="vector-components")
    named = counts.join(roots.withColumnRenamed("vertex", "vec_id"), "vec_id", "left")
    out = vectors.select("vec_id").join(named, "vec_id", "left")
    out = out.select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
