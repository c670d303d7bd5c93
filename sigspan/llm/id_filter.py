"""A bitmap of hashed ids that thins out a table before it is joined.

Its size is fixed, so it can pass the driver and go to every task whatever the
number of ids. It lets some other rows through, the more the fuller it is: a join
with the ids must follow. It only saves that join from moving most of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24  #: 2 MB


def slot(column: str) -> Column:
    return F.xxhash64(F.col(column)).bitwiseAND(F.lit(BITS - 1))


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of ids, null among them; at most BITS / 64 numbers are collected."""
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    words = ids.select(slot(column).alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
    words = words.agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(BITS >> 6, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    return bits


def thinned(df: DataFrame, bits: np.ndarray, column: str) -> DataFrame:
    """The rows of df whose id is in the bitmap, and a few others."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def kept(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            at = batch.column("_slot").to_numpy()
            found = pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)
            yield batch.filter(found).drop_columns(["_slot"])

    return df.withColumn("_slot", slot(column)).mapInArrow(kept, df.schema)
