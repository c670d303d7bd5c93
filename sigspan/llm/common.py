"""What the operators share: stored intermediates and views of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspan.session import shared_dir

BATCH_ROWS = 1000
SLICE_BYTES = 2 << 20  #: text that is expanded into arrays at once; a longer row is taken alone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the cluster's shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation, and what is drawn
    once (row identifiers, for instance) stays as it is.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """`stored`, for operators of many steps: the driver lets go of what led to the table.

    Each step leaves broadcasts, shuffles and plans whose memory and files are dropped
    when the driver's JVM collects their handles; it would rather let its heap grow.
    """
    found = stored(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return found


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to send at most BATCH_ROWS rows to Python at a time.

    The default of 10,000 texts is tens of megabytes, held several times over on
    both sides of the socket, for each core of an executor.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def release() -> None:
    """Give memory that Arrow and the allocator keep back to the machine.

    Python workers outlive their tasks; what one operator needed would stay with
    them while the next one runs.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a text or binary column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (first, end) whose sizes add up to about limit at most."""
    total, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
        yield first, end
        first = end


def batches(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """The batch cut into pieces with about limit bytes of text each."""
    _, offsets = text_bytes(batch.column(column))
    for first, end in slices(np.diff(offsets), limit):
        yield batch.slice(first, end - first)


def id_order(name: str = "doc_id"):
    """A fixed pseudo-random 31-bit number of an id; null has one too."""
    return F.xxhash64(F.col(name)).bitwiseAND(F.lit((1 << 31) - 1))


def text_key(name: str = "text"):
    """128 bits that name a text; empty for null. With an id it tells apart rows that share theirs."""
    return F.coalesce(F.unhex(F.md5(F.col(name))), F.lit(b""))


def schema_of(df: DataFrame, **more: str | T.DataType) -> T.StructType:
    """df's schema with more fields; adding to df.schema would change df itself."""
    found = T.StructType(list(df.schema.fields))
    for name, kind in more.items():
        found.add(name, kind)
    return found
