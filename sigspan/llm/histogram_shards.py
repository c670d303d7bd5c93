"""Shards of nearly equal bytes by histogram sort (operator 2).

Rows are ordered by a 64-bit key, a hash of their columns with the row's own number
below it for ties, so that equal rows can be parted. Splitters between shards are
found by probing: each round places `PROBES` candidate keys in the interval that
still holds a splitter, one pass over all partitions counts the exact bytes below
every candidate, and the interval shrinks around the wanted share of bytes. It ends
when each splitter is within the tolerance, or parts two neighbouring rows. Only
then are rows exchanged, once, to shards and ranges within shards; a row's slot is
its rank in its range plus the rows in the shard's earlier ranges, so no task sorts
a whole shard.

What passes the driver is shards * PROBES byte counts a round.

Defined cases: an empty table gives no rows; with fewer rows than shards some shards
stay empty; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspan.llm.common import schema_of, stored

SHARDS = 40
PROBES = 15
TOLERANCE = 0.001  #: of a shard's bytes
RANGE_ROWS = 100_000  #: rows of a range that one task sorts
OVERHEAD = 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def bytes_below(keyed: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of the rows whose key is smaller than each of the sorted probes."""

    def counted(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, np.int64)
        for batch in arrow:
            cell = np.searchsorted(probes, batch.column("_key").to_numpy(), "right")
            np.add.at(total, cell, batch.column("_size").to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["cell", "size"])

    cells = keyed.select("_key", "_size").mapInArrow(counted, "cell long, size long")
    sums = np.zeros(len(probes) + 1, np.int64)
    for row in cells.groupBy("cell").agg(F.sum("size").alias("size")).collect():
        sums[row["cell"]] = row["size"]
    return np.cumsum(sums)[:-1]


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """shards - 1 keys; a row belongs to the shard of the splitters not above its key."""
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    wanted = [total * (i + 1) / shards for i in range(shards - 1)]
    low, high = [_LOW] * (shards - 1), [_HIGH] * (shards - 1)
    below = [(0, total)] * (shards - 1)  # bytes below low and below high
    best = [(abs(w), _LOW) for w in wanted]
    while True:
        active = [i for i in range(shards - 1) if best[i][0] > tolerance * total / shards and high[i] - low[i] > 1]
        if not active:
            return np.array(sorted(key for _, key in best), np.int64)
        probes = set()
        for i in active:
            wide = high[i] - low[i]
            probes.update(low[i] + wide * j // (PROBES + 1) for j in range(1, PROBES + 1))
        probes = np.array(sorted(probes - {_LOW}), np.int64)
        counts = bytes_below(keyed, probes)
        for i in active:
            for key, count in zip(probes.tolist(), counts.tolist()):
                if low[i] < key < high[i]:
                    best[i] = min(best[i], (abs(count - wanted[i]), key))
            inside = [(k, c) for k, c in zip(probes.tolist(), counts.tolist()) if low[i] <= k <= high[i]]
            low[i], at_low = max(((k, c) for k, c in inside if c <= wanted[i]), default=(low[i], below[i][0]))
            high[i], at_high = min(((k, c) for k, c in inside if c >= wanted[i] and k > low[i]), default=(high[i], below[i][1]))
            below[i] = (at_low, at_high)
            if at_low == at_high:  # no row lies between: any key here parts the same rows
                high[i] = low[i]


def shard_by_bytes(df: DataFrame, size: Column, shards: int = SHARDS) -> DataFrame:
    """df with `shard` and `slot`; the shards' sums of size are nearly equal."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    numbered = df.select(*names, size.cast("long").alias("_size"), F.monotonically_increasing_id().alias("_row"))
    # the hash spreads rows evenly; the row number parts equal hashes and is fixed by storing it
    keyed = stored(numbered.withColumn("_key", F.xxhash64(*names, "_row")), "shard-keys")
    cuts = splitters(keyed, shards)
    rows = keyed.count()
    ranges = max(1, -(-rows // (shards * RANGE_ROWS)))
    edges = np.array([_LOW, *cuts.tolist(), _HIGH], dtype=object)
    inner = [int(a) + (int(b) - int(a)) * j // ranges for a, b in zip(edges[:-1], edges[1:]) for j in range(1, ranges)]
    bounds = np.array(sorted([*cuts.tolist(), *inner]), np.int64)

    def placed(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            key = batch.column("_key").to_numpy()
            batch = batch.append_column("shard", pa.array(np.searchsorted(cuts, key, "right").astype(np.int32)))
            yield batch.append_column("_range", pa.array(np.searchsorted(bounds, key, "right")))

    schema = schema_of(keyed, shard="integer", _range="long")
    found = keyed.mapInArrow(placed, schema)
    within = Window.partitionBy("shard", "_range").orderBy("_key", "_row")
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    ranked = found.withColumn("_rank", F.row_number().over(within)).join(starts, ["shard", "_range"])
    return ranked.select(*names, "shard", (F.col("_start") + F.col("_rank") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest of every document with its place; the size is the text's bytes plus 16."""
    text = F.coalesce("text", F.lit(""))
    digest = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    found = shard_by_bytes(digest, F.col("size"), shards)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
