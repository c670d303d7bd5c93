"""Windows, overlaps and labels for all recordings in one plan.

The window rows are the bulk of the output, so they are never shuffled. What
moves is (1) one row per *block* of windows and (2) one row per interval and
block that it touches. Both are hashed on (recording, block): a
recording of any length spreads over the cluster, and so does one that holds a
large share of all annotations. The windows come out of the joined blocks by a
local explode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspan.functions.labeling import assign_label
from sigspan.functions.windows import (
    WindowSpec,
    checked_duration,
    ordered_end,
    overlap_ratio,
    shared_seconds,
    window_count,
    window_start,
)
from sigspan.schemas import SEGMENTS, SORT_KEYS
from sigspan.session import shuffle_partitions

# Windows per block. Bounds every array a task holds; small enough that an
# hour-long recording of 5-second windows is still cut in several pieces.
BLOCK = 256

DURATION = "recording_duration_sec"


def _blocks(recordings: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row per block of windows."""
    last = F.floor((F.col("_n") - 1) / BLOCK)
    return (
        recordings.withColumn(DURATION, checked_duration(F.col(DURATION)))
        .select("*", window_count(F.col(DURATION), spec).alias("_n"))
        # No windows give a null array, and explode drops those rows.
        .select("*", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), last))).alias("_block"))
    )


def _spread(blocks: DataFrame, key: str) -> DataFrame:
    """Even hash spread of the blocks.

    The count is fixed because adaptive coalescing judges by bytes: it would put
    the tiny block rows, and all windows they expand to, into one task. The key
    is a hash of its own, since Spark drops a repartition that repeats the
    partitioning of the join below it.
    """
    slot = F.xxhash64(key, "_block")
    return blocks.repartition(shuffle_partitions(blocks.sparkSession), slot)


def _spread_in_order(blocks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Even range spread of the blocks along the output order."""
    keys = [F.col(c).asc_nulls_last() for c in (*order, "_block")]
    return blocks.repartitionByRange(shuffle_partitions(blocks.sparkSession), *keys)


def _block_windows() -> Column:
    first = F.col("_block") * BLOCK
    return F.sequence(first, F.least(first + (BLOCK - 1), F.col("_n") - 1))


def _bounds(spec: WindowSpec) -> list[Column]:
    start = window_start(F.col("_k"), spec)
    return [start.alias("start_sec"), (start + float(spec.window_size_sec)).alias("end_sec")]


def generate_time_windows(
    recordings: DataFrame, spec: WindowSpec, key: str = "path"
) -> DataFrame:
    """All complete windows of each recording, with their bounds."""
    return (
        _spread(_blocks(recordings, spec), key)
        .select(*recordings.columns, F.explode(_block_windows()).alias("_k"))
        .select(*recordings.columns, *_bounds(spec))
        .where(F.col("end_sec") <= F.col(DURATION))
    )


def _block_of(k: Column) -> Column:
    return F.floor(k / BLOCK)


def window_overlaps(
    intervals: DataFrame, recordings: DataFrame, spec: WindowSpec, key: str = "path"
) -> DataFrame:
    """One row per (window, interval) pair that shares time.

    The pairs are found by arithmetic on the interval's own row, bounded by the
    length of its recording; an interval of any length, or with an open bound,
    follows the same rule, and one of a recording that isn't there has no pairs.
    An interval is first cut into blocks of windows, and the blocks are spread
    before they become windows, so a long one is shared by many tasks. The
    result stays partitioned by (recording, block).
    """
    size, stride = float(spec.window_size_sec), float(spec.stride_sec)
    zero, huge = F.lit(0).cast("bigint"), F.lit(2.0**53)
    onset, end = F.col("onset_sec"), F.col("end_sec")
    window_end, interval_end = F.col("window_end_sec"), F.col("interval_end_sec")
    lengths = recordings.groupBy(key).agg(F.max(checked_duration(F.col(DURATION))).alias("_length"))
    # One window of slack on both sides absorbs rounding; the overlap decides.
    first = F.when(onset.isNull(), zero).otherwise(
        F.greatest(F.floor(F.least((onset - size) / stride, huge)), zero)
    )
    last = F.least(
        F.floor(F.least(end / stride, huge)) + 1, window_count(F.col("_length"), spec) - 1
    )
    blocks = F.when(
        F.col("_first") <= F.col("_last"),
        F.sequence(_block_of(F.col("_first")), _block_of(F.col("_last"))),
    )
    begin = F.greatest("_first", F.col("_block") * BLOCK)
    finish = F.least(F.col("_last"), F.col("_block") * BLOCK + (BLOCK - 1))
    shared = shared_seconds(F.col("start_sec"), window_end, onset, interval_end)
    return (
        intervals.select(key, onset, ordered_end(onset, end).alias("end_sec"))
        .join(lengths, key)
        .select("*", first.alias("_first"), last.alias("_last"))
        .select("*", F.explode(blocks).alias("_block"))
        .repartition(key, "_block")
        .select(key, "_block", "_length", onset, end, F.explode(F.sequence(begin, finish)).alias("_k"))
        .select(
            key,
            "_block",
            "_k",
            "_length",
            window_start(F.col("_k"), spec).alias("start_sec"),
            onset,
            end.alias("interval_end_sec"),
        )
        .select("*", (F.col("start_sec") + size).alias("window_end_sec"))
        .select("*", shared.alias("overlap_sec"))
        .where("overlap_sec > 0 AND window_end_sec <= _length")
        .drop("_length")
    )


def total_overlaps(pairs: DataFrame, key: str = "path") -> DataFrame:
    """Summed overlap per touched window, where the pairs already are."""
    return pairs.groupBy(key, "_block", "_k").agg(F.sum("overlap_sec").alias("overlap_sec"))


def _dense() -> Column:
    """The overlaps of a block by the place of their window, as far as the last one that is touched."""
    offset = lambda hit: (hit["_k"] - F.col("_block") * BLOCK).cast("int")

    def filled(done: Column, hit: Column) -> Column:
        gap = F.array_repeat(F.lit(0.0), offset(hit) - F.size(done))
        return F.concat(done, gap, F.array(hit["overlap_sec"]))

    return F.aggregate("_touched", F.array().cast("array<double>"), filled)


def windows_with_overlap(
    recordings: DataFrame,
    intervals: DataFrame,
    spec: WindowSpec,
    key: str = "path",
    order: Sequence[str] = (),
) -> DataFrame:
    """Every complete window with its total overlap in seconds (0 if untouched).

    With ``order``, partitions follow those columns; only blocks move for it.
    """
    touched = (
        total_overlaps(window_overlaps(intervals, recordings, spec, key), key)
        # At most BLOCK entries: the windows of a block are distinct by now.
        .groupBy(key, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("_k", "overlap_sec"))).alias("_touched"))
        .select(key, "_block", _dense().alias("_hits"))
    )
    overlap = F.coalesce(F.get("_hits", (F.col("_k") - F.col("_block") * BLOCK).cast("int")), F.lit(0.0))
    keep = recordings.columns
    joined = _blocks(recordings, spec).join(touched, [key, "_block"], "left")
    # Spread after the join: whatever way the join runs, the explode below then
    # starts from evenly filled partitions.
    joined = _spread_in_order(joined, order) if order else _spread(joined, key)
    return (
        joined.select(*keep, "_block", "_hits", F.explode(_block_windows()).alias("_k"))
        .select(*keep, "_k", overlap.alias("overlap_sec"))
        .select(*keep, "overlap_sec", *_bounds(spec))
        .where(F.col("end_sec") <= F.col(DURATION))
    )


def windows_with_ratio(
    recordings: DataFrame,
    intervals: DataFrame,
    spec: WindowSpec,
    key: str = "path",
    order: Sequence[str] = (),
) -> DataFrame:
    """Every complete window with the fraction that intervals cover."""
    return windows_with_overlap(recordings, intervals, spec, key, order).withColumn(
        "overlap_ratio",
        overlap_ratio(F.col("overlap_sec"), F.col("end_sec") - F.col("start_sec")),
    )


def label_windows(
    recordings: DataFrame, intervals: DataFrame, spec: WindowSpec, key: str = "path"
) -> DataFrame:
    """Windows with the full label decision, dropped ones included."""
    return windows_with_ratio(recordings, intervals, spec, key).withColumn(
        "decision",
        assign_label(
            F.col("overlap_ratio"), spec.positive_overlap_threshold, spec.drop_partial_overlap
        ),
    )


def optional_string(df: DataFrame, column: str) -> Column:
    """A column as text, or null where the table lacks it."""
    value = F.col(column) if column in df.columns else F.lit(None)
    return value.cast("string").alias(column)


def segments(
    recordings: DataFrame,
    intervals: DataFrame,
    spec: WindowSpec,
    key: str = "path",
    ordered: bool = False,
) -> DataFrame:
    """Kept windows in the segments schema.

    ``ordered`` gives the order of ``sort_segments`` without a sort of all
    windows: their blocks are range-partitioned and each partition is sorted.

    The same policy as ``assign_label``, without its reason text and without a
    second range check: the ratio was checked when it was formed.
    """
    inputs = recordings.select(
        F.col("subject").cast("string").alias("subject"),
        optional_string(recordings, "session"),
        optional_string(recordings, "run"),
        F.col(key).cast("string").alias(key),
        F.col(DURATION).cast("double").alias(DURATION),
    )
    order = ("subject", key) if ordered else ()
    windows = windows_with_ratio(inputs, intervals, spec, key, order)
    positive = F.col("overlap_ratio") >= spec.positive_overlap_threshold
    if spec.drop_partial_overlap:
        windows = windows.where(positive | (F.col("overlap_ratio") == 0))
    out = (
        windows.withColumns(
            {
                "window_size_sec": F.lit(float(spec.window_size_sec)),
                "stride_sec": F.lit(float(spec.stride_sec)),
                "label": positive.cast("bigint"),
            }
        ).select(*[c if c != "path" else key for c in SEGMENTS.fieldNames()])
    )
    if not ordered:
        return out
    return out.sortWithinPartitions(
        *[F.col(c).asc_nulls_last() for c in ("subject", key, "start_sec")]
    )


def sort_segments(df: DataFrame) -> DataFrame:
    """The output order of any segments or features table; nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in SORT_KEYS])
