"""Segments table and recordings to the features table.

Neither signals nor feature rows are shuffled. The segments, which are small,
are range-partitioned in output order; a task then holds neighbouring segments
and reads just the byte ranges they cover. A long recording is shared by many
tasks, and the features come out sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspan.errors import FeatureDatasetBuilderError, fail, stage_errors
from sigspan.operators.features import default_channel_names, feature_block, feature_names
from sigspan.operators.ranks import running_sum
from sigspan.operators.segmentation import optional_string
from sigspan.schemas import SEGMENT_KEYS, SORT_KEYS, require_columns
from sigspan.session import shuffle_partitions
from sigspan.sources.edf import EdfHeader, read_header, read_records, recording_headers
from sigspan.sources.remote import open_file
from sigspan.sources.tables import load_segments

# Samples (all channels) decoded and transformed at a time.
READ_SAMPLES = 1 << 19
# Recordings that may be sent to all executors at once.
SENT_RECORDINGS = 10_000


def _sample_bounds(header: EdfHeader, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sample index pairs; half-even rounding, end clipped to the recording."""
    bounds = np.rint(np.stack([start, end], axis=1) * header.sfreq).astype(np.int64)
    bad = (end <= start) | (bounds[:, 1] <= bounds[:, 0]) | (bounds[:, 0] >= header.n_samples)
    if bad.any():
        at = int(np.flatnonzero(bad)[0])
        raise FeatureDatasetBuilderError(
            f"No samples from start_sec={start[at]} to end_sec={end[at]} in {header.path}"
        )
    return np.minimum(bounds, header.n_samples)


def _recording_features(
    source, header: EdfHeader, start: np.ndarray, end: np.ndarray, relative: bool
) -> np.ndarray:
    """Feature rows of segments that are ordered by start within one recording."""
    bounds = _sample_bounds(header, start, end)
    n_channels = len(header.sampled)
    out = np.empty((len(bounds), len(feature_names([header.names[c] for c in header.sampled]))))
    budget = max(1, READ_SAMPLES // n_channels)
    at = 0
    while at < len(bounds):
        # As many following segments as fit into one read.
        upto = at + 1
        while upto < len(bounds) and bounds[upto, 1] - bounds[at, 0] <= budget:
            upto += 1
        part = bounds[at:upto]
        first = int(part[:, 0].min()) // header.samples_per_record
        last = -(-int(part[:, 1].max()) // header.samples_per_record)
        signal = read_records(source, header, first, last)
        origin = first * header.samples_per_record
        lengths = part[:, 1] - part[:, 0]
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            # Overlapping segments copy shared samples: the copies are bounded, too.
            step = max(1, READ_SAMPLES // (n_channels * int(length)))
            for rows in (same[i : i + step] for i in range(0, len(same), step)):
                picks = (part[rows, 0] - origin)[:, None] + np.arange(length)
                stacked = np.moveaxis(signal[:, picks], 0, 1)
                out[at + rows] = feature_block(stacked, header.sfreq, relative)
        at = upto
    return out


def _segment_features(names: list[str], relative: bool):
    """Arrow function: segment keys in, keys and wide features out."""
    columns = feature_names(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header: EdfHeader | None = None
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), dtype=object)
            start = batch.column("start_sec").to_numpy(zero_copy_only=False)
            end = batch.column("end_sec").to_numpy(zero_copy_only=False)
            values = np.full((len(paths), len(columns)), np.nan)
            absent = np.ones(values.shape, dtype=bool)
            cuts = np.flatnonzero(paths[1:] != paths[:-1]) + 1
            for rows in np.split(np.arange(len(paths)), cuts):
                if rows.size == 0:
                    continue
                path = paths[rows[0]]
                if header is None or header.path != path:
                    header = read_header(path, FeatureDatasetBuilderError)
                if len(header.names) > len(names):
                    raise FeatureDatasetBuilderError(
                        f"{path} has {len(header.names)} channels, more than max_channels={len(names)}"
                    )
                mine = [names[c] for c in header.sampled]
                target = [columns.index(c) for c in feature_names(mine)]
                with open_file(path) as source:
                    found = _recording_features(source, header, start[rows], end[rows], relative)
                values[np.ix_(rows, target)] = found
                absent[np.ix_(rows, target)] = False
            arrays = [batch.column(k) for k in SEGMENT_KEYS]
            arrays += [pa.array(values[:, i], mask=absent[:, i]) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*SEGMENT_KEYS, *columns])

    return run


def max_channel_count(segments: DataFrame) -> int:
    """Widest recording; one small job over headers."""
    with stage_errors():
        widest = (
            recording_headers(segments.select("path").distinct(), FeatureDatasetBuilderError)
            .agg(F.max("n_channels"))
            .first()[0]
        )
    return int(widest or 0)


def limit_segments(segments: DataFrame, max_segments: int | None) -> DataFrame:
    """The first segments in output order, for quick runs; in no order themselves.

    Counts by recording place the cut: recordings before it are kept whole, and
    only the one that it falls into is ranked. No task gathers the kept segments, nor
    the counts, which are summed by ranges (`running_sum`). The recordings, at most
    ``max_segments``, go to the segments: files of segments are so small for their rows
    that Spark might send these through the driver instead.
    """
    if max_segments is None:
        return segments
    if max_segments <= 0:
        raise FeatureDatasetBuilderError(
            f"'max_segments' is not positive: {max_segments}"
        )
    subject, path, start = (F.col(c).asc_nulls_last() for c in SORT_KEYS)
    counts = segments.groupBy("subject", "path").agg(F.count("*").alias("_n"))
    before = running_sum(counts, [subject, path], F.col("_n"), "_before")
    room = (max_segments - F.col("_before")).alias("_room")
    recordings = before.where(F.col("_before") < max_segments).select(
        F.col("subject").alias("_s"), F.col("path").alias("_p"), "_n", room
    )
    recordings = F.broadcast(recordings) if max_segments <= SENT_RECORDINGS else recordings.hint("merge")
    same = F.col("subject").eqNullSafe(F.col("_s")) & F.col("path").eqNullSafe(F.col("_p"))
    placed = segments.join(recordings, same)
    whole = placed.where("_n <= _room")
    rank = F.row_number().over(Window.partitionBy("_s", "_p").orderBy(start))
    partial = placed.where("_n > _room").withColumn("_rank", rank).where("_rank <= _room")
    return whole.select(*segments.columns).unionByName(partial.select(*segments.columns))


def segment_features(
    segments: DataFrame, relative_bandpower: bool = False, max_channels: int | None = None
) -> DataFrame:
    """Wide features of every segment, in output order.

    Channels are numbered, so recordings with fewer channels, or with channels that
    have no samples, leave nulls.
    ``max_channels`` saves the header scan when the width is known.
    """
    require_columns(segments, SEGMENT_KEYS, FeatureDatasetBuilderError, "segments.parquet")
    names = default_channel_names(max_channels or max_channel_count(segments))
    keys = segments.select(
        F.col("subject").cast("string").alias("subject"),
        optional_string(segments, "session"),
        optional_string(segments, "run"),
        F.coalesce(F.col("path"), fail(FeatureDatasetBuilderError, "Segment without path")).alias(
            "path"
        ),
        F.col("start_sec").cast("double").alias("start_sec"),
        F.col("end_sec").cast("double").alias("end_sec"),
        F.col("label").cast("bigint").alias("label"),
    )
    schema = ", ".join(
        [f"{n} string" for n in SEGMENT_KEYS[:4]]
        + ["start_sec double", "end_sec double", "label bigint"]
        + [f"{n} double" for n in feature_names(names)]
    )
    order = [F.col(c).asc_nulls_last() for c in SORT_KEYS]
    return (
        keys.repartitionByRange(shuffle_partitions(keys.sparkSession), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_segment_features(names, relative_bandpower), schema)
    )


def build_features_dataset(
    spark: SparkSession,
    segments: DataFrame | str,
    relative_bandpower: bool = False,
    max_segments: int | None = None,
    max_channels: int | None = None,
) -> DataFrame:
    """Features of a segments table, sorted."""
    if isinstance(segments, str):
        segments = load_segments(spark, segments)
    limited = limit_segments(segments, max_segments)
    return segment_features(limited, relative_bandpower, max_channels)

