"""Manifest and annotation files to the segments table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspan.errors import DatasetBuilderError
from sigspan.functions.bids import EEG_SUFFIX, EVENTS_SUFFIX, dirname, events_path, plain_path
from sigspan.functions.windows import WindowSpec
from sigspan.operators.intervals import extract_seizure_intervals
from sigspan.operators.segmentation import segments
from sigspan.schemas import SEGMENTS, require_columns
from sigspan.sources.edf import recording_headers
from sigspan.sources.events_tsv import read_paths
from sigspan.sources.manifest import load_manifest


def recording_intervals(manifest: DataFrame, missing_bounds: str = "open") -> DataFrame:
    """Seizure intervals keyed by the recording's path.

    Works from the wanted annotation paths, wherever they lie; one that doesn't
    exist fails the job. A file belongs to one recording by its name, so the key
    is renamed in place instead of joined, and always names a recording.
    """
    wanted = manifest.select(events_path(F.col("path")).alias("path"))
    intervals = extract_seizure_intervals(read_paths(wanted), ["path"], missing_bounds)
    folder, name = dirname(F.col("path")), F.substring_index("path", "/", -1)
    eeg_name = F.replace(name, F.lit(EVENTS_SUFFIX), F.lit(EEG_SUFFIX))
    return intervals.withColumn("path", F.concat(folder, F.lit("/"), eeg_name))


def build_segments_dataset(
    spark: SparkSession,
    manifest: DataFrame | str,
    spec: WindowSpec = WindowSpec(),
    missing_bounds: str = "open",
) -> DataFrame:
    """Labelled segments of every recording in the manifest, sorted.

    Any bad recording or annotation fails the whole job.
    """
    if isinstance(manifest, str):
        manifest = load_manifest(spark, manifest)
    require_columns(manifest, ("subject", "path"), DatasetBuilderError, "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], SEGMENTS)
    manifest = manifest.withColumn("path", plain_path(F.col("path"), encoded=False))
    headers = recording_headers(manifest.select("path").distinct(), DatasetBuilderError).select(
        "path", F.col("duration_sec").alias("recording_duration_sec")
    )
    recordings = manifest.join(headers, "path")
    return segments(recordings, recording_intervals(manifest, missing_bounds), spec, ordered=True)
