"""Printed checks of stored tables and of a dataset folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspan.operators import quality
from sigspan.schemas import SEGMENT_KEYS
from sigspan.sinks.report import preview
from sigspan.sources import edf
from sigspan.sources.events_tsv import read_events
from sigspan.sources.manifest import list_recordings

# How much of each listing is shown.
STATISTICS_COLUMNS, SAMPLE_COLUMNS, DURATIONS, ANNOTATIONS, NAMES = 10, 20, 5, 10, 10
# Lists of distinct values are shown whole; more than this is no listing, and an error says so.
DISTINCT = 10_000


def _whole(df: DataFrame) -> str:
    rows = df.limit(DISTINCT + 1).count()
    if rows > DISTINCT:
        raise ValueError(f"More than {DISTINCT} distinct values to list")
    return preview(df, max(rows, 1))


def _section(title: str, body: object) -> str:
    return f"\n{title}:\n{body}"


def _durations(df: DataFrame) -> str:
    counts = quality.value_counts(df, F.col("end_sec") - F.col("start_sec"), "duration_sec")
    return preview(counts, DURATIONS)


def _missing(df: DataFrame, only_present: bool) -> str:
    counts = quality.null_counts(df)
    if only_present:
        counts = counts.where("n_missing > 0")
        if counts.isEmpty():
            return "No nulls found."
    return preview(counts, len(df.columns))


def _labels(df: DataFrame) -> str:
    return _whole(quality.value_counts(df, "label", "label"))


def _distinct(df: DataFrame, column: str, order: Column | None) -> str:
    """In order of first appearance where rows have places, else by value."""
    found = quality.unique_values(df, column, order)
    return _whole(found if order is not None else found.orderBy(column))


def _subjects(df: DataFrame) -> int:
    return quality.n_unique(df, ["subject"]).first()[0]


def segments_report(df: DataFrame, order: Column | None = None) -> str:
    """order: the rows' places, `file_order()` for a table as it is loaded."""
    return "\n".join(
        [
            f"Shape: {(df.count(), len(df.columns))}",
            _section("Labels", _labels(df)),
            _section(
                "Overlap ratio summary",
                preview(quality.summary_statistics(df, ["overlap_ratio"]), 1),
            ),
            _section("Nulls", _missing(df, only_present=False)),
            _section("Window durations", _durations(df)),
            _section("Window sizes", _distinct(df, "window_size_sec", order)),
            _section("Strides", _distinct(df, "stride_sec", order)),
            _section("Subjects", _subjects(df)),
        ]
    )


def features_report(df: DataFrame) -> str:
    columns = quality.feature_columns(df)
    numeric = [c for c in columns if c not in quality.non_numeric_features(df)]
    shown = [c for c in columns[:STATISTICS_COLUMNS] if c in numeric]
    statistics = (
        preview(quality.summary_statistics(df, shown), STATISTICS_COLUMNS)
        if shown
        else "No feature columns found."
    )
    power = [c for c in columns if "power_" in c]
    negative = (
        [r["column"] for r in quality.negative_power(df).where("has_negative").collect()]
        if power
        else []
    )
    return "\n".join(
        [
            f"Shape: {(df.count(), len(df.columns))}",
            _section("Labels", _labels(df)),
            _section("Nulls per column", _missing(df, only_present=True)),
            _section("Metadata columns", [c for c in SEGMENT_KEYS if c in df.columns]),
            _section("Number of feature columns", len(columns)),
            _section("Sample feature columns", columns[:SAMPLE_COLUMNS]),
            _section("Summary statistics of the first feature columns", statistics),
            _section(
                "Non-numeric feature columns",
                quality.non_numeric_features(df) or "All feature columns are numeric.",
            ),
            _section("Bandpower columns with negative values", negative or "None"),
            _section("Window durations", _durations(df)),
            _section("Subjects", _subjects(df)),
        ]
    )


def _first_recording(spark: SparkSession, root: str) -> str:
    first = list_recordings(spark, root).agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"No EEG files found in {root}")
    return first


def recording_report(spark: SparkSession, root: str) -> str:
    """Header facts of the first recording."""
    edf.register(spark)
    path = _first_recording(spark, root)
    head = spark.read.format("edf_header").load(path).first()
    return "\n".join(
        [
            f"File: {path.rsplit('/', 1)[1]}",
            f"Channels: {head.n_channels}",
            f"Sampling frequency: {head.sfreq}",
            f"First {NAMES} channels: {head.channel_names[:NAMES]}",
        ]
    )


def annotations_report(spark: SparkSession, root: str) -> str:
    """The first annotations of the first recording."""
    path = _first_recording(spark, root)
    events = path.removesuffix("_eeg.edf") + "_events.tsv"
    rows = read_events(spark, events).select("onset", "duration", "eventType", "position")
    onset = F.expr("try_cast(onset AS DOUBLE)")
    return "\n".join(
        [
            f"File: {path.rsplit('/', 1)[1]}",
            f"Number of annotations: {rows.count()}",
            preview(rows.orderBy(onset.asc_nulls_last(), "position").drop("position"), ANNOTATIONS),
        ]
    )
