"""Table schemas and the minimum-column rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**kinds: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


TEXT, REAL, INTEGER = StringType(), DoubleType(), LongType()

MANIFEST = _struct(
    subject=TEXT, session=TEXT, task=TEXT, run=TEXT, filename=TEXT, path=TEXT
)
INTERVALS = _struct(onset_sec=REAL, duration_sec=REAL, end_sec=REAL, event_type=TEXT)
SEGMENTS = _struct(
    subject=TEXT,
    session=TEXT,
    run=TEXT,
    path=TEXT,
    recording_duration_sec=REAL,
    start_sec=REAL,
    end_sec=REAL,
    window_size_sec=REAL,
    stride_sec=REAL,
    overlap_ratio=REAL,
    label=INTEGER,
)
SUBJECT_SUMMARY = _struct(
    subject=TEXT,
    n_segments=INTEGER,
    n_positive=INTEGER,
    n_negative=INTEGER,
    positive_ratio=REAL,
    n_recordings=INTEGER,
    has_positive=BooleanType(),
    positive_share_overall=REAL,
    segment_share_overall=REAL,
)

SEGMENT_KEYS = ("subject", "session", "run", "path", "start_sec", "end_sec", "label")
SORT_KEYS = ("subject", "path", "start_sec")


def require_columns(
    df: DataFrame, columns: Iterable[str], error: type[Exception], what: str
) -> DataFrame:
    """Check a minimum column set at plan-build time; extra columns pass."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise error(f"Missing required columns in {what}: {missing}")
    return df
