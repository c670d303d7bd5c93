"""Annotation rows to event intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspan.errors import EventsFileError
from sigspan.functions.events import (
    coerce_non_negative,
    is_seizure_event_type,
    normalize_event_type,
)
from sigspan.schemas import require_columns

REQUIRED = ("onset", "duration", "eventType")


def validate_events_columns(events: DataFrame) -> DataFrame:
    return require_columns(events, REQUIRED, EventsFileError, "events.tsv")


def extract_seizure_intervals(
    events: DataFrame, keys: Sequence[str] = (), missing_bounds: str = "open"
) -> DataFrame:
    """Keep seizure rows and derive their bounds; a narrow transformation.

    Times are checked on seizure rows only. A missing onset leaves both bounds
    null, a missing duration the end: see ``coerce_non_negative``.
    """
    if missing_bounds not in ("open", "error"):
        raise EventsFileError(f"'missing_bounds' must be 'open' or 'error': {missing_bounds!r}")
    validate_events_columns(events)
    return (
        events.select(
            *keys, "onset", "duration", normalize_event_type(F.col("eventType")).alias("event_type")
        )
        .where(is_seizure_event_type(F.col("event_type")))
        .select(
            *keys,
            coerce_non_negative(F.col("onset"), "onset", missing_bounds).alias("onset_sec"),
            coerce_non_negative(F.col("duration"), "duration", missing_bounds).alias(
                "duration_sec"
            ),
            "event_type",
        )
        .select(
            *keys,
            "onset_sec",
            "duration_sec",
            (F.col("onset_sec") + F.col("duration_sec")).alias("end_sec"),
            "event_type",
        )
    )


def sort_intervals(intervals: DataFrame, key: str = "path") -> DataFrame:
    """By key and onset, for output; equal onsets in the order of their ``position``, if there is one.

    A sort across a cluster is not stable by itself; rows that carry their place in
    the file (``read_paths``) come out as a stable sort of the file leaves them.
    """
    place = ["position"] if "position" in intervals.columns else []
    return intervals.orderBy(key, F.col("onset_sec").asc_nulls_last(), *place)
