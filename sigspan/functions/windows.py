"""Window grid and overlap arithmetic.

Windows are numbered k = 0, 1, ... per recording, so that every operator can
refer to a window by an integer instead of comparing floating-point bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspan.errors import SegmentationError, fail
from sigspan.functions.labeling import check_threshold

# Overlap sums arrive in no fixed order on a cluster. This forgives rounding
# only; a window that is counted twice exceeds it by far.
ROUNDING_SLACK = 1e-9
LONGEST = 2.0**1000  #: seconds; no window begins later


@dataclass(frozen=True)
class WindowSpec:
    """Window and label parameters, checked once on the driver."""

    window_size_sec: float = 5.0
    stride_sec: float = 5.0
    positive_overlap_threshold: float = 0.5
    drop_partial_overlap: bool = True

    def __post_init__(self) -> None:
        for name in ("window_size_sec", "stride_sec"):
            if getattr(self, name) <= 0:
                raise SegmentationError(f"'{name}' must be > 0. Received: {getattr(self, name)}")
        check_threshold(self.positive_overlap_threshold)

    @property
    def exact_grid(self) -> bool:
        """True when k * stride is exact, so that repeated addition equals it."""
        return float(self.stride_sec * 2**16).is_integer()


def accumulated_pieces(stride: float) -> list[tuple[int, float, float]]:
    """(k, start, step): what adding the stride again and again gives, as linear pieces.

    Within one binade every sum is a multiple of the same unit, so each addition
    rounds the stride to the same step, but for the first one where the stride lies
    just between two multiples: it makes the sum even. From k on, start + (k' - k) *
    step is exact until the next piece. Some sixty binades later the stride is too
    small to change the sum.
    """
    pieces, k, start = [(0, 0.0, 0.0)], 0, 0.0
    while True:
        k, start = k + 1, start + stride
        after = start + stride
        if after == start or start >= LONGEST:
            return [*pieces, (k, start, 0.0)]
        top = math.ldexp(1.0, math.frexp(start)[1])  # where the binade ends
        step = after - start
        if after >= top or after + stride < top and after + stride - after != step:
            pieces.append((k, start, 0.0))
            continue
        pieces.append((k, start, step))
        n = int((top - start) / step)
        n -= start + n * step >= top
        k, start = k + n, start + n * step


def _accumulated_start(k: Column, stride: float) -> Column:
    """Start of window k under repeated addition: a search for its piece, then one product."""
    pieces = accumulated_pieces(stride)

    def among(low: int, high: int) -> Column:
        if high - low == 1:
            first, start, step = pieces[low]
            return F.lit(start) + (k - F.lit(first).cast("bigint")) * F.lit(step)
        middle = (low + high) // 2
        return F.when(k < F.lit(pieces[middle][0]).cast("bigint"), among(low, middle)).otherwise(among(middle, high))

    return among(0, len(pieces))


def window_start(k: Column, spec: WindowSpec) -> Column:
    """Start of window k.

    Strides such as 5.0 or 0.25 need one multiplication. For others (0.1) the
    repeated addition drifts away from k * stride, and the drifted value is the
    one to reproduce.
    """
    if spec.exact_grid:
        return k * F.lit(float(spec.stride_sec))
    return _accumulated_start(k, float(spec.stride_sec))


def checked_duration(duration: Column) -> Column:
    """A recording duration that is present, finite and not negative."""
    return (
        F.when(duration.isNull(), fail(SegmentationError, "Recording duration is missing"))
        .when(
            (duration < 0) | (duration == float("inf")),
            fail(SegmentationError, "'recording_duration_sec' must be >= 0. Received: ", duration),
        )
        .otherwise(duration)
    )


def window_count(duration: Column, spec: WindowSpec) -> Column:
    """An upper bound, at most two too high, on the complete windows.

    The caller filters on ``start + window <= duration``, which decides.
    """
    size, stride = float(spec.window_size_sec), float(spec.stride_sec)
    return F.when(F.isnan(duration) | (duration < size), F.lit(0).cast("bigint")).otherwise(
        F.floor((duration - size) / stride).cast("bigint") + 2
    )


def shared_seconds(
    window_start: Column, window_end: Column, onset: Column, end: Column
) -> Column:
    """Seconds shared by a window and one interval.

    A null interval bound is open: ``greatest``/``least`` skip nulls. Rows that
    matched no interval must therefore be handled by the caller.
    """
    return F.greatest(F.lit(0.0), F.least(window_end, end) - F.greatest(window_start, onset))


def ordered_end(onset: Column, end: Column, what: str = "interval") -> Column:
    """The end of a window or interval, checked not to lie before its start."""
    return F.when(
        end < onset, fail(SegmentationError, f"Reversed {what}: ", onset, " > ", end)
    ).otherwise(end)


def overlap_seconds(
    window_start: Column, window_end: Column, onset: Column, end: Column
) -> Column:
    """``shared_seconds`` with both pairs of bounds checked."""
    return shared_seconds(
        window_start, ordered_end(window_start, window_end, "window"), onset, ordered_end(onset, end)
    )


def overlap_ratio(overlap: Column, duration: Column) -> Column:
    """Covered fraction; more coverage than the window holds is an error."""
    return (
        F.when(
            overlap < 0,
            fail(SegmentationError, "'overlap_seconds' must be >= 0. Received: ", overlap),
        )
        .when(
            overlap > duration * (1 + ROUNDING_SLACK),
            fail(SegmentationError, "Overlap exceeds the window: ", overlap, " > ", duration),
        )
        .otherwise(F.least(overlap, duration) / duration)
    )
