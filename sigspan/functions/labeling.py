"""The label policy as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspan.errors import LabelingError, fail


def check_threshold(threshold: float) -> None:
    if threshold <= 0 or threshold > 1:
        raise LabelingError(
            f"'positive_overlap_threshold' must be in (0, 1]. Received value: {threshold}"
        )


def assign_label(
    ratio: Column, positive_overlap_threshold: float = 0.5, drop_partial_overlap: bool = True
) -> Column:
    """Struct (label, keep, reason) for an overlap ratio in [0, 1]."""
    check_threshold(positive_overlap_threshold)

    def decision(label: int | None, keep: bool, reason: str) -> Column:
        return F.struct(
            F.lit(label).cast("bigint").alias("label"),
            F.lit(keep).alias("keep"),
            F.lit(reason).alias("reason"),
        )

    partial = (
        decision(None, False, "partial_overlap_dropped")
        if drop_partial_overlap
        else decision(0, True, "partial_overlap_assigned_negative")
    )
    # The range check wraps the value itself, so that pruning cannot remove it.
    checked = F.when((ratio >= 0) & (ratio <= 1), ratio).otherwise(
        fail(LabelingError, "'overlap_ratio' must be in [0, 1]. Received value: ", ratio)
    )
    return (
        F.when(
            checked >= positive_overlap_threshold,
            decision(1, True, "positive_overlap_threshold_reached"),
        )
        .when(ratio == 0, decision(0, True, "no_overlap"))
        .otherwise(partial)
    )
