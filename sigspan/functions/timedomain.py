"""Time-domain kernels over array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspan.errors import FeatureComputationError, fail
from sigspan.functions.events import let


def checked_signal(signal: Column, error: type[Exception] = FeatureComputationError) -> Column:
    """The samples as doubles; null or empty signals and missing samples abort the job."""
    return (
        F.when(F.size(F.coalesce(signal, F.array())) == 0, fail(error, "A signal has no samples."))
        .when(F.exists(signal, lambda v: v.isNull()), fail(error, "A signal has a missing sample."))
        .otherwise(signal.cast("array<double>"))
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def compute_mean(signal: Column) -> Column:
    return let(checked_signal(signal), _mean)


def compute_std(signal: Column) -> Column:
    """Population standard deviation, in two passes over the array."""

    def spread(x: Column, mean: Column) -> Column:
        squares = F.aggregate(x, F.lit(0.0), lambda total, v: total + (v - mean) * (v - mean))
        return F.sqrt(squares / F.size(x))

    # The signal is checked once, and the mean computed once per signal.
    return let(checked_signal(signal), lambda x: let(_mean(x), lambda mean: spread(x, mean)))


def compute_rms(signal: Column) -> Column:
    def rms(x: Column) -> Column:
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda total, v: total + v * v) / F.size(x))

    return let(checked_signal(signal), rms)


def compute_line_length(signal: Column) -> Column:
    """Sum of absolute steps; 0 for a single sample."""

    def length(x: Column) -> Column:
        steps = F.zip_with(
            F.slice(x, F.lit(2), F.size(x)),
            F.slice(x, F.lit(1), F.size(x) - 1),
            lambda later, earlier: F.abs(later - earlier),
        )
        return F.aggregate(steps, F.lit(0.0), lambda total, v: total + v)

    return let(checked_signal(signal), length)


TIME_FEATURES = {
    "mean": compute_mean,
    "std": compute_std,
    "rms": compute_rms,
    "line_length": compute_line_length,
}
