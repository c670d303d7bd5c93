"""One ``ValueError`` subclass per stage, and the bridge from executor failures.

Checks that depend on row values run inside the plan (``fail``), so that they
cost no extra pass over the data. Spark reports them as its own runtime error;
``stage_errors`` turns that back into the class named in the message.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException, PySparkException, PythonException
from pyspark.sql import Column
from pyspark.sql import functions as F


class EventsFileError(ValueError):
    """An annotation file is unreadable or holds invalid times."""


class SegmentationError(ValueError):
    """Window parameters, bounds or overlaps are invalid."""


class LabelingError(ValueError):
    """An overlap ratio or a threshold is out of range."""


class DatasetBuilderError(ValueError):
    """A segments table cannot be built."""


class FeatureComputationError(ValueError):
    """A time-domain feature cannot be computed."""


class FrequencyFeatureError(ValueError):
    """A frequency-domain feature cannot be computed."""


class FeatureExtractionError(ValueError):
    """A multichannel signal has the wrong shape or channel names."""


class FeatureDatasetBuilderError(ValueError):
    """A features table cannot be built."""


class DatasetInspectionError(ValueError):
    """A table cannot be audited."""


STAGE_ERRORS: dict[str, type[Exception]] = {
    cls.__name__: cls
    for cls in (
        EventsFileError,
        SegmentationError,
        LabelingError,
        DatasetBuilderError,
        FeatureComputationError,
        FrequencyFeatureError,
        FeatureExtractionError,
        FeatureDatasetBuilderError,
        DatasetInspectionError,
        FileNotFoundError,
    )
}
_TAGGED = re.compile(rf"\b({'|'.join(STAGE_ERRORS)}): ([^\n]*)")


def fail(error: type[Exception], *message: str | Column) -> Column:
    """An expression that aborts the job with ``error`` when it is evaluated."""
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    parts = [F.coalesce(p, F.lit("NULL")) for p in parts]
    return F.raise_error(F.concat(F.lit(f"{error.__name__}: "), *parts))


@contextmanager
def stage_errors() -> Iterator[None]:
    """Re-raise tagged executor failures as the stage's own class."""
    try:
        yield
    except AnalysisException:
        # Its text quotes the plan, messages of unreached checks included.
        raise
    except PySparkException as exc:
        tagged = _TAGGED.findall(str(exc))
        if not tagged:
            raise
        # A worker's traceback names the cause first and the raised error last.
        name, message = tagged[-1 if isinstance(exc, PythonException) else 0]
        raise STAGE_ERRORS[name](message) from exc
