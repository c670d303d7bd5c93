"""Expressions over annotation fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspan.errors import EventsFileError, fail

# Field texts that count as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# White space as Unicode defines it, plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = (
    rf"(?U)^{_SPACE}*([+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    rf"|(?i:inf|infinity|nan))){_SPACE}*$"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def null_if_na(text: Column) -> Column:
    return F.when(~text.isin(*NA_TOKENS), text)


def normalize_event_type(text: Column) -> Column:
    """Missing becomes the empty string; the rest is stripped and lower-cased."""
    return F.lower(strip(F.coalesce(null_if_na(text), F.lit(""))))


def is_seizure_event_type(event_type: Column) -> Column:
    """Codes that start with ``sz``; background (``bckg``) does not."""
    return event_type.startswith("sz")


def coerce_non_negative(value: Column, field: str, missing: str = "open") -> Column:
    """Text or number to a non-negative double.

    A missing value becomes null, which later reads as an open bound;
    ``missing='error'`` rejects it instead. NaN also counts as missing.
    """
    none = F.lit(None).cast("double")
    absent = fail(EventsFileError, f"Missing value for '{field}'") if missing == "error" else none

    def parsed(text: Column) -> Column:
        return let(
            F.regexp_extract(text, _NUMBER, 1),
            lambda number: F.when(
                number == "", fail(EventsFileError, f"Not a number in '{field}': ", text)
            ).otherwise(F.replace(number, F.lit("_"), F.lit("")).try_cast("double")),
        )

    def checked(number: Column) -> Column:
        return (
            F.when(F.isnan(number), absent)
            .when(number < 0, fail(EventsFileError, f"Negative '{field}': ", number))
            .otherwise(number)
        )

    text = null_if_na(value.cast("string"))
    return F.when(text.isNull(), absent).otherwise(let(parsed(text), checked))
