"""Quality checks of segments and features tables: one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from sigspan.operators.quantiles import describe
from sigspan.schemas import SEGMENT_KEYS


def value_counts(df: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """Rows per value, nulls included, most frequent first."""
    value = F.col(column) if isinstance(column, str) else column
    return (
        df.groupBy(value.alias(name))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last(name))
    )


def summary_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column."""
    return describe(df, columns, {0.25: "p25", 0.5: "p50", 0.75: "p75"}, sample_std=True)


def _missing(df: DataFrame, column: str) -> Column:
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of missing values (null or NaN)."""
    counts = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    return _unpivot(counts, df.columns, "n_missing")


def _unpivot(one_row: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in columns])
    return one_row.select(F.inline(pairs))


def first_places(df: DataFrame, column: str, order: Column, name: str = "first") -> DataFrame:
    """Distinct values with the place of their first row; pre-aggregated where the rows are."""
    return df.groupBy(column).agg(F.min(order).alias(name))


def unique_values(df: DataFrame, column: str, order: Column | None = None) -> DataFrame:
    """Distinct values, with an order of rows by first appearance; only the values are sorted."""
    if order is None:
        return df.select(column).distinct()
    return first_places(df, column, order).orderBy("first").select(column)


def n_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column."""
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SEGMENT_KEYS]


def non_numeric_features(df: DataFrame) -> list[str]:
    return [
        c for c in feature_columns(df) if not isinstance(df.schema[c].dataType, NumericType)
    ]


def negative_power(df: DataFrame) -> DataFrame:
    """One row per band-power column: does it hold any negative value?"""
    columns = [c for c in feature_columns(df) if "power_" in c]
    found = df.agg(
        *[F.coalesce(F.bool_or(F.col(c) < 0), F.lit(False)).alias(c) for c in columns]
    )
    return _unpivot(found, columns, "has_negative")
