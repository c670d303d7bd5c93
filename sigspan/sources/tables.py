"""Reading stored tables with their minimum-column checks."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspan.errors import DatasetInspectionError, FeatureDatasetBuilderError
from sigspan.schemas import SEGMENT_KEYS, require_columns


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on whichever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def existing(spark: SparkSession, path: str, error: type[Exception], message: str) -> str:
    if not path_exists(spark, path):
        raise error(f"{message}: {path}")
    return path


def file_order() -> Column:
    """The place of a row in a stored Parquet table: its file, and its number there.

    Works on a table as it is loaded, before anything else is done to it.
    """
    return F.struct("_metadata.file_path", "_metadata.row_index")


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a loaded Parquet table, in the order of its files.

    Files are opened from the first one on until they hold n rows; a plain limit takes
    rows from whichever file is scanned first.
    """
    files = sorted(unquote(f) for f in df.inputFiles())
    taken = 1
    while files:
        first = df.sparkSession.read.schema(df.schema).parquet(*files[:taken])
        if taken >= len(files) or first.limit(n).count() >= n:
            rows = first.withColumn("_place", file_order()).orderBy("_place").limit(n)
            return rows.drop("_place")
        taken *= 2
    return df.limit(0)


def load_segments(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(
        existing(spark, path, FileNotFoundError, "No segments table at")
    )
    return require_columns(df, SEGMENT_KEYS, FeatureDatasetBuilderError, "segments.parquet")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix; an empty table is an error."""
    existing(spark, path, DatasetInspectionError, "No table at")
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = name[name.rfind(".") :].lower() if "." in name else ""
    if kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind == ".csv":
        df = spark.read.csv(path, header=True, inferSchema=True)
    else:
        raise DatasetInspectionError(f"Neither Parquet nor CSV: {kind}")
    if df.isEmpty():
        raise DatasetInspectionError("The table has no rows.")
    return df
