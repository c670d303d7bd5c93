"""Indexing recordings from their file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspan.errors import DatasetBuilderError
from sigspan.functions.bids import EEG_SUFFIX, basename, entities, filename_fields, name_parts, plain_path
from sigspan.schemas import MANIFEST, require_columns
from sigspan.sources.tables import existing


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths below ``root`` whose name matches; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(plain_path(F.col("path"), encoded=False).alias("path"))
    )


def list_recordings(spark: SparkSession, root: str) -> DataFrame:
    return list_files(spark, root, f"*{EEG_SUFFIX}")


def with_filename_fields(paths: DataFrame) -> DataFrame:
    """Paths to manifest rows."""
    path = F.col("path")
    # The parts are used several times, so Spark keeps them as a column.
    return (
        paths.select(path, name_parts(path).alias("parts"))
        .select(*filename_fields(F.col("parts")), basename(path).alias("filename"), path)
        .select(*MANIFEST.fieldNames())
    )


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    return with_filename_fields(list_recordings(spark, root)).orderBy("path")


def recording_entities(spark: SparkSession, root: str) -> DataFrame:
    """All name entities of every recording, as a map."""
    return list_recordings(spark, root).select("path", entities(F.col("path")).alias("entities"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(existing(spark, path, FileNotFoundError, "Manifest not found"))
    return require_columns(df, ("subject", "path"), DatasetBuilderError, "manifest")
