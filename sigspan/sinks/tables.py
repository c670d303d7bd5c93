"""Writing result tables. Parquet outputs are folders, as Spark writes them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigspan.errors import stage_errors
from sigspan.operators.ranks import numbered
from sigspan.session import shuffle_partitions
from sigspan.sinks.staged import FILE, RANGE, remove, write_files
from sigspan.sources.remote import file_system


def save_parquet(df: DataFrame, path: str) -> None:
    with stage_errors():
        df.write.mode("overwrite").parquet(path)


save_segments_dataset = save_parquet
save_features_dataset = save_parquet


def part_name(number: Column) -> Column:
    """`features_part_0000.parquet` and on; more digits where four are too few."""
    digits = F.greatest(F.lit(4), F.length(number.cast("string")))
    return F.concat(F.lit("features_part_"), F.lpad(number.cast("string"), digits, F.lit("0")), F.lit(".parquet"))


def recording_numbers(features: DataFrame) -> DataFrame:
    """path -> number, its 0-based rank among all recordings' paths."""
    return numbered(features.select("path").distinct(), [F.col("path")], "number")


def save_feature_parts(features: DataFrame, folder: str) -> None:
    """One file per recording, numbered by the rank of its path, rows by start.

    Rows are range-partitioned by recording and start, so a long recording is written
    by several tasks; its pieces are joined by row groups, and all files appear at once.
    """
    columns = features.columns
    order = [F.col("number"), F.col("start_sec").asc_nulls_last()]
    with stage_errors():
        placed = features.join(recording_numbers(features).withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"))
        placed = placed.repartitionByRange(shuffle_partitions(features.sparkSession), *order).sortWithinPartitions(*order)
        rows = placed.select(*columns, part_name(F.col("number")).alias(FILE), F.spark_partition_id().alias(RANGE))
        write_files(rows, folder)


def load_feature_parts(
    spark: SparkSession, folder: str, path: str | None = None, schema: StructType | None = None
) -> DataFrame:
    """All features, or those of one recording; row-group statistics keep the other files closed to it.

    Features without rows leave a folder without files, which has no columns but those of ``schema``.
    """
    parts = (spark.read.schema(schema) if schema else spark.read).parquet(folder)
    return parts if path is None else parts.where(F.col("path") == path)


def save_csv(df: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """One CSV file with a header, rows in the given order, or in that of df's partitions.

    Tasks write sorted pieces in parallel; one task joins their bytes as a stream.
    """
    columns, head = df.columns, ",".join(_quoted(c) for c in df.columns) + "\n"
    if order:
        df = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    name = path.rstrip("/").rsplit("/", 1)[1]
    rows = df.select(*columns, F.lit(name).alias(FILE), F.spark_partition_id().alias(RANGE))
    folder = f"{path.rstrip('/')}.new"
    with stage_errors():
        write_files(rows, folder, "csv", head.encode())
    system, made = file_system(f"{folder}/{name}")
    final = file_system(path)[1]
    if system.get_file_info(made).type == pafs.FileType.NotFound:  # a table without rows
        with system.open_output_stream(made, compression=None) as out:
            out.write(head.encode())
    if system.get_file_info(final).type == pafs.FileType.Directory:
        system.delete_dir(final)
    system.move(made, final)
    remove(folder)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\n\r') else name
