"""The driver's tables read as recordings, annotations and signals.

The tables hold no recordings, so the registered queries derive them:

* ``events``: a user is a recording of 30 days, an ``error`` event is a seizure
  whose ``value`` gives its length in minutes, cut at the user's next error.
* ``embeddings``: a vector is one second of one channel at 64 Hz.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspan.session import shared_dir
from sigspan.sources.tables import path_exists

RECORDING_SEC = 30 * 86400.0
EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
SLOT_SEC = 600
SFREQ = 64.0
_written: dict[tuple[str | None, ...], tuple[list, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of each file of a stored table: others, once it is another table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


def written_once(
    spark: SparkSession, sf_dir: str, source: str, name: str, write: Callable[[str], None], ending: str = ""
) -> str:
    """The folder that ``write`` fills from the table ``source``, once per session.

    It is written again where the folder is gone, the table has other files, or the
    session's shared folder is another.
    """
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf_dir, name)
    state = _files_of(spark, f"{sf_dir}/{source}.parquet")
    held, path = _written.get(key, (None, ""))
    if held != state or not path_exists(spark, path):
        path = shared_dir(spark, name) + ending
        write(path)
        _written[key] = state, path
    return path


def onset_sec() -> Column:
    """Seconds since the start of the recording."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col("ts").cast("timestamp_ntz")) / 1e6


def recording_path(user: Column) -> Column:
    """A file name in the expected scheme for a user's recording."""
    subject = F.concat(F.lit("sub-"), user.cast("string"))
    return F.concat(
        F.lit("/rec/"), subject, F.lit("/ses-01/eeg/"), subject,
        F.lit("_ses-01_task-monitor_run-00_eeg.edf"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("sub-"), F.col("user_id").cast("string")).alias("subject"),
        F.lit("ses-01").alias("session"),
        F.lit("00").alias("run"),
        recording_path(F.col("user_id")).alias("path"),
        F.lit(RECORDING_SEC).alias("recording_duration_sec"),
    )


def next_in_slots(df: DataFrame, key: str, order: str, slot_sec: int, name: str) -> DataFrame:
    """The following value of ``order`` within ``key``, without one task per key.

    A plain ``lead`` over the key would sort a hot key in a single task. Time
    slots split it: inside a slot ``lead`` finds the successor; the last row of
    a slot takes the first value of the next non-empty slot. Those firsts are
    pre-aggregated, at most one row per slot of a recording.
    """
    slotted = df.withColumn("_slot", F.floor(F.col(order) / slot_sec))
    firsts = slotted.groupBy(key, "_slot").agg(F.min(order).alias("_first"))
    following = firsts.select(
        key,
        "_slot",
        F.lead("_first").over(Window.partitionBy(key).orderBy("_slot")).alias("_next_slot_first"),
    )
    within = Window.partitionBy(key, "_slot").orderBy(order)
    return (
        slotted.withColumn("_in_slot", F.lead(order).over(within))
        .join(following, [key, "_slot"], "left")
        .withColumn(name, F.coalesce("_in_slot", "_next_slot_first"))
        .drop("_slot", "_in_slot", "_next_slot_first")
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the annotation layout: onset, duration, eventType, plus path."""
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", onset_sec().alias("onset")
    )
    errors = next_in_slots(
        events.where(F.col("event_type") == "error"), "user_id", "onset", SLOT_SEC, "next_onset"
    )
    end = F.least(F.col("onset") + F.col("value") * 60, F.col("next_onset"))
    return errors.select(
        recording_path(F.col("user_id")).alias("path"),
        "onset",
        (end - F.col("onset")).alias("duration"),
        F.lit(" SZ_error\t").alias("eventType"),
        end.alias("end"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seizure intervals that do not overlap within a recording."""
    return annotations(spark, sf_dir).select(
        "path",
        F.col("onset").alias("onset_sec"),
        F.col("duration").alias("duration_sec"),
        F.col("end").alias("end_sec"),
    )
