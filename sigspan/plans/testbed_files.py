"""A folder of EDF recordings and annotation files, written from ``embeddings``.

The file readers need files, and the driver supplies tables. So the vectors are
stored as recordings: 40 vectors make one recording of 4 channels and up to 10
seconds, and the label of a second's first channel decides its annotation. The
folder grows with the table and is written by Spark tasks.

A recording need not be whole: the last one ends where the table does, and ids may
be missing. A channel without any vector is in the header and has no samples. A data
record holds all channels that have some, so where a channel lacks a single second,
or its vector is null, that second is silent; so are components that are no numbers.
A second has 64 samples, the first 64 components of its vector, and is silent where
these end before. A vector without an id has no place in any recording. Numbers are
rounded down, so ids below 0 fill recordings below 0. A table without vectors is a
folder without recordings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspan.plans.testbed import SFREQ, table, written_once
from sigspan.sources.remote import create_file, file_system

CHANNELS = 4
SECONDS = 10
SEIZURE_LABELS = 3
STEPS = 65535
NOTED = 1000  #: events in an annotation file with notes


def _edf(signal: np.ndarray, recorded: np.ndarray) -> bytes:
    """One-second data records of the recorded channels; physical range -1 to 1 V over all 16-bit steps."""
    n, seconds = len(signal), signal.shape[1]

    def text(value: object, width: int) -> bytes:
        return str(value).ljust(width).encode("ascii")

    sizes = (8, 80, 80, 8, 8, 8, 44, 8, 8, 4)
    values = ("0", "", "", "01.01.24", "00.00.00", 256 * (n + 1), "", seconds, 1, n)
    head = b"".join(map(text, values, sizes))
    columns = [
        ([f"EEG {i}" for i in range(n)], 16), ([""] * n, 80), (["V"] * n, 8), ([-1] * n, 8),
        ([1] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80),
        (np.where(recorded, int(SFREQ), 0), 8), ([""] * n, 32),
    ]
    head += b"".join(text(v, width) for column, width in columns for v in column)
    signal = np.where(np.isnan(signal), 0.0, signal)[recorded]
    digital = np.clip(np.rint((signal + 1) * (STEPS / 2) - 32768), -32768, 32767)
    return head + np.swapaxes(digital, 0, 1).astype("<i2").tobytes()


def _tsv(seconds: np.ndarray, seizure: np.ndarray, reordered: bool) -> str:
    """One annotation for each of these seconds, in one of two column orders."""
    kinds = [(i, "sz_foc_a" if s else "bckg") for i, s in zip(seconds, seizure)]
    if reordered:
        lines = [f"1.0\t{k}\tall\t{i}" for i, k in kinds]
        return "\n".join(["duration\teventType\tchannels\tonset", *lines, ""])
    lines = [f"{i}\t1.0\t{k}" for i, k in kinds]
    return "\n".join(["onset\tduration\teventType ", *lines, ""])


def _writer(root: str):
    def write(vectors: pd.DataFrame) -> pd.DataFrame:
        """Both files of one recording; its size is fixed by construction."""
        number = int(vectors["recording"].iloc[0])
        vectors = vectors.sort_values(["second", "channel"])
        signal = np.zeros((CHANNELS, int(vectors["second"].max()) + 1, int(SFREQ)))
        for channel, second, samples in zip(vectors["channel"], vectors["second"], vectors["embedding"]):
            if samples is not None:
                samples = samples[: int(SFREQ)]
                signal[channel, second, : len(samples)] = samples
        recorded = np.isin(np.arange(CHANNELS), vectors["channel"])
        first = vectors.loc[vectors["channel"] == 0]
        seizure = (first["label"] < SEIZURE_LABELS).to_numpy()
        subject = f"sub-{number % 5:02d}"
        name = f"{root}/{subject}/ses-01/eeg/{subject}_ses-01_task-monitor_run-{number:04d}"
        for ending, data in (
            ("_eeg.edf", _edf(signal, recorded)),
            ("_events.tsv", _tsv(first["second"].to_numpy(), seizure, number % 2 == 1).encode()),
        ):
            with create_file(name + ending) as out:
                out.write(data)
        return pd.DataFrame({"name": [name]})

    return write


def _quotient(number: Column, by: int) -> Column:
    """Rounded down, and exact where a double is not."""
    below = (F.pmod(number, F.lit(by)) != number % by).cast("bigint")
    return F.call_function("div", number, F.lit(by)) - below


def channel_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its place in a recording."""
    number = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").where(number.isNotNull()).select(
        _quotient(number, CHANNELS * SECONDS).alias("recording"),
        F.pmod(_quotient(number, CHANNELS), F.lit(SECONDS)).alias("second"),
        F.pmod(number, F.lit(CHANNELS)).alias("channel"),
        "embedding",
        "label",
    )


def recording_tree(spark: SparkSession, sf_dir: str) -> str:
    """Write the folder once per session and table; return its path."""

    def write(root: str) -> None:
        system, folder = file_system(root)
        system.create_dir(folder, recursive=True)
        names = (
            channel_seconds(spark, sf_dir)
            .groupBy("recording")
            .applyInPandas(_writer(root), "name string")
        )
        names.write.format("noop").mode("overwrite").save()

    return written_once(spark, sf_dir, "embeddings", "recordings", write)


def _note_writer(root: str):
    def write(events: pd.DataFrame) -> pd.DataFrame:
        """One file of NOTED events: notes with line ends, tabs and quotes, and onsets that repeat."""
        number = int(events["number"].iloc[0])
        end = "\r\n" if number % 2 else "\n"
        lines = ["onset\tnote\tduration\teventType"]
        for e in events.sort_values("event_id").itertuples():
            note = (f'"line {e.event_id}{end}\t""{e.event_type}"" {end}"', f'in"side {e.event_id}', '""')[e.event_id % 3]
            kind = {"error": '"sz_a"', "click": "sz_b"}.get(e.event_type, "bckg")
            lines.append(f"{e.event_id * 7 % 250}\t{note}\t{e.value!r}\t{kind}")
        name = f"{root}/log-{number:06d}_events.tsv"
        with create_file(name) as out:
            out.write(end.join([*lines, ""]).encode())
        return pd.DataFrame({"name": [name]})

    return write


def noted_annotations(spark: SparkSession, sf_dir: str) -> str:
    """A folder of annotation files with quoted notes, written from ``events``."""

    def write(root: str) -> None:
        events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
        numbered = events.withColumn("number", F.floor(F.col("event_id") / NOTED))
        names = numbered.groupBy("number").applyInPandas(_note_writer(root), "name string")
        names.write.format("noop").mode("overwrite").save()

    return written_once(spark, sf_dir, "events", "notes", write)


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stored table of several files, in order of their ids."""

    def write(path: str) -> None:
        events = table(spark, sf_dir, "events").repartitionByRange(8, "event_id").sortWithinPartitions("event_id")
        events.write.parquet(path)

    return spark.read.parquet(written_once(spark, sf_dir, "events", "events", write))
