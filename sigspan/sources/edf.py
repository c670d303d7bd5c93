"""European Data Format recordings (Kemp et al. 1992) as a Spark data source.

``edf_header``: one row per file, from the header bytes alone.
``edf``: one row per run of data records and channel, with physical samples.
Files are cut into byte ranges, so a long recording is read by many tasks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sigspan.session import shuffle_partitions
from sigspan.sources.remote import find_files, open_file

FIXED_BYTES = 256
SIGNAL_BYTES = 256
SPLIT_BYTES = 32 << 20
ANNOTATION_LABELS = ("EDF Annotations", "BDF Annotations")
# Factors from the physical unit to volts.
UNIT_SCALE = {"uV": 1e-6, "µV": 1e-6, "mV": 1e-3}

HEADER_SCHEMA = (
    "path string, n_channels int, sfreq double, n_records bigint, record_sec double, "
    "n_samples bigint, duration_sec double, channel_names array<string>"
)
SAMPLES_SCHEMA = (
    "path string, channel int, channel_name string, sfreq double, start_sec double, "
    "samples array<double>"
)


@dataclass(frozen=True)
class EdfHeader:
    """What is needed to find and scale samples."""

    path: str
    header_bytes: int
    record_bytes: int
    n_records: int
    record_sec: float
    samples_per_record: int
    names: tuple[str, ...]
    columns: tuple[int, ...]
    counts: tuple[int, ...]
    gain: tuple[float, ...]
    offset: tuple[float, ...]

    @property
    def sfreq(self) -> float:
        return self.samples_per_record / self.record_sec

    @property
    def sampled(self) -> list[int]:
        """The channels that have samples; others are named in the header only."""
        return [channel for channel, count in enumerate(self.counts) if count]

    @property
    def n_samples(self) -> int:
        return self.n_records * self.samples_per_record

    @property
    def duration_sec(self) -> float:
        return self.n_samples / self.sfreq

    def row(self) -> tuple:
        return (
            self.path, len(self.names), self.sfreq, self.n_records, self.record_sec,
            self.n_samples, self.duration_sec, list(self.names),
        )


def parse_header(source, path: str) -> EdfHeader:
    """Read the fixed and per-signal header fields.

    Recordings with gaps (EDF+D) have no single sample grid and are refused.
    Where channels differ in rate, the highest one is the recording's rate, and
    slower channels hold each sample until their next one. A channel without samples
    has no rows and no features.
    """
    fixed = source.read(FIXED_BYTES)
    n_signals = int(fixed[252:256])
    record_sec = float(fixed[244:252])
    if fixed[192:197] == b"EDF+D":
        raise ValueError("discontinuous recording")
    if fixed[:1] == b"\xff" or record_sec <= 0 or n_signals < 1:
        raise ValueError("not a 16-bit recording with timed data records")
    header_bytes = FIXED_BYTES + SIGNAL_BYTES * n_signals
    table = source.read(header_bytes - FIXED_BYTES)

    def field(start: int, width: int) -> list[str]:
        begin = start * n_signals
        return [
            table[begin + i * width : begin + (i + 1) * width].decode("latin-1").strip()
            for i in range(n_signals)
        ]

    labels, units = field(0, 16), field(96, 8)
    physical = np.array([field(104, 8), field(112, 8)], dtype=float)
    digital = np.array([field(120, 8), field(128, 8)], dtype=float)
    counts = [int(v) for v in field(216, 8)]
    kept = [i for i, label in enumerate(labels) if label not in ANNOTATION_LABELS]
    if not any(counts[i] for i in kept) or min(counts) < 0:
        raise ValueError("no channel with samples")
    scale = np.array([UNIT_SCALE.get(u, 1.0) for u in units])
    gain = (physical[1] - physical[0]) / (digital[1] - digital[0])
    offset = (physical[0] - gain * digital[0]) * scale
    gain = gain * scale
    starts = np.concatenate([[0], np.cumsum(counts)])
    record_bytes = 2 * int(starts[-1])
    return EdfHeader(
        path=path,
        header_bytes=header_bytes,
        record_bytes=record_bytes,
        # The stored count is -1 while recording, so the file size decides.
        n_records=(source.size() - header_bytes) // record_bytes,
        record_sec=record_sec,
        samples_per_record=max(counts[i] for i in kept),
        names=tuple(labels[i] for i in kept),
        columns=tuple(int(starts[i]) for i in kept),
        counts=tuple(counts[i] for i in kept),
        gain=tuple(gain[kept].tolist()),
        offset=tuple(offset[kept].tolist()),
    )


def read_header(path: str, error: type[Exception]) -> EdfHeader:
    try:
        with open_file(path) as source:
            return parse_header(source, path)
    except Exception as exc:
        raise error(f"Could not read EEG file: {path} ({exc})") from exc


def read_records(
    source, header: EdfHeader, first: int, last: int, channels: list[int] | None = None
) -> np.ndarray:
    """Physical samples of data records [first, last), shape (channels, samples).

    ``channels`` have samples; without them, all that do.
    """
    source.seek(header.header_bytes + first * header.record_bytes)
    raw = source.read((last - first) * header.record_bytes)
    records = np.frombuffer(raw, dtype="<i2").reshape(last - first, -1)
    width = header.samples_per_record
    wanted = header.sampled if channels is None else channels
    picked = np.empty((len(wanted), (last - first) * width))
    for row, channel in enumerate(wanted):
        column, count = header.columns[channel], header.counts[channel]
        samples = records[:, column : column + count]
        if count != width:
            samples = samples[:, np.arange(width) * count // width]
        picked[row] = samples.reshape(-1) * header.gain[channel] + header.offset[channel]
    return picked


def _header_batches(error: type[Exception]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [
            pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.int64(),
            pa.float64(), pa.list_(pa.string()),
        ]
        names = [c.split(" ")[0] for c in HEADER_SCHEMA.split(", ")]
        for batch in batches:
            rows = [read_header(p, error).row() for p in batch.column("path").to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names
            )

    return read


def recording_headers(paths: DataFrame, error: type[Exception]) -> DataFrame:
    """Headers of the recordings in a ``path`` column, read on the executors."""
    spark = paths.sparkSession
    return (
        paths.select("path")
        .repartition(shuffle_partitions(spark), "path")
        .mapInArrow(_header_batches(error), HEADER_SCHEMA)
    )


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Ranges(InputPartition):
    """Byte ranges (path, first, last) that one task reads."""

    ranges: list[tuple[str, int, int]]


def _wanted(options) -> list[tuple[str, int]]:
    """The recordings a path option names: one file, or every EDF below a folder, or those of them that are asked for."""
    if not options.get("path"):
        raise ValueError("give the recording or folder with load(path)")
    found = find_files(options["path"], ".edf")
    if options.get("recordings") is None:
        return found
    asked = set(json.loads(options["recordings"]))
    return [(path, size) for path, size in found if path in asked]


def plan_ranges(files: list[tuple[str, int]], limit: int) -> list[list[tuple[str, int, int]]]:
    """Cut long files and pack short ones, so that tasks read about ``limit`` bytes."""
    groups: list[list[tuple[str, int, int]]] = [[]]
    filled = 0
    for path, size in files:
        for at in range(0, size, limit):
            end = min(at + limit, size)
            if filled and filled + end - at > limit:
                groups.append([])
                filled = 0
            groups[-1].append((path, at, end))
            filled += end - at
    return groups


class _HeaderReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def partitions(self):
        paths = [path for path, _ in _wanted(self.options)]
        size = int(self.options.get("filesPerPartition", 64))
        return [_Files(paths[i : i + size]) for i in range(0, len(paths), size)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            yield read_header(path, ValueError).row()


class EdfHeaderSource(DataSource):
    """``spark.read.format("edf_header").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "edf_header"

    def schema(self) -> str:
        return HEADER_SCHEMA

    def reader(self, schema):
        return _HeaderReader(self.options)


class _SampleReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options
        self.channels = [int(c) for c in options.get("channels", "").split(",") if c.strip()]
        self.rows_sec = float(options.get("secondsPerRow", 60))
        self.start, self.end = float(options.get("startSec", 0)), float(options.get("endSec", "inf"))

    def partitions(self):
        """Planned from file sizes alone; the driver opens no recording."""
        limit = int(self.options.get("splitBytes", SPLIT_BYTES))
        return [_Ranges(group) for group in plan_ranges(_wanted(self.options), limit)]

    def read(self, partition):
        for path, begin, end in partition.ranges:
            header = read_header(path, ValueError)
            # A data record belongs to the range that holds its first byte.
            first, last = (
                min(max(0, -(-(at - header.header_bytes) // header.record_bytes)), header.n_records)
                for at in (begin, end)
            )
            # and is read if it overlaps the wanted time
            first = max(first, int(min(self.start / header.record_sec, header.n_records)))
            last = min(last, math.ceil(min(self.end / header.record_sec, header.n_records)))
            step = max(1, int(self.rows_sec / header.record_sec))
            channels = [c for c in header.sampled if not self.channels or c in self.channels]
            with open_file(path) as source:
                for at in range(first, last, step):
                    upto = min(at + step, last)
                    signal = read_records(source, header, at, upto, channels)
                    yield _sample_batch(header, at, channels, signal)


def _sample_batch(
    header: EdfHeader, record: int, channels: list[int], signal: np.ndarray
) -> pa.RecordBatch:
    n, width = signal.shape
    return pa.RecordBatch.from_arrays(
        [
            pa.array([header.path] * n, pa.string()),
            pa.array(channels, pa.int32()),
            pa.array([header.names[c] for c in channels], pa.string()),
            pa.array([header.sfreq] * n, pa.float64()),
            pa.array([record * header.record_sec] * n, pa.float64()),
            pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(signal.ravel())
            ),
        ],
        names=[c.split(" ")[0] for c in SAMPLES_SCHEMA.split(", ")],
    )


class EdfSource(DataSource):
    """``spark.read.format("edf").load(folder)``.

    Options: ``channels``, the numbers to decode, "0,3"; ``recordings``, a JSON list of
    paths; ``startSec`` and ``endSec``, of which whole data records are read. They are
    options and not pushed filters, since Spark keeps one reader per loaded table, so a
    filter of one query would hold for the next one: see ``read_samples``.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SAMPLES_SCHEMA

    def reader(self, schema):
        return _SampleReader(self.options)


def register(spark) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(EdfHeaderSource)
    spark.dataSource.register(EdfSource)


def read_samples(
    spark, root: str, recordings: list[str] | None = None, start_sec: float = 0.0, end_sec: float = float("inf"),
    channels: list[int] | None = None, rows_sec: float = 60.0,
) -> DataFrame:
    """Samples of some recordings, of a stretch of time and some channels: a table for this scan alone.

    Only the named files are opened, and of them only the data records that overlap
    the time; rows begin and end with data records.
    """
    if not 0 <= start_sec < end_sec:
        raise ValueError(f"no time from {start_sec} to {end_sec}")
    register(spark)
    reader = spark.read.format("edf").option("secondsPerRow", rows_sec)
    if recordings is not None:
        reader = reader.option("recordings", json.dumps(recordings))
    if channels is not None:
        reader = reader.option("channels", ",".join(map(str, channels)))
    return reader.option("startSec", start_sec).option("endSec", end_sec).load(root)
