"""Tab-separated annotation files, all at once, read on the executors.

Files may order their columns differently. One pass over the wanted paths reads
each header and finds the required columns; then every file is cut into byte
ranges and the ranges are read in parallel. Cells may be quoted and hold line ends:
of files with several ranges, a scan finds in which state each range begins
(`quoted_rows`). Paths, headers and rows stay on the executors, whatever the number
of files, folders or layouts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspan.errors import EventsFileError, fail
from sigspan.functions.bids import EVENTS_SUFFIX
from sigspan.operators.intervals import REQUIRED, extract_seizure_intervals, sort_intervals
from sigspan.session import shuffle_partitions
from sigspan.sources import quoted_rows as rows_of
from sigspan.sources.manifest import list_files
from sigspan.sources.remote import open_file
from sigspan.sources.tables import existing

HEADER_BYTES = 4096
RANGE_BYTES = 16 << 20
_HEADS = "path string, begin long, size long, columns array<int>, absent boolean, missing string"
_EVENTS = "path string, onset string, duration string, eventType string, position bigint"


def _head(path: str) -> tuple:
    """Where the rows begin, the size, and the places of the required columns."""
    try:
        source = open_file(path)
    except FileNotFoundError:
        return path, 0, 0, None, True, None
    with source:
        size, text, chunk = source.size(), b"", HEADER_BYTES
        while True:
            text += source.read(chunk)
            ends, _ = rows_of.scan(text, rows_of.START)
            starts = [0, *ends.tolist()]
            header = next((i for i, end in enumerate(ends) if not rows_of.blank(text[starts[i] : end])), None)
            if header is not None or len(text) == size:
                break
            chunk *= 2
    line, begin = (text[starts[header] : ends[header]], int(ends[header])) if header is not None else (text, size)
    if len(text) == size and rows_of.blank(text[begin:]):
        return path, size, size, None, False, None  # no rows: nothing to check
    names = [c.strip() for c in rows_of.cells(line.rstrip(b"\r\n"), "utf-8-sig")]
    missing = sorted(set(REQUIRED) - set(names))
    if missing:
        return path, begin, size, None, False, f"{missing} ({path})"
    return path, begin, size, [names.index(c) for c in REQUIRED], False, None


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.string())
    names = ["path", "begin", "size", "columns", "absent", "missing"]
    for batch in batches:
        rows = [_head(path) for path in batch.column("path").to_pylist()]
        columns = zip(*rows) if rows else ((),) * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to the state of the reader; a file's only range isn't looked through."""
    for batch in batches:
        found = []
        for ask in batch.select(["path", "start", "stop", "ranges"]).to_pylist():
            if ask["ranges"] == 1:
                found.append([])
                continue
            with open_file(ask["path"]) as source:
                source.seek(ask["start"])
                found.append(rows_of.transitions(source.read(ask["stop"] - ask["start"])))
        yield batch.drop_columns(["ranges"]).append_column("steps", pa.array(found, pa.list_(pa.int32())))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each range begins; a file's ranges follow each other."""
    path, state = None, rows_of.START
    for batch in batches:
        states = []
        for name, steps in zip(batch.column("path").to_pylist(), batch.column("steps").to_pylist()):
            if name != path:
                path, state = name, rows_of.START
            states.append(state)
            state = steps[state] if steps else state
        yield batch.drop_columns(["steps"]).append_column("state", pa.array(states, pa.int32()))


def _rows_from(path: str, start: int, stop: int, state: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, row) of the rows that begin in [start, stop), blank ones left out."""
    with open_file(path) as source:
        size = source.size()
        source.seek(start)
        data = source.read(stop - start)
        ends, now = rows_of.scan(data, state)
        ends = ends.tolist()
        at = 0 if state == rows_of.START else ends.pop(0) if ends else len(data)
        tail = []  # the rest of the last row
        while at < len(data) and now != rows_of.START and source.tell() < size:
            more = source.read(HEADER_BYTES)
            over, now = rows_of.scan(more, now)
            tail.append(more[: int(over[0])] if len(over) else more)
            if len(over):
                now = rows_of.START
    if now == rows_of.QUOTED and at < len(data):
        raise EventsFileError(f"a quoted cell is never closed ({path})")
    data += b"".join(tail)
    for end in [*ends, len(data)]:
        row = data[at:end]
        if not rows_of.blank(row):
            yield start + at, row.rstrip(b"\r\n")
        at = max(at, end)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ask in batch.to_pylist():
            found = list(_rows_from(ask["path"], ask["start"], ask["stop"], ask["state"]))
            cells = [rows_of.cells(row) for _, row in found]
            picked = [
                pa.array([(c[i] if i < len(c) else None) or None for c in cells], pa.string()) for i in ask["columns"]
            ]
            paths = pa.array([ask["path"]] * len(cells), pa.string())
            places = pa.array([at for at, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([paths, *picked, places], ["path", *REQUIRED, "position"])


def read_paths(paths: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """Rows of the annotation files in column ``path``.

    Columns: path, onset, duration, eventType, as text, and position, the byte at
    which the row begins. Header names are trimmed; other columns are ignored. A file
    that is absent fails the job; files without rows are not checked.
    """
    n, size = shuffle_partitions(paths.sparkSession), range_bytes or RANGE_BYTES
    heads = paths.select("path").distinct().repartition(n, "path").mapInArrow(_heads, _HEADS)
    known = (
        F.when(F.col("absent"), fail(FileNotFoundError, "no annotation file ", F.col("path")))
        .when(
            F.col("missing").isNotNull(),
            fail(EventsFileError, "annotation columns are missing: ", F.col("missing")),
        )
        .otherwise(F.col("begin") < F.col("size"))
    )
    starts = F.sequence("begin", F.col("size") - 1, F.lit(size).cast("bigint"))
    heads = heads.where(known).select("path", "size", "columns", starts.alias("starts"))
    stop = F.least(F.col("start") + size, "size").alias("stop")
    ranges = heads.select("path", "size", "columns", F.size("starts").alias("ranges"), F.explode("starts").alias("start"))
    ranges = ranges.select("path", "columns", "start", stop, "ranges").repartition(n, "path", "start")
    fields = "path string, columns array<int>, start bigint, stop bigint"
    ranges = ranges.mapInArrow(_transitions, f"{fields}, steps array<int>")
    # one short row for each range of a file passes one task
    ranges = ranges.repartition(n, "path").sortWithinPartitions("path", "start").mapInArrow(_chained, f"{fields}, state int")
    return ranges.repartition(n, "path", "start").mapInArrow(_rows, _EVENTS)


def read_events(spark: SparkSession, root: str, range_bytes: int | None = None) -> DataFrame:
    """Rows of all annotation files below ``root``, or of the one file it names."""
    existing(spark, root, FileNotFoundError, "no annotation files at")
    return read_paths(list_files(spark, root, f"*{EVENTS_SUFFIX}"), range_bytes)


def read_seizure_intervals(
    spark: SparkSession, root: str, missing_bounds: str = "open", ordered: bool = False
) -> DataFrame:
    """Seizure intervals of every annotation file, keyed by its path.

    ``ordered``: by path and onset, equal onsets as the file has them.
    """
    events = read_events(spark, root)
    if not ordered:
        return extract_seizure_intervals(events, ["path"], missing_bounds)
    return sort_intervals(extract_seizure_intervals(events, ["path", "position"], missing_bounds)).drop("position")
