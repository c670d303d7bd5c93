"""Files with names of their own, written by many tasks and published at once.

A Spark data source writer: every task attempt writes its pieces into a folder of its
own below a staging folder and reports that folder; the commit notes the reported
folders, so pieces of failed or repeated attempts don't count, and an abort removes
the staging folder. A second job then puts the pieces of each file together in their
order, one task a file, as streams of bounded memory, and the result is published by
renaming one folder. Until then nothing can be seen under the final name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sigspan.session import shuffle_partitions
from sigspan.sources.remote import create_file, file_system, open_file

COPY_BYTES = 4 << 20
_COMMITTED = "_committed.json"
#: columns that say where rows go: the file's name, and the place of the task's rows among all
FILE, RANGE = "_file", "_range"


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str | None


class _Pieces(DataSourceArrowWriter):
    def __init__(self, options, schema) -> None:
        self.staging, self.format = options["path"].rstrip("/"), options.get("pieces", "parquet")
        self.columns = [f.name for f in schema.fields if f.name not in (FILE, RANGE)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Attempt:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        name, piece, stream, used = None, None, None, False
        try:
            for batch in iterator:
                files, ranges = (batch.column(c).to_pylist() for c in (FILE, RANGE))
                rows, at = batch.select(self.columns), 0
                while at < len(files):
                    end = at + 1
                    while end < len(files) and files[end] == files[at]:
                        end += 1
                    if files[at] != name:
                        if stream:
                            _close(piece, stream)
                        name, used = files[at], True
                        stream = create_file(f"{folder}/{name}.{ranges[at]:08d}")
                        piece = pq.ParquetWriter(stream, rows.schema) if self.format == "parquet" else None
                    part = rows.slice(at, end - at)
                    if piece:
                        piece.write_batch(part)
                    else:
                        stream.write(csv_lines(part))
                    at = end
            if stream:
                _close(piece, stream)
        except BaseException:
            if stream and not stream.closed:
                stream.close()
            remove(folder)
            raise
        return _Attempt(folder if used else None)

    def commit(self, messages) -> None:
        folders = sorted(m.folder for m in messages if m and m.folder)
        with create_file(f"{self.staging}/{_COMMITTED}") as out:
            out.write(json.dumps(folders).encode())

    def abort(self, messages) -> None:
        remove(self.staging)


def _close(piece, stream) -> None:
    if piece:
        piece.close()
    if not stream.closed:
        stream.close()


class StagedPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sigspan_pieces"

    def writer(self, schema, overwrite: bool):
        return _Pieces(self.options, schema)


def csv_lines(batch: pa.RecordBatch, header: bool = False) -> bytes:
    """Rows as pandas writes them: shortest floats, True and False, empty for missing."""
    frame = pa.Table.from_batches([batch]).to_pandas(integer_object_nulls=True)
    return frame.to_csv(index=False, header=header, lineterminator="\n").encode("utf-8")


def remove(path: str) -> None:
    system, inner = file_system(path)
    if system.get_file_info(inner).type == pafs.FileType.Directory:
        system.delete_dir(inner)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, range, piece) of every piece in committed folders."""
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            system, inner = file_system(folder)
            found = [f.base_name for f in system.get_file_info(pafs.FileSelector(inner)) if f.is_file]
            names, ranges = zip(*(f.rsplit(".", 1) for f in found)) if found else ((), ())
            pieces = [f"{folder}/{f}" for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ranges, pa.string()), pa.array(pieces, pa.string())], ["file", "range", "piece"])


def _joined(target: str, kind: str, head: bytes):
    """Tasks of the second job: each file's pieces come one after the other, in their order."""

    def finish(name: str, pieces: list[str]) -> None:
        path = f"{target}/{name}"
        if len(pieces) == 1 and not head:
            system, inner = file_system(pieces[0])
            final = file_system(path)[1]
            if system.get_file_info(inner).type == pafs.FileType.File:  # else an earlier attempt has moved it
                system.create_dir(final.rsplit("/", 1)[0], recursive=True)
                system.move(inner, final)
            return
        with create_file(path) as out:
            if kind == "parquet":
                writer = None
                for piece in pieces:
                    source = pq.ParquetFile(open_file(piece))
                    for i in range(source.num_row_groups):
                        group = source.read_row_group(i)
                        writer = writer or pq.ParquetWriter(out, group.schema)
                        writer.write_table(group)
                writer.close()
                return
            out.write(head)
            for piece in pieces:
                with open_file(piece) as source:
                    while data := source.read(COPY_BYTES):
                        out.write(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pieces = None, []
        for batch in batches:
            for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()):
                if file != name and name is not None:
                    finish(name, pieces)
                if file != name:
                    name, pieces = file, []
                pieces.append(piece)
        if name is not None:
            finish(name, pieces)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["file"])

    return run


def write_files(rows: DataFrame, folder: str, pieces: str = "parquet", head: bytes = b"") -> str:
    """The rows as files of a new folder, each named by its rows' `_file`; returns the folder.

    rows are sorted by `_file` within partitions; `_range` orders the pieces of a file
    that several partitions hold. ``head`` begins every file.
    """
    spark = rows.sparkSession
    spark.dataSource.register(StagedPieces)
    folder = folder.rstrip("/")
    parent, name = folder.rsplit("/", 1)
    staging = f"{parent}/_{name}-{uuid.uuid4().hex[:12]}"
    try:
        rows.write.format("sigspan_pieces").option("pieces", pieces).mode("append").save(f"{staging}/pieces")
        with open_file(f"{staging}/pieces/{_COMMITTED}") as source:
            folders = json.loads(source.read())  # one for each task
        n = shuffle_partitions(spark)
        listed = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(n)
        listed = listed.mapInArrow(_piece_rows, "file string, range string, piece string")
        ordered = listed.repartition(n, "file").sortWithinPartitions("file", "range")
        done = ordered.mapInArrow(_joined(f"{staging}/files", pieces, head), "file string")
        done.write.format("noop").mode("overwrite").save()
        system, final = file_system(folder)
        made = file_system(f"{staging}/files")[1]
        system.create_dir(made, recursive=True)  # no rows give an empty folder
        if system.get_file_info(final).type == pafs.FileType.Directory:
            system.delete_dir(final)
        elif system.get_file_info(final).type == pafs.FileType.File:
            system.delete_file(final)
        system.move(made, final)
    finally:
        remove(staging)
    return folder
