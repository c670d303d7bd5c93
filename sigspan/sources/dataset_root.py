"""Obtaining and checking a dataset folder: checksums, unpacking, structure."""

from __future__ import annotations

import hashlib
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sigspan.session import shuffle_partitions
from sigspan.sources.manifest import list_files
from sigspan.sources.remote import create_file, open_file
from sigspan.sources.tables import path_exists

DESCRIPTION = "dataset_description.json"
PARTICIPANTS = "participants.tsv"
CHUNK_BYTES = 8 << 20


def _md5(path: str) -> str:
    digest = hashlib.md5()
    with open_file(path) as source:
        while chunk := source.read(CHUNK_BYTES):
            digest.update(chunk)
    return digest.hexdigest()


def file_checksums(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, md5) of matching files; files are streamed, never loaded whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(md5=[_md5(p) for p in batch["path"]])

    files = list_files(spark, root, pattern)
    return files.repartition(shuffle_partitions(spark), "path").mapInPandas(
        run, "path string, md5 string"
    )


def verify_checksum(spark: SparkSession, path: str, expected: str) -> None:
    folder, name = posixpath.split(path)
    found = file_checksums(spark, folder, name).first()
    if found is None:
        raise FileNotFoundError(path)
    if found["md5"] != expected:
        raise RuntimeError(f"Checksum mismatch: {found['md5']} instead of {expected}")


def _targets(names: list[str]) -> dict[str, str]:
    """Archive member to relative path; a single wrapping folder is dropped."""
    for name in names:
        parts = name.replace("\\", "/").split("/")
        if name.startswith("/") or ".." in parts or ":" in parts[0]:
            raise RuntimeError(f"Unsafe member name: {name}")
    tops = {name.split("/", 1)[0] for name in names}
    nested = DESCRIPTION not in names and len(tops) == 1 and f"{min(tops)}/{DESCRIPTION}" in names
    files = [n for n in names if not n.endswith("/")]
    return {n: n.split("/", 1)[1] if nested else n for n in files}


def extract_archive(spark: SparkSession, archive: str, folder: str) -> int:
    """Unpack a ZIP with one task per share of its members; return their number."""
    with open_file(archive) as source, zipfile.ZipFile(source) as members:
        targets = _targets(members.namelist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with open_file(archive) as source, zipfile.ZipFile(source) as members:
                for member, target in zip(batch["member"], batch["target"]):
                    with members.open(member) as data, create_file(f"{folder}/{target}") as out:
                        while chunk := data.read(CHUNK_BYTES):
                            out.write(chunk)
            yield batch[["target"]]

    rows = spark.createDataFrame(list(targets.items()), "member string, target string")
    copied = rows.repartition(shuffle_partitions(spark), "member").mapInPandas(run, "target string")
    return copied.count()


def validate_root(spark: SparkSession, root: str) -> list[str]:
    """The required files and at least one subject; returns the subject folders."""
    for name in (DESCRIPTION, PARTICIPANTS):
        if not path_exists(spark, f"{root}/{name}"):
            raise RuntimeError(f"Missing {name} in {root}")
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sub-*")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in system.globStatus(pattern) if s.isDirectory()]
    if not found:
        raise RuntimeError(f"No sub-* directories found in {root}")
    return sorted(found)
