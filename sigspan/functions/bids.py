"""File-name expressions for recordings that follow the BIDS naming scheme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspan.errors import DatasetBuilderError, fail

EEG_SUFFIX = "_eeg.edf"
EVENTS_SUFFIX = "_events.tsv"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def plain_path(uri: Column, encoded: bool = True) -> Column:
    """The one form of a path: as stored, and without the scheme if it is local.

    ``_metadata.file_path`` is percent-encoded on every file system, listed
    paths are not.
    """
    text = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))) if encoded else uri
    return F.regexp_replace(text, r"^file:/+", "/")


def name_parts(path: Column) -> Column:
    return F.split(stem(path), "_")


def entity(parts: Column, key: str) -> Column:
    """Value of the last ``key-value`` part, or null."""
    tag = f"{key}-"
    mine = F.filter(parts, lambda p: p.startswith(tag))
    return F.substr(F.try_element_at(mine, F.lit(-1)), F.lit(len(tag) + 1))


def suffix(parts: Column) -> Column:
    """Last part without a dash, or null."""
    return F.try_element_at(F.filter(parts, lambda p: ~p.contains("-")), F.lit(-1))


def filename_fields(parts: Column) -> list[Column]:
    """The manifest's name-derived columns."""
    return [
        F.concat(F.lit("sub-"), entity(parts, "sub")).alias("subject"),
        F.concat(F.lit("ses-"), entity(parts, "ses")).alias("session"),
        entity(parts, "task").alias("task"),
        entity(parts, "run").alias("run"),
    ]


def entities(path: Column) -> Column:
    """Every ``key-value`` part as a map; dash-less parts go under ``suffix``.

    The last of repeated keys wins, so earlier ones are removed before the map
    is built.
    """
    pairs = F.transform(
        name_parts(path),
        lambda p: F.when(
            p.contains("-"),
            F.struct(
                F.substring_index(p, "-", 1).alias("key"),
                F.substr(p, F.locate("-", p) + 1).alias("value"),
            ),
        ).otherwise(F.struct(F.lit("suffix").alias("key"), p.alias("value"))),
    )
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"]
        ),
    )
    return F.map_from_entries(last)


def events_path(path: Column) -> Column:
    """Annotation file that belongs to a recording."""
    name = basename(path)
    renamed = F.replace(name, F.lit(EEG_SUFFIX), F.lit(EVENTS_SUFFIX))
    folder = F.substr(path, F.lit(1), F.length(path) - F.length(name))
    return F.when(name.endswith(EEG_SUFFIX), F.concat(folder, renamed)).otherwise(
        fail(DatasetBuilderError, "Not the name of a recording: ", path)
    )
