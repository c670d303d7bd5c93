"""Per-channel features of multichannel signals, as wide rows.

A row holds all channels of a segment, so its features are computed in place:
no explode, no pivot, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sigspan.errors import FeatureDatasetBuilderError, FeatureExtractionError, fail
from sigspan.functions.spectral import (
    STANDARD_BANDS,
    band_powers,
    by_length,
    check_bands,
    time_features,
)
from sigspan.functions.timedomain import TIME_FEATURES


def default_channel_names(n_channels: int) -> list[str]:
    """``ch_01``, ``ch_02``, ...; three digits from 100 on."""
    return [f"ch_{i:02d}" for i in range(1, n_channels + 1)]


def channel_name(number: Column) -> Column:
    """The default name of a channel number, as a column."""
    return F.format_string("ch_%02d", number)


def check_channel_names(names: Sequence[str]) -> list[str]:
    if not names:
        raise FeatureExtractionError("A signal needs at least one channel.")
    if len(set(names)) != len(names):
        raise FeatureExtractionError("Channel names must be distinct.")
    return list(names)


def feature_names(
    names: Sequence[str], time: bool = True, frequency: bool = True
) -> list[str]:
    """Column order: time features of every channel, then the band powers."""
    out: list[str] = []
    for wanted, stems in ((time, TIME_FEATURES), (frequency, STANDARD_BANDS)):
        if wanted:
            out += [f"{stem}_{name}" for name in names for stem in stems]
    return out


def feature_block(
    signals: np.ndarray, sfreq: float | None, relative: bool, time: bool = True
) -> np.ndarray:
    """Features of (..., channels, samples), flattened in ``feature_names`` order."""
    parts = []
    if time:
        parts.append(time_features(signals))
    if sfreq is not None:
        bands = list(STANDARD_BANDS.values())
        parts.append(band_powers(signals, check_bands(sfreq, bands), bands, relative))
    return np.concatenate([p.reshape(*p.shape[:-2], -1) for p in parts], axis=-1)


def _extract(
    df: DataFrame,
    signal: str,
    channel_names: Sequence[str] | None,
    max_channels: int | None,
    sfreq: float | None,
    relative: bool,
    time: bool,
) -> DataFrame:
    kind = df.schema[signal].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)):
        raise FeatureExtractionError(
            f"A multichannel signal is a 2D array of channels and samples, not {kind.simpleString()}"
        )
    if channel_names is None:
        if max_channels is None:
            raise FeatureExtractionError("Give 'channel_names' or 'max_channels'.")
        names, ragged = default_channel_names(max_channels), True
    else:
        names, ragged = list(channel_names), False
    names = check_channel_names(names)
    if sfreq is not None:
        sfreq = check_bands(sfreq, list(STANDARD_BANDS.values()))
    columns = feature_names(names, time, sfreq is not None)
    per_channel = len(columns) // len(names)
    # Position of every (channel, feature) in the output row.
    by_name = {name: i for i, name in enumerate(columns)}
    layout = np.array([[by_name[c] for c in feature_names([n], time, sfreq is not None)] for n in names])

    @F.arrow_udf("array<double>")
    def extract(column: pa.Array) -> pa.Array:
        """One list of features per row; absent channels stay null."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        counts = np.diff(column.offsets.to_numpy())
        if column.null_count or (counts == 0).any():
            raise FeatureExtractionError("A signal needs at least one channel.")
        if (counts > len(names)).any() or (not ragged and (counts != len(names)).any()):
            raise FeatureExtractionError("A signal has as many channels as there are names.")
        channels = column.flatten()
        if channels.flatten().null_count:
            raise FeatureExtractionError("A signal has a missing sample.")
        sizes = np.diff(channels.offsets.to_numpy())
        if (sizes == 0).any():
            raise FeatureExtractionError("Every channel needs at least one sample.")
        row = np.repeat(np.arange(len(column)), counts)
        if (sizes != np.repeat(sizes[np.cumsum(counts) - counts], counts)).any():
            raise FeatureExtractionError("Channels of a signal must be equally long.")
        values = by_length(
            channels, per_channel, lambda x: feature_block(x[:, None, :], sfreq, relative, time)
        )
        target = layout[np.arange(row.size) - np.repeat(np.cumsum(counts) - counts, counts)]
        wide = np.zeros((len(column), len(columns)))
        absent = np.ones(wide.shape, dtype=bool)
        wide[row[:, None], target] = values
        absent[row[:, None], target] = False
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(column) + 1, dtype=np.int32) * len(columns)),
            pa.array(wide.ravel(), mask=absent.ravel()),
        )

    rest = [c for c in df.columns if c != signal]
    values = extract(F.col(signal)).alias("_features")
    return df.select(*rest, values).select(
        *rest, *[F.col("_features")[i].alias(name) for i, name in enumerate(columns)]
    )


def extract_time_domain_features(
    df: DataFrame,
    signal: str,
    channel_names: Sequence[str] | None = None,
    max_channels: int | None = None,
) -> DataFrame:
    """Replace a signal column by mean, std, rms and line length per channel."""
    return _extract(df, signal, channel_names, max_channels, None, False, True)


def extract_frequency_domain_features(
    df: DataFrame,
    signal: str,
    sfreq: float,
    channel_names: Sequence[str] | None = None,
    max_channels: int | None = None,
    relative: bool = False,
) -> DataFrame:
    """Replace a signal column by the standard band powers per channel."""
    return _extract(df, signal, channel_names, max_channels, sfreq, relative, False)


def extract_all_features(
    df: DataFrame,
    signal: str,
    sfreq: float,
    channel_names: Sequence[str] | None = None,
    max_channels: int | None = None,
    relative: bool = False,
) -> DataFrame:
    """Both families. Without names, channels are numbered and rows may have
    fewer than ``max_channels``; their missing columns are null."""
    return _extract(df, signal, channel_names, max_channels, sfreq, relative, True)


def crop_samples(samples: Column, start_sec: Column, end_sec: Column, sfreq: Column) -> Column:
    """Samples of [start, end) of one channel; bounds round half to even.

    The end is clipped to the recording, as when reading past its last sample.
    """
    first = F.rint(start_sec * sfreq).cast("int")
    last = F.rint(end_sec * sfreq).cast("int")
    bad = (end_sec <= start_sec) | (last <= first) | (first >= F.size(samples))
    length = F.when(
        bad,
        fail(FeatureDatasetBuilderError, "No samples between the bounds ", start_sec, " to ", end_sec),
    ).otherwise(last - first)
    return F.slice(samples, first + 1, length)
